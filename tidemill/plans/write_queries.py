"""DML as tables after the statement, constraints, text files, and the streaming extension."""

from pyspark.sql import functions as F

from tidemill.operators import dml
from tidemill.plans.registry import query
from tidemill.sources import scratch, tables
from tidemill.streaming import events


@query("SELECT s_suppkey, s_acctbal FROM supplier UNION ALL SELECT c_custkey + 1000000, c_acctbal FROM customer WHERE c_nationkey = 3")
def dml_insert_select(t):
    new = t.customer.filter("c_nationkey = 3").select((F.col("c_custkey") + 1000000).alias("s_suppkey"), F.col("c_acctbal").alias("s_acctbal"))
    return dml.insert(t.supplier.select("s_suppkey", "s_acctbal"), new)


@query("SELECT 'small' AS target, p_partkey FROM part WHERE p_size < 10 UNION ALL SELECT 'large', p_partkey FROM part WHERE p_size > 40")
def dml_insert_all(t):
    empty = t.part.select("p_partkey").limit(0)
    out = dml.insert_all(t.part, {"small": (empty, F.col("p_size") < 10, {"p_partkey": F.col("p_partkey")}), "large": (empty, F.col("p_size") > 40, {"p_partkey": F.col("p_partkey")})})
    return out["small"].select(F.lit("small").alias("target"), "p_partkey").unionAll(out["large"].select(F.lit("large").alias("target"), "p_partkey"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice FROM part")
def dml_update(t):
    return dml.update(t.part.select("p_partkey", "p_size", "p_retailprice"), {"p_retailprice": F.col("p_retailprice") * 2}, F.col("p_size") > 40).select("p_partkey", "p_retailprice")


@query("SELECT c_custkey, COALESCE((SELECT count(*) FROM orders WHERE o_custkey = c_custkey HAVING count(*) > 0), c_nationkey) AS c_nationkey FROM customer")
def dml_update_from(t):
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    table = t.customer.select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"))
    return dml.update_from(table, counts, ["c_custkey"], {"c_nationkey": F.col("s_n")})


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 50000)")
def dml_delete(t):
    return dml.delete(t.orders, (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 50000)).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def dml_delete_using(t):
    return dml.delete_using(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


@query("""SELECT COALESCE(s_suppkey, k) AS s_suppkey, CASE WHEN k IS NOT NULL AND s_suppkey IS NOT NULL THEN s_acctbal + b WHEN s_suppkey IS NULL THEN b ELSE s_acctbal END AS s_acctbal
FROM supplier FULL JOIN (SELECT c_custkey AS k, c_acctbal AS b FROM customer WHERE c_mktsegment <> 'BUILDING') c ON s_suppkey = k WHERE NOT (k IS NOT NULL AND s_suppkey IS NOT NULL AND b < -500)""")
def dml_merge(t):
    source = t.customer.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_acctbal").alias("b"))
    return dml.merge(t.supplier.select("s_suppkey", "s_acctbal"), source, ["s_suppkey"], matched={"s_acctbal": F.col("s_acctbal") + F.col("s_b")}, delete_when=F.col("s_b") < -500, not_matched={"s_suppkey": F.col("s_s_suppkey"), "s_acctbal": F.col("s_b")})


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 5 UNION ALL SELECT r_regionkey, r_name FROM region")
def dml_replace(t):
    return dml.replace_into(t.nation.select("n_nationkey", "n_name"), t.region.select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name")), ["n_nationkey"])


@query("""SELECT 'not null o_custkey' AS violation, count(*) FILTER (o_custkey IS NULL) AS cases FROM orders UNION ALL SELECT 'check', count(*) FILTER (NOT (o_totalprice > 1000)) FROM orders
UNION ALL SELECT 'unique', count(*) FROM (SELECT o_custkey, o_orderstatus FROM orders GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'foreign key', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def constraints(t):
    return tables.violations(t.orders, unique=["o_custkey", "o_orderstatus"], not_null=["o_custkey"], check=F.col("o_totalprice") > 1000, foreign=("o_custkey", t.customer, "c_custkey"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def text_dump_and_load(t):
    """DUMP and an external table over it. The files go to the cluster's shared folder where one is named."""
    where = scratch.path(t.spark, "dump")
    tables.dump(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), where)
    return tables.external(t.spark, where, "s_suppkey bigint, s_name string, s_acctbal double", enclosed='"')


@query("SELECT count(*) AS n, count(*) AS keys FROM orders")
def sequence_keys(t):
    return tables.with_sequence(t.orders, "id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("keys"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def events_tumbling(t):
    """The streaming extension's aggregation, over the table as a batch."""
    return events.windowed_counts(t.events).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def events_sessions(t):
    """Sessions end after 30 minutes without an event; against gaps and islands."""
    return events.sessions(t.events).select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")
