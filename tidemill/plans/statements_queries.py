"""Statements and sources: DML with general conditions, tables and views, loads, partitions, hints, result types, sequences."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.operators import dml, joins, limits, sets
from tidemill.plans.registry import query
from tidemill.sources import scratch, statements, tables


@query("""WITH s AS (SELECT r_regionkey AS a, r_regionkey + 100 AS b, r_name FROM region) SELECT n_nationkey, COALESCE(r_name, n_name) AS n_name FROM nation LEFT JOIN s ON n_nationkey = a OR n_nationkey = b
UNION ALL SELECT a + 1000, r_name FROM s WHERE a NOT IN (SELECT n_nationkey FROM nation) AND b NOT IN (SELECT n_nationkey FROM nation)""")
def dml_merge_or(t):
    """MERGE ON a OR b: each side of the OR is a join of its own."""
    source = t.region.select(F.col("r_regionkey").alias("a"), (F.col("r_regionkey") + 100).alias("b"), "r_name")
    on = [F.col("n_nationkey") == F.col("s_a"), F.col("n_nationkey") == F.col("s_b")]
    return dml.merge(t.nation.select("n_nationkey", "n_name"), source, on, matched={"n_name": F.col("s_r_name")}, not_matched={"n_nationkey": F.col("s_a") + 1000, "n_name": F.col("s_r_name")})


@query("SELECT s_suppkey, s_acctbal + COALESCE(b, 0) AS s_acctbal FROM supplier LEFT JOIN (SELECT c_custkey AS k, c_acctbal AS b FROM customer) c ON k = s_suppkey UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def dml_upsert(t):
    """INSERT ... ON DUPLICATE KEY UPDATE."""
    rows = t.customer.select(F.col("c_custkey").alias("s_suppkey"), F.col("c_acctbal").alias("s_acctbal"))
    return dml.upsert(t.supplier.select("s_suppkey", "s_acctbal"), rows, ["s_suppkey"], {"s_acctbal": F.col("s_acctbal") + F.col("s_s_acctbal")})


@query("SELECT s_suppkey, s_acctbal FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def dml_insert_ignore(t):
    """New rows that share a key: the first by its value comes in."""
    rows = t.customer.select(F.col("c_custkey").alias("s_suppkey"), F.col("c_acctbal").alias("s_acctbal"))
    return dml.insert_ignore(t.supplier.select("s_suppkey", "s_acctbal"), rows.unionAll(rows.withColumn("s_acctbal", F.col("s_acctbal") + 1)), ["s_suppkey"], F.col("s_acctbal"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer) UNION ALL SELECT c_nationkey, max(c_name) FROM customer GROUP BY 1")
def dml_replace_several(t):
    """REPLACE with many new rows for a key: the last one stays."""
    rows = t.customer.select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_name").alias("n_name"))
    return dml.replace_into(t.nation.select("n_nationkey", "n_name"), rows, ["n_nationkey"], F.col("n_name"))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def dml_delete_using_some(t):
    keys = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("s_suppkey"))
    return dml.delete_using(t.supplier.select("s_suppkey"), keys, ["s_suppkey"])


@query("SELECT year(l_shipdate) AS y, count(*) AS n, sum(l_linenumber)::BIGINT AS s FROM lineitem WHERE year(l_shipdate) BETWEEN 1995 AND 1996 GROUP BY 1")
def partition_scan(t):
    """A table written by partitions of the year; the read opens those that the filter leaves."""
    rows = scratch.materialised(t.lineitem.select(F.year("l_shipdate").alias("y"), "l_linenumber"), "by-year", ["y"])
    return rows.filter(F.col("y").between(1995, 1996)).groupBy(F.col("y").cast("long").alias("y")).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def view_over_table(t):
    """A stored SELECT, then a query over the view; the view's name is this query's own."""
    name = f"positive_{uuid.uuid4().hex}"
    statements.create_view(t.customer.filter("c_acctbal > 0"), name)
    return t.spark.sql(f"SELECT c_mktsegment, count(*) AS n FROM {name} GROUP BY 1")


@query("SELECT a.o_custkey, round(a.total, 2) AS total FROM (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) a JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey WHERE total > (SELECT max(total) / 2 FROM (SELECT sum(o_totalprice) AS total FROM orders GROUP BY o_custkey))")
def cte_hint_materialize(t):
    """A CTE with the hint MATERIALIZE (or a derived table that is kept): evaluated once, used twice."""
    totals = scratch.materialised(t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")), "cte")
    top = totals.agg((F.max("total") / 2).alias("bar"))
    return totals.join(t.customer.filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey")).crossJoin(F.broadcast(top)).filter("total > bar").select("o_custkey", F.round("total", 2).alias("total"))


@query("SELECT o_orderstatus, count(*) AS n, round(min(o_totalprice), 2) AS low FROM orders GROUP BY 1")
def create_table_as(t):
    """CREATE TABLE AS SELECT, read by its name."""
    name = statements.create_table_as(t.orders.select("o_orderstatus", "o_totalprice"), "orders_copy")
    return t.spark.table(name).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.min("o_totalprice"), 2).alias("low"))


@query("SELECT 0 AS after_truncate, 3 AS after_insert, false AS after_drop")
def table_statements(t):
    """CREATE, INSERT, TRUNCATE and DROP TABLE."""
    name = statements.create_table_as(t.region.select("r_regionkey", "r_name"), "regions")
    statements.truncate_table(t.spark, name)
    empty = t.spark.table(name).count()
    t.region.filter("r_regionkey >= 2").select("r_regionkey", "r_name").write.insertInto(name)
    filled = t.spark.table(name).count()
    statements.drop_table(t.spark, name)
    return t.spark.range(1).select(F.lit(empty).alias("after_truncate"), F.lit(filled).alias("after_insert"), F.lit(t.spark.catalog.tableExists(name)).alias("after_drop"))


@query("SELECT 'n_regionkey' AS name, CAST(count(DISTINCT n_regionkey) AS BIGINT) AS distinct_values, CAST(count(*) FILTER (n_regionkey IS NULL) AS BIGINT) AS nulls, CAST(min(n_regionkey) AS VARCHAR) AS low, CAST(max(n_regionkey) AS VARCHAR) AS high FROM nation")
def analyze_table(t):
    """ANALYZE: the statistics that the optimizer has afterwards."""
    name = statements.create_table_as(t.nation, "nations")
    return statements.column_statistics(t.spark, name, "n_regionkey").withColumnRenamed("column", "name")


@query("SELECT 1 AS plans, true AS pushed")
def explain_plan(t):
    """EXPLAIN: the plan's text, here whether it pushes its filter."""
    text = statements.explain(t.orders.filter("o_orderkey = 7"))
    return t.spark.createDataFrame([(text,)], "plan string").agg(F.count("*").cast("int").alias("plans"), F.bool_and(F.contains("plan", F.lit("EqualTo(o_orderkey,7)"))).alias("pushed"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey <= 5")
def load_data(t):
    """LOAD DATA: two text files into one table."""
    rows = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    into, schema = scratch.path(t.spark, "loaded"), "s_suppkey bigint, s_name string, s_acctbal double"
    for part in (rows, rows.filter("s_suppkey <= 5")):
        where = scratch.path(t.spark, "text")
        tables.dump(part, where, terminated="|")
        tables.load_data(t.spark, where, schema, into, terminated="|", enclosed='"')
    return t.spark.read.schema(schema).parquet(into)


@query("SELECT o_orderkey, 100 + 5 * (row_number() OVER (ORDER BY o_orderkey) - 1) AS id, 100 + 5 * ((SELECT count(*) FROM orders) - 1) AS currval FROM orders")
def sequence_in_order(t):
    """NEXTVAL from 100 by 5 in an order, without gaps, and CURRVAL afterwards."""
    rows = tables.numbered(t.orders, "id", ["o_orderkey"], start=100, step=5)
    last = rows.agg(F.max("id").alias("currval"))
    return rows.crossJoin(F.broadcast(last)).select("o_orderkey", "id", "currval")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS keys, true AS steps FROM orders")
def sequence_cached(t):
    """A cached sequence: every partition takes runs of `cache` numbers; all values are start plus a multiple of step."""
    rows = tables.with_sequence(t.orders, "id", start=10, step=3)
    return rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("keys"), F.bool_and((F.col("id") - 10) % 3 == 0).alias("steps"))


@query("SELECT CAST(sum(n) AS BIGINT) AS n, true AS whole FROM (SELECT count(*) AS n FROM orders)")
def parallel_scan(t):
    """Ranges of a key, and the rows of each: together they are the table."""
    ranges = tables.parallel_ranges(t.orders, "o_orderkey", 4)
    parts = [tables.range_rows(t.orders, "o_orderkey", low, high).agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.col("o_orderkey") >= (low if low is not None else 0)), F.lit(True)).alias("inside")) for low, high in ranges]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.agg(F.sum("n").alias("n"), F.bool_and("inside").alias("whole"))


@query("SELECT c_custkey FROM customer WHERE (c_nationkey, c_mktsegment) IN (SELECT s_nationkey, CASE WHEN s_acctbal > 0 THEN 'BUILDING' ELSE 'MACHINERY' END FROM supplier)")
def predicates_in_tuples(t):
    pairs = t.supplier.select("s_nationkey", F.when(F.col("s_acctbal") > 0, "BUILDING").otherwise("MACHINERY").alias("segment"))
    return joins.in_tuples(t.customer, ["c_nationkey", "c_mktsegment"], pairs, ["s_nationkey", "segment"]).select("c_custkey")


@query("SELECT r_regionkey FROM region WHERE r_regionkey <> ALL (SELECT n_regionkey FROM nation WHERE n_nationkey < 3) UNION ALL SELECT r_regionkey + 100 FROM region WHERE r_regionkey = ALL (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)")
def compare_all_equal(t):
    different = joins.compare_all(t.region, "r_regionkey", "<>", t.nation.filter("n_nationkey < 3"), "n_regionkey").select("r_regionkey")
    same = joins.compare_all(t.region, "r_regionkey", "=", t.nation.filter("n_nationkey = 3"), "n_regionkey").select((F.col("r_regionkey") + 100).alias("r_regionkey"))
    return different.unionAll(same)


@query("SELECT p_partkey, low FROM part JOIN (SELECT s_suppkey * 40 AS low, s_suppkey * 40 + 55 AS high FROM supplier) s ON p_partkey BETWEEN low AND high")
def join_range(t):
    """A join on a range only: equal cells of the range first."""
    spans = t.supplier.select((F.col("s_suppkey") * 40).alias("low"), (F.col("s_suppkey") * 40 + 55).alias("high"))
    return joins.within(t.part, "p_partkey", spans, "low", "high", 60).select("p_partkey", "low")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 20")
def join_merge_left_range(t):
    """MERGE_LEFT with a range key behind the equal one."""
    on = (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_totalprice") > F.col("c_acctbal") * 20)
    return t.customer.join(joins.hinted(t.orders, "USE_MERGE"), on, "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal < 5000) FULL JOIN supplier ON c_custkey = s_suppkey")
def join_merge_full(t):
    return joins.equi(t.customer.filter("c_acctbal < 5000"), t.supplier, [("c_custkey", "s_suppkey")], "full", hint="USE_MERGE").select("c_custkey", "s_suppkey")


@query("SELECT n_nationkey, r_regionkey FROM nation FULL JOIN (SELECT r_regionkey + 22 AS r_regionkey FROM region) r ON n_nationkey > r_regionkey")
def join_theta_full_only(t):
    """FULL JOIN without an equality: the small side is broadcast, of a size that the catalogue bounds (five regions)."""
    r = t.region.select((F.col("r_regionkey") + 22).alias("r_regionkey"))
    return t.nation.join(r, F.expr("n_nationkey > r_regionkey"), "full").select("n_nationkey", "r_regionkey")


@query("SELECT n_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def join_hint_nl(t):
    return joins.equi(t.nation, t.region, [("n_regionkey", "r_regionkey")], hint="USE_NL").groupBy("n_name").agg(F.count("*").alias("n"))


@query("SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def join_hint_leading(t):
    """LEADING / ORDERED: region, then nation, then customer."""
    on = [F.expr("r_regionkey = n_regionkey"), F.expr("c_nationkey = n_nationkey")]
    return joins.in_order(t.region, t.nation, t.customer, on=on).groupBy("r_name").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def join_hint_unnest(t):
    """UNNEST with HASH_SJ and HASH_AJ: the subqueries as joins with the hash hint."""
    semi = joins.equi(t.customer, t.orders, [("c_custkey", "o_custkey")], "left_semi", hint="USE_HASH")
    return joins.not_in(semi, "c_nationkey", t.supplier.filter("s_acctbal < 0"), "s_nationkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_anti_some(t):
    return joins.equi(t.customer, t.orders.filter("o_orderstatus = 'P'"), [("c_custkey", "o_custkey")], "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def join_anti_null_aware_some(t):
    return joins.not_in(t.customer, "c_nationkey", t.supplier.filter("s_acctbal > 5000"), "s_nationkey").select("c_custkey")


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_minus_some(t):
    return t.nation.select(F.col("n_nationkey").alias("k")).subtract(t.supplier.filter("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT * FROM (SELECT n_name AS s FROM nation UNION SELECT r_name FROM region) ORDER BY s DESC LIMIT 9")
def set_sorted(t):
    """ORDER BY and LIMIT over a set operation."""
    return limits.ordered(t.nation.select(F.col("n_name").alias("s")).union(t.region.select("r_name")).distinct(), "s DESC").limit(9)


@query("""SELECT CAST(n_nationkey AS DOUBLE) AS a, CAST(n_nationkey AS DECIMAL(20, 2)) AS b, CAST(n_nationkey AS VARCHAR) AS c, TIMESTAMP '2024-01-02 00:00:00' AS d, CAST(n_nationkey AS BIGINT) AS e, 'x' AS f, CAST(NULL AS DOUBLE) AS g FROM nation
UNION ALL SELECT s_acctbal, CAST(1.25 AS DECIMAL(20, 2)), s_name, TIMESTAMP '2024-01-02 03:04:05', s_suppkey, NULL, s_acctbal FROM supplier""")
def set_result_types(t):
    """The result types of a set operation, by the dialect's lattice."""
    one = t.nation.select(F.col("n_nationkey").alias("a"), F.col("n_nationkey").alias("b"), F.col("n_nationkey").alias("c"), F.lit("2024-01-02").cast("date").alias("d"), F.col("n_nationkey").alias("e"), F.lit("x").alias("f"), F.lit(None).alias("g"))
    two = t.supplier.select("s_acctbal", F.lit("1.25").cast("decimal(4,2)"), "s_name", F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"), "s_suppkey", F.lit(None), "s_acctbal")
    out = sets.union_all(one, two)
    return out.withColumn("b", F.col("b").cast("decimal(20,2)"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(len(list)) AS BIGINT) AS size FROM (SELECT user_id, event_type, list(event_id ORDER BY event_id) AS list FROM events GROUP BY 1, 2) GROUP BY 1")
def agg_array_elements(t):
    from tidemill.functions import aggregates

    made = t.events.groupBy("user_id", "event_type").agg(F.array_sort(aggregates.array_agg(F.col("event_id"))).alias("list"))
    return made.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.size("list")).alias("size"))


@query("SELECT event_type, rank() OVER (ORDER BY total DESC) AS place FROM (SELECT event_type, sum(value) AS total FROM events GROUP BY 1)")
def window_over_aggregate(t):
    """A window over groups: what is left is one row a type."""
    totals = t.events.groupBy("event_type").agg(F.sum("value").alias("total"))
    return totals.select("event_type", F.rank().over(Window.orderBy(F.desc("total"))).cast("long").alias("place"))
