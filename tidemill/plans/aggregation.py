"""Aggregation, grouping sets, PIVOT, UNPIVOT, ordered-set and hypothetical-set aggregates."""

from pyspark.sql import functions as F

from tidemill.functions import aggregates
from tidemill.operators import grouping
from tidemill.plans.registry import query


@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem")
def agg_scalar(t):
    return t.lineitem.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.avg("l_discount"), 6).alias("d"), F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def agg_group(t):
    e = F.expr
    return t.lineitem.filter("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(e("l_extendedprice * (1 - l_discount)")), 2).alias("sum_disc"),
        F.round(F.sum(e("l_extendedprice * (1 - l_discount) * (1 + l_tax)")), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def agg_having(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 12")


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines, round(avg(DISTINCT l_discount), 6) AS d FROM lineitem GROUP BY 1")
def agg_distinct(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.sum_distinct("l_linenumber").alias("lines"), F.round(F.expr("avg(DISTINCT l_discount)"), 6).alias("d"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def select_distinct(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


_STATS = "round(stddev_samp({0}), 4) AS s1, round(stddev_pop({0}), 4) AS s2, round(var_samp({0}), 2) AS v1, round(var_pop({0}), 2) AS v2, round(covar_pop({0}, {1}), 4) AS c1, round(covar_samp({0}, {1}), 4) AS c2, round(corr({0}, {1}), 6) AS r, round(median({0}), 4) AS m"


@query(f"SELECT l_returnflag, {_STATS.format('l_quantity', 'l_discount')} FROM lineitem GROUP BY 1")
def agg_statistics(t):
    a, b = "l_quantity", "l_discount"
    r = lambda c, n: F.round(c, n)
    return t.lineitem.groupBy("l_returnflag").agg(r(F.stddev_samp(a), 4).alias("s1"), r(F.stddev_pop(a), 4).alias("s2"), r(F.var_samp(a), 2).alias("v1"), r(F.var_pop(a), 2).alias("v2"), r(F.covar_pop(a, b), 4).alias("c1"), r(F.covar_samp(a, b), 4).alias("c2"), r(F.corr(a, b), 6).alias("r"), r(F.median(a), 4).alias("m"))


@query()
def agg_approx_distinct(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey").alias("n"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, CAST(grouping(c_mktsegment) AS INT) AS g1, CAST(grouping(c_nationkey) AS INT) AS g2 FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def cube(t):
    return t.customer.cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.grouping("c_mktsegment").cast("int").alias("g1"), F.grouping("c_nationkey").cast("int").alias("g2"))


@query("SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS gid FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(t):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().alias("gid"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
def grouping_sets(t):
    return grouping.grouping_sets(t.lineitem, [("l_returnflag", "l_linestatus"), ("l_linenumber",), ()], F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus), ROLLUP (l_linenumber)")
def grouping_sets_product(t):
    sets = grouping.cartesian_sets(grouping.cube_sets("l_returnflag", "l_linestatus"), grouping.rollup_sets("l_linenumber"))
    return grouping.grouping_sets(t.lineitem, sets, F.count("*").alias("n"))


@query("""SELECT l_linenumber, count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS af_n, round(sum(l_quantity) FILTER (l_returnflag = 'A' AND l_linestatus = 'F'), 2) AS af_q,
count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS no_n, round(sum(l_quantity) FILTER (l_returnflag = 'N' AND l_linestatus = 'O'), 2) AS no_q FROM lineitem GROUP BY 1""")
def pivot_two_columns(t):
    measures = {"n": F.count_if, "q": lambda hit: F.round(F.sum(F.when(hit, F.col("l_quantity"))), 2)}
    return grouping.pivot(t.lineitem, ["l_linenumber"], ["l_returnflag", "l_linestatus"], {"af": ("A", "F"), "no": ("N", "O")}, measures)


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'O') AS open_c, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') AS done_c FROM orders GROUP BY 1")
def pivot_count_distinct(t):
    return grouping.pivot(t.orders, ["o_orderpriority"], ["o_orderstatus"], {"open": ("O",), "done": ("F",)}, {"c": lambda hit: F.count_distinct(F.when(hit, F.col("o_custkey")))})


@query("""SELECT l_orderkey, l_linenumber, 'net' AS kind, l_extendedprice AS amount, l_discount AS rate FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_quantity, l_tax FROM lineitem""")
def unpivot_measures(t):
    return grouping.unpivot(t.lineitem, ["l_orderkey", "l_linenumber"], "kind", ["amount", "rate"], {"net": ("l_extendedprice", "l_discount"), "tax": ("l_quantity", "l_tax")})


@query("""SELECT l_orderkey, l_linenumber, 'net' AS kind, l_extendedprice AS amount, l_discount AS rate FROM lineitem WHERE l_extendedprice IS NOT NULL OR l_discount IS NOT NULL
UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_quantity, l_tax FROM lineitem WHERE l_quantity IS NOT NULL OR l_tax IS NOT NULL""")
def unpivot_measures_whole(t):
    """As unpivot_measures, with the rule for nulls in the SQL."""
    return grouping.unpivot(t.lineitem, ["l_orderkey", "l_linenumber"], "kind", ["amount", "rate"], {"net": ("l_extendedprice", "l_discount"), "tax": ("l_quantity", "l_tax")})


@query("""SELECT doc_id, 'quality' AS k, quality AS v FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'toxic', toxic FROM documents LEFT JOIN labels USING (doc_id)""")
def unpivot_include_nulls(t):
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return grouping.unpivot(rows, ["doc_id"], "k", ["v"], {"quality": ("quality",), "toxic": ("toxic",)}, include_nulls=True)


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, string_agg(CAST(turn AS VARCHAR), '-' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id")
def agg_listagg(t):
    return t.conversations.groupBy("conv_id").agg(aggregates.listagg(F.col("role"), ",", F.col("turn")).alias("roles"), aggregates.listagg(F.col("turn"), "-", F.col("turn")).alias("turns"))


@query("SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM (SELECT DISTINCT n_regionkey, n_name FROM nation) GROUP BY 1")
def agg_group_concat_distinct(t):
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ";").alias("names"))


@query("SELECT n_regionkey, len(list(n_nationkey)) AS n, CAST(list_sum(list(n_nationkey)) AS BIGINT) AS total FROM nation GROUP BY 1")
def agg_array(t):
    g = t.nation.groupBy("n_regionkey").agg(aggregates.array_agg(F.col("n_nationkey")).alias("a"))
    return g.select("n_regionkey", F.size("a").cast("bigint").alias("n"), F.aggregate("a", F.lit(0).cast("bigint"), lambda x, y: x + y).alias("total"))


@query("""SELECT o_orderstatus, 1 + count(*) FILTER (o_totalprice < 100000) AS r, 1 + count(DISTINCT CASE WHEN o_totalprice < 100000 THEN o_totalprice END) AS dr,
round((1 + count(*) FILTER (o_totalprice <= 100000)) / (1.0 + count(*)), 6) AS cd FROM orders GROUP BY 1""")
def agg_hypothetical(t):
    k, c = F.col("o_totalprice"), F.lit(100000.0)
    return t.orders.groupBy("o_orderstatus").agg(aggregates.rank_within(k, c).alias("r"), aggregates.dense_rank_within(k, c).alias("dr"), F.round(aggregates.cume_dist_within(k, c), 6).alias("cd"))


@query("""WITH q AS (SELECT source, quality, doc_id FROM documents LEFT JOIN labels USING (doc_id)), r AS (SELECT *, CASE WHEN quality IS NULL THEN 2 ELSE 1 - quality END AS down FROM q)
SELECT source, 1 + count(*) FILTER (down < 0 OR (quality IS NULL) OR (quality = 1 AND doc_id < 50)) AS r, 1 + count(DISTINCT (quality, doc_id)) FILTER (quality IS NULL OR (quality = 1 AND doc_id < 50)) AS dr FROM r GROUP BY 1""")
def agg_hypothetical_keys(t):
    """Two keys, the first descending with nulls: RANK(1, 50) WITHIN GROUP (ORDER BY quality DESC, doc_id)."""
    rows = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    keys, constants, up = [F.col("quality"), F.col("doc_id")], [F.lit(1), F.lit(50)], [False, True]
    return rows.groupBy("source").agg(aggregates.rank_within(keys, constants, up).alias("r"), aggregates.dense_rank_within(keys, constants, up).alias("dr"))


@query("SELECT c_mktsegment, round(sum(s), 2) AS total FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) ON c_custkey = o_custkey GROUP BY 1")
def agg_pushed_below_join(t):
    """Orders are summed by customer before the join: the join then sees one row a customer."""
    per = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    return t.customer.join(per, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").agg(F.round(F.sum("s"), 2).alias("total"))
