"""Scans, predicates, joins, sorts, limits and set operations."""

from pyspark.sql import functions as F

from tidemill.operators import joins, limits
from tidemill.plans.registry import query


@query("""SELECT c_mktsegment, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY c_mktsegment""")
def flagship_revenue(t):
    rows = t.lineitem.filter("l_shipdate >= timestamp_ntz'1995-01-01'").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24")
def scan_pushdown(t):
    return t.lineitem.filter("l_shipdate >= timestamp_ntz'1996-01-01' AND l_shipdate < timestamp_ntz'1996-04-01' AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey = 7 OR o_custkey = 11 OR o_orderpriority = '1-URGENT'")
def scan_or_of_keys(t):
    return t.orders.filter("o_orderkey = 7 OR o_custkey = 11 OR o_orderpriority = '1-URGENT'").select("o_orderkey")


@query("""SELECT p_partkey, p_size + 1 AS a, p_size * 2 AS b, p_size % 7 AS m, CASE WHEN p_size > 25 THEN 'big' WHEN p_size > 10 THEN 'mid' ELSE 'small' END AS kind,
(p_size & 3) AS band, (p_size | 8) AS bor, xor(p_size, 5) AS bxor, p_size << 2 AS shl, p_size >> 1 AS shr FROM part""")
def projection_expressions(t):
    s = F.col("p_size")
    kind = F.when(s > 25, "big").when(s > 10, "mid").otherwise("small")
    return t.part.select("p_partkey", (s + 1).alias("a"), (s * 2).alias("b"), (s % 7).alias("m"), kind.alias("kind"), s.bitwiseAND(F.lit(3)).alias("band"), s.bitwiseOR(F.lit(8)).alias("bor"), s.bitwiseXOR(F.lit(5)).alias("bxor"), F.shiftleft(s, 2).alias("shl"), F.shiftright(s, 1).alias("shr"))


@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%BRASS%' OR p_name LIKE 'a_%' OR (p_brand NOT LIKE 'Brand#1%' AND p_size IN (1, 5, 9)) OR regexp_matches(p_type, '^S.*R$')")
def predicates_like_regexp(t):
    return t.part.filter(F.col("p_type").like("%BRASS%") | F.col("p_name").like("a_%") | (~F.col("p_brand").like("Brand#1%") & F.col("p_size").isin(1, 5, 9)) | F.col("p_type").rlike("^S.*R$")).select("p_partkey", "p_type")


@query("SELECT doc_id, quality IS NULL AS missing, (quality IS NOT DISTINCT FROM NULL) AS same, COALESCE(NOT (quality = 1), TRUE) AS lnnvl FROM documents LEFT JOIN labels USING (doc_id)")
def predicates_nulls(t):
    from tidemill.functions.nulls import lnnvl

    q = F.col("quality")
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", q.isNull().alias("missing"), q.eqNullSafe(F.lit(None).cast("int")).alias("same"), lnnvl(q == 1).alias("lnnvl"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= ALL (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'F')")
def compare_all(t):
    return joins.compare_all(t.orders, "o_totalprice", ">=", t.orders.filter("o_orderstatus = 'F'"), "o_totalprice").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_retailprice < ANY (SELECT p_retailprice FROM part WHERE p_size = 50)")
def compare_any(t):
    return joins.compare_any(t.part, "p_retailprice", "<", t.part.filter("p_size = 50"), "p_retailprice").select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = ANY (SELECT s_nationkey FROM supplier)")
def compare_any_equal(t):
    return joins.compare_any(t.customer, "c_nationkey", "=", t.supplier, "s_nationkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 1000)")
def join_anti_null_aware(t):
    return joins.not_in(t.customer, "c_custkey", t.orders.filter("o_totalprice > 1000"), "o_custkey").select("c_custkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT CASE WHEN quality = 1 THEN doc_id END FROM labels)")
def join_anti_null_in_subquery(t):
    """The subquery has nulls, so no row passes."""
    return joins.not_in(t.documents, "doc_id", t.labels.select(F.expr("CASE WHEN quality = 1 THEN doc_id END").alias("k")), "k").select("doc_id")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_inner(t):
    return joins.equi(t.nation, t.region, [("n_regionkey", "r_regionkey")]).select("n_name", "r_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000")
def join_left(t):
    o = t.orders.filter("o_totalprice > 100000")
    return joins.equi(t.customer, o, [("c_custkey", "o_custkey")], "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey")
def join_right(t):
    return joins.equi(t.orders, t.customer, [("o_custkey", "c_custkey")], "right").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal < 0) c FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON c_custkey = s_suppkey")
def join_full(t):
    return joins.equi(t.customer.filter("c_acctbal < 0"), t.supplier.filter("s_acctbal > 0"), [("c_custkey", "s_suppkey")], "full").select("c_custkey", "s_suppkey")


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
def join_cross(t):
    return t.region.select(F.col("r_name").alias("a")).crossJoin(t.region.select(F.col("r_name").alias("b")))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_name > b.n_name")
def join_theta(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, F.expr("a.n_regionkey < b.n_regionkey AND a.n_name > b.n_name")).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@query("SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a LEFT JOIN region b ON a.n_regionkey > b.r_regionkey + 2")
def join_theta_left(t):
    return t.nation.join(t.region, F.expr("n_regionkey > r_regionkey + 2"), "left").select(F.col("n_nationkey").alias("a"), F.col("r_regionkey").alias("b"))


@query("SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a FULL JOIN region b ON a.n_regionkey = b.r_regionkey AND a.n_nationkey < 10")
def join_theta_full(t):
    return t.nation.join(t.region, F.expr("n_regionkey = r_regionkey AND n_nationkey < 10"), "full").select(F.col("n_nationkey").alias("a"), F.col("r_regionkey").alias("b"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_semi(t):
    return joins.equi(t.customer, t.orders.filter("o_orderstatus = 'P'"), [("c_custkey", "o_custkey")], "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(t):
    return joins.equi(t.customer, t.orders, [("c_custkey", "o_custkey")], "left_anti").select("c_custkey")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
def join_hint_hash(t):
    return joins.equi(t.lineitem, t.orders, [("l_orderkey", "o_orderkey")], hint="USE_HASH").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus")
def join_hint_merge(t):
    return joins.equi(t.lineitem, t.orders, [("l_orderkey", "o_orderkey")], hint="USE_MERGE").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT n_name, count(*) AS n FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA' GROUP BY n_name")
def join_comma(t):
    return t.nation.crossJoin(t.region).filter("n_regionkey = r_regionkey AND r_name <> 'ASIA'").groupBy("n_name").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders i WHERE i.o_custkey = o.o_custkey)")
def subquery_correlated(t):
    mean = t.orders.groupBy(F.col("o_custkey").alias("k")).agg((F.avg("o_totalprice") * 1.5).alias("bar"))
    return t.orders.join(mean, F.col("o_custkey") == F.col("k")).filter("o_totalprice > bar").select("o_orderkey")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT max(r_name) FROM region) AS top FROM customer")
def subquery_scalar(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return t.customer.join(n, F.col("c_custkey") == F.col("k"), "left").crossJoin(F.broadcast(joins.scalar(t.region.agg(F.max("r_name")), "top"))).select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "top")


@query("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT a.o_custkey, round(a.total, 2) AS total FROM big a WHERE a.total > (SELECT avg(total) FROM big)")
def cte_materialised(t):
    """One CTE used twice: Spark reuses its exchange."""
    big = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return big.crossJoin(F.broadcast(big.agg(F.avg("total").alias("m")))).filter("total > m").select("o_custkey", F.round("total", 2).alias("total"))


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) v(x, y)")
def values_list(t):
    return t.spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b'), (3, NULL) AS v(x, y)")


@query("SELECT 1 + 1 AS two, 'x' || 'y' AS xy")
def dual(t):
    return t.spark.range(1).select((F.lit(1) + F.lit(1)).alias("two"), F.concat(F.lit("x"), F.lit("y")).alias("xy"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def limit_offset(t):
    return limits.limit(limits.ordered(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice DESC", "o_orderkey"), 10, 5)


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS FIRST, doc_id LIMIT 20")
def order_nulls(t):
    return limits.ordered(t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", "quality"), "quality DESC", "doc_id").limit(20)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rownum FROM orders")
def rownum_total_order(t):
    return limits.rownum(t.orders, "o_orderdate", "o_orderkey").select("o_orderkey", "rownum")


@query("SELECT o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey) LIMIT 7")
def rownum_filter(t):
    return t.orders.filter("o_orderstatus = 'O'").select("o_orderkey").orderBy("o_orderkey").limit(7)


_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 0"


def _sides(t):
    return t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.filter("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))


@query(f"{_A} UNION ALL {_B}")
def set_union_all(t):
    a, b = _sides(t)
    return a.unionAll(b)


@query(f"{_A} UNION {_B}")
def set_union(t):
    a, b = _sides(t)
    return a.union(b).distinct()


@query(f"{_A} EXCEPT {_B}")
def set_minus(t):
    a, b = _sides(t)
    return a.subtract(b)


@query(f"{_A} EXCEPT ALL {_B}")
def set_except_all(t):
    a, b = _sides(t)
    return a.exceptAll(b)


@query(f"{_A} INTERSECT {_B}")
def set_intersect(t):
    a, b = _sides(t)
    return a.intersect(b)


@query(f"{_A} INTERSECT ALL {_B}")
def set_intersect_all(t):
    a, b = _sides(t)
    return a.intersectAll(b)


@query("SELECT CAST(n_nationkey AS DOUBLE) AS v, n_name AS s FROM nation UNION ALL SELECT s_acctbal, NULL FROM supplier")
def set_type_coercion(t):
    return t.nation.select(F.col("n_nationkey").cast("double").alias("v"), F.col("n_name").alias("s")).unionAll(t.supplier.select("s_acctbal", F.lit(None).cast("string")))
