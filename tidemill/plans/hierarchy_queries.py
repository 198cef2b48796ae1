"""CONNECT BY over the regions, nations and suppliers as one tree, over parts in a row, and over rings."""

from pyspark.sql import functions as F

from tidemill.operators.hierarchy import connect_by
from tidemill.operators.limits import rownum
from tidemill.plans.registry import query

_TREE = """tree AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS up, r_name AS name FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier)"""
_WALK = f"""WITH RECURSIVE {_TREE}, walk AS (SELECT id, up, name, 1 AS level, id AS root, '/' || name AS path FROM tree WHERE up IS NULL
UNION ALL SELECT t.id, t.up, t.name, w.level + 1, w.root, w.path || '/' || t.name FROM tree t JOIN walk w ON t.up = w.id)"""


def _tree(t):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = t.region.select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("up"), F.col("r_name").alias("name"))
    n = t.nation.select(key("n", "n_nationkey"), key("r", "n_regionkey"), "n_name")
    return r.unionAll(n).unionAll(t.supplier.select(key("s", "s_suppkey"), key("n", "s_nationkey"), "s_name"))


@query(_WALK + " SELECT id, up, name, level, root, path, CAST(NOT EXISTS (SELECT 1 FROM tree c WHERE c.up = walk.id) AS INT) AS is_leaf FROM walk")
def connect_by_tree(t):
    return connect_by(_tree(t), "id", "up", F.col("up").isNull(), show="name").select("id", "up", "name", "level", "root", "path", "is_leaf")


@query(_WALK + """, keyed AS (SELECT id, CAST(NULL AS VARCHAR) AS up, name, 1 AS level, [name || chr(1) || id] AS sort FROM tree WHERE up IS NULL
UNION ALL SELECT t.id, t.up, t.name, k.level + 1, list_append(k.sort, t.name || chr(1) || t.id) FROM tree t JOIN keyed k ON t.up = k.id)
SELECT id, row_number() OVER (ORDER BY sort) AS place FROM keyed""")
def connect_by_siblings(t):
    """Depth first, siblings by name, over the whole tree: the path of sort keys is the order."""
    found = connect_by(_tree(t), "id", "up", F.col("up").isNull(), siblings="name")
    return rownum(found.select("id", "sort_path"), F.col("sort_path")).select("id", F.col("rownum").alias("place"))


@query("""WITH RECURSIVE walk AS (SELECT p_partkey AS k, p_size AS s, 1 AS level, [p_partkey] AS seen FROM part WHERE p_size < 10
UNION ALL SELECT p_partkey, p_size, level + 1, list_append(seen, p_partkey) FROM part JOIN walk ON p_partkey = k + 1 WHERE p_size > s AND NOT list_contains(seen, p_partkey))
SELECT k, level FROM walk WHERE level > 1""")
def connect_by_conditions(t):
    """CONNECT BY PRIOR p_partkey = p_partkey - 1 AND p_size > PRIOR p_size, and a WHERE that holds after the walk."""
    parts = t.part.select("p_partkey", "p_size", (F.col("p_partkey") - 1).alias("before"))
    found = connect_by(parts, "p_partkey", "before", F.col("p_size") < 10, condition=F.col("p_size") > F.col("prior.p_size"))
    return found.filter("level > 1").select(F.col("p_partkey").alias("k"), "level")


@query("""WITH RECURSIVE j AS (SELECT c_custkey AS k, c_nationkey AS n, n_regionkey AS r, c_custkey - 1 AS up, c_acctbal AS a FROM customer JOIN nation ON c_nationkey = n_nationkey),
walk AS (SELECT k, n, r, 1 AS level FROM j WHERE a < 0 UNION ALL SELECT j.k, j.n, j.r, level + 1 FROM j JOIN walk w ON j.up = w.k AND j.r = w.r)
SELECT k, level, n FROM walk""")
def connect_by_over_join(t):
    """CONNECT BY over a join, with two PRIOR terms."""
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.col("n_regionkey").alias("r"), (F.col("c_custkey") - 1).alias("up"), F.col("c_acctbal").alias("a"))
    return connect_by(rows, ["k", "r"], ["up", "r"], F.col("a") < 0).select("k", "level", "n")


@query("""WITH RECURSIVE ring AS (SELECT n_nationkey AS node, (n_nationkey + 4) % 5 + n_nationkey // 5 * 5 AS up FROM nation),
walk AS (SELECT node, 1 AS level, [node] AS seen FROM ring WHERE node IN (0, 7) UNION ALL SELECT r.node, level + 1, list_append(seen, r.node) FROM ring r JOIN walk w ON r.up = w.node WHERE NOT list_contains(seen, r.node))
SELECT node, level, CAST(EXISTS (SELECT 1 FROM ring c WHERE c.up = walk.node AND list_contains(seen, c.node)) AS INT) AS is_cycle, '/' || array_to_string(seen, '/') AS path FROM walk""")
def connect_by_nocycle(t):
    """The nations in rings of five, from one nation of two of them."""
    k = F.col("n_nationkey")
    ring = t.nation.select(k.alias("node"), ((k + 4) % 5 + F.floor(k / 5) * 5).cast("int").alias("up"))
    return connect_by(ring, "node", "up", F.col("node").isin(0, 7), nocycle=True).select("node", "level", "is_cycle", "path")
