"""Window functions and all pairs of frame borders."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.operators import windows
from tidemill.plans.registry import query

_BY = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query(f"SELECT o_orderkey, row_number() {_BY} AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr, ntile(4) {_BY} AS nt, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus), 6) AS cd FROM orders")
def window_ranking(t):
    w, s = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    long = lambda c, n: c.cast("long").alias(n)
    return t.orders.select("o_orderkey", long(F.row_number().over(w), "rn"), long(F.rank().over(s), "rk"), long(F.dense_rank().over(s), "dr"), long(F.ntile(4).over(w), "nt"), F.round(F.cume_dist().over(s), 6).alias("cd"))


@query(f"SELECT o_orderkey, lag(o_totalprice) {_BY} AS l1, lag(o_totalprice, 2, 0.0) {_BY} AS l2, lead(o_totalprice) {_BY} AS l3, first_value(o_orderkey) {_BY} AS f1, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f2 FROM orders")
def window_offsets(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = "o_totalprice"
    return t.orders.select("o_orderkey", F.lag(p).over(w).alias("l1"), F.lag(p, 2, 0.0).over(w).alias("l2"), F.lead(p).over(w).alias("l3"), F.first_value("o_orderkey").over(w).alias("f1"), F.last_value("o_orderkey").over(whole).alias("f2"))


@query("SELECT doc_id, last_value(quality IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM documents LEFT JOIN labels USING (doc_id)")
def window_ignore_nulls(t):
    rows = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    return windows.last_known(rows, ["source"], "doc_id", "quality", "seen").select("doc_id", "seen")


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER w, 4) AS a, round(stddev_pop(o_totalprice) OVER w, 2) AS s, count(*) OVER w AS n, round(covar_pop(o_totalprice, o_orderkey) OVER w, 0) AS c FROM orders WINDOW w AS (PARTITION BY o_orderpriority, o_orderstatus)")
def window_aggregates(t):
    w = Window.partitionBy("o_orderpriority", "o_orderstatus")
    return t.orders.select("o_orderkey", F.round(F.avg("o_totalprice").over(w), 4).alias("a"), F.round(F.stddev_pop("o_totalprice").over(w), 2).alias("s"), F.count("*").over(w).alias("n"), F.round(F.covar_pop("o_totalprice", "o_orderkey").over(w), 0).alias("c"))


@query("SELECT o_orderkey, n, p FROM orders JOIN (SELECT o_custkey AS k, count(DISTINCT o_orderpriority) AS n, CAST(sum(DISTINCT length(o_orderpriority)) AS BIGINT) AS p FROM orders GROUP BY 1) ON k = o_custkey")
def window_distinct(t):
    rows = t.orders.withColumn("len", F.length("o_orderpriority"))
    return windows.with_distinct(rows, ["o_custkey"], {"n": ("count", "o_orderpriority"), "p": ("sum", "len")}).select("o_orderkey", "n", "p")


@query("SELECT conv_id, turn, string_agg(role, ',') OVER (PARTITION BY conv_id ORDER BY turn) AS roles FROM conversations")
def window_listagg(t):
    return t.conversations.select("conv_id", "turn", windows.listagg_over(F.col("role"), ",", Window.partitionBy("conv_id").orderBy("turn")).alias("roles"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS n FROM events""")
def window_range_interval(t):
    rows = t.events.select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return windows.count_within(rows, ["event_type"], "at", 6 * 3600 * 10**6, "n").select("event_id", "n")


#: Borders of frames: (name, SQL, offset), None for unbounded.
_LOW = [("up", "UNBOUNDED PRECEDING", None), ("p3", "3 PRECEDING", -3), ("c", "CURRENT ROW", 0), ("f1", "1 FOLLOWING", 1)]
_HIGH = [("p1", "1 PRECEDING", -1), ("c", "CURRENT ROW", 0), ("f2", "2 FOLLOWING", 2), ("uf", "UNBOUNDED FOLLOWING", None)]
#: A frame may not end before it begins.
_FRAMES = [(f"{a}_{b}", f"{x} AND {y}", i, j) for a, x, i in _LOW for b, y, j in _HIGH if i is None or j is None or i <= j]


def _frames(kind: str, order: str):
    sql = ", ".join(f"CAST(sum(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY {order} {kind.upper()} BETWEEN {between}) AS BIGINT) AS {name}" for name, between, _, _ in _FRAMES)
    keys = "l_orderkey, l_linenumber"

    def run(t):
        columns = order.split(", ")
        return windows.dealt(t.lineitem, ["l_suppkey"]).select("l_orderkey", "l_linenumber", *[F.sum("l_linenumber").over(windows.frame(kind, ["l_suppkey"], columns, low, high)).alias(name) for name, _, low, high in _FRAMES])

    run.__name__ = f"window_frames_{kind}"
    return query(f"SELECT {keys}, {sql} FROM lineitem")(run)


# (l_orderkey, l_linenumber) isn't unique in lineitem: frames of rows need a total order
_frames("rows", "l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice, l_quantity")
_frames("range", "l_orderkey")
