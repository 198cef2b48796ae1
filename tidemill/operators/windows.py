"""Window forms that Spark has no syntax for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_distinct(df: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str]]) -> DataFrame:
    """SUM/COUNT/AVG(DISTINCT x) OVER (PARTITION BY keys): grouped first, with map-side combination, and joined back, so no
    set of values is held for a partition. aggregates: output -> (function, column)."""
    make = {"sum": lambda c: F.sum_distinct(F.col(c)), "count": F.count_distinct, "avg": lambda c: F.expr(f"avg(DISTINCT `{c}`)")}
    renamed = {k: f"_key_{i}" for i, k in enumerate(keys)}
    found = df.groupBy(*[F.col(k).alias(r) for k, r in renamed.items()]).agg(*[make[f](c).alias(out) for out, (f, c) in aggregates.items()])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()])
    return df.join(found, on, "left").select(*df.columns, *aggregates)


def frame(kind: str, keys: list[str], order: list[str], low, high):
    """ROWS or RANGE BETWEEN low AND high over ascending columns; None is unbounded.

    A frame from some place to the end is, the order turned round, one from the beginning: Spark carries that on from row to
    row, while it would compute a frame to UNBOUNDED FOLLOWING anew for each row."""
    if high is None and low is not None:
        order, low, high = [F.col(c).desc() for c in order], None, -low
    w = Window.partitionBy(*keys).orderBy(*order)
    a = Window.unboundedPreceding if low is None else low
    b = Window.unboundedFollowing if high is None else high
    return w.rowsBetween(a, b) if kind == "rows" else w.rangeBetween(a, b)


def dealt(df: DataFrame, keys: list[str], rows: int = 500_000) -> DataFrame:
    """df dealt by keys for windows over them, to partitions of about `rows` each that aren't merged: what a task sorts doesn't
    grow with the table. Rows are counted first, in Parquet's footers where df is a table."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = df.count()
    return df.repartition(max(1, -(-found // rows), min(least, found // 10_000)), *keys)


def listagg_over(value: Column, separator: str, window) -> Column:
    return F.array_join(F.collect_list(value.cast("string")).over(window), separator)


def in_ranges(df: DataFrame, keys: list[str], order: str, rows: int = 1_000_000) -> DataFrame:
    """df with _cell: each key's rows cut into ranges of the order (numbers) at approximate quantiles, of about `rows` each. What
    spans ranges is carried over by the caller, so that a key with a large part of all rows is no single task's work."""
    parts = F.ceil(F.count("*") / rows).cast("int")
    cuts = df.groupBy(*[F.col(k).alias(f"_cut_{k}") for k in keys]).agg(parts.alias("_parts"), F.percentile_approx(order, [i / 64 for i in range(1, 64)]).alias("_cuts"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_cut_{k}")) for k in keys])
    cell = F.when(F.col("_parts") > 1, F.size(F.filter("_cuts", lambda c: c <= F.col(order)))).otherwise(F.lit(0))
    return df.join(cuts, on, "left").withColumn("_cell", cell).drop("_parts", "_cuts", *[f"_cut_{k}" for k in keys])


def last_known(df: DataFrame, keys: list[str], order: str, value: str, out: str, rows: int = 1_000_000) -> DataFrame:
    """LAST_VALUE(value IGNORE NULLS) up to each row. Within ranges of the order by a window, and from range to range by each
    range's last known value."""
    placed = in_ranges(df, keys, order, rows)
    inside = Window.partitionBy(*keys, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    known = placed.filter(F.col(value).isNotNull()).groupBy(*keys, "_cell").agg(F.max_by(value, order).alias("_last"))
    cells = placed.select(*keys, "_cell").distinct().join(known.withColumnsRenamed({k: f"_c_{k}" for k in [*keys, "_cell"]}), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in [*keys, "_cell"]]), "left")
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select(*[F.col(k).alias(f"_b_{k}") for k in [*keys, "_cell"]], F.last_value("_last", ignoreNulls=True).over(before).alias("_carried"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in [*keys, "_cell"]])
    joined = placed.withColumn("_own", F.last_value(value, ignoreNulls=True).over(inside)).join(carried, on, "left")
    return joined.withColumn(out, F.coalesce("_own", "_carried")).select(*df.columns, out)


def count_within(df: DataFrame, keys: list[str], order: str, width: int, out: str, rows: int = 200_000) -> DataFrame:
    """COUNT(*) OVER (PARTITION BY keys ORDER BY order RANGE BETWEEN width PRECEDING AND CURRENT ROW), for whole numbers; rows without
    an order are peers of each other alone. A frame's count is the rows up to its end less those before its beginning. Both are
    places in one running sum, in which each place has a row for its own count and one, `width` before it, for its frame's
    beginning: linear, however many rows a frame holds. The sum runs within ranges of the order, with one figure a range."""
    renamed = {k: f"_f_{k}" for k in keys}
    steps = df.groupBy(*[F.col(k).alias(r) for k, r in renamed.items()], F.col(order).alias("_of")).agg(F.count("*").alias("_n"))
    known, names = steps.filter(F.col("_of").isNotNull()), [*renamed.values()]
    ends = F.array(F.struct((F.col("_of") - width).alias("at"), F.lit(-1).alias("sign"), F.lit(0).cast("long").alias("n")), F.struct(F.col("_of").alias("at"), F.lit(1).alias("sign"), F.col("_n").alias("n")))
    placed = in_ranges(known.select(*names, "_of", F.inline(ends)), names, "at", rows)
    # a beginning comes before the rows of its own place, which are in the frame
    inside = Window.partitionBy(*names, "_cell").orderBy("at", "sign").rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy(*[F.col(c).alias(f"_b_{c}") for c in [*names, "_cell"]]).agg(F.sum("n").alias("_total"))
    before = Window.partitionBy(*[f"_b_{c}" for c in names]).orderBy("_b__cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("_carried", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in [*names, "_cell"]])
    summed = placed.withColumn("_sum", F.sum("n").over(inside)).join(carried, on)
    found = summed.groupBy(*names, "_of").agg(F.sum(F.col("sign") * (F.col("_sum") + F.col("_carried"))).alias(out))
    found = found.unionByName(steps.filter(F.col("_of").isNull()).withColumnRenamed("_n", out))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(r)) for k, r in [*renamed.items(), (order, "_of")]])
    return df.join(found, on, "left").select(*df.columns, out)
