"""Joins by logical type, quantified comparisons, and hints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hints for a join's physical form, by the dialect's name.
HINTS = {"USE_HASH": "shuffle_hash", "USE_MERGE": "merge", "USE_NL": "shuffle_replicate_nl"}


def hinted(df: DataFrame, hint: str | None) -> DataFrame:
    return df.hint(HINTS[hint]) if hint else df


def equi(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner", hint: str | None = None) -> DataFrame:
    on = reduce(lambda a, b: a & b, [left[a] == right[b] for a, b in keys])
    return left.join(hinted(right, hint), on, how)


def not_in(left: DataFrame, column: str, right: DataFrame, other: str) -> DataFrame:
    """NOT IN (subquery) with its rule for nulls: no rows at all where the subquery has a null; a null on the left only passes
    an empty subquery. What is asked of the subquery as a whole is one row."""
    facts = right.agg(F.count("*").alias("_rows"), F.count_if(F.col(other).isNull()).alias("_nulls"))
    keys = right.select(F.col(other).alias("_key")).filter("_key IS NOT NULL").distinct()
    kept = left.join(keys, left[column] == F.col("_key"), "left_anti").crossJoin(F.broadcast(facts))
    return kept.filter((F.col("_rows") == 0) | ((F.col("_nulls") == 0) & F.col(column).isNotNull())).drop("_rows", "_nulls")


def compare_all(left: DataFrame, column: str, op: str, right: DataFrame, other: str) -> DataFrame:
    """column op ALL (subquery): against the extreme values; true for an empty subquery, unknown with a null. <> ALL is NOT IN."""
    if op == "<>":
        return not_in(left, column, right, other)
    facts = right.agg(F.count("*").alias("_rows"), F.count_if(F.col(other).isNull()).alias("_nulls"), F.max(other).alias("_max"), F.min(other).alias("_min"))
    c = F.col(column)
    test: dict[str, Column] = {">": c > F.col("_max"), ">=": c >= F.col("_max"), "<": c < F.col("_min"), "<=": c <= F.col("_min"), "=": (c == F.col("_min")) & (c == F.col("_max"))}
    return left.crossJoin(F.broadcast(facts)).filter((F.col("_rows") == 0) | ((F.col("_nulls") == 0) & test[op])).drop("_rows", "_nulls", "_max", "_min")


def compare_any(left: DataFrame, column: str, op: str, right: DataFrame, other: str) -> DataFrame:
    """column op ANY (subquery): = is a semi join; the others compare with the extreme value."""
    if op == "=":
        return left.join(right.select(F.col(other).alias("_key")).distinct(), F.col(column) == F.col("_key"), "left_semi")
    facts = right.agg(F.max(other).alias("_max"), F.min(other).alias("_min"))
    c = F.col(column)
    test: dict[str, Column] = {">": c > F.col("_min"), ">=": c >= F.col("_min"), "<": c < F.col("_max"), "<=": c <= F.col("_max"), "<>": (c != F.col("_min")) | (c != F.col("_max"))}
    return left.crossJoin(F.broadcast(facts)).filter(test[op]).drop("_max", "_min")


def in_tuples(left: DataFrame, columns: list[str], right: DataFrame, others: list[str]) -> DataFrame:
    """(a, b) IN (SELECT x, y ...): a semi join on all columns; a null anywhere matches nothing."""
    keys = right.select(*[F.col(o).alias(f"_key_{i}") for i, o in enumerate(others)]).distinct()
    return left.join(keys, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_key_{i}") for i, c in enumerate(columns)]), "left_semi")


def within(left: DataFrame, point: str, right: DataFrame, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """Join on low <= point <= high (numbers) as an equi join on ranges of `width`: a row on the right goes to every range that
    it touches, so width should be about the usual length of an interval. how: inner or left."""
    cell = F.floor(F.col(point) / width)
    cells = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    wide = right.filter(F.col(low) <= F.col(high)).withColumn("_cell", F.explode(cells))
    on = (F.col("_own") == F.col("_cell")) & F.col(point).between(F.col(low), F.col(high))
    return left.withColumn("_own", cell).join(wide, on, how).drop("_own", "_cell")


def in_order(*tables: DataFrame, on: list[Column], how: str = "inner") -> DataFrame:
    """LEADING / ORDERED: joins in the order given, whatever their sizes: each is written before it meets the next."""
    from tidemill.sources.scratch import materialised

    out = tables[0]
    for k, (table, condition) in enumerate(zip(tables[1:], on, strict=True)):
        out = out.join(table, condition, how)
        if k + 2 < len(tables):
            out = materialised(out, "leading")
    return out


def scalar(df: DataFrame, name: str) -> DataFrame:
    """A scalar subquery: one row with one column `name`, null for an empty subquery; an error if it has several rows."""
    several = F.raise_error(F.lit("a scalar subquery gives more than one row"))
    value = F.col(df.columns[0])
    return df.agg(F.when(F.count("*") > 1, several.cast(df.schema[0].dataType)).otherwise(F.max(value)).alias(name))
