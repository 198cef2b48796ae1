"""INSERT, UPDATE, DELETE, MERGE and REPLACE on tables as DataFrames: each gives the table after the statement, to be written
over the old one. Source columns are s_name in conditions and values. A statement never makes two rows of one: where several
source rows would change one row of the table it fails, as MERGE does in the dialect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns that the rows lack are null."""
    return table.unionByName(rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns]))


def insert_all(rows: DataFrame, targets: dict[str, tuple[DataFrame, Column, dict[str, Column]]]) -> dict[str, DataFrame]:
    """INSERT ALL WHEN ... INTO ...: each target takes the rows that meet its condition."""
    return {name: insert(table, rows.filter(when).select(*[v.alias(c) for c, v in values.items()])) for name, (table, when, values) in targets.items()}


def update(table: DataFrame, values: dict[str, Column], where: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return table.select(*[F.when(hit, values[c]).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) if c in values else F.col(c) for c in table.columns])


def _source(source: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The source with s_ names; with keys also _many, true where several rows have a key (null keys meet nothing)."""
    s = source.select(*[F.col(c).alias(f"s_{c}") for c in source.columns]).withColumn("_in_s", F.lit(True))
    if keys is None:
        return s
    whole = reduce(lambda a, b: a & b, [F.col(f"s_{k}").isNotNull() for k in keys])
    many = s.filter(whole).groupBy(*[f"s_{k}" for k in keys]).agg(F.count("*").alias("_n")).filter("_n > 1").select(*[F.col(f"s_{k}").alias(f"_m_{k}") for k in keys], F.lit(True).alias("_many"))
    return s.join(many, reduce(lambda a, b: a & b, [F.col(f"s_{k}") == F.col(f"_m_{k}") for k in keys]), "left").drop(*[f"_m_{k}" for k in keys])


def _one_each(rows: DataFrame, several: Column) -> DataFrame:
    return rows.filter(F.when(several, F.raise_error(F.lit("several source rows for one row of the table")).cast("boolean")).otherwise(F.lit(True)))


def update_from(table: DataFrame, source: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """UPDATE t, s SET ... WHERE t.key = s.key."""
    s = _source(source, keys)
    joined = _one_each(table.join(s, [table[k] == s[f"s_{k}"] for k in keys], "left"), F.col("_many"))
    return update(joined, values, F.col("_in_s")).select(*table.columns)


def delete(table: DataFrame, where: Column) -> DataFrame:
    return table.filter(~F.coalesce(where, F.lit(False)))


def delete_using(table: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(source.select(*keys).distinct(), keys, "left_anti")


def _outcome(rows: DataFrame, table: DataFrame, matched, delete_when, not_matched) -> DataFrame:
    both, only_s = F.col("_in_t").isNotNull() & F.col("_in_s").isNotNull(), F.col("_in_t").isNull()
    if not_matched is None:
        rows = rows.filter("_in_t IS NOT NULL")
    if delete_when is not None:
        rows = rows.filter(~(both & F.coalesce(delete_when, F.lit(False))))
    out = []
    for c in table.columns:
        v = F.when(both, (matched or {}).get(c, F.col(c))).when(only_s, (not_matched or {}).get(c, F.lit(None))).otherwise(F.col(c))
        out.append(v.cast(table.schema[c].dataType).alias(c))
    return rows.select(*out)


def merge(table: DataFrame, source: DataFrame, on: list[str] | list[Column], matched: dict[str, Column] | None = None, delete_when: Column | None = None, not_matched: dict[str, Column] | None = None) -> DataFrame:
    """MERGE INTO table USING source ON ...

    on: names of equal columns, which is one full outer join; or conditions, of which one at least must hold. Each condition
    is a join of its own, so an OR of equalities needs no nested loop. Conditions see the table's columns and s_ columns.
    For conditions, rows are numbered by their place in the input, which must be a stored table (a retry numbers them alike).
    """
    if all(isinstance(k, str) for k in on):
        s = _source(source, on)
        t = table.withColumn("_in_t", F.lit(True))
        rows = t.join(s, [t[k] == s[f"s_{k}"] for k in on], "full")
        return _outcome(_one_each(rows, F.col("_in_t") & F.col("_many")), table, matched, delete_when, not_matched)
    t = table.withColumn("_in_t", F.lit(True)).withColumn("_t", F.monotonically_increasing_id())
    s = _source(source).withColumn("_s", F.monotonically_increasing_id())
    pairs = reduce(DataFrame.unionAll, [t.join(s, condition).select("_t", "_s") for condition in on]).distinct()
    of_table = pairs.groupBy("_t").agg(F.min("_s").alias("_s"), (F.count("*") > 1).alias("_many"))
    met = _one_each(t.join(of_table, "_t", "left"), F.col("_many")).join(s, "_s", "left")
    new = s.join(pairs.select("_s").distinct(), "_s", "left_anti")
    return _outcome(met.unionByName(new, allowMissingColumns=True), table, matched, delete_when, not_matched)


def _last(rows: DataFrame, keys: list[str], order: Column | None, *, first: bool = False) -> DataFrame:
    """Of rows with one key the last (or first) by `order`, or by all columns where there is none."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    pick = F.min_by if first else F.max_by
    return rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(pick(whole, order if order is not None else whole).alias("_r")).select("_r.*")


def replace_into(table: DataFrame, rows: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Rows with the same keys go, then the new ones come; of new rows with one key the last by `order` (by all columns where
    there is none) stays, as each replaces the one before."""
    return insert(delete_using(table, rows, keys), _last(rows, keys, order))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """INSERT ... ON DUPLICATE KEY UPDATE: rows with a known key change that row by `values`, others are inserted. New rows
    that share a key have no order in which they could change each other: an error."""
    new = {c: F.col(f"s_{c}") for c in table.columns if c in rows.columns}
    s = _source(rows, keys)
    t = table.withColumn("_in_t", F.lit(True))
    return _outcome(_one_each(t.join(s, [t[k] == s[f"s_{k}"] for k in keys], "full"), F.col("_many")), table, values, None, new)


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """INSERT IGNORE: rows with a known key are left out; of new rows with one key the first by `order` comes in."""
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys])
    known = table.select(*[F.col(k).alias(f"_t_{k}") for k in keys])
    return insert(table, _last(rows, keys, order, first=True).join(known, on, "left_anti"))
