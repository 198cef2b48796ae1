"""Sorting with the dialect's place for nulls, limits, and ROWNUM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.sources.scratch import materialised


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    """'name' or 'name DESC': nulls come last ascending and first descending."""
    out = []
    for k in keys:
        name, _, direction = k.partition(" ")
        out.append(F.col(name).desc_nulls_first() if direction.upper() == "DESC" else F.col(name).asc_nulls_last())
    return df.orderBy(*out)


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    return (df.offset(offset) if offset else df).limit(n)


def rownum(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with rownum, the place in a total order. Rows are dealt into ranges of the order and sorted there, and written once;
    the places follow from one count for each range: no single task sorts or numbers all rows."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = materialised(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()), "rownum")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n") - F.col("_first") + 1).alias("_base"))
    return placed.join(F.broadcast(before), "_part").withColumn("rownum", F.col("_base") + F.col("_place")).drop("_part", "_base", "_place")
