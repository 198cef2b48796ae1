"""Reading and writing: Parquet tables, the text loader and DUMP, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import limits

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def views(spark: SparkSession, folder: str, names: list[str] | None = None) -> None:
    for name in names or TABLES:
        table(spark, folder, name).createOrReplaceTempView(name)


def external(spark: SparkSession, location: str, schema: str, *, terminated: str = ",", enclosed: str | None = None, records: str = "\n", skip_header: bool = False) -> DataFrame:
    """An external table of delimited text; blank fields are null."""
    reader = spark.read.schema(schema).option("sep", terminated).option("lineSep", records).option("header", str(skip_header).lower()).option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").option("nullValue", "").option("mode", "PERMISSIVE")
    return (reader.option("quote", enclosed) if enclosed else reader.option("quote", "")).csv(location)


def load_data(spark: SparkSession, location: str, schema: str, into: str, **options) -> None:
    """LOAD DATA: text into a Parquet table."""
    external(spark, location, schema, **options).write.mode("append").parquet(into)


def dump(df: DataFrame, location: str, *, terminated: str = ",", enclosed: str = '"', records: str = "\n") -> None:
    """DUMP: a table as delimited text, all fields enclosed."""
    df.write.mode("overwrite").option("sep", terminated).option("quote", enclosed).option("quoteAll", "true").option("lineSep", records).option("emptyValue", "").csv(location)


def with_sequence(df: DataFrame, name: str, start: int = 1, step: int = 1) -> DataFrame:
    """NEXTVAL for every row, of a sequence with a cache: unique and ascending by partition, start plus a multiple of step, with
    gaps between partitions."""
    return df.withColumn(name, F.lit(start) + F.monotonically_increasing_id() * step)


def numbered(df: DataFrame, name: str, order: list[str], start: int = 1, step: int = 1) -> DataFrame:
    """NEXTVAL in an order and without gaps; CURRVAL afterwards is its largest value (for a positive step)."""
    return limits.rownum(df, *order).withColumn(name, F.lit(start) + (F.col("rownum") - 1) * step).drop("rownum")


def parallel_ranges(df: DataFrame, key: str, parts: int) -> list[tuple[int | None, int | None]]:
    """Ranges [low, high) of a whole-number key that hold about as many rows each; the outer borders are open (None)."""
    cuts = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)])).first()[0] or []
    borders = [None, *sorted(set(cuts)), None]
    return list(zip(borders, borders[1:]))


def range_rows(df: DataFrame, key: str, low: int | None, high: int | None) -> DataFrame:
    """The rows of a range; rows without a key belong to the first one."""
    c = F.col(key)
    rows = df if high is None else df.filter((c < high) | c.isNull() if low is None else c < high)
    return rows if low is None else rows.filter(c >= low)


def violations(df: DataFrame, *, unique: list[str] | None = None, not_null: list[str] | None = None, check=None, foreign: tuple[str, DataFrame, str] | None = None) -> DataFrame:
    """Rows (or keys) that break a constraint, in one column `violation` with the number of cases."""
    parts = []
    if unique:
        parts.append(df.groupBy(*unique).count().filter("count > 1").agg(F.lit("unique").alias("violation"), F.count("*").alias("cases")))
    for c in not_null or []:
        parts.append(df.agg(F.lit(f"not null {c}").alias("violation"), F.count_if(F.col(c).isNull()).alias("cases")))
    if check is not None:
        parts.append(df.agg(F.lit("check").alias("violation"), F.count_if(~check).alias("cases")))
    if foreign:
        c, other, key = foreign
        lost = df.filter(F.col(c).isNotNull()).join(other.select(F.col(key).alias("_key")).distinct(), F.col(c) == F.col("_key"), "left_anti")
        parts.append(lost.agg(F.lit("foreign key").alias("violation"), F.count("*").alias("cases")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
