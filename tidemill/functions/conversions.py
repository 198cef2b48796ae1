"""Conversions, hashes and facts of the session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import dates, numbers


def convert(c: Column, kind: str) -> Column:
    """The same as a cast."""
    return c.cast(kind)


def to_nchar(c: Column, model: str | None = None, *, date: bool = False) -> Column:
    """As to_char."""
    if model is None:
        return c.cast("string")
    return dates.to_char(c, model) if date else numbers.to_char(c, model)


def to_clob(c: Column) -> Column:
    return c.cast("string")


def to_blob(hexadecimal: Column) -> Column:
    """Hex digits as bytes; an error for other text."""
    return F.to_binary(hexadecimal, F.lit("hex"))


def empty_blob() -> Column:
    return F.lit(b"")


def empty_clob() -> Column:
    return F.lit("")


def hash(*columns: Column) -> Column:
    """A 64-bit hash; its values are Spark's own."""
    return F.xxhash64(*columns)


#: Type numbers of SQL's call-level interface and their names.
TYPE_NAMES = {1: "CHAR", 2: "NUMERIC", 3: "DECIMAL", 4: "INTEGER", 5: "SMALLINT", 6: "FLOAT", 7: "REAL", 8: "DOUBLE", 12: "VARCHAR", 16: "BOOLEAN", 91: "DATE", 92: "TIME", 93: "TIMESTAMP"}


def type_id2name(n: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])[n]


def sys_context(spark: SparkSession, name: str) -> Column:
    """A fact of the session: also userenv."""
    facts = {"CURRENT_USER": F.current_user(), "SESSION_USER": F.session_user(), "CURRENT_SCHEMA": F.current_schema(), "DB_NAME": F.current_catalog(), "SESSIONID": F.lit(spark.sparkContext.applicationId), "TIMEZONE": F.current_timezone()}
    return facts.get(name.upper(), F.lit(None).cast("string"))


def found_rows(df: DataFrame) -> DataFrame:
    """How many rows a query has without its limit: one row."""
    return df.agg(F.count("*").alias("found_rows"))
