"""Conditional functions and the rules for nulls in which the dialect differs from Spark."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty_as_null(c: Column) -> Column:
    """'' as null: the switch that a session applies at sources and to results of string functions."""
    return F.nullif(c, F.lit(""))


def lnnvl(condition: Column) -> Column:
    """True when the condition is false or unknown."""
    return ~F.coalesce(condition, F.lit(False))


def _any_null(columns) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() for c in columns])


def greatest(*columns: Column) -> Column:
    """Null when any argument is."""
    return F.when(_any_null(columns), F.lit(None)).otherwise(F.greatest(*columns) if len(columns) > 1 else columns[0])


def least(*columns: Column) -> Column:
    """Null when any argument is."""
    return F.when(_any_null(columns), F.lit(None)).otherwise(F.least(*columns) if len(columns) > 1 else columns[0])


def decode(c: Column, *rest: Column) -> Column:
    """decode(x, key, value, ..., [default]); null matches null."""
    pairs, default = (rest[:-1], rest[-1]) if len(rest) % 2 else (rest, F.lit(None))
    out = None
    for key, value in zip(pairs[::2], pairs[1::2], strict=True):
        out = F.when(c.eqNullSafe(key), value) if out is None else out.when(c.eqNullSafe(key), value)
    return default if out is None else out.otherwise(default)


def nvl2(c: Column, some: Column, none: Column) -> Column:
    return F.when(c.isNotNull(), some).otherwise(none)


def concat(*columns: Column) -> Column:
    """Null arguments count as empty; all null gives null."""
    every = reduce(lambda a, b: a & b, [c.isNull() for c in columns])
    return F.when(every, F.lit(None)).otherwise(F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def is_numeric(c: Column) -> Column:
    """1 for text that is a number, 0 for other text."""
    return c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$").cast("int")
