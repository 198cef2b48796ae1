"""Set operations whose columns differ in type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.FloatType, T.DoubleType)
_WHOLE = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The result type of two columns: null takes the other's type; numbers the wider one (decimals keep all their digits, 38 at
    most); dates and timestamps a timestamp; bytes only meet bytes; whatever else differs is text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, _NUMBERS) and isinstance(b, _NUMBERS):
        if isinstance(a, T.FloatType | T.DoubleType) or isinstance(b, T.FloatType | T.DoubleType):
            return T.DoubleType()
        if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
            parts = [(x.precision - x.scale, x.scale) if isinstance(x, T.DecimalType) else (_WHOLE[type(x)], 0) for x in (a, b)]
            whole, scale = max(p[0] for p in parts), max(p[1] for p in parts)
            return T.DecimalType(min(38, whole + scale), min(scale, max(0, 38 - whole)))
        return max((a, b), key=lambda x: _NUMBERS.index(type(x)))
    times = (T.DateType, T.TimestampNTZType, T.TimestampType)
    if isinstance(a, times) and isinstance(b, times):
        return T.TimestampType() if isinstance(a, T.TimestampType) or isinstance(b, T.TimestampType) else T.TimestampNTZType()
    if isinstance(a, T.BinaryType) or isinstance(b, T.BinaryType):
        raise TypeError(f"{a.simpleString()} and {b.simpleString()} don't meet in a set operation")
    return T.StringType()


def aligned(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides in their common types, with the names of the first."""
    if len(a.columns) != len(b.columns):
        raise ValueError("the sides of a set operation have as many columns")
    kinds = [common_type(x.dataType, y.dataType) for x, y in zip(a.schema, b.schema, strict=True)]
    of = lambda df: df.toDF(*a.columns).select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in zip(a.columns, kinds, strict=True)])
    return of(a), of(b)


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    a, b = aligned(a, b)
    return a.unionAll(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return union_all(a, b).distinct()


def minus(a: DataFrame, b: DataFrame, *, every: bool = False) -> DataFrame:
    a, b = aligned(a, b)
    return a.exceptAll(b) if every else a.subtract(b)


def intersect(a: DataFrame, b: DataFrame, *, every: bool = False) -> DataFrame:
    a, b = aligned(a, b)
    return a.intersectAll(b) if every else a.intersect(b)
