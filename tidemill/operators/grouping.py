"""Grouping sets, PIVOT and UNPIVOT."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cartesian_sets(*items: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Several grouping items in one GROUP BY: every combination of their sets."""
    return [tuple(dict.fromkeys(c for part in combo for c in part)) for combo in product(*items)]


def cube_sets(*columns: str) -> list[tuple[str, ...]]:
    return [tuple(c for c, on in zip(columns, bits, strict=True) if on) for bits in product((True, False), repeat=len(columns))]


def rollup_sets(*columns: str) -> list[tuple[str, ...]]:
    return [columns[:i] for i in range(len(columns), -1, -1)]


def grouping_sets(df: DataFrame, sets: list[tuple[str, ...]], *aggregates: Column) -> DataFrame:
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[df[c] for c in s] for s in sets], *[df[c] for c in columns]).agg(*aggregates)


def pivot(df: DataFrame, keys: list[str], on: list[str], values: dict[str, tuple], measures: dict[str, Column]) -> DataFrame:
    """PIVOT over several columns: one aggregation with a condition in each measure, so one shuffle. values: name -> the
    tuple of values of `on`; output columns are name_measure. measures: functions of a condition."""
    out = []
    for name, value in values.items():
        hit = F.lit(True)
        for c, v in zip(on, value, strict=True):
            hit = hit & F.col(c).eqNullSafe(F.lit(v))
        out += [measure(hit).alias(f"{name}_{label}") for label, measure in measures.items()]
    return df.groupBy(*keys).agg(*out)


def unpivot(df: DataFrame, keys: list[str], name: str, values: list[str], groups: dict[str, tuple[str, ...]], include_nulls: bool = False) -> DataFrame:
    """UNPIVOT with several measures: groups: label -> columns that go to `values`. Rows of nulls only are left out unless
    asked for."""
    rows = F.array(*[F.struct(F.lit(label).alias(name), *[F.col(c).alias(v) for c, v in zip(columns, values, strict=True)]) for label, columns in groups.items()])
    out = df.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")
    if include_nulls:
        return out
    some = F.lit(False)
    for v in values:
        some = some | F.col(v).isNotNull()
    return out.filter(some)
