"""Ordered-set and hypothetical-set aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def listagg(value: Column, separator: str, *order: Column) -> Column:
    """Values in an order, joined; nulls are left out. The sort is by the typed keys."""
    pairs = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"].cast("string")), separator)


def array_agg(value: Column) -> Column:
    """Nulls stay."""
    return F.transform(F.collect_list(F.struct(value.alias("v"))), lambda s: s["v"])


def _sorts(keys, constants, ascending, *, same: bool) -> Column:
    """Whether a row sorts before the constants, key by key (or, with same, at their place). Nulls come last ascending and first
    descending."""
    keys, constants = ([x] if isinstance(x, Column) else list(x) for x in (keys, constants))
    up = [ascending] * len(keys) if isinstance(ascending, bool) else list(ascending)
    out = F.lit(same)
    for key, constant, asc in reversed(list(zip(keys, constants, up, strict=True))):
        less = F.coalesce(key < constant, F.lit(False)) | (key.isNotNull() & constant.isNull())
        more = F.coalesce(key > constant, F.lit(False)) | (key.isNull() & constant.isNotNull())
        out = (less if asc else more) | (key.eqNullSafe(constant) & out)
    return out


def rank_within(keys: Column | list[Column], constants: Column | list[Column], ascending: bool | list[bool] = True) -> Column:
    """RANK(constants) WITHIN GROUP (ORDER BY keys): the rank that a row with these keys would have."""
    return F.count_if(_sorts(keys, constants, ascending, same=False)) + 1


def dense_rank_within(keys: Column | list[Column], constants: Column | list[Column], ascending: bool | list[bool] = True) -> Column:
    before = _sorts(keys, constants, ascending, same=False)
    whole = F.struct(*([keys] if isinstance(keys, Column) else keys))
    return F.count_distinct(F.when(before, whole)) + 1


def cume_dist_within(keys: Column | list[Column], constants: Column | list[Column], ascending: bool | list[bool] = True) -> Column:
    return (F.count_if(_sorts(keys, constants, ascending, same=True)) + 1) / (F.count("*") + 1)
