"""JSON functions over text."""

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def is_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def json_value(c: Column, path: str, kind: str = "string", on_error: str | Column = "null", on_empty: str | Column = "null") -> Column:
    """The scalar at a path (a literal), as a type. on_error says what follows for text that isn't JSON, for an object or an
    array, and for a scalar that isn't of the type; on_empty, where there is nothing at the path: "null", "error" or a
    value. A JSON null is null."""
    parsed = F.try_parse_json(c)
    at = F.try_variant_get(parsed, path, "variant")
    value = F.get_json_object(c, path).try_cast(kind)

    def otherwise(choice, what: str) -> Column:
        if isinstance(choice, Column):
            return choice.cast(kind)
        return F.raise_error(F.lit(f"no scalar at {path}: {what}")).cast(kind) if choice == "error" else F.lit(None).cast(kind)

    out = F.when(c.isNull(), F.lit(None).cast(kind)).when(parsed.isNull(), otherwise(on_error, "no JSON")).when(at.isNull(), otherwise(on_empty, "nothing there"))
    out = out.when(_kind(at).rlike("^(OBJECT|ARRAY)"), otherwise(on_error, "an object or an array")).when(_kind(at) == "VOID", F.lit(None).cast(kind))
    return out.when(value.isNull(), otherwise(on_error, f"not of type {kind}")).otherwise(value)


def json_query(c: Column, path: str, wrapper: bool | str = False) -> Column:
    """The fragment at a path. wrapper: False (none), True (always in brackets), or "conditional" (scalars only)."""
    found = F.get_json_object(c, path)
    if wrapper == "conditional":
        kind = _kind(F.try_variant_get(F.try_parse_json(c), path, "variant"))
        quoted = F.when(kind == "STRING", F.to_json(F.array(found))).otherwise(F.concat(F.lit("["), found, F.lit("]")))
        return F.when(kind.rlike("^(OBJECT|ARRAY)"), found).when(found.isNotNull(), quoted)
    return F.when(found.isNotNull(), F.concat(F.lit("["), found, F.lit("]"))) if wrapper else found


def json_exists(c: Column, path: str) -> Column:
    """Also where the value is an explicit null."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(c), path, "variant").isNotNull(), F.lit(False))


def json_array(*columns: Column, absent_on_null: bool = True) -> Column:
    """Values keep their types: numbers and booleans aren't quoted."""
    parts = [F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "") for c in columns]
    if absent_on_null:
        parts = [F.when(c.isNotNull(), p) for c, p in zip(columns, parts, strict=True)]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def json_object(*, absent_on_null: bool = True, **columns: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]), {"ignoreNullFields": str(absent_on_null).lower()})


def json_mergepatch(target: Column, patch: Column) -> Column:
    """RFC 7386; null where either is null or no JSON."""

    def run(targets: pd.Series, patches: pd.Series) -> pd.Series:
        def merged(target, patch):
            if not isinstance(patch, dict):
                return patch
            out = dict(target) if isinstance(target, dict) else {}
            for k, v in patch.items():
                if v is None:
                    out.pop(k, None)
                else:
                    out[k] = merged(out.get(k), v)
            return out

        def one(a, b):
            try:
                return json.dumps(merged(json.loads(a), json.loads(b)), separators=(",", ":"), ensure_ascii=False)
            except (TypeError, ValueError):
                return None

        return pd.Series([one(a, b) for a, b in zip(targets, patches, strict=True)], dtype=object)

    return F.pandas_udf(run, StringType())(target, patch)


def _steps(path: str) -> list[str | int]:
    """The keys and places of a path such as $.a[1].b."""
    return [int(i) if i else k for k, i in re.findall(r"\.([^.\[\]]+)|\[(\d+)\]", path)]


def json_set(document: Column, path: Column, value: Column, create: bool = True) -> Column:
    """value (JSON) at a path of keys and places, such as $.a[1].b. Missing keys are made, and a place just behind an array's
    end, unless create is false. Null where an argument is null or no JSON; a path that can't be followed changes nothing."""

    def run(documents: pd.Series, paths: pd.Series, values: pd.Series) -> pd.Series:
        def put(at, steps, new):
            if not steps:
                return new
            step, rest = steps[0], steps[1:]
            if isinstance(step, str) and isinstance(at, dict):
                if step in at or create:
                    at[step] = put(at.get(step, [] if rest and isinstance(rest[0], int) else {}), rest, new)
            elif isinstance(step, int) and isinstance(at, list):
                if step < len(at):
                    at[step] = put(at[step], rest, new)
                elif create and step == len(at):
                    at.append(put([] if rest and isinstance(rest[0], int) else {}, rest, new))
            return at

        def one(d, p, v):
            try:
                return json.dumps(put(json.loads(d), _steps(p), json.loads(v)), separators=(",", ":"), ensure_ascii=False)
            except (TypeError, ValueError):
                return None

        return pd.Series([one(*x) for x in zip(documents, paths, values, strict=True)], dtype=object)

    return F.pandas_udf(run, StringType())(document, path, value)


def json_table(df: DataFrame, column: str, path: str, columns: dict[str, tuple], ordinality: str | None = None, outer: bool = False) -> DataFrame:
    """A row for each element of the array at a path (an object is one element).

    columns: name -> (type, path), (type, path, default for errors and for nothing there), ("exists", path), ("json", path) for a
    fragment, or ("nested", path, columns): a row for each element of an array inside the element, one at least.
    The array is read with the schema of strings, so one pass of the JSON reader serves all columns."""
    found = F.get_json_object(F.col(column), path)
    elements = F.when(found.startswith("["), F.from_json(found, "array<string>")).when(found.isNotNull(), F.array(found))
    explode = F.posexplode_outer if outer else F.posexplode
    own = df.columns
    place, element = (f"_{x}_{len(own)}" for x in ("place", "element"))
    rows = df.select("*", explode(elements).alias(place, element))
    if ordinality:
        rows = rows.withColumn(ordinality, F.col(place) + 1)
    for name, (kind, sub, *more) in columns.items():
        if kind == "nested":
            rows = json_table(rows, element, sub, more[0], outer=True)
        elif kind == "exists":
            rows = rows.withColumn(name, json_exists(F.col(element), sub))
        elif kind == "json":
            rows = rows.withColumn(name, json_query(F.col(element), sub))
        elif sub == "$":
            rows = rows.withColumn(name, F.col(element).try_cast(kind))
        else:
            rows = rows.withColumn(name, json_value(F.col(element), sub, kind, *([F.lit(more[0])] * 2 if more else [])))
    return rows.drop(place, element)


# ---- the same on parsed JSON (VARIANT)


def jsonb(c: Column) -> Column:
    """Text as parsed JSON; null for what is none."""
    return F.try_parse_json(c)


def jsonb_value(v: Column, path: str, kind: str = "string") -> Column:
    """The scalar at a path; null for objects and arrays, and for other types."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(~_kind(at).rlike("^(OBJECT|ARRAY)"), F.try_variant_get(v, path, kind))


def jsonb_query(v: Column, path: str) -> Column:
    return F.to_json(F.try_variant_get(v, path, "variant"))


def jsonb_exists(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "variant").isNotNull(), F.lit(False))


def jsonb_array_length(v: Column, path: str = "$") -> Column:
    """Null for what is no array."""
    items = F.try_variant_get(v, path, "array<variant>")
    return F.when(items.isNotNull(), F.size(items))


def jsonb_mergepatch(target: Column, patch: Column) -> Column:
    return F.try_parse_json(json_mergepatch(F.to_json(target), F.to_json(patch)))


def jsonb_set(document: Column, path: Column, value: Column, create: bool = True) -> Column:
    return F.try_parse_json(json_set(F.to_json(document), path, F.to_json(value), create))
