"""START WITH ... CONNECT BY PRIOR, level by level.

Each level is one join of the last level's rows with the table, written once; the number of its rows, and of those that close
a cycle, come with the write. Rows carry their level, root, path and sibling path; a row whose own key is on its path closes a
cycle: an error, or with NOCYCLE the branch ends there. A filter after the walk is a filter of the result; a join before it is
a join before the call.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemill.sources.scratch import materialised

MAX_LEVEL = 256


def connect_by(table: DataFrame, key: str | list[str], parent: str | list[str], start: Column, *, condition: Column | None = None, show: str | None = None, separator: str = "/", siblings: str | None = None, nocycle: bool = False) -> DataFrame:
    """The table's columns with level, root, path (of `show`), is_leaf, is_cycle and, with siblings, sort_path, by which
    ORDER SIBLINGS BY sorts.

    key and parent: PRIOR key = parent, for one or several columns. condition: what else CONNECT BY asks for; the row above is
    prior.name in it, and its level `prior.level`. siblings: a column, or "name DESC" (descending: numbers and dates only).
    An error if the separator occurs in a shown value.
    """
    keys, parents = ([key], [parent]) if isinstance(key, str) else (key, parent)
    show = show or keys[0]
    own = table.columns
    base = table.withColumn("_key", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])).withColumn("_on", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(parents)]))
    text = F.col(show).cast("string")
    base = base.withColumn("_text", F.when(F.contains(text, F.lit(separator)), F.raise_error(F.lit(f"the separator {separator} occurs in {show}")).cast("string")).otherwise(text))

    def sort_key():
        if not siblings:
            return F.struct(F.col("_key").alias("k"))
        name, _, direction = siblings.partition(" ")
        value = -F.col(name) if direction.upper() == "DESC" else F.col(name)
        return F.struct(F.col(name).isNull().alias("null_last") if direction.upper() != "DESC" else F.col(name).isNotNull().alias("null_first"), value.alias("s"), F.col("_key").alias("k"))

    level = base.filter(start).select(*own, "_key", F.lit(1).alias("level"), F.col(keys[0]).alias("root"), F.concat(F.lit(separator), "_text").alias("path"), F.array("_key").alias("_seen"), F.array(sort_key()).alias("sort_path"), F.lit(False).alias("_loops"), F.lit(None).cast(base.schema["_key"].dataType).alias("_above"))
    levels = []
    while True:
        facts = Observation()
        level = materialised(level.observe(facts, F.count("*").alias("rows"), F.count_if("_loops").alias("loops")), "connect-by")
        if facts.get["loops"] and not nocycle:
            raise ValueError("the hierarchy runs in a circle")
        if not facts.get["rows"] and levels:
            break
        levels.append(level)
        if len(levels) > MAX_LEVEL:
            raise ValueError(f"more than {MAX_LEVEL} levels")
        up = level.filter("NOT _loops").select(F.struct(*own, "level").alias("prior"), F.col("_key").alias("_up"), F.col("root").alias("_root"), F.col("path").alias("_path"), F.col("_seen").alias("_up_seen"), F.col("sort_path").alias("_up_sort"))
        on = reduce(lambda a, b: a & b, [base["_on"][f"k{i}"] == up["_up"][f"k{i}"] for i in range(len(keys))])
        down = base.join(up, on)
        if condition is not None:
            down = down.filter(condition)
        level = down.select(*[base[c] for c in own], base["_key"], (F.col("prior.level") + 1).alias("level"), F.col("_root").alias("root"), F.concat("_path", F.lit(separator), "_text").alias("path"), F.concat("_up_seen", F.array("_key")).alias("_seen"), F.concat("_up_sort", F.array(sort_key())).alias("sort_path"), F.array_contains("_up_seen", F.col("_key")).alias("_loops"), F.col("_up").alias("_above"))
    found = reduce(DataFrame.unionAll, levels)
    # what a row has below it, and whether one of that closes a circle
    below = found.filter("level > 1").select(F.slice("_seen", 1, F.size("_seen") - 1).alias("_line"), "_loops").groupBy("_line").agg(F.count_if(~F.col("_loops")).alias("_children"), F.count_if("_loops").alias("_rings"))
    out = found.filter("NOT _loops").join(below, F.col("_seen") == F.col("_line"), "left")
    leaf = (F.coalesce("_children", F.lit(0)) == 0).cast("int")
    return out.select(*own, "level", "root", "path", leaf.alias("is_leaf"), (F.coalesce("_rings", F.lit(0)) > 0).cast("int").alias("is_cycle"), "sort_path")
