"""The dialect's own rules on literal tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, TINY
from tidemill.functions import dates, jsons, nulls, numbers, strings
from tidemill.operators import dml, grouping, hierarchy, joins, limits
from tidemill.plans.registry import ORACLE_SQL, QUERIES
from tidemill.sources import tables
from tidemill.streaming import events


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lit(v, kind):
    return F.lit(v).cast(kind)


def test_nulls(spark):
    n = lit(None, "int")
    assert one(spark, nulls.greatest(F.lit(1), n), nulls.least(F.lit(1), n), nulls.greatest(F.lit(1), F.lit(2))) == (None, None, 2)
    assert one(spark, nulls.lnnvl(n == 1), nulls.lnnvl(F.lit(1) == 1), nulls.lnnvl(F.lit(1) == 2)) == (True, False, True)
    assert one(spark, nulls.decode(n, n, F.lit("null"), F.lit("other"))) == ("null",)
    assert one(spark, nulls.concat(F.lit("a"), lit(None, "string")), nulls.empty_as_null(F.lit(""))) == ("a", None)
    assert one(spark, nulls.is_numeric(F.lit("1.5")), nulls.is_numeric(F.lit("x"))) == (1, 0)


def test_numbers(spark):
    assert one(spark, numbers.mod(F.lit(7), F.lit(0)), numbers.divide(F.lit(1), F.lit(0), True), numbers.trunc(F.lit(-2.57), 1)) == (7, None, -2.5)
    assert one(spark, numbers.inet_aton(F.lit("10.0.1.2")), numbers.inet_ntoa(lit(167772418, "bigint"))) == (167772418, "10.0.1.2")
    assert one(spark, numbers.add(F.lit(2**31 - 1), F.lit(1))) == (2**31,)


def test_strings(spark):
    s = F.lit("abcabcabc")
    assert one(spark, strings.instr(s, F.lit("bc")), strings.instr(s, F.lit("bc"), 3), strings.instr(s, F.lit("bc"), 1, 3), strings.instr(s, F.lit("bc"), -1), strings.instr(s, F.lit("x"), 2)) == (2, 5, 8, 8, 0)
    assert one(spark, strings.to_single_byte(strings.to_multi_byte(F.lit("aZ 9!"))), strings.asciistr(F.lit("aé€\U0001f642"))) == ("aZ 9!", "a\\00E9\\20AC\\D83D\\DE42")
    assert one(spark, strings.regexp_substr(F.lit("a1b22c333"), "[0-9]+", occurrence=2), strings.regexp_instr(F.lit("a1b22c333"), "[0-9]+", occurrence=3), strings.regexp_count(F.lit("AbaB"), "b", flags="i"), strings.regexp_substr(F.lit("x"), "y")) == ("22", 7, 2, None)
    assert one(spark, strings.substrb(F.lit("héllo"), F.lit(1), F.lit(3))) == ("hé",)


def test_dates(spark):
    def ts(s):
        return lit(s, "timestamp_ntz")

    at = dt.datetime
    assert one(spark, dates.add_months(ts("2024-02-29 10:00:00"), F.lit(1)), dates.add_months(ts("2024-01-31 00:00:00"), F.lit(1)), dates.add_months(ts("2024-01-15 01:02:03"), F.lit(-1.5))) == (at(2024, 3, 31, 10), at(2024, 2, 29), at(2023, 11, 15, 1, 2, 3))
    assert one(spark, dates.minus(ts("2024-01-02 12:00:00"), ts("2024-01-01")), dates.plus_days(ts("2024-01-01"), F.lit(0.25))) == (1.5, at(2024, 1, 1, 6))
    assert one(spark, dates.next_day(ts("2024-01-01 05:00:00"), 1), dates.next_day(ts("2024-01-01 05:00:00"), "TU")) == (at(2024, 1, 7, 5), at(2024, 1, 2, 5))
    assert one(spark, dates.timestampdiff("MONTH", ts("2024-01-31"), ts("2024-02-29")), dates.timestampdiff("MONTH", ts("2024-01-15"), ts("2024-03-15")), dates.timestampdiff("WEEK", ts("2024-01-01"), ts("2024-01-20")), dates.timestampdiff("DAY", ts("2024-01-02"), ts("2024-01-01 01:00:00"))) == (0, 2, 2, 0)
    assert one(spark, dates.to_char(ts("2024-03-05 14:07:09"), 'YYYY"y"MM HH24:MI'), dates.to_date(F.lit("05/03/2024"), "DD/MM/YYYY")) == ("2024y03 14:07", at(2024, 3, 5))
    assert one(spark, dates.round_to(ts("2024-07-01"), "YYYY"), dates.round_to(ts("2024-01-16"), "MM"), dates.round_to(ts("2024-01-16 11:59:59"), "DD")) == (at(2025, 1, 1), at(2024, 2, 1), at(2024, 1, 16))
    assert one(spark, *[dates.seconds(dates.to_ds_interval(F.lit(x))) for x in ("1 02:03:04", "P1DT2H3M4S", "-0 00:00:01", "0 00:00:01.25", "PT0.5S")]) == (93784, 93784, -1, 1.25, 0.5)
    assert one(spark, *[dates.to_ym_interval(F.lit(x)).cast("string") for x in ("1-2", "-0-3", "P2Y")]) == ("INTERVAL '1-2' YEAR TO MONTH", "INTERVAL '-0-3' YEAR TO MONTH", "INTERVAL '2-0' YEAR TO MONTH")
    assert one(spark, dates.to_ds_interval(F.lit("x")).cast("string"), dates.to_ym_interval(F.lit("1")).cast("string")) == (None, None)
    assert one(spark, dates.num_to_ds(F.lit(1.5), "HOUR").cast("string"), dates.num_to_ym(F.lit(2), "YEAR").cast("string")) == ("INTERVAL '0 01:30:00' DAY TO SECOND", "INTERVAL '2-0' YEAR TO MONTH")


def test_json(spark):
    j = F.lit('{"a":{"b":1},"n":null,"l":[1,2]}')
    assert one(spark, jsons.json_value(j, "$.a.b", "int"), jsons.json_value(j, "$.a"), jsons.json_exists(j, "$.n"), jsons.json_exists(j, "$.z"), jsons.is_json(F.lit("{")), jsons.json_query(j, "$.l", True)) == (1, None, True, False, False, "[[1,2]]")
    assert one(spark, jsons.json_mergepatch(j, F.lit('{"a":null,"c":2}')), jsons.json_set(F.lit("{}"), F.lit("$.x.y"), F.lit("3"))) == ('{"n":null,"l":[1,2],"c":2}', '{"x":{"y":3}}')
    with pytest.raises(Exception, match="no scalar"):
        one(spark, jsons.json_value(j, "$.a", on_error="error"))


def test_not_in_and_quantifiers(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    some, hole, none = spark.createDataFrame([(2,)], "y int"), spark.createDataFrame([(2,), (None,)], "y int"), spark.createDataFrame([], "y int")
    assert [r.x for r in joins.not_in(left, "x", some, "y").collect()] == [1]
    assert joins.not_in(left, "x", hole, "y").count() == 0
    assert joins.not_in(left, "x", none, "y").count() == 3
    assert [r.x for r in joins.compare_all(left, "x", ">=", some, "y").collect()] == [2]
    assert joins.compare_all(left, "x", ">", none, "y").count() == 3
    assert [r.x for r in joins.compare_any(left, "x", "<", some, "y").collect()] == [1]


def test_dml(spark):
    t, s = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k int, v int"), spark.createDataFrame([(2, 5), (3, -1), (4, 40)], "k int, v int")
    merged = dml.merge(t, s, ["k"], {"v": F.col("v") + F.col("s_v")}, F.col("s_v") < 0, {"k": F.col("s_k"), "v": F.col("s_v")})
    assert sorted(map(tuple, merged.collect())) == [(1, 10), (2, 25), (4, 40)]
    assert sorted(map(tuple, dml.merge(t, s, ["k"], {"v": F.lit(0)}).collect())) == [(1, 10), (2, 0), (3, 0)]
    assert sorted(map(tuple, dml.replace_into(t, s, ["k"]).collect())) == [(1, 10), (2, 5), (3, -1), (4, 40)]
    assert sorted(map(tuple, dml.update(t, {"v": F.lit(0)}, F.when(F.col("k") > 1, True)).collect())) == [(1, 10), (2, 0), (3, 0)]
    assert dml.delete(t, F.lit(None).cast("boolean")).count() == 3
    assert sorted(map(tuple, dml.update_from(t, s, ["k"], {"v": F.col("s_v")}).collect())) == [(1, 10), (2, 5), (3, -1)]


def test_dml_never_makes_two_rows_of_one(spark):
    t = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    twice = spark.createDataFrame([(1, 1), (1, 2), (3, 3), (3, 4), (None, 5), (None, 6)], "k int, v int")
    for bad in (lambda: dml.merge(t, twice, ["k"], {"v": F.col("s_v")}), lambda: dml.merge(t, twice, [F.col("k") == F.col("s_k")], {"v": F.col("s_v")}), lambda: dml.update_from(t, twice, ["k"], {"v": F.col("s_v")}), lambda: dml.upsert(t, twice.filter("k = 1"), ["k"], {"v": F.col("s_v")})):
        with pytest.raises(Exception, match="several source rows"):
            bad().collect()
    new = {"k": F.col("s_k"), "v": F.col("s_v")}
    for on in (["k"], [F.col("k") == F.col("s_k")]):
        rest = dml.merge(t, twice.filter("k IS NULL OR k = 3"), on, {"v": F.lit(0)}, None, new)
        assert sorted(map(tuple, rest.collect()), key=str) == sorted([(1, 10), (2, 20), (3, 3), (3, 4), (None, 5), (None, 6)], key=str)
    assert sorted(map(tuple, dml.replace_into(t, twice.filter("k = 1"), ["k"]).collect())) == [(1, 2), (2, 20)]
    assert sorted(map(tuple, dml.insert_ignore(t, twice.filter("k IS NOT NULL"), ["k"]).collect())) == [(1, 10), (2, 20), (3, 3)]
    merged = dml.merge(t, spark.createDataFrame([(9, 2, 7)], "a int, b int, v int"), [F.col("k") == F.col("s_a"), F.col("k") == F.col("s_b")], {"v": F.col("s_v")}, F.lit(False), None)
    assert sorted(map(tuple, merged.collect())) == [(1, 10), (2, 7)]


def test_windows_in_cells(spark):
    """Hot keys cut into ranges give what one window gives."""
    from pyspark.sql import Window

    from tidemill.operators import windows

    rows = [(i % 3 and 1, i * 7 % 1000, i if i % 11 == 0 else None) for i in range(1000)]
    t = spark.createDataFrame(rows, "k int, at long, v int").dropDuplicates(["k", "at"])
    w = Window.partitionBy("k").orderBy("at")
    want = t.withColumn("seen", F.last_value("v", ignoreNulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.count("*").over(w.rangeBetween(-40, 0)))
    got = windows.count_within(windows.last_known(t, ["k"], "at", "v", "seen", rows=20), ["k"], "at", 40, "n")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_scalar_subqueries(spark):
    t = spark.createDataFrame([(1,), (2,)], "x int")
    assert [r.v for r in joins.scalar(t.filter("x = 1"), "v").collect()] == [1]
    assert [r.v for r in joins.scalar(t.filter("x = 9"), "v").collect()] == [None]
    with pytest.raises(Exception, match="more than one row"):
        joins.scalar(t, "v").collect()


def test_set_types():
    from pyspark.sql import types as T

    from tidemill.operators.sets import common_type

    assert common_type(T.IntegerType(), T.LongType()) == T.LongType()
    assert common_type(T.DecimalType(10, 3), T.LongType()) == T.DecimalType(23, 3)
    assert common_type(T.DecimalType(38, 0), T.DecimalType(10, 5)) == T.DecimalType(38, 0)
    assert common_type(T.DateType(), T.TimestampNTZType()) == T.TimestampNTZType()
    assert common_type(T.StringType(), T.IntegerType()) == T.StringType()
    assert common_type(T.NullType(), T.BinaryType()) == T.BinaryType()
    with pytest.raises(TypeError):
        common_type(T.BinaryType(), T.StringType())


def test_partitions_are_pruned(spark):
    plan = QUERIES["partition_scan"](spark, TINY)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(y" in plan


def test_hierarchy(spark):
    ring = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "node int, up int")
    with pytest.raises(ValueError, match="circle"):
        hierarchy.connect_by(ring, "node", "up", F.col("node") == 1)
    deep = spark.createDataFrame([(i, i - 1 if i else None) for i in range(6)], "node int, up int")
    found = hierarchy.connect_by(deep, "node", "up", F.col("up").isNull(), separator=">")
    assert found.orderBy("level").collect()[-1].path == ">0>1>2>3>4>5"
    with pytest.raises(Exception, match="separator"):
        hierarchy.connect_by(deep.withColumn("name", F.lit("a>b")), "node", "up", F.col("up").isNull(), show="name", separator=">").collect()
    wide = spark.createDataFrame([(0, None, None), (1, 0, 5), (2, 0, None), (3, 0, 7)], "node int, up int, weight int")
    for order, want in (("weight", [0, 1, 3, 2]), ("weight DESC", [0, 2, 3, 1])):
        found = hierarchy.connect_by(wide, "node", "up", F.col("up").isNull(), siblings=order)
        assert [r.node for r in found.orderBy("sort_path").collect()] == want


def test_limits_and_sets(spark):
    t = spark.createDataFrame([(3,), (None,), (1,)], "x int")
    assert [r.x for r in limits.ordered(t, "x").collect()] == [1, 3, None]
    assert [r.x for r in limits.ordered(t, "x DESC").collect()] == [None, 3, 1]
    assert sorted(r.rownum for r in limits.rownum(t, "x").collect()) == [1, 2, 3]
    assert grouping.cartesian_sets([("a",), ()], [("b",), ()]) == [("a", "b"), ("a",), ("b",), ()]


def test_text_tables(spark, tmp_path):
    (tmp_path / "in.txt").write_text("1, 2.5,a\n2,,\n,,\n")
    t = tables.external(spark, f"file://{tmp_path}/in.txt", "i int, d double, s string")
    assert [tuple(r) for r in t.collect()] == [(1, 2.5, "a"), (2, None, None), (None, None, None)]
    tables.dump(t, f"file://{tmp_path}/out")
    assert tables.external(spark, f"file://{tmp_path}/out", "i int, d double, s string", enclosed='"').count() == 3


def test_stream(spark, tmp_path):
    source = f"file://{tmp_path}/events"
    rows = [(i, dt.datetime(2024, 1, 1, i % 3), i % 2, "a", 1.0) for i in range(12)] + [(0, dt.datetime(2024, 1, 1), 0, "a", 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(source)
    batch = events.windowed_counts(spark.read.parquet(source).dropDuplicates(["event_id"]))
    assert sorted(r.n for r in batch.collect()) == [4, 4, 4]
    # windows that the watermark has passed are out; the repeated event counts once
    late = [(100 + i, dt.datetime(2024, 1, 5 + i), 0, "a", 1.0) for i in range(3)]
    spark.createDataFrame(late, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.mode("append").parquet(source)
    parquet = events.windowed_counts(events.deduplicated(events.event_stream(spark, source)), late=None)
    out = f"file://{tmp_path}/out"
    parquet.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start().awaitTermination()
    done = sorted((r.start.day, r.n) for r in spark.read.parquet(out).collect())
    assert done[:3] == [(1, 4)] * 3 and all(n == 1 for _, n in done[3:])


def test_unpivot_measures_of_all_orders(spark):
    found = QUERIES["unpivot_measures_whole"](spark, TINY)
    assert found.count() == 2 * spark.read.parquet(f"{TINY}/lineitem.parquet").count()


def against_sql(spark, folder, name, **odd):
    """A query over odd tables, and what its SQL gives over the same."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table, df in odd.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    return sorted(map(str, map(tuple, got.collect()))), sorted(map(str, want))


def test_conversions_of_halves_and_nulls(spark, tmp_path):
    balances = [0.5, 1.5, 2.5, -0.5, -2.5, -3.5, 4278.5, 0.49999999999999994, 4503599627370497.5, None]
    rows = [(i, f"c{i}", None if i == 3 else i - 4, b, "S") for i, b in enumerate(balances)]
    got, want = against_sql(spark, tmp_path, "fn_conversion_more", customer=spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"))
    assert got == want


def test_counts_within_are_linear(spark, tmp_path):
    """Null and equal times, and frames over many ranges of a key's rows; no frame is summed anew for each row."""
    from pyspark.sql import Window

    from tidemill.operators import windows

    day = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 17 == 0 else day + dt.timedelta(minutes=i * i % 997), i, None if i % 5 == 0 else "ab"[i % 2], 1.0, "{}") for i in range(400)]
    got, want = against_sql(spark, tmp_path, "window_range_interval", events=spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"))
    assert got == want
    t = spark.createDataFrame([(i % 4 or None, None if i % 13 == 0 else i * i % 500, i) for i in range(1500)], "k int, at long, id int")
    w = Window.partitionBy("k").orderBy(F.col("at").asc_nulls_last())
    for width in (0, 1, 40, 10_000):
        found = windows.count_within(t, ["k"], "at", width, "n", rows=20)
        assert sorted(map(str, found.collect())) == sorted(map(str, t.withColumn("n", F.count("*").over(w.rangeBetween(-width, 0))).collect()))
    frames = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RowFrame, unboundedpreceding$(), currentrow$()" in frames and "RangeFrame" not in frames


def test_frames_are_dealt_by_rows(spark):
    """What a task of the frames sorts is bounded by rows: partitions by key, as many as the rows need, and not merged."""
    from tidemill.operators import windows

    t = spark.range(1000).select((F.col("id") % 100).alias("k"), "id")
    found = windows.dealt(t, ["k"], rows=20).select("k", "id", F.sum("id").over(windows.frame("range", ["k"], ["id"], -100, None)).alias("s"), F.spark_partition_id().alias("p"))
    assert found.select("p").distinct().count() > 30
    w = windows.frame("range", ["k"], ["id"], -100, None)
    assert sorted(map(tuple, found.drop("p").collect())) == sorted(map(tuple, t.select("k", "id", F.sum("id").over(w)).collect()))
    for kind in ("rows", "range"):
        plan = QUERIES[f"window_frames_{kind}"](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(l_suppkey") == plan.count("REPARTITION_BY_NUM") == plan.count("Exchange ") == 1


def test_json_table_of_missing_turns(spark, tmp_path):
    """A missing turn stands last; missing roles and conversations are kept."""
    rows = [(1, 2, "b"), (1, None, "last"), (1, 1, "a"), (None, 1, "x"), (None, 0, None), (2, None, None), (2, 10, 'q"\\é'), (2, 9, "n")]
    got, want = against_sql(spark, tmp_path, "json_table", conversations=spark.createDataFrame([(*r, "t") for r in rows], "conv_id long, turn long, role string, text string"))
    assert got == want
