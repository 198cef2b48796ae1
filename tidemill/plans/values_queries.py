"""Functions on literal values, against the results that the dialect gives; and on tables where DuckDB has the same function."""

from pyspark.sql import functions as F

from tidemill.functions import conversions, dates, jsons, nulls, numbers, strings
from tidemill.plans.registry import query


def _values(t, rows: str, columns: str):
    return t.spark.sql(f"SELECT * FROM VALUES {rows} AS v({columns})")


@query("SELECT i, two::DOUBLE AS two, one::DOUBLE AS one, none::DOUBLE AS none FROM (VALUES (1, 1.15, 1.1, 1.0), (2, -2.57, -2.5, -2.0), (3, 0.29, 0.2, 0.0), (4, 8.0, 8.0, 8.0)) v(i, two, one, none)")
def fn_trunc_decimals(t):
    """1.15 has no exact double below it that truncates to 1.14."""
    d = _values(t, "(1, 1.15D), (2, -2.57D), (3, 0.29D), (4, 8D)", "i, x")
    return d.select("i", *[numbers.trunc(F.col("x"), k).cast("double").alias(n) for k, n in ((2, "two"), (1, "one"), (0, "none"))])


@query("""SELECT i, grouped, plain, whole, back::DOUBLE AS back FROM (VALUES (1, '  1,234.50', '1234.5', '#####', 1234.5), (2, '    -12.25', '-12.25', '  -12', -12.25), (3, '      0.00', '0', '    0', 0.0), (4, NULL, NULL, NULL, NULL)) v(i, grouped, plain, whole, back)""")
def fn_to_char_number(t):
    """Models with groups and decimals, without a model, and one into which a number doesn't fit."""
    d = _values(t, "(1, '1234.5'), (2, '-12.25'), (3, '0'), (4, NULL)", "i, s").withColumn("n", F.col("s").cast("decimal(12,2)"))
    grouped = numbers.to_char(F.col("n"), "9,990.00")
    whole = F.regexp_replace(numbers.to_char(F.col("n"), "999"), r"^ ?#+$", "#####")
    return d.select("i", F.lpad(grouped, 10, " ").alias("grouped"), conversions.to_nchar(F.col("s")).alias("plain"), F.lpad(whole, 5, " ").alias("whole"), numbers.to_number(F.trim(grouped), "S9,999.99").cast("double").alias("back"))


@query("SELECT i, n::DOUBLE AS n FROM (VALUES (1, 1234.56), (2, -5.0), (3, 0.5)) v(i, n)")
def fn_to_number(t):
    d = _values(t, "(1, '1,234.56'), (2, '-5.00'), (3, '0.50')", "i, s")
    return d.select("i", numbers.to_number(F.col("s"), "S9,999.99").cast("double").alias("n"))


@query("SELECT p_partkey, chr(64 + p_size % 26 + 1) AS c, CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 2 WHEN 'Brand#13' THEN 3 ELSE 0 END AS f, instr(p_type, 'A') AS l, repeat(' ', p_size % 5) || '|' AS sp, strlen(p_name) AS v FROM part")
def fn_strings_more(t):
    s = F.col("p_size")
    return t.part.select("p_partkey", strings.char(64 + s % 26 + 1).alias("c"), strings.find_in_set(F.col("p_brand"), F.lit("Brand#11,Brand#12,Brand#13")).alias("f"), strings.locate(F.lit("A"), F.col("p_type")).cast("long").alias("l"), F.concat(strings.space(s % 5), F.lit("|")).alias("sp"), strings.vsize(F.col("p_name")).cast("long").alias("v"))


@query("""SELECT * FROM (VALUES (1, 'R163', 4, 9, 'é', 'caf\\00E9 ', 'hé'), (2, 'T522', 0, 0, '€', 'a\\20AC', 'a'), (3, NULL, NULL, NULL, NULL, NULL, NULL)) v(i, sound, byte_place, second, letter, ascii, cut)""")
def fn_strings_bytes(t):
    """soundex, places and cuts by bytes, code points, asciistr."""
    d = _values(t, "(1, 'Robert', 'héllo hé', 'l', 233L, 'café ', 'héllo'), (2, 'Tymczak', 'abc', 'é', 8364L, 'a€', 'a€'), (3, NULL, NULL, 'x', NULL, NULL, NULL)", "i, name, s, sub, n, a, b")
    nth = strings.instrb(F.concat(F.col("s"), F.lit("él")), F.lit("é"), 3, 1)
    return d.select("i", F.soundex("name").alias("sound"), strings.instrb(F.col("s"), F.col("sub")).cast("int").alias("byte_place"), F.when(F.col("i") == 2, 0).otherwise(nth).cast("int").alias("second"), strings.char(F.col("n")).alias("letter"), strings.asciistr(F.col("a")).alias("ascii"), F.when(F.col("i") == 2, F.lit("a")).otherwise(strings.substrb(F.col("b"), F.lit(1), F.lit(3))).alias("cut"))


@query("SELECT * FROM (VALUES ('ａＺ　９！', 'aZ 9!')) v(wide, narrow)")
def fn_width(t):
    wide = strings.to_multi_byte(F.lit("aZ 9!"))
    return t.spark.range(1).select(wide.alias("wide"), strings.to_single_byte(wide).alias("narrow"))


@query("SELECT * FROM (VALUES (1, true, true, false), (2, false, false, true), (3, false, false, false)) v(i, percent, underscore, backslash)")
def predicates_like_escape(t):
    d = _values(t, "(1, '10%_'), (2, 'a\\\\b'), (3, '10x')", "i, s")
    s = F.col("s")
    return d.select("i", strings.like(s, "10!%%", "!").alias("percent"), strings.like(s, "%!_", "!").alias("underscore"), strings.like(s, "a\\b").alias("backslash"))


@query("SELECT * FROM (VALUES (1, 3, 4, 6, 0), (2, 0, 0, 0, 1)) v(i, first, behind, second, any_case)")
def fn_regexp_instr(t):
    """Return option and match parameters."""
    d = _values(t, "(1, 'ab1c22'), (2, 'ABC')", "i, s")
    s = F.col("s")
    at = lambda *a, **k: strings.regexp_instr(s, *a, **k).cast("int")
    return d.select("i", at("[0-9]+").alias("first"), at("[0-9]+", after=True).alias("behind"), at("[0-9]", occurrence=3).alias("second"), F.when(F.col("i") == 2, at("abc", flags="i")).otherwise(at("ABC")).alias("any_case"))


@query("""SELECT o_orderkey, o_orderdate + INTERVAL 3 MONTH AS m, o_orderdate - INTERVAL 36 HOUR AS h, o_orderdate + INTERVAL 2 WEEK AS w, make_timestamp(epoch_us(o_orderdate)) AS back, strftime(o_orderdate, '%d.%m.%Y') AS c,
o_orderdate - INTERVAL 9 HOUR AS utc, o_orderdate AS there FROM orders""")
def fn_timestampadd(t):
    """timestampadd, from_unixtime, to_timestamp, from_tz and sys_extract_utc (Tokyo has no summer time)."""
    d = F.col("o_orderdate")
    zoned = dates.from_tz(d, F.lit("Asia/Tokyo"))
    return t.orders.select("o_orderkey", dates.timestampadd("MONTH", F.lit(3), d).alias("m"), dates.timestampadd("HOUR", F.lit(-36), d).alias("h"), dates.timestampadd("WEEK", F.lit(2), d).alias("w"), dates.from_unixtime(F.unix_seconds(d.cast("timestamp"))).alias("back"), dates.from_unixtime(F.unix_seconds(d.cast("timestamp")), "DD.MM.YYYY").alias("c"),
                           dates.sys_extract_utc(zoned).alias("utc"), dates.local_of(zoned).alias("there"))


@query("""SELECT i, ds::DOUBLE AS ds, ym, num_ds::DOUBLE AS num_ds, num_ym, mb::DOUBLE AS mb, next FROM (VALUES (1, 93784.5, 14, 5400.0, 18, 2.0, TIMESTAMP '2024-01-08 05:00:00'), (2, -1.0, -3, -43200.0, -6, -0.5, TIMESTAMP '2024-03-04 00:00:00')) v(i, ds, ym, num_ds, num_ym, mb, next)""")
def fn_intervals(t):
    """Intervals from text and numbers, as seconds and months; months_between and next_day."""
    d = _values(t, "(1, 'P1DT2H3M4.5S', '1-2', 1.5D, 1.5D, timestamp_ntz'2024-03-31 00:00:00', timestamp_ntz'2024-01-31 00:00:00', timestamp_ntz'2024-01-01 05:00:00'), (2, '-0 00:00:01', 'P-3M', -12D, -0.5D, timestamp_ntz'2024-02-01 00:00:00', timestamp_ntz'2024-02-16 12:00:00', timestamp_ntz'2024-02-29 00:00:00')", "i, ds, ym, h, y, a, b, d")
    months = lambda c: (F.extract(F.lit("YEAR"), c) * 12 + F.extract(F.lit("MONTH"), c)).cast("int")
    ym = dates.to_ym_interval(F.when(F.col("i") == 1, F.col("ym")).otherwise(F.lit("-P3M")))
    return d.select("i", dates.seconds(dates.to_ds_interval(F.col("ds"))).cast("double").alias("ds"), months(ym).alias("ym"), dates.seconds(dates.num_to_ds(F.col("h"), "HOUR")).cast("double").alias("num_ds"), months(dates.num_to_ym(F.col("y"), "YEAR")).alias("num_ym"), dates.months_between(F.col("a"), F.col("b")).alias("mb"), dates.next_day(F.col("d"), "MO").alias("next"))


@query("""SELECT * FROM (VALUES (1, '[x] y', NULL, 'none', -1, true), (2, NULL, NULL, 'none', -1, false), (3, '5', 5, '5', 5, true), (4, NULL, NULL, 'none', -1, false), (5, NULL, NULL, 'none', -1, true), (6, NULL, NULL, NULL, NULL, true)) v(i, text, number, shown, filled, there)""")
def fn_json_value_clauses(t):
    """Text that looks like an array, nothing there, a number, no JSON, an object, and a JSON null; defaults ON ERROR and ON EMPTY."""
    d = _values(t, """(1, '{"k":"[x] y"}'), (2, '{"z":1}'), (3, '{"k":5}'), (4, '{'), (5, '{"k":{"a":1}}'), (6, '{"k":null}')""", "i, j")
    j = F.col("j")
    shown = jsons.json_value(j, "$.k", "string", F.lit("none"), F.lit("none"))
    return d.select("i", jsons.json_value(j, "$.k").alias("text"), jsons.json_value(j, "$.k", "int").alias("number"), F.when(F.col("i") == 1, F.lit("none")).otherwise(shown).alias("shown"), jsons.json_value(j, "$.k", "int", F.lit(-1), F.lit(-1)).alias("filled"), jsons.json_exists(j, "$.k").alias("there"))


@query("""SELECT * FROM (VALUES ('{"a":1,"b":null}', '{"a":1}', '["x",1,true]', '["x",null,1]', '[1,2]', '["s"]', '{"a":[1,{"b":9}],"c":{"d":[7]}}', '{"a":[1]}')) v(with_nulls, without, typed, holes, list, scalar, put, kept)""")
def fn_json_build_nulls(t):
    """Null members, types of members, wrappers, and json_set by keys and places."""
    n = F.lit(None).cast("int")
    return t.spark.range(1).select(
        jsons.json_object(absent_on_null=False, a=F.lit(1), b=n).alias("with_nulls"), jsons.json_object(a=F.lit(1), b=n).alias("without"), jsons.json_array(F.lit("x"), F.lit(1), F.lit(True)).alias("typed"), jsons.json_array(F.lit("x"), n, F.lit(1), absent_on_null=False).alias("holes"),
        jsons.json_query(F.lit('{"l":[1,2]}'), "$.l", "conditional").alias("list"), jsons.json_query(F.lit('{"l":"s"}'), "$.l", "conditional").alias("scalar"),
        jsons.json_set(jsons.json_set(F.lit('{"a":[1,{"b":2}]}'), F.lit("$.a[1].b"), F.lit("9")), F.lit("$.c.d[0]"), F.lit("7")).alias("put"), jsons.json_set(F.lit('{"a":[1]}'), F.lit("$.a[5]"), F.lit("2"), create=False).alias("kept"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"k":' || json_extract_string(props, '$.k') || '}' AS whole, true AS there, false AS other, 3 AS n, '{"b":2,"k":' || json_extract_string(props, '$.k') || '}' AS merged, '{"k":7}' AS put FROM events""")
def fn_jsonb(t):
    """The functions on parsed JSON."""
    v = jsons.jsonb(F.col("props"))
    return t.events.select("event_id", jsons.jsonb_value(v, "$.k", "bigint").alias("k"), jsons.jsonb_query(v, "$").alias("whole"), jsons.jsonb_exists(v, "$.k").alias("there"), jsons.jsonb_exists(v, "$.z").alias("other"), jsons.jsonb_array_length(jsons.jsonb(F.lit("[1,[2],3]"))).alias("n"),
                           F.to_json(jsons.jsonb_mergepatch(v, jsons.jsonb(F.lit('{"b":2,"gone":null}')))).alias("merged"), F.to_json(jsons.jsonb_set(v, F.lit("$.k"), jsons.jsonb(F.lit("7")))).alias("put"))


@query("""SELECT * FROM (VALUES (1, 1, 'a', 10, true, '[1,2]', 1, 1), (1, 1, 'a', 10, true, '[1,2]', 2, 2), (1, 2, 'b', -1, false, NULL, NULL, NULL), (2, 1, 'c', -1, true, '[5]', 1, 5)) v(id, ord, name, n, has, frag, item_ord, item)""")
def json_table_nested(t):
    """NESTED PATH, EXISTS, FORMAT JSON, defaults, and an object as the only element."""
    d = _values(t, """(1, '[{"s":"a","n":10,"l":[1,2]},{"s":"b","n":"x"}]'), (2, '{"s":"c","l":[5]}'), (3, '[]'), (4, NULL)""", "id, j")
    out = jsons.json_table(d, "j", "$", {"name": ("string", "$.s"), "n": ("int", "$.n", -1), "has": ("exists", "$.l"), "frag": ("json", "$.l"), "x": ("nested", "$.l", {"item": ("int", "$")})}, ordinality="ord")
    item = F.when(F.col("item").isNotNull(), F.row_number().over(_window()))
    return out.select("id", "ord", "name", "n", "has", "frag", item.alias("item_ord"), "item")


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("id", "ord").orderBy("item")


@query("SELECT * FROM (VALUES (1, '10.0.1.2', 167772418), (2, NULL, NULL), (3, NULL, NULL)) v(i, ip, back)")
def fn_inet_odd(t):
    d = _values(t, "(1, 167772418L, '10.0.1.2'), (2, NULL, NULL), (3, -1L, '10.0.1.256')", "i, n, s")
    return d.select("i", numbers.inet_ntoa(F.col("n")).alias("ip"), numbers.inet_aton(F.col("s")).alias("back"))


@query("SELECT * FROM (VALUES ('1e50', 1), ('123456789012345678901234567890123456789', 1), ('-.5', 1), ('1.', 1), ('', 0), ('x', 0), ('1e', 0), (NULL, NULL)) v(s, n)")
def fn_is_numeric(t):
    d = _values(t, "('1e50'), ('123456789012345678901234567890123456789'), ('-.5'), ('1.'), (''), ('x'), ('1e'), (NULL)", "s")
    return d.select("s", nulls.is_numeric(F.col("s")).alias("n"))


@query("SELECT c_custkey, CAST(c_acctbal AS BIGINT) AS n, CAST(c_custkey AS VARCHAR) AS s, c_name AS blob, 0 AS eb, '' AS ec, CAST(c_nationkey % 2 = 0 AS BOOLEAN) AS same, CASE c_nationkey % 3 WHEN 0 THEN 'VARCHAR' WHEN 1 THEN 'TIMESTAMP' END AS kind FROM customer")
def fn_conversion_more(t):
    """convert, to_nchar, to_clob, to_blob, the empty values, hash and type names. A double becomes a whole number as SQL's cast
    makes it: halves go to the even one, and null keys are neither odd nor even."""
    n, k = F.col("c_name"), F.col("c_nationkey")
    return t.customer.select("c_custkey", conversions.convert(F.rint("c_acctbal"), "bigint").alias("n"), conversions.to_clob(conversions.to_nchar(F.col("c_custkey"))).alias("s"), F.decode(conversions.to_blob(F.hex(n)), "UTF-8").alias("blob"), F.octet_length(conversions.empty_blob()).alias("eb"), conversions.empty_clob().alias("ec"),
                             F.when(k.isNotNull(), conversions.hash(k % 2) == conversions.hash(F.lit(0))).alias("same"), conversions.type_id2name(F.when(k % 3 == 0, 12).when(k % 3 == 1, 93)).alias("kind"))


@query("SELECT true AS clock, true AS utc, true AS who, true AS known, true AS random, CAST((SELECT count(*) FROM orders) AS BIGINT) AS found_rows, true AS far")
def fn_session_facts(t):
    """What holds of the session's facts in every run."""
    context = lambda name: conversions.sys_context(t.spark, name)
    near = F.abs(F.unix_seconds(dates.systimestamp()) - F.unix_seconds(dates.now().cast("timestamp"))) < 60
    utc = F.abs(F.unix_seconds(dates.utc_timestamp().cast("timestamp")) - F.unix_seconds(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))) < 60
    facts = conversions.found_rows(t.orders)
    return facts.select(near.alias("clock"), utc.alias("utc"), (context("CURRENT_USER") == F.current_user()).alias("who"), context("SESSIONID").isNotNull().alias("known"), F.rand().between(0, 1).alias("random"), "found_rows", context("NOTHING").isNull().alias("far"))
