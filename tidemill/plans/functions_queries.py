"""Scalar functions by category."""

from pyspark.sql import functions as F

from tidemill.functions import dates, jsons, nulls, numbers, strings
from tidemill.plans.registry import query


@query("""SELECT p_partkey, abs(p_size - 25) AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, round(exp(p_size / 10.0), 4) AS e, round(ln(p_retailprice), 6) AS l, round(log10(p_retailprice) / log10(2), 6) AS l2,
round(pow(p_size, 1.5), 4) AS p, sign(p_size - 25) AS s, round(sqrt(p_retailprice), 6) AS q, trunc(p_retailprice * 10) / 10 AS t, round(p_retailprice, 1) AS r FROM part""")
def fn_math(t):
    s, p = F.col("p_size"), F.col("p_retailprice")
    r = F.round
    return t.part.select("p_partkey", F.abs(s - 25).alias("a"), F.ceil(p).cast("double").alias("c"), F.floor(p).cast("double").alias("f"), r(F.exp(s / 10.0), 4).alias("e"), r(F.log(p), 6).alias("l"), r(F.log(2.0, p), 6).alias("l2"),
                         r(F.pow(s, F.lit(1.5)), 4).alias("p"), F.signum(s - 25).cast("tinyint").alias("s"), r(F.sqrt(p), 6).alias("q"), numbers.trunc(p, 1).cast("double").alias("t"), r(p, 1).alias("r"))


@query("SELECT p_partkey, round(sin(p_size), 8) AS a, round(cos(p_size), 8) AS b, round(tan(p_size / 100.0), 8) AS c, round(asin(p_size / 100.0), 8) AS d, round(acos(p_size / 100.0), 8) AS e, round(atan(p_size), 8) AS f, round(atan2(p_size, 3), 8) AS g, round(tanh(p_size / 100.0), 8) AS h, round(radians(p_size), 8) AS i, round(pi(), 8) AS j FROM part")
def fn_trigonometry(t):
    s = F.col("p_size")
    h = s / 100.0
    return t.part.select("p_partkey", *[F.round(c, 8).alias(n) for n, c in zip("abcdefghij", (F.sin(s), F.cos(s), F.tan(h), F.asin(h), F.acos(h), F.atan(s), F.atan2(s, F.lit(3)), F.tanh(h), F.radians(s), F.pi()), strict=True)])


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_size ELSE p_size % (p_size % 5) END AS m, CASE WHEN p_size % 5 = 0 THEN NULL ELSE round(p_size / (p_size % 5), 6) END AS d, CAST(p_size AS BIGINT) * 2000000000 AS big FROM part")
def fn_mod_div(t):
    s = F.col("p_size")
    return t.part.select("p_partkey", numbers.mod(s, s % 5).alias("m"), F.round(numbers.divide(s, s % 5, zero_is_null=True), 6).alias("d"), numbers.multiply(s, F.lit(2000000000)).alias("big"))


@query("SELECT c_custkey, CAST(c_custkey // 16777216 AS VARCHAR) || '.' || CAST(c_custkey // 65536 % 256 AS VARCHAR) || '.' || CAST(c_custkey // 256 % 256 AS VARCHAR) || '.' || CAST(c_custkey % 256 AS VARCHAR) AS ip, c_custkey AS back FROM customer")
def fn_inet(t):
    ip = numbers.inet_ntoa(F.col("c_custkey"))
    return t.customer.select("c_custkey", ip.alias("ip"), numbers.inet_aton(ip).alias("back"))


@query("""SELECT p_partkey, ascii(p_name) AS a, length(p_name) AS n, strlen(p_name) AS nb, upper(p_name) AS u, lower(p_type) AS l, left(p_name, 4) AS lf, right(p_name, 4) AS rt, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp,
replace(p_type, 'E', '') AS re, reverse(p_name) AS rv, repeat('ab', 3) AS rp3, substr(p_name, 3, 5) AS s1, substr(p_name, -5, 3) AS s2, translate(p_brand, 'Bd#', 'bD') AS tr, concat_ws('|', p_brand, NULL, p_size) AS cw FROM part""")
def fn_strings(t):
    n, b, y = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    i = F.lit
    return t.part.select("p_partkey", F.ascii(n).alias("a"), F.length(n).cast("long").alias("n"), F.octet_length(n).cast("long").alias("nb"), F.upper(n).alias("u"), F.lower(y).alias("l"), F.left(n, i(4)).alias("lf"), F.right(n, i(4)).alias("rt"), F.lpad(b, 12, "*").alias("lp"), F.rpad(b, 12, "-").alias("rp"),
                         F.replace(y, i("E"), i("")).alias("re"), F.reverse(n).alias("rv"), F.repeat(i("ab"), 3).alias("rp3"), strings.substr(n, i(3), i(5)).alias("s1"), strings.substr(n, i(-5), i(3)).alias("s2"), F.translate(b, "Bd#", "bD").alias("tr"), F.concat_ws("|", b, i(None).cast("string"), F.col("p_size").cast("string")).alias("cw"))


@query("""SELECT p_partkey, instr(p_type, 'E') AS i1, ltrim(p_brand, 'Ba') AS t1, rtrim(p_brand, '123') AS t2, trim(p_brand, 'B1') AS t3, left(p_type, 2) || 'XX' || substr(p_type, 6) AS ins,
CASE WHEN position(' ' IN p_type) > 0 THEN split_part(p_type, ' ', 1) ELSE p_type END AS si, COALESCE(p_name, '') || COALESCE(NULL, '') AS cc FROM part""")
def fn_strings_dialect(t):
    b, y = F.col("p_brand"), F.col("p_type")
    return t.part.select("p_partkey", strings.instr(y, F.lit("E")).cast("long").alias("i1"), strings.ltrim(b, "Ba").alias("t1"), strings.rtrim(b, "123").alias("t2"), strings.trim(b, "B1").alias("t3"), strings.insert(y, F.lit(3), F.lit(3), F.lit("XX")).alias("ins"),
                         F.substring_index(y, " ", 1).alias("si"), nulls.concat(F.col("p_name"), F.lit(None)).alias("cc"))


@query("""SELECT p_partkey, len(regexp_extract_all(p_type, '[AEIOU]')) AS n, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS r, NULLIF(regexp_extract_all(p_type, '[A-Z]+')[2], '') AS second, CAST(CASE WHEN regexp_matches(p_type, '[AEIOU]') THEN length(regexp_extract(p_type, '^[^AEIOU]*')) + 1 ELSE 0 END AS INT) AS at FROM part""")
def fn_regexp(t):
    y = F.col("p_type")
    return t.part.select("p_partkey", strings.regexp_count(y, "[AEIOU]").cast("long").alias("n"), strings.regexp_replace(y, "[AEIOU]", "_").alias("r"), strings.regexp_substr(y, "[A-Z]+", occurrence=2).alias("second"), strings.regexp_instr(y, "[AEIOU]").cast("int").alias("at"))


@query("SELECT c_custkey, md5(c_name) AS m, upper(hex(c_name)) AS h, sha1(c_name) AS s, c_name AS back FROM customer")
def fn_hash_hex(t):
    n = F.col("c_name")
    return t.customer.select("c_custkey", F.md5(n).alias("m"), F.hex(n).alias("h"), F.sha1(n).alias("s"), F.decode(F.unhex(F.hex(n)), "UTF-8").alias("back"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS d, COALESCE(NULLIF(c_nationkey, 3), -1) AS nv, CASE WHEN NULLIF(c_nationkey, 3) IS NOT NULL THEN 'y' ELSE 'n' END AS n2, CASE WHEN NULLIF(c_nationkey, 3) IS NULL THEN NULL ELSE greatest(c_nationkey, 10) END AS g, CASE WHEN NULLIF(c_nationkey, 3) IS NULL THEN NULL ELSE least(c_nationkey, 10) END AS l, CAST(TRY_CAST(c_name AS DOUBLE) IS NOT NULL AS INT) AS num FROM customer")
def fn_conditional(t):
    k = F.nullif(F.col("c_nationkey"), F.lit(3))
    return t.customer.select("c_custkey", nulls.decode(F.col("c_mktsegment"), F.lit("BUILDING"), F.lit(1), F.lit("MACHINERY"), F.lit(2), F.lit(0)).alias("d"), F.nvl(k, F.lit(-1)).alias("nv"), nulls.nvl2(k, F.lit("y"), F.lit("n")).alias("n2"), nulls.greatest(k, F.lit(10)).alias("g"), nulls.least(k, F.lit(10)).alias("l"), nulls.is_numeric(F.col("c_name")).alias("num"))


@query("""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, date_trunc('month', o_orderdate)::TIMESTAMP AS tm, date_trunc('year', o_orderdate)::TIMESTAMP AS ty,
last_day(o_orderdate)::TIMESTAMP AS ld, epoch(o_orderdate)::BIGINT AS u, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') AS c, o_orderdate + INTERVAL 36 HOUR AS p FROM orders""")
def fn_dates(t):
    d = F.col("o_orderdate")
    long = lambda c, n: c.cast("long").alias(n)
    return t.orders.select("o_orderkey", long(F.year(d), "y"), long(F.month(d), "m"), long(F.dayofmonth(d), "d"), long(F.quarter(d), "q"), dates.trunc(d, "MM").alias("tm"), dates.trunc(d, "YYYY").alias("ty"), dates.last_day(d).alias("ld"), F.unix_seconds(d.cast("timestamp")).alias("u"), dates.to_char(d, "YYYY/MM/DD HH24:MI:SS").alias("c"), dates.plus_days(d, F.lit(1.5)).alias("p"))


@query("""SELECT o_orderkey, CASE WHEN o_orderdate::DATE = last_day(o_orderdate) THEN last_day(o_orderdate + INTERVAL 1 MONTH)::TIMESTAMP ELSE o_orderdate + INTERVAL 1 MONTH END AS am, round(epoch(TIMESTAMP '1998-08-02' - o_orderdate) / 86400.0, 6) AS days,
datesub('month', o_orderdate, TIMESTAMP '1998-12-31 00:00:00') AS dm, datesub('day', o_orderdate, TIMESTAMP '1998-12-31 00:00:00') AS dd, o_orderdate AS back FROM orders WHERE o_orderdate <= TIMESTAMP '1998-12-31 00:00:00'""")
def fn_dates_dialect(t):
    d = F.col("o_orderdate")
    end = F.lit("1998-12-31 00:00:00").cast("timestamp_ntz")
    return t.orders.filter(d <= end).select("o_orderkey", dates.add_months(d, F.lit(1)).alias("am"), F.round(dates.minus(F.lit("1998-08-02").cast("timestamp_ntz"), d), 6).alias("days"), dates.timestampdiff("MONTH", d, end).alias("dm"), dates.timestampdiff("DAY", d, end).alias("dd"), dates.to_date(dates.to_char(d, "YYYY-MM-DD HH24:MI:SS")).alias("back"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS v, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n, json_exists(props, '$.k') AS ex, json_valid(props) AS ok, '[' || json_extract(props, '$.k')::VARCHAR || ']' AS w FROM events")
def fn_json(t):
    p = F.col("props")
    return t.events.select("event_id", jsons.json_value(p, "$.k").alias("v"), jsons.json_value(p, "$.k", "bigint").alias("n"), jsons.json_exists(p, "$.k").alias("ex"), jsons.is_json(p).alias("ok"), jsons.json_query(p, "$.k", wrapper=True).alias("w"))


@query("SELECT event_id, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS o, '[\"' || event_type || '\",' || user_id || ']' AS a, 2 AS n FROM events")
def fn_json_build(t):
    a = jsons.json_array(F.col("event_type"), F.col("user_id"), F.lit(None))
    return t.events.select("event_id", jsons.json_object(id=F.col("event_id"), type=F.col("event_type")).alias("o"), a.alias("a"), F.json_array_length(a).alias("n"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '1' AS one, json_merge_patch(props::JSON, '{"gone":null,"b":2}'::JSON)::VARCHAR AS merged FROM events""")
def fn_json_merge_set(t):
    patched = jsons.json_mergepatch(F.col("props"), F.lit('{"gone":null,"b":2}'))
    merged = jsons.json_set(patched, F.lit("$.c.d"), F.lit("1"))
    return t.events.select("event_id", jsons.json_value(merged, "$.k", "bigint").alias("k"), jsons.json_value(merged, "$.c.d").alias("one"), patched.alias("merged"))


@query("""SELECT conv_id, i AS ord, json_extract_string(j, '$[' || (i - 1) || '].r') AS r, CAST(json_extract_string(j, '$[' || (i - 1) || '].t') AS BIGINT) AS t FROM
(SELECT conv_id, json_group_array(json_object('r', role, 't', turn)) AS j, count(*) AS n FROM (SELECT * FROM conversations ORDER BY conv_id, turn) GROUP BY conv_id), LATERAL (SELECT unnest(range(1, n + 1)) AS i)""")
def json_table(t):
    made = t.conversations.groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col("turn").isNull(), "turn", "role"))), lambda s: F.struct(s["role"].alias("r"), s["turn"].alias("t")))).alias("j"))
    out = jsons.json_table(made, "j", "$", {"r": ("string", "$.r"), "t": ("bigint", "$.t")}, ordinality="ord")
    return out.select("conv_id", F.col("ord").cast("long").alias("ord"), "r", "t")


@query("SELECT vec_id, len(embedding) AS n, round(embedding[1], 6) AS first, round(list_sum(embedding[2:4]), 5) AS part FROM embeddings")
def fn_arrays(t):
    e = F.col("embedding")
    return t.embeddings.select("vec_id", F.size(e).cast("long").alias("n"), F.round(F.element_at(e, 1).cast("double"), 6).cast("float").alias("first"), F.round(F.aggregate(F.slice(e, 2, 3), F.lit(0.0), lambda a, x: a + x), 5).alias("part"))


@query("SELECT vec_id, unnest(embedding[1:3]) AS v FROM embeddings")
def table_function_collection(t):
    return t.embeddings.select("vec_id", F.explode(F.slice("embedding", 1, 3)).alias("v"))


@query()
def fn_session(t):
    """Values of the session: rows only, they differ by run."""
    return t.spark.range(1).select(F.current_timestamp().alias("now"), F.localtimestamp().alias("local"), F.uuid().alias("guid"), F.rand(7).alias("r"), F.current_user().alias("who"), F.version().alias("version"), F.current_timezone().alias("zone"))


@query("SELECT event_id, CAST(event_id AS VARCHAR) AS s, CAST(CAST(value AS DECIMAL(18, 2)) AS DOUBLE) AS d, CAST(user_id AS INTEGER) AS i, hex(event_type) AS b FROM events")
def fn_conversion(t):
    return t.events.select("event_id", F.col("event_id").cast("string").alias("s"), F.col("value").cast("decimal(18,2)").cast("double").alias("d"), F.col("user_id").cast("int").alias("i"), F.hex(F.encode("event_type", "UTF-8")).alias("b"))
