"""Document fingerprints by spot signatures.

A spot signature is a very common word (the anchor) with the chain of content words that follow it. The set of a
document's signatures is its fingerprint: boilerplate without running prose leaves few, and edits change few. Sets are
compared by Jaccard likeness. Since J(A, B) <= min(|A|, |B|) / max(|A|, |B|), sets are put into partitions by length such
that only sets of the same or of neighbouring partitions can reach the threshold, and within them only the rarest
signatures of a set are looked up.

Everything is DataFrame expressions. A document's neighbour comes from a window over buckets of ids, cut at quantiles, so
no task holds more than its bucket; an id (or no id) that very many rows have is cut by the hashes of their texts.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import read, shuffle_width, stored

#: Very common words of four languages.
ANCHORS = (
    "the of and to in a is that it for on as with was by be this are or from at an "
    "der die und das den ist zu mit von auf für nicht ein eine "
    "le la les et des du un une est dans que en pour qui "
    "el los las de y del se por con una al lo"
).split()
CHAIN = 2
#: Hex digits of a signature.
DIGITS = 12
#: Buckets of ids for each shuffle partition: several in a partition even out their sizes.
BUCKETS = 4
THRESHOLD = 0.8
SPLIT = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body of value, with value computed once: an expression named twice, or in a lambda, is else computed each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spot(*parts: Column) -> Column:
    """The signature of an anchor and its chain: hex digits of the MD5 of the words. Null words are none."""
    return F.left(F.md5(F.concat_ws(" ", *parts)), F.lit(DIGITS))


def signatures(words: Column, chain: int = CHAIN) -> Column:
    """The sorted distinct signatures of an array of words.

    A text with words but without any anchor has one signature, made of all its words; a text without words has none.
    Chains at the end of a text may be shorter, down to one content word.
    """
    def chained(w, places, content):
        def of_place(p, j):
            k = p - j  # content words before an anchor = its place - anchors before it
            return F.when(k < F.size(content), spot(F.get(w, p), *[F.get(content, k + c) for c in range(chain)]))

        spots = F.array_compact(F.transform(places, of_place))
        return F.when(F.size(spots) == 0, F.array(spot(w))).otherwise(F.array_sort(F.array_distinct(spots)))

    def of(w):
        places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(ANCHORS))
        content = F.filter(w, lambda x: ~x.isin(ANCHORS))
        return let(places, lambda p: let(content, lambda c: chained(w, p, c)))

    return let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(of(w)))


def fingerprint(sigs: Column) -> Column:
    """The signatures one after another."""
    return F.array_join(sigs, "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two signature sets; two empty sets are alike."""
    n, m = F.size(a), F.size(b)
    common = F.size(F.array_intersect(a, b))
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when((n == 0) | (m == 0), F.lit(0.0)).otherwise(common / (n + m - common))


def _constant(values: list, kind: str) -> Column:
    """A list of numbers (or of lists) as one literal, however long."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _count_under(cuts: list[int], x: Column, *, equal: bool) -> Column:
    """How many of the sorted cuts are less than x (or equal to it). Cuts are looked up in two steps, each over about the root
    of their number."""
    width = max(1, math.isqrt(len(cuts)))
    parts = [cuts[i : i + width] for i in range(0, len(cuts), width)] or [[]]

    def under(values: Column) -> Column:
        return F.size(F.filter(values, lambda c: (c <= x) if equal else (c < x)))

    coarse = _constant([part[0] for part in parts[1:]], "array<bigint>")
    return let(under(coarse), lambda g: g * width + under(F.get(_constant(parts, "array<array<bigint>>"), g)))


def with_next(docs: DataFrame, buckets: int | None = None) -> tuple[DataFrame, Window]:
    """Rows (doc_id, text, at, ghost) dealt into buckets, and the window in which lead() is the next document by ascending
    doc_id (after the last: the first). Rows with ghost = 1 are there to be seen by lead() and are to be dropped then.

    Rows without a doc_id come before all others. Documents of equal ids follow each other in the order of the hashes of their
    texts. Ids are dealt into buckets at approximate quantiles; an id with more rows than a bucket is split by those
    hashes, and so are the rows without an id. The driver gets one id and one hash a bucket. The first row of each bucket is
    also sent to the bucket before.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    total, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    buckets = buckets or max(64, BUCKETS * shuffle_width(docs.sparkSession))
    cuts = sorted(map(int, docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0] or []))
    none = -(-nulls * buckets // max(1, total))  # buckets of the rows without an id
    share = (F.shiftrightunsigned("hash", 34) / float(1 << 30))  # the hash's place among all hashes, 0 to 1
    order = F.col("hash") >= 0  # unsigned hashes in the order of signed ones: the upper half comes first
    share = F.when(order, share + 0.5).otherwise(share - 0.5)
    low, high = _count_under(cuts, F.col("doc_id"), equal=False), _count_under(cuts, F.col("doc_id"), equal=True)
    of = F.when(F.col("doc_id").isNull(), F.floor(share * none)).otherwise(F.lit(none) + low + F.floor(share * (high - low + 1))).cast("int")
    firsts = sorted((r[0], r[1][0], r[1][1]) for r in docs.select(of.alias("bucket"), F.struct("doc_id", "hash").alias("row")).groupBy("bucket").agg(F.min("row")).collect())

    place = {b: i for i, (b, _, _) in enumerate(firsts)}

    def by_bucket(value) -> Column:
        """value of each bucket's place among the buckets that have rows."""
        return F.get(_constant([value(place[b]) if b in place else None for b in range(none + len(cuts) + 1)], "array<bigint>"), F.col("bucket"))

    is_first = by_bucket(lambda i: firsts[i][1]).eqNullSafe(F.col("doc_id")) & (by_bucket(lambda i: firsts[i][2]) == F.col("hash"))
    here = F.struct(F.col("bucket").alias("at"), F.lit(0).alias("ghost"))
    there = F.struct(by_bucket(lambda i: firsts[i - 1][0]).cast("int").alias("at"), F.lit(1).alias("ghost"))
    sent = docs.withColumn("bucket", of).select("doc_id", "text", "hash", F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here))).alias("to"))
    rows = sent.select("doc_id", "text", "hash", "to.at", "to.ghost").repartition("at")
    return rows, Window.partitionBy("at").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "hash")


def edited(text: Column, following: Column) -> Column:
    """The last quarter (rounded down) of the code points replaced by the first as many of the next document."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.left(text, F.length(text) - quarter), F.left(following, quarter))


def fingerprints(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts are empty texts. A text without words has an empty fingerprint; two of these are alike (1), one and any
    other text are not (0). One document alone is its own next. Repeated rows give a row each. Rows without a doc_id come
    before all others, and rows of one doc_id in the order of the hashes of their texts.
    """
    rows, order = with_next(docs)
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("sigs", signatures(F.col("words"))).drop("words")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sigs", F.lead("sigs").over(order)).filter("ghost = 0")
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_words", words_of(F.col("edited"))).withColumn("edited_sigs", signatures(F.col("edited_words")))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def length_partition(n: Column, threshold: float = THRESHOLD) -> Column:
    """The partition of a set of n signatures. Borders grow by 1 / threshold, so that sets two or more partitions apart can't
    reach it."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.lit(math.log(1 / threshold))).cast("int")


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs a < b of documents with a likeness of threshold or more: a, b, likeness. Of documents with equal sets only the
    one with the smallest id takes part (`fingerprints` tells the copies: their fingerprints are equal).

    Partitions by set length: each set is looked up in its own partition and the next. Within them, two sets that reach the
    threshold share a signature among the n - ceil(threshold * n) + 1 rarest of each, so only these are joined on; then
    pairs whose lengths alone rule it out are dropped, and the rest compared. Texts without words match nothing.
    """
    sets = docs.select("doc_id", words_of(F.col("text")).alias("w")).select("doc_id", signatures(F.col("w")).alias("sigs")).filter("doc_id IS NOT NULL AND size(sigs) > 0")
    sets = stored(sets.groupBy("sigs").agg(F.min("doc_id").alias("doc_id")), "spot-sets")
    each = sets.select("doc_id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count("*").alias("often"))
    ranked = each.join(often, "sig").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("often", "sig"))).alias("by"))
    keep = F.col("n") - F.ceil(F.lit(threshold) * F.col("n")).cast("int") + 1
    rare = ranked.select("doc_id", "n", length_partition(F.col("n"), threshold).alias("part"), F.explode(F.transform(F.slice("by", F.lit(1), keep), lambda s: s["sig"])).alias("sig"))
    left = rare.select(F.col("doc_id").alias("a"), F.col("n").alias("an"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("part").alias("ap"))
    right = rare.select(F.col("doc_id").alias("b"), F.col("n").alias("bn"), "sig", "part")
    both = left.join(right, ["sig", "part"]).filter((F.col("a") != F.col("b")) & ((F.col("ap") < F.col("part")) | (F.col("a") < F.col("b"))))
    both = both.filter(F.least("an", "bn") >= F.lit(threshold) * F.greatest("an", "bn")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x, y = sets.select(F.col("doc_id").alias("a"), F.col("sigs").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("sigs").alias("y"))
    return both.join(x, "a").join(y, "b").select("a", "b", likeness(F.col("x"), F.col("y")).alias("likeness")).filter(F.col("likeness") >= threshold)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


def _oracle() -> str:
    anchors = ", ".join(f"'{a}'" for a in dict.fromkeys(ANCHORS))

    def sigs(text: str) -> str:
        ws = f"list_filter(string_split_regex(lower({text}), '{SPLIT}'), lambda x: x <> '')"
        return ws

    def spots(ws: str, places: str, content: str) -> str:
        chain = ", ".join(f"{content}[{places}[j] - j + {c + 1}]" for c in range(CHAIN))
        found = f"list_filter(list_transform(range(1, len({places}) + 1), lambda j: CASE WHEN {places}[j] - j < len({content}) THEN left(md5(concat_ws(' ', {ws}[{places}[j]], {chain})), {DIGITS}) END), lambda x: x IS NOT NULL)"
        return f"CASE WHEN len({ws}) = 0 THEN []::VARCHAR[] WHEN len({found}) = 0 THEN [left(md5(array_to_string({ws}, ' ')), {DIGITS})] ELSE list_sort(list_distinct({found})) END"

    def likeness(a: str, b: str) -> str:
        common = f"len(list_intersect({a}, {b}))"
        return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE CAST({common} AS DOUBLE) / (len({a}) + len({b}) - {common}) END"

    def step(name: str, before: str, w: str) -> str:
        """Words w and their signatures, as <w>_sigs."""
        return f"""{name}_p AS (SELECT *, list_filter(range(1, len({w}) + 1), lambda i: list_contains([{anchors}], {w}[i])) AS pl, list_filter({w}, lambda x: NOT list_contains([{anchors}], x)) AS ct FROM {before}),
{name} AS (SELECT * EXCLUDE (pl, ct), {spots(w, 'pl', 'ct')} AS {w}_sigs FROM {name}_p)"""

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt FROM d),
e AS (SELECT doc_id, t, nt, left(t, length(t) - length(t) // 4) || left(nt, length(t) // 4) AS ed FROM n),
w AS (SELECT *, {sigs('t')} AS a, {sigs('nt')} AS b, {sigs('ed')} AS c FROM e),
{step('sa', 'w', 'a')},
{step('sb', 'sa', 'b')},
{step('sc', 'sb', 'c')}
SELECT doc_id, length(t) AS n_chars, sha256(ed) AS edited_sha256, array_to_string(a_sigs, '') AS fingerprint, array_to_string(c_sigs, '') AS edited_fingerprint,
{likeness('a_sigs', 'c_sigs')} AS near_edited, {likeness('a_sigs', 'b_sigs')} AS near_next FROM sc"""


ORACLE = _oracle()
