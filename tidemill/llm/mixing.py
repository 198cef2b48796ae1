"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

Token shares of the sources are raised to an exponent and normalised. The exponent is bisected until the weights meet a
target entropy, or until no source is repeated more often than a limit. The weights are then realised: each source gets
whole epochs and one partial epoch, in which its documents come in an order that permutes blocks, and documents within a
block, until the source's token budget is spent.

All work on documents is DataFrame expressions. No text is shuffled: what decides on a document is its own hash and a
row for its source. Within a source, sums run over blocks (a bounded number of documents each), then over the documents
of one block, so a source with most of the rows is no single task's work.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import read, stored

#: Exponents that are tried in one pass over the sources' sums, and how often the interval is cut.
WAYS = 32
ROUNDS = 8


@dataclass(frozen=True)
class Mix:
    exponent: float
    log_total: float  # log of the sum of powers
    budget_tokens: float
    smallest: float
    largest: float

    def weight(self, tokens: Column) -> Column:
        return F.when(tokens > 0, F.exp(F.lit(self.exponent) * F.log(tokens) - F.lit(self.log_total))).otherwise(F.lit(0.0))


def token_count(text: str = "text") -> Column:
    """White-space separated words; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A source as a string that is never null; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit("null"))


def _sums(per_source: DataFrame):
    """A function from exponents a to their (log sum n^a, entropy of n^a / sum), and the smallest and largest n. The sums stay
    a table, however many sources there are: each call is one pass over it."""
    n = F.col("source_tokens").cast("double")
    some = per_source.filter(n > 0)
    count, low, high = some.agg(F.count("*"), F.min(n), F.max(n)).first()
    if not count:
        return None, 0.0, 0.0

    def at(exponents: list[float]) -> list[tuple[float, float]]:
        tops = [max(a * math.log(low), a * math.log(high)) for a in exponents]  # keeps the powers finite
        powers = [F.exp(F.lit(a) * F.log(n) - F.lit(top)) for a, top in zip(exponents, tops, strict=True)]
        sums = some.agg(*[x for p in powers for x in (F.sum(p), F.sum(p * F.log(n)))]).first()
        return [(top + math.log(z), top + math.log(z) - a * zl / z) for a, top, z, zl in zip(exponents, tops, sums[::2], sums[1::2], strict=True)]

    return at, low, high


def solve(per_source: DataFrame, *, target_entropy: float | None = None, max_repetition: float | None = None, budget_tokens: float | None = None) -> Mix:
    """The exponent in [0, 1] nearest 0 under which the weights' entropy is at most the target (nats), or under which no
    source is seen more than max_repetition times. With budget_tokens=None the budget is the least under which every
    source is seen whole at least once. Where even exponent 1 repeats more often than the limit (the budget is more than
    max_repetition times all tokens), the exponent is 1. Both given: the larger exponent. Neither: 1.
    """
    at, low, high = _sums(per_source)
    if at is None:
        return Mix(1.0, 0.0, 0.0, 0.0, 0.0)

    def budget(a: float, log_z: float) -> float:
        return budget_tokens if budget_tokens is not None else math.exp(log_z + (1 - a) * math.log(high))

    def too_flat(a: float, log_z: float, entropy: float) -> bool:
        if target_entropy is not None and entropy > target_entropy + 1e-12:
            return True
        return max_repetition is not None and budget(a, log_z) * math.exp((a - 1) * math.log(low) - log_z) > max_repetition * (1 + 1e-12)

    if target_entropy is None and max_repetition is None:
        a = 1.0
    elif not too_flat(0.0, *at([0.0])[0]):
        a = 0.0
    else:
        lo, a = 0.0, 1.0  # too flat below, not above: the interval is cut at WAYS - 1 places at a time
        for _ in range(ROUNDS):
            tried = [lo + (a - lo) * i / WAYS for i in range(1, WAYS)]
            flat = [too_flat(x, *found) for x, found in zip(tried, at(tried), strict=True)]
            k = flat.index(False) if False in flat else len(tried)
            lo, a = ([lo, *tried][k], [*tried, a][k])
    log_z, _ = at([a])[0]
    return Mix(a, log_z, budget(a, log_z), low, high)


def _block_key(seed: int, epoch: Column) -> Column:
    return F.xxhash64(F.col("source_key"), F.col("block"), epoch, F.lit(seed))


def _own_key() -> Column:
    """What a document is dealt by: its id, or its text where it has none."""
    return F.xxhash64(F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("text"))).alias("own_key")


def _doc_key(seed: int, epoch: Column) -> Column:
    return F.xxhash64(F.col("own_key"), epoch, F.lit(seed), F.lit("doc"))


def _blocked(df: DataFrame, seed: int) -> DataFrame:
    return df.withColumn("block", F.pmod(F.xxhash64(F.col("own_key"), F.lit(seed)), F.col("blocks")))


def plan(docs: DataFrame, *, seed: int = 17, block_docs: int = 1024, **targets) -> tuple[DataFrame, DataFrame, DataFrame, Mix]:
    """Per document its tokens; per source its weight, epochs and where its partial epoch ends; per block its tokens."""
    light = stored(docs.select("doc_id", _own_key(), _key(F.col("source")).alias("source_key"), token_count().alias("n_tokens")), "mix-tokens")
    per_source = light.groupBy("source_key").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("source_docs"))
    per_source = stored(per_source, "mix-sources")
    mix = solve(per_source, **targets)
    share = mix.weight(F.col("source_tokens"))
    repeats = F.when(F.col("source_tokens") > 0, share * F.lit(mix.budget_tokens) / F.col("source_tokens")).otherwise(F.lit(1.0))
    near = F.when(F.abs(repeats - F.round(repeats)) < 1e-9, F.round(repeats)).otherwise(repeats)
    per_source = per_source.select(
        "source_key", "source_tokens", share.alias("weight"), near.alias("repeats"), F.floor(near).alias("whole"),
        ((near - F.floor(near)) * F.col("source_tokens")).alias("part_tokens"), F.ceil(F.col("source_docs") / block_docs).alias("blocks"),
    )
    placed = _blocked(light.join(per_source.select("source_key", "blocks"), "source_key"), seed)
    per_block = stored(placed.groupBy("source_key", "block").agg(F.sum("n_tokens").alias("block_tokens")), "mix-blocks")
    order = Window.partitionBy("source_key").orderBy("block_key", "block")
    cut_block = (
        per_block.join(per_source.select("source_key", "whole", "part_tokens"), "source_key").filter("part_tokens > 0")
        .withColumn("block_key", _block_key(seed, F.col("whole")))
        .withColumn("before", F.sum("block_tokens").over(order) - F.col("block_tokens"))
        .filter("before < part_tokens").groupBy("source_key")
        .agg(F.max_by(F.struct("block_key", "block", "before"), F.struct("block_key", "block")).alias("cut"))
        .select("source_key", F.col("cut.block_key").alias("cut_block_key"), F.col("cut.block").alias("cut_block"), F.col("cut.before").alias("cut_before"))
    )
    ends = per_source.join(cut_block, "source_key", "left")
    inside = (
        placed.join(ends.select("source_key", "whole", "part_tokens", "cut_block", "cut_before"), "source_key").filter("block = cut_block")
        .withColumn("doc_key", _doc_key(seed, F.col("whole")))
    )
    run = Window.partitionBy("source_key").orderBy("doc_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut_doc = inside.withColumn("before", F.col("cut_before") + F.sum("n_tokens").over(run) - F.col("n_tokens")).filter("before < part_tokens").groupBy("source_key").agg(F.max("doc_key").alias("cut_doc_key"))
    ends = stored(ends.join(cut_doc, "source_key", "left").drop("cut_before"), "mix-ends")
    return light, ends, per_block, mix


def _epochs(df: DataFrame, seed: int) -> DataFrame:
    """A row for each time that a document is seen: epochs 0 ... whole-1, and the partial one where it reaches it."""
    bk, dk = _block_key(seed, F.col("whole")), _doc_key(seed, F.col("whole"))
    first = (bk < F.col("cut_block_key")) | ((bk == F.col("cut_block_key")) & ((F.col("block") < F.col("cut_block")) | ((F.col("block") == F.col("cut_block")) & (dk <= F.col("cut_doc_key")))))
    seen = F.col("whole") + F.coalesce(first.cast("long"), F.lit(0))
    return _blocked(df, seed).withColumn("seen", seen).filter("seen > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("seen") - 1)))


def mix_documents(docs: DataFrame, *, seed: int = 17, **targets) -> DataFrame:
    """The documents, each as often as the mix sees it, with all their own columns and no others.

    Null sources are one source of their own. Documents without tokens cost nothing and are seen as often as their
    block's place says; a source without any token is seen once. Repeated rows are separate documents of the same place.
    """
    _, ends, _, _ = plan(docs, seed=seed, **targets)
    own = docs.columns
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), _own_key(), _key(F.col("source")).alias("source_key"))
    return _epochs(boxed.join(ends, "source_key"), seed).select("row.*")


def mix_schedule(docs: DataFrame, *, seed: int = 17, **targets) -> DataFrame:
    """One row for each time that a document is seen, with its place in the training order.

    Columns: doc_id, source, n_tokens, weight (of the source), repeats (epochs of the source), epoch, block, place.
    place lies in [0, 1): the share of the source's budget that is spent before the document's block; ordered by it, every
    stretch of the schedule holds the sources at their weights.
    """
    light, ends, per_block, _ = plan(docs, seed=seed, **targets)
    top = Window.partitionBy("source_key", "epoch").orderBy("block_key", "block").rowsBetween(Window.unboundedPreceding, -1)
    passes = (
        per_block.join(ends.select("source_key", "source_tokens", "whole", "part_tokens", "repeats"), "source_key")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - F.when(F.col("part_tokens") > 0, 0).otherwise(1))))
        .withColumn("block_key", _block_key(seed, F.col("epoch")))
        .withColumn("spent", F.col("epoch") * F.col("source_tokens") + F.coalesce(F.sum("block_tokens").over(top), F.lit(0)))
        .select("source_key", "block", "epoch", F.when(F.col("source_tokens") > 0, F.col("spent") / (F.col("repeats") * F.col("source_tokens"))).otherwise(F.lit(0.0)).alias("place"))
    )
    seen = _epochs(light.join(ends, "source_key"), seed)
    source = F.when(F.col("source_key") == "null", F.lit(None).cast("string")).otherwise(F.substring("source_key", 3, 1 << 30))
    return seen.join(passes, ["source_key", "block", "epoch"]).select("doc_id", source.alias("source"), "n_tokens", "weight", "repeats", "epoch", "block", "place")


#: Production parameters: no source is read more than twice, and every source is read whole at least once.
MAX_REPETITION = 2.0


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_schedule(read(spark, sf_dir, "documents"), max_repetition=MAX_REPETITION)
