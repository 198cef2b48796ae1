"""N-gram Jaccard join by a MinHash LSH forest.

Each document is the set of its five-word shingles. TREES tries hold it, each under a label of FULL_DEPTH MinHash values;
labels are byte strings, so a prefix of a label is a prefix of bytes. Documents whose labels match in a prefix in some trie are
candidates, and candidates are verified on the exact sets of hashed shingles.

Matching begins with the longest prefixes. What a document's verified links say about their own likeness tells how many more
a prefix of that length has missed (a link of likeness s is found with probability 1 - (1 - s^depth)^TREES); a link at the
threshold that isn't seen at all is reckoned with as well. Documents whose estimated recall falls short of the target are
matched again by shorter prefixes, and so on down to the length under which even links at the threshold are found with the
target recall. A pair is looked at where its match is met first, as long as either of the two is still being matched; nodes
of a trie that have one child only, or whose documents are all done, are passed by.

How the work is dealt out. Equal sets are one representative from the first step on. Documents that share a shortest prefix
are put into chunks, once for all lengths, of about CHUNK documents and CHUNK_BYTES; the units of work are pairs of chunks
that share a prefix, so no pair of documents is ever a row: a unit counts its links and hands on at most one edge a document,
enough to connect what it has linked. A group of m different near copies is (m / CHUNK)^2 / 2 units over all executors, and a
set is sent once for each unit of its chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.chunks import groups
from tidemill.llm.common import alone, batches, bucketed, drop, joined, mix, read, shuffle_width, stored, word_hashes
from tidemill.llm.graph import components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 32
FULL_DEPTH = 8
TARGET_RECALL = 0.9999
CHUNK = 512
CHUNK_BYTES = 32 << 20
#: Characters that are hashed together: what they need is small and stays in the processor's cache.
CHARS = 120_000
WIDE = 1  # bytes of a MinHash value in a label: unequal values pass for equal ones now and then, which costs a comparison


def recall_at(likeness, depth: int, trees: int = TREES):
    """The probability that two sets of this likeness match in a prefix of this length in some trie."""
    return 1 - (1 - likeness**depth) ** trees


def depths_for(threshold: float, target: float = TARGET_RECALL, trees: int = TREES) -> list[int]:
    """Prefix lengths in the order in which they are tried, from the full one to the longest under which a link at the
    threshold, the hardest to find, is found with the target recall."""
    depth = FULL_DEPTH
    while depth > 1 and recall_at(threshold, depth, trees) < target:
        depth -= 1
    return list(range(FULL_DEPTH, depth - 1, -1))


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingle_sets(texts: list[str], n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's n-word shingles.

    Words are runs of letters and digits (and of anything beyond ASCII) of the lower-cased text. A text of fewer than n
    words is one shingle; a text without words has none.
    """
    raw = [t.lower().encode() for t in texts]
    buf, starts, lengths = joined(raw)
    begin, _, words = word_hashes(buf)
    first, past = np.searchsorted(begin, starts), np.searchsorted(begin, starts + lengths)
    m = max(0, len(words) - n + 1)
    rolled = np.zeros(m, np.uint64)
    for j in range(n):
        rolled += words[j : j + m] * _MIX[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first.tolist(), past.tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _MIX[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_RNG = np.random.default_rng(20)
_FACTORS = (_RNG.integers(0, 1 << 31, TREES * FULL_DEPTH, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFTS = _RNG.integers(0, 1 << 32, TREES * FULL_DEPTH, dtype=np.uint32)


def minhash(shingles: np.ndarray, count: int = TREES * FULL_DEPTH) -> np.ndarray:
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(count, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 2048):
        out = np.minimum(out, (low[None, k : k + 2048] * _FACTORS[:count, None] + _SHIFTS[:count, None]).min(1))
    return out


def labels(shingles: np.ndarray) -> bytes:
    """The labels in all tries, one after another: of each value the lowest byte (the highest ones of a minimum say little)."""
    return minhash(shingles).astype(np.uint8).tobytes()


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), digest (of the shingle set; null without shingles), labels, size (of the set)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [t or "" for t in part.column("text").to_pylist()]
            digests, found, sizes = [], [], []
            for own in groups(texts, CHARS):
                for s in shingle_sets([texts[i] for i in own]):
                    sizes.append(len(s))
                    digests.append(_digest(s) if len(s) else None)
                    found.append(labels(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(digests, pa.binary()), pa.array(found, pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "text_key", "digest", "labels", "size"])

    batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return own.mapInArrow(alone(run), "doc_id long, text_key long, digest binary, labels binary, size long")


def _prefix(tree, depth: int):
    """The first `depth` values of a document's label in a trie; no two tries share one."""
    return F.xxhash64(tree, F.substring(F.col("labels"), tree * (WIDE * FULL_DEPTH) + 1, F.lit(WIDE * depth)))


def _placed(reps: DataFrame, depth: int, before: int | None, *columns: str) -> DataFrame:
    """A row for each document and trie: the prefix of this length, and the longer one (`inner`) that was tried before."""
    trees = F.sequence(F.lit(0), F.lit(TREES - 1))
    inner = (lambda t: _prefix(t, before)) if before else (lambda t: F.lit(0).cast("long"))
    return reps.select(*columns, F.explode(F.transform(trees, lambda t: F.struct(_prefix(t, depth).alias("label"), inner(t).alias("inner")))).alias("at")).select(*columns, "at.*")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set on the left shares with each on the right."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    if not len(both):
        return out
    sides = []
    for sets, flat in ((left, a), (right, b)):
        of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        hit = both[at] == flat
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], of[hit][order], len(sets)))
    for k in range(0, len(both), 4096):
        dense = []
        for at, of, n in sides:
            lo, hi = np.searchsorted(at, (k, k + 4096))
            m = np.zeros((n, min(4096, len(both) - k)), np.float32)
            m[of[lo:hi], at[lo:hi] - k] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def matched(values: list[np.ndarray], depth: int) -> np.ndarray:
    """Whether the documents on the left (rows) and on the right match in a prefix of this length in some trie. values: the
    labels of either side, documents x tries x values."""
    hashed = []
    for v in values:
        h = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), v.shape[:2])
        for j in range(depth):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + v[:, :, j])
        hashed.append(h)
    out = np.zeros((len(values[0]), len(values[1])), bool)
    for t in range(TREES):
        out |= hashed[0][:, t][:, None] == hashed[1][:, t][None, :]
    return out


def link_unit(rows: list[dict], threshold: float, depths: list[int], level: int) -> tuple[np.ndarray, np.ndarray, list[tuple[bytes, bytes]]]:
    """Of one unit's representatives (`side`: 0 and 1 for its two chunks, of which only pairs across count; all 0 for a chunk
    with itself): links of each (every copy of a linked one counts); how many more each prefix length is reckoned to have
    missed; and the edges of a forest over what is linked. A pair counts if it matches at this level and at none before,
    and if either of the two is open."""
    sides = np.array([r["side"] for r in rows])
    a, b = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    alone = not len(b)
    b = a if alone else b
    links, missed, edges = np.zeros(len(rows), np.int64), np.zeros((len(rows), len(depths))), []
    values = [np.stack([np.frombuffer(rows[i]["labels"], np.uint8).reshape(TREES, FULL_DEPTH).astype(np.uint64) for i in side]) if len(side) else np.zeros((0, TREES, FULL_DEPTH), np.uint64) for side in (a, b)]
    open_ = np.array([r["slot"] not in r["closed"] for r in rows])
    pairs = matched(values, depths[level]) & (open_[a][:, None] | open_[b][None, :])
    if level:
        pairs &= ~matched(values, depths[level - 1])
    if alone:
        np.fill_diagonal(pairs, False)
    if not pairs.any():
        return links, missed, edges
    sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    copies = np.array([r["copies"] for r in rows], np.int64)
    x, y = pairs.any(1), pairs.any(0)  # what no pair asks for isn't compared
    pairs, a, b, alone = pairs[x][:, y], a[x], b[y], alone and bool((x == y).all())
    both = overlaps([sets[i] for i in a], [sets[i] for i in b])
    likeness = both / np.maximum(sizes[a][:, None] + sizes[b][None, :] - both, 1)
    linked = pairs & (likeness >= threshold - 1e-6)
    np.add.at(links, a, linked @ copies[b])
    for j in range(level, len(depths)):
        short = np.where(linked, 1 / recall_at(np.minimum(likeness, 1.0).astype(np.float64), depths[j]) - 1, 0)
        np.add.at(missed[:, j], a, short @ copies[b])
        if not alone:
            np.add.at(missed[:, j], b, short.T @ copies[a])
    if not alone:
        np.add.at(links, b, linked.T @ copies[a])
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        u, v = root(int(a[i])), root(int(b[j]))
        if u != v:
            parent[u] = v
            edges.append((rows[a[i]]["rep"], rows[b[j]]["rep"]))
    return links, missed, edges


def _by_unit(parts: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of each unit, from batches that are sorted by it."""
    unit, rows = None, []
    for part in parts:
        for row in part.to_pylist():
            if (row["a"], row["b"]) != unit and rows:
                yield rows
                rows = []
            unit = (row["a"], row["b"])
            rows.append(row)
    if rows:
        yield rows


def _verified(dealt: DataFrame, threshold: float, depths: list[int], level: int) -> DataFrame:
    """rep, other (an edge; null in a row with counts), n (links found), missed (by prefix length)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_unit(parts):
            links, missed, edges = link_unit(rows, threshold, depths, level)
            some = np.flatnonzero(links).tolist()
            rep = [rows[i]["rep"] for i in some] + [x for x, _ in edges]
            other = [None] * len(some) + [y for _, y in edges]
            n = links[some].tolist() + [0] * len(edges)
            short = missed[some].tolist() + [[0.0] * len(depths)] * len(edges)
            yield pa.RecordBatch.from_arrays([pa.array(rep, pa.binary()), pa.array(other, pa.binary()), pa.array(n, pa.int64()), pa.array(short, pa.list_(pa.float64()))], names=["rep", "other", "n", "missed"])

    batches(dealt.sparkSession)
    return dealt.mapInArrow(alone(run), "rep binary, other binary, n long, missed array<double>")


def _candidates(reps: DataFrame, depth: int) -> DataFrame:
    """The representatives that share a prefix of the shortest length with another one (nothing else can have links), with
    their chunks and places in them. A document goes where most others share a prefix with it, so that few chunks hold a
    large group."""
    placed = _placed(reps, depth, None, "rep").drop("inner")
    shared = placed.groupBy("label").agg(F.count("*").alias("n"), F.min("rep").alias("leader")).filter("n > 1")
    led = placed.join(shared, "label").groupBy("rep").agg(F.max(F.struct("n", "leader")).alias("at")).select("rep", "at.leader")
    led = stored(led.join(reps, "rep"), "join-led")
    parts = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum(F.col("size") * 8) / CHUNK_BYTES))
    chunks = led.groupBy("leader").agg(parts.alias("parts"))
    chunk = F.xxhash64("leader", F.pmod(F.xxhash64("rep"), F.col("parts")))
    near = led.join(chunks, "leader").select("rep", "first_id", "copies", "labels", chunk.alias("chunk"))
    slot = F.row_number().over(Window.partitionBy("chunk").orderBy("rep")).alias("slot")
    near = stored(near.select("*", slot), "join-candidates")
    drop(led)
    return near


def _with_sets(docs: DataFrame, near: DataFrame) -> DataFrame:
    """What a unit needs of each candidate, with its set of shingles, sorted, as bytes; in buckets of the chunk. The ids that are
    looked up are hashed by partition, so the texts aren't sorted; texts go no further than the task that hashes them."""
    names = ["rep", "chunk", "slot", "copies", "labels"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [t or "" for t in part.column("text").to_pylist()]
            wanted = part.column("rep").to_pylist()
            for own in groups(texts, CHARS):
                # rows of one id may have other texts than the candidate's
                sets = {i: s.tobytes() for i, s in zip(own, shingle_sets([texts[i] for i in own]), strict=True) if _digest(s) == wanted[i]}
                at = pa.array(list(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(n).take(at) for n in names], pa.array(list(sets.values()), pa.binary())], names=[*names, "shingles"])

    batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("first_id"), "text").join(near.hint("shuffle_hash"), "first_id").select("text", *names)
    sets = texts.mapInArrow(alone(run), "rep binary, chunk long, slot int, copies long, labels binary, shingles binary")
    dealt = sets.repartition(shuffle_width(docs.sparkSession), "chunk")
    once = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("chunk", "rep").orderBy("slot"))).filter("_n = 1").drop("_n")
    return bucketed(once, "join-sets", "chunk")


def _level(near: DataFrame, held: DataFrame, done: DataFrame, threshold: float, depths: list[int], level: int) -> DataFrame:
    """What the pairs hold that match at this level first. done: rep, chunk and slot of those whose matching has ended."""
    depth, before = depths[level], depths[level - 1] if level else None
    still = near.select("rep", "chunk", "slot", "labels").join(done.select("rep", F.lit(True).alias("done")), "rep", "left").withColumn("open", F.col("done").isNull())
    placed = _placed(still, depth, before, "chunk", "slot", "open")
    of_chunks = placed.groupBy("label", "chunk").agg(F.count("*").alias("n"), F.max("open").alias("open"), F.min("inner").alias("low"), F.max("inner").alias("high"))
    shared = of_chunks.groupBy("label").agg(F.sum("n").alias("members"), F.max("open").alias("any_open"), (F.min("low") < F.max("high")).alias("branches"))
    shared = shared.filter(F.col("any_open") & (F.col("members") > 1) & (F.col("branches") | F.lit(before is None))).select("label")
    touching = stored(of_chunks.join(shared, "label").select("label", "chunk", "n", "open", (F.lit(before is None) | (F.col("low") < F.col("high"))).alias("branches")), "join-touching")
    # pairs of chunks that share a prefix, and chunks of which two members do
    alone = touching.filter("n > 1 AND open AND branches").select(F.col("chunk").alias("a"), F.col("chunk").alias("b"))
    one, two = (touching.select("label", F.col("chunk").alias(x), F.col("open").alias(f"open_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    met = one.join(two, "label").filter("a < b AND (open_a OR open_b)")
    # two chunks meet as a whole, or, where few of their members share a prefix, only these do
    sizes = near.groupBy("chunk").agg(F.count("*").alias("size"))
    units = met.groupBy("a", "b").agg(F.sum(F.col("n_a") + F.col("n_b")).alias("need"))
    units = units.join(sizes.select(F.col("chunk").alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col("chunk").alias("b"), F.col("size").alias("size_b")), "b")
    units = stored(units.select("a", "b", (F.col("need") * 2 < F.col("size_a") + F.col("size_b")).alias("narrow")), "join-units")
    sides = F.array(F.struct(F.col("a").alias("chunk"), F.lit(0).alias("side")), F.struct(F.col("b").alias("chunk"), F.lit(1).alias("side")))
    wide = units.filter("NOT narrow").select("a", "b", F.explode(sides).alias("s")).select("a", "b", "s.*").unionAll(alone.distinct().select("a", "b", F.col("a").alias("chunk"), F.lit(0).alias("side")))
    narrow = met.select("label", "a", "b").join(units.filter("narrow").select("a", "b"), ["a", "b"], "left_semi").select("label", "a", "b", F.explode(sides).alias("s")).select("label", "a", "b", "s.*")
    narrow = narrow.join(placed.select("label", "chunk", "slot"), ["label", "chunk"]).select("a", "b", "chunk", "side", "slot").distinct()
    closed = done.groupBy("chunk").agg(F.collect_list("slot").alias("closed"))
    columns = ["a", "b", "side", "rep", "slot", "closed", "copies", "labels", "shingles"]

    def with_closed(sent: DataFrame) -> DataFrame:
        return sent.join(closed, "chunk", "left").withColumn("closed", F.coalesce("closed", F.array().cast("array<int>")))

    dealt = with_closed(wide).join(held, "chunk").select(*columns).unionAll(with_closed(narrow).join(held, ["chunk", "slot"]).select(*columns))
    dealt = dealt.repartition(2 * shuffle_width(near.sparkSession), "a", "b").sortWithinPartitions("a", "b")
    found = stored(_verified(dealt, threshold, depths, level), "join-found")
    drop(touching, units)
    return found


def forest(near: DataFrame, held: DataFrame, threshold: float, depths: list[int], target_recall: float) -> tuple[DataFrame, DataFrame]:
    """rep, n (links), depth (the prefix length at which its matching ended); and all edges (rep, other)."""
    edges = None
    state = near.select("rep", "chunk", "slot", F.lit(0).cast("long").alias("n"), F.array(*[F.lit(0.0)] * len(depths)).alias("missed"), F.lit(depths[0]).alias("depth"), F.lit(True).alias("open"))
    for level, depth in enumerate(depths):
        done = state.filter("NOT open").select("rep", "chunk", "slot")
        found = _level(near, held, done, threshold, depths, level)
        more = found.filter("other IS NULL").groupBy("rep").agg(F.sum("n").alias("_n"), F.array(*[F.sum(F.col("missed")[j]) for j in range(len(depths))]).alias("_missed"))
        n = F.col("n") + F.coalesce("_n", F.lit(0))
        missed = F.when(F.col("_missed").isNull(), F.col("missed")).otherwise(F.zip_with("missed", "_missed", lambda x, y: x + y))
        # a link at the threshold that hasn't been seen is reckoned with as well
        recall = n / (n + missed[level] + F.lit(float(1 - recall_at(threshold, depth))))
        go_on = F.col("open") & F.lit(level + 1 < len(depths)) & (recall < target_recall)
        now = state.join(more, "rep", "left").select("rep", "chunk", "slot", n.alias("n"), missed.alias("missed"), F.when(F.col("open"), F.lit(depth)).otherwise(F.col("depth")).alias("depth"), go_on.alias("open"))
        state = stored(now, "join-state")
        own = found.filter("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b"))
        edges = own if edges is None else edges.unionAll(own)
    return state.select("rep", "n", "depth"), edges


def classes(docs: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """One row for each document: doc_id, class_id and n_links as join() has them; leads (whether it is the first of its
    class); depth (the prefix length at which its matching ended; null if it shares no prefix with another document);
    text_key and rows: the hash of its text (of the smallest hash, where one doc_id has several texts with one shingle set)
    and how many rows have it."""
    depths = depths_for(threshold, target_recall)
    signed = stored(sign(docs.filter("doc_id IS NOT NULL")), "join-signed")
    one = signed.groupBy("doc_id", "digest", "text_key").agg(F.count("*").alias("rows")).groupBy("doc_id", "digest").agg(F.min(F.struct("text_key", "rows")).alias("t")).select("doc_id", "digest", "t.*")
    one = stored(one, "join-documents")
    same = signed.filter("digest IS NOT NULL").groupBy(F.col("digest").alias("rep")).agg(F.min("doc_id").alias("first_id"), F.countDistinct("doc_id").alias("copies"), F.min("labels").alias("labels"), F.min("size").alias("size"))
    reps = stored(same, "join-reps")
    drop(signed)
    near = _candidates(reps, depths[-1])
    held = _with_sets(docs, near)
    counts, edges = forest(near, held, threshold, depths, target_recall)
    joined_to = components(edges, "join-classes").withColumnRenamed("node", "rep")
    of = reps.select("rep", "first_id", "copies").join(counts, "rep", "left").join(joined_to, "rep", "left").select("rep", "first_id", "copies", "n", "depth", F.coalesce("component", "rep").alias("component"))
    of = stored(of, "join-classes")
    drop(near, held)
    first = of.groupBy("component").agg(F.min(F.struct("first_id", "rep")).alias("first"))
    per_rep = of.join(first, "component").select("rep", F.col("first.first_id").alias("class_id"), (F.col("first.rep") == F.col("rep")).alias("first"), "depth", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    out = one.join(per_rep, one.digest == per_rep.rep, "left")
    leads = F.coalesce(F.col("first") & (F.col("class_id") == F.col("doc_id")), F.lit(True))
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), leads.alias("leads"), "depth", "text_key", "rows")


def join(docs: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """One row for each document: doc_id, class_id, n_links.

    n_links: other documents whose shingle sets have a Jaccard likeness of threshold or more with this one's, equal sets
    included. class_id: the smallest doc_id that can be reached over links, its own included. Null and empty texts, and
    texts without words, link with nothing. Rows that share a doc_id and a shingle set are one document; rows of one doc_id
    with different sets are documents of their own, and have a row each. Rows without a doc_id are left out.
    """
    return classes(docs, threshold, target_recall).select("doc_id", "class_id", "n_links")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one with the smallest id, with its own columns.

    Rows without a doc_id stay. Rows that share a doc_id are judged by their texts: those with different texts that aren't
    near copies all stay if they lead their classes. Of rows with one id and one text one stays, the first by its other
    columns, so that a retry chooses the same.
    """
    own = docs.columns
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_key"))
    kept = stored(classes(docs).filter("leads").select("doc_id", "text_key", "rows"), "join-kept")

    def rows(of: DataFrame) -> DataFrame:
        return boxed.join(of, (F.col("_id") == F.col("doc_id")) & (F.col("_key") == F.col("text_key")), "left_semi")

    others = F.to_json(F.struct(*[F.col(f"_row.`{c}`") for c in own if c != "text"]))
    repeated = rows(kept.filter("rows > 1")).groupBy("_id", "_key").agg(F.min_by("_row", others).alias("_row"))
    return rows(kept.filter("rows = 1")).select("_row").unionAll(repeated.select("_row")).unionAll(boxed.filter("_id IS NULL").select("_row")).select("_row.*")
