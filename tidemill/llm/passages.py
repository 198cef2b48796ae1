"""Suffix-array dedup: passages of LENGTH bytes or more that a document with a smaller id holds are removed.

A suffix array over all text at once is no work for a cluster, and most of its entries would never be looked at. Every
stretch of LENGTH bytes is therefore given a key by its own content: the smallest hash among its GRAM-byte substrings.
Equal stretches have equal keys, so

1. keys that occur in one text only are dropped: a batch of texts tells once what its own texts share and sends the others,
   so a key has at most two rows a batch in the task that looks for keys of several batches;
2. for the others, the bytes around each occurrence go to the task of their key. Equal bytes (by 128 bits: their key and a
   digest) are one row there, with the smallest document that has them: all the others lose everything;
3. a task leaves out what can't match (both sides of the key's gram unlike all others') and builds suffix arrays of the
   rest, in blocks of whole keys and bounded size, by two-stage sorting, and compares adjacent suffixes: runs with LENGTH
   common bytes are equal stretches, and the smallest document of a run is their source;
4. what is to be removed goes back to the documents.

Keys that occur more than FOLDED * GROUP times go another way: equal bytes are one row before anything is dealt by key, and what is
found of a row is joined with its occurrences, by Spark's joins.
A key with more than GROUP different surroundings (the edge of a passage that a large part of all documents hold) gets
longer first: its stretches are told apart by where the gram stands in them, in two halves, and those of one half have more
than the gram in common, which is their new key. Halves of which the key is still too common are halved again, until a key is
a whole stretch and has one surrounding. The surroundings get narrower with each step, so those inside the passage become
equal, and those outside become unlike all others.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.chunks import groups
from tidemill.llm.common import alone, batches, drop, joined, mix, powers, ranges, read, shuffle_width, stored
from tidemill.llm.suffixes import common_prefixes, suffix_array, words

LENGTH = 50
GRAM = 16
#: Stretches in a row of one key that are sent together.
MAX_RUN = 64
#: Bytes of a block of keys that a task sorts at a time, and surroundings of a key that are not too many for one.
BLOCK_BYTES = 1 << 18
GROUP = 2048
#: Times GROUP, the occurrences of a key that one task folds: a block of so many different surroundings is one of 1.4 MB.
FOLDED = 8
#: Rows of numbers that a task orders at a time, about, and rows of surroundings.
TASK_ROWS = 1_000_000
CHUNK_ROWS = 1 << 17
#: Characters that are looked at together: what they need stays in the processor's cache.
CHARS = 120_000


def stretch_keys(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The bytes of all texts; for every stretch where it starts, its key and its text; where each text starts; and the hash
    of the gram at each place."""
    buf, starts, lengths = joined(texts)
    n = len(buf)
    count = np.maximum(lengths - length + 1, 0)
    total = int(count.sum())
    ends = np.cumsum(count)
    place = np.repeat(starts - ends + count, count) + np.arange(total)
    if not total:
        return buf, place, np.zeros(0, np.uint64), place, starts, np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    grams = mix((sums[gram:] - sums[:-gram]) * down[: n + 1 - gram])
    low = sliding(grams, length - gram + 1, np.minimum)
    return buf, place, low[place], np.repeat(np.arange(len(texts)), count), starts, grams


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """The minimum (or maximum) of each `width` neighbours."""
    span = 1
    while 2 * span <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: -(width - span)], x[width - span :]) if width > span else x


def gram_places(grams: np.ndarray, key: np.ndarray, first: np.ndarray, width: np.ndarray, window: int) -> np.ndarray:
    """For each row, where among the `width` places from `first` on the gram with its key stands, from `first`; -1 if it stands
    there more than once. Each key is the least of some window of grams in its row, so only such places are looked at."""
    low = sliding(grams, window, np.minimum)
    none = np.zeros(window - 1, np.uint64)
    least = np.flatnonzero(grams == sliding(np.concatenate([none, low, none]), window, np.maximum))
    begin, end = np.searchsorted(least, first), np.searchsorted(least, first + width)
    at, count, left = np.full(len(key), -1), np.zeros(len(key), np.int64), np.flatnonzero(begin < end)
    while len(left):
        here = least[begin[left]]
        hit = left[grams[here] == key[left]]
        at[hit] = least[begin[hit]] - first[hit]
        count[hit] += 1
        begin[left] += 1
        left = left[begin[left] < end[left]]
    return np.where(count == 1, at, -1)


def starts_of(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where new keys begin in arrays that are sorted by them."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def distinct_rows(key: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort([whole, key])
    order = order[starts_of(key[order], whole[order])]
    return key[order], whole[order]


def shared_rows(key: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, ...]:
    """Key and text of the rows whose key several texts have, each once; of every key with one text only, that one row; and two rows of
    different texts of each of the former keys."""
    if not len(key):
        return (key, whole) * 3
    order = np.argsort(key)
    key, whole = key[order], whole[order]
    begin = starts_of(key)
    low, high = np.minimum.reduceat(whole, begin), np.maximum.reduceat(whole, begin)
    several = low != high
    rows = np.repeat(several, np.diff(np.append(begin, len(key))))
    told = key[begin[several]]
    return *distinct_rows(key[rows], whole[rows]), key[begin[~several]], low[~several], np.concatenate([told, told]), np.concatenate([low[several], high[several]])


def _tasks(spark: SparkSession, size: int) -> int:
    """How many tasks texts of so many bytes need for what has a row for each run of stretches with one key: as minima of 35
    places change every 18 places, about."""
    return max(shuffle_width(spark), -(-size // (18 * TASK_ROWS)))


def _shared_keys(docs: DataFrame, length: int, tasks: int) -> DataFrame:
    """whole (the number of a text) and each of its keys that another text has as well; a row may come a second time."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("text").to_pylist()
            whole = part.column("whole").to_numpy()
            keys, wholes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for own in groups([t or "" for t in texts], CHARS):
                _, _, key, of, _, _ = stretch_keys([(texts[i] or "").encode() for i in own], length)
                if len(key):
                    new = starts_of(key, of)
                    keys.append(key[new].view(np.int64))
                    wholes.append(whole[np.array(own)][of[new]])
            held_key, held_whole, lone_key, lone_whole, told_key, told_whole = shared_rows(np.concatenate(keys), np.concatenate(wholes))
            known = np.repeat([True, False, False], [len(held_key), len(lone_key), len(told_key)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([held_key, lone_key, told_key])), pa.array(np.concatenate([held_whole, lone_whole, told_whole])), pa.array(known)], names=["key", "whole", "known"])

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, wholes, known = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for part in parts:
            for column, out in (("key", keys), ("whole", wholes), ("known", known)):
                out.append(part.column(column).to_numpy(zero_copy_only=False))
        key, whole, is_known = np.concatenate(keys), np.concatenate(wholes), np.concatenate(known)
        for key, whole in (distinct_rows(key[is_known], whole[is_known]), shared_rows(key[~is_known], whole[~is_known])[:2]):
            yield pa.RecordBatch.from_arrays([pa.array(whole), pa.array(key)], names=["whole", "key"])

    batches(docs.sparkSession)
    rows = docs.select("text", "whole").mapInArrow(alone(run), "key long, whole long, known boolean")
    # what is known already needs no task of its key, and what copies of a text tell is one row
    return rows.repartition(tasks, F.when(F.col("known"), F.xxhash64("key", "whole")).otherwise(F.col("key"))).mapInArrow(alone(count), "whole long, key long")


def _listed(rows: DataFrame, by: list[str], values: list[str], name: str, tasks: int) -> DataFrame:
    """All rows of numbers with the same `by` as one row, with a list of their values (of structures, if there are several)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(parts)
        if not parts:
            return
        columns = {c: np.concatenate([p.column(c).to_numpy() for p in parts]) for c in (*by, *values)}
        order = np.lexsort([columns[c] for c in by])
        own = [columns[c][order] for c in by]
        begin = starts_of(*own)
        ends = np.append(begin, len(order))
        for a in range(0, len(begin), 1000):
            cuts = ends[a : a + 1001]
            lists = [pa.array(columns[c][order[cuts[0] : cuts[-1]]]) for c in values]
            flat = lists[0] if len(values) == 1 else pa.StructArray.from_arrays(lists, names=values)
            yield pa.RecordBatch.from_arrays([*(pa.array(k[cuts[:-1]]) for k in own), pa.ListArray.from_arrays(pa.array(cuts - cuts[0], pa.int32()), flat)], names=[*by, name])

    kind = "long" if len(values) == 1 else f"struct<{', '.join(f'{v} long' for v in values)}>"
    return rows.select(*by, *values).repartition(tasks, *by).mapInArrow(alone(run), ", ".join(f"{c} long" for c in by) + f", {name} array<{kind}>")


def side_hashes(grams: np.ndarray, at: np.ndarray, first: np.ndarray, end: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the `half` bytes before the gram at each place, and of those after it; 0 where they leave first ... end."""
    out = []
    for inside, offsets in ((at - half >= first, [*range(-half, -GRAM, GRAM), -min(half, GRAM)]), (at + GRAM + half <= end, [*range(GRAM, half, GRAM), half])):
        side = np.zeros(len(at), np.uint64)
        for o in offsets:
            side[inside] = mix(side[inside] + grams[at[inside] + o])
        side[inside] |= np.uint64(1)
        out.append(side.astype(np.uint32).view(np.int32))
    return out[0], out[1]


def _surroundings(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, whole, key, first (place of the first stretch), n (stretches), bytes (what they cover), for runs of stretches whose
    key is in the row's array `keys`; at: where in them the gram with the key stands (-1: at several places); left and right:
    hashes of what is beside that gram (0: not within them)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column("doc_id").to_numpy()
            texts = [t or "" for t in part.column("text").to_pylist()]
            whole_of, wanted = part.column("whole").to_numpy(), part.column("keys")
            for own in groups(texts, CHARS):
                raw = [texts[i].encode() for i in own]
                buf, place, key, of, starts, grams = stretch_keys(raw, length)
                if not len(key):
                    continue
                hot = np.unique(np.concatenate([wanted[i].values.to_numpy() for i in own])).view(np.uint64)
                hot.sort()
                at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                # a key that another document of the group is known by is known to be shared as well
                is_hot = hot[at] == key
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])])
                begin = np.flatnonzero(new)
                size = np.diff(np.concatenate([begin, [len(key)]]))
                begin, size = begin[is_hot[begin]], size[is_hot[begin]]
                pieces = -(-size // MAX_RUN)
                cut = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = np.repeat(begin, pieces) + MAX_RUN * cut
                n = np.minimum(MAX_RUN, np.repeat(begin + size, pieces) - first)
                if not len(first):
                    continue
                whole = buf.tobytes()
                covered = [whole[p : p + m + length - 1] for p, m in zip(place[first].tolist(), n.tolist(), strict=True)]
                doc = of[first]
                at = gram_places(grams, key[first], place[first], n + length - GRAM, length - GRAM + 1)
                left, right = side_hashes(grams, place[first] + at, place[first], np.where(at < 0, 0, place[first] + n + length - 1), (length - GRAM) // 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids[np.array(own)][doc], pa.int64()), pa.array(whole_of[np.array(own)][doc], pa.int64()), pa.array(key[first].view(np.int64)), pa.array(place[first] - starts[doc], pa.int64()), pa.array(n, pa.int32()), pa.array(covered, pa.binary()), pa.array(at, pa.int16()), pa.array(left), pa.array(right)], names=["doc_id", "whole", "key", "first", "n", "bytes", "at", "left", "right"])

    batches(docs.sparkSession)
    return docs.mapInArrow(alone(run), "doc_id long, whole long, key long, first long, n int, bytes binary, at short, left int, right int")


def earlier_runs(surroundings: list[bytes], sources: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs (number of the piece of text, first, past the last) of stretches that a piece with a smaller source holds.

    One suffix array over all pieces: pieces end with a zero byte, other bytes are raised by one (255 is in no UTF-8 text).
    """
    sizes = np.fromiter(map(len, surroundings), np.int64, len(surroundings))
    flat = np.frombuffer(b"".join(surroundings), np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), np.uint8)
    of_byte = np.repeat(np.arange(len(sizes)), sizes)
    text[np.arange(len(flat)) + of_byte] = flat + 1
    depth = -(-length // 8) * 8
    eight = words(text, depth)
    order = suffix_array(text, eight, depth)
    of = np.repeat(np.arange(len(sizes)), sizes + 1)
    valid = np.arange(len(text)) + length <= (starts + sizes)[of]
    order = order[valid[order]]
    if not len(order):
        return (np.zeros(0, np.int64),) * 3
    new = np.flatnonzero(common_prefixes(order, eight, depth) < length)
    mine = sources[of[order]]
    least = np.repeat(np.minimum.reduceat(mine, new), np.diff(np.concatenate([new, [len(order)]])))
    flag = np.zeros(len(text) + 1, np.int8)
    flag[order[least < mine]] = 1
    edge = np.diff(flag, prepend=np.int8(0))
    first, past = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return of[first], first - starts[of[first]], past - starts[of[first]]


def can_match(rows: list[tuple], length: int = LENGTH, gram: int = GRAM) -> list[tuple]:
    """Of the (bytes, at, ...) of one key those that can share a stretch with another. A stretch holds the gram, so it also
    holds half of its other bytes on the left or on the right of it: rows of which both halves are unlike all others' go."""
    if len(rows) < 2 or any(r[1] < 0 for r in rows):
        return rows if len(rows) > 1 else []
    half = (length - gram) // 2
    left = [r[0][r[1] - half : r[1]] if r[1] >= half else None for r in rows]
    right = [r[0][r[1] + gram : r[1] + gram + half] if r[1] + gram + half <= len(r[0]) else None for r in rows]
    lefts, rights = Counter(left), Counter(right)
    return [r for r, x, y in zip(rows, left, right, strict=True) if (x is not None and lefts[x] > 1) or (y is not None and rights[y] > 1)]


def _sorted_blocks(length: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            runs: dict[int, list[tuple[int, int]]] = {}
            for i, a, b in zip(*(x.tolist() for x in earlier_runs([r[0] for r in rows], np.array([r[4] for r in rows], np.int64), length)), strict=True):
                runs.setdefault(i, []).append((a, b))
            keep = list(runs)
            return pa.RecordBatch.from_arrays([pa.array([rows[i][2] for i in keep], pa.int64()), pa.array([rows[i][3] for i in keep], pa.int64()), pa.array([[{"first": a, "past": b} for a, b in runs[i]] for i in keep], pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())])))], names=["key", "digest", "runs"])

        block, size, group = [], 0, []
        for part in parts:
            for row in zip(*[part.column(c).to_pylist() for c in ("bytes", "at", "key", "digest", "source")], strict=True):
                if group and row[2] != group[0][2]:
                    found = can_match(group, length)
                    block += found
                    size += sum(len(r[0]) for r in found)
                    group = []
                    if size >= BLOCK_BYTES:
                        yield flush(block)
                        block, size = [], 0
                group.append(row)
        block += can_match(group, length)
        if block:
            yield flush(block)

    return run


def may_match(key: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """can_match() by the hashes of both sides, for rows that are sorted by their keys."""
    begin = starts_of(key)
    size = np.diff(np.append(begin, len(key)))
    out = np.repeat(np.maximum.reduceat(at < 0, begin), size)
    for side in (left, right):
        inside = np.flatnonzero(side)
        _, of, count = np.unique(side[inside].view(np.uint32) + mix(key[inside].view(np.uint64)), return_inverse=True, return_counts=True)
        out[inside] |= count[of] > 1
    return out & np.repeat(size > 1, size)


def lost_runs(table: pa.Table, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of whole keys, and first and past of what a smaller document holds of them; from the start of each row."""
    key, digest, doc, n, at, left, right = (table.column(c).to_numpy() for c in ("key", "digest", "doc_id", "n", "at", "left", "right"))
    order = np.lexsort([doc, digest, key])
    begin = starts_of(key[order], digest[order])
    source = doc[order[begin]]
    later = doc[order] > np.repeat(source, np.diff(np.append(begin, len(order))))
    # a later document with the same surroundings loses them all; the first one, what earlier ones hold of them
    yield order[later], np.zeros(int(later.sum()), np.int64), n[order[later]].astype(np.int64)
    own = np.add.reduceat(~later, begin, dtype=np.int64)
    one = order[begin]
    keep = np.flatnonzero(may_match(key[one], at[one], left[one], right[one]))
    pieces = table.column("bytes").take(pa.array(one[keep])).to_pylist()
    new = starts_of(key[one[keep]])
    size = np.add.reduceat(np.fromiter(map(len, pieces), np.int64, len(pieces)), new) if len(new) else new
    block = (np.cumsum(size) - size) // BLOCK_BYTES
    cuts = np.append(new[starts_of(block)], len(keep)).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        of, first, past = earlier_runs(pieces[a:b], source[keep[a:b]], length)
        of = keep[a:b][of]
        yield order[ranges(begin[of], own[of])], np.repeat(first, own[of]), np.repeat(past, own[of])


def _lost(few: DataFrame, length: int) -> DataFrame:
    """doc_id, whole, first, past: runs of stretches that a smaller document holds, for surroundings of keys with few of them."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [p for p in parts if p.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        doc, whole, start = (table.column(c).to_numpy() for c in ("doc_id", "whole", "first"))
        for rows, first, past in lost_runs(table, length):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[rows], whole[rows], start[rows] + first, start[rows] + past)], names=["doc_id", "whole", "first", "past"])

    spark = few.sparkSession
    batches(spark)
    dealt = few.repartition(max(shuffle_width(spark), -(-few.count() // CHUNK_ROWS)), "key").withColumn("digest", F.xxhash64("bytes"))
    return dealt.mapInArrow(alone(run), "doc_id long, whole long, first long, past long")


def halves(low: int, high: int) -> list[tuple[int, int]]:
    middle = (low + high) // 2
    return [(low, middle), (middle + 1, high)] if low < high else [(low, high)]


def narrowed(text: bytes, n: int, at: int, low: int, high: int, length: int = LENGTH) -> Iterator[tuple[int, int, bytes, int, int, int, bytes]]:
    """Of n stretches of a text, in which a gram stands at `at`, those that hold it at low ... high, in two halves: first
    stretch, how many, what they cover, where the gram is in that, low, high, and what all stretches of the half share."""
    for lo, hi in halves(low, high):
        first, last = max(0, at - hi), min(n - 1, at - lo)
        if first <= last:
            yield first, last - first + 1, text[first : last + length], at - first, lo, hi, text[at - lo : at - hi + length]


def _longer_keys(hot: DataFrame, length: int) -> DataFrame:
    """Rows of surroundings under longer keys. hot: as _surroundings() gives them, with low and high."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            of, rows = [], []
            for i, (text, key, n, at, low, high) in enumerate(zip(*[part.column(c).to_pylist() for c in ("bytes", "key", "n", "at", "low", "high")], strict=True)):
                places = [at] if at >= 0 else np.flatnonzero(stretch_keys([text], length)[5][: len(text) - GRAM + 1].view(np.int64) == key).tolist()
                for place in places:
                    for row in narrowed(text, n, place, low, high, length):
                        of.append(i)
                        rows.append(row)
            first, n, covered, at, low, high, shared = zip(*rows, strict=True) if rows else ([],) * 7
            key = [int.from_bytes(hashlib.blake2b(x + bytes([a, b]), digest_size=8).digest(), "little", signed=True) for x, a, b in zip(shared, low, high, strict=True)]
            of = pa.array(of, pa.int64())
            start = np.asarray(part.column("first").take(of)) + np.array(first, np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(of), part.column("whole").take(of), pa.array(key, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int32()), pa.array(covered, pa.binary()), pa.array(at, pa.int16()), pa.array(low, pa.int16()), pa.array(high, pa.int16())], names=["doc_id", "whole", "key", "first", "n", "bytes", "at", "low", "high"])

    batches(hot.sparkSession)
    return hot.mapInArrow(alone(run), "doc_id long, whole long, key long, first long, n int, bytes binary, at short, low short, high short")


def _grouped(wide: DataFrame, length: int) -> list[tuple[DataFrame, DataFrame]]:
    """Tables (each occurrence, each distinct surrounding with its smallest document) in which no key has more than GROUP
    surroundings."""
    out = []
    wide = wide.withColumn("low", F.lit(0)).withColumn("high", F.lit(length - GRAM))
    while True:
        one = stored(wide.groupBy("key", "digest").agg(F.min("doc_id").alias("source"), F.min("bytes").alias("bytes"), F.min("at").alias("at")), "passages-one")
        large = stored(one.groupBy("key").count().filter(F.col("count") > GROUP).select("key"), "passages-large")
        if large.isEmpty():
            return [*out, (wide, one)]
        out.append((wide.join(large, "key", "left_anti"), one.join(large, "key", "left_anti")))
        wide = stored(_longer_keys(wide.join(large, "key", "left_semi").drop("digest"), length).withColumn("digest", F.xxhash64("bytes")), "passages-wide")


def _lost_of_many(hot: DataFrame, length: int) -> DataFrame:
    """As _lost(), for keys with any number of surroundings."""
    spark = hot.sparkSession
    pieces = _grouped(hot, length)
    every, one = pieces[0]
    for more, distinct in pieces[1:]:
        every, one = every.unionByName(more), one.unionByName(distinct)
    batches(spark)
    dealt = one.select("key", "digest", "bytes", "at", "source").repartition(2 * shuffle_width(spark), "key").sortWithinPartitions("key")
    runs = stored(dealt.mapInArrow(alone(_sorted_blocks(length)), "key long, digest long, runs array<struct<first int, past int>>"), "passages-runs")
    # written before it is joined again: a join with a table can be split where a passage is hot
    sources = stored(one.select("key", "digest", "source").join(runs.hint("shuffle_hash"), ["key", "digest"], "left"), "passages-sources")
    drop(runs)
    back = every.select("doc_id", "whole", "first", "n", "key", "digest").join(sources.hint("shuffle_hash"), ["key", "digest"])
    # a later document with the same surroundings loses them all; the first one, what earlier ones hold of them
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("n").alias("past")))
    part = F.when(F.col("doc_id") > F.col("source"), whole).otherwise(F.col("runs"))
    gone = back.select("doc_id", "whole", F.col("first").alias("start"), F.explode(part).alias("r"))
    return gone.select("doc_id", "whole", (F.col("start") + F.col("r.first")).alias("first"), (F.col("start") + F.col("r.past")).alias("past"))


def covered_places(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, whole (the hash of the text) and runs [first, past): stretches of `length` bytes that also start in a document
    with a smaller id."""
    if length < GRAM + 2:
        raise ValueError(f"passages of fewer than {GRAM + 2} bytes aren't looked for")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("whole")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    # whole copies: the first of them takes part; the others lose everything
    texts = docs.filter(F.octet_length("text") >= length).select("doc_id", "whole", F.unhex(F.md5("text")).alias("text"), F.octet_length("text").alias("size"))
    firsts = texts.groupBy("text").agg(F.min("doc_id").alias("first_id"))
    ids = stored(texts.join(firsts, "text").select("doc_id", "whole", "size", (F.col("doc_id") > F.col("first_id")).alias("copy")).distinct(), "passages-ids")
    tasks = _tasks(docs.sparkSession, ids.agg(F.sum("size")).first()[0] or 0)
    held = _listed(_shared_keys(docs, length, tasks), ["whole"], ["key"], "keys", tasks)
    held = stored(held.join(ids.filter("NOT copy").select("doc_id", "whole"), "whole"), "passages-held")
    wide = _surroundings(docs.join(held, ["doc_id", "whole"]).select("doc_id", "text", "whole", "keys"), length)
    wide = stored(wide, "passages-wide")
    drop(held)
    many = stored(wide.groupBy("key").count().filter(F.col("count") > FOLDED * GROUP).select("key"), "passages-many")
    if many.isEmpty():
        lost = _lost(wide, length)
    else:
        hot = wide.join(many, "key", "left_semi").drop("left", "right").withColumn("digest", F.xxhash64("bytes"))
        lost = _lost(wide.join(many, "key", "left_anti"), length).unionByName(_lost_of_many(hot, length))
    copies = ids.filter("copy").select("doc_id", "whole", F.lit(0).cast("long").alias("first"), (F.col("size") - length + 1).cast("long").alias("past"))
    return _listed(lost.unionByName(copies), ["doc_id", "whole"], ["first", "past"], "runs", tasks)


def removal(size: int, first: np.ndarray, past: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of bytes that the runs of stretches (first, past the last) cover."""
    if not len(first):
        return first, past
    change = np.bincount(first, minlength=size + 1) - np.bincount(past + length - 1, minlength=size + 1)
    gone = (np.cumsum(change) > 0).view(np.int8)
    edge = np.diff(gone, prepend=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _removals(part: pa.RecordBatch, length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """The bytes of each row's text, and start and end of what is to be removed."""
    runs = part.column("_runs")
    sizes = runs.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    flat = runs.flatten()
    first, past = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
    ends = np.cumsum(sizes)
    for text, a, b in zip(part.column("_text"), (ends - sizes).tolist(), ends.tolist(), strict=True):
        raw = text.as_py().encode()
        yield raw, *removal(len(raw), first[a:b], past[a:b], length)


def _kept(raw: bytes, begin: np.ndarray, end: np.ndarray) -> bytes:
    return b"".join(raw[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(raw)], strict=True))


def _with_runs(docs: DataFrame, length: int) -> DataFrame:
    found = stored(covered_places(docs, length), "passages-runs-by-doc")
    runs = found.select(F.col("doc_id").alias("_run_id"), F.col("whole").alias("_run_whole"), F.col("runs").alias("_runs"))
    own = docs.columns
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_whole"), F.coalesce("text", F.lit("")).alias("_text"))
    return boxed.join(runs, (F.col("_id") == F.col("_run_id")) & (F.col("_whole") == F.col("_run_whole")), "left").drop("_run_id", "_run_whole", "_whole")


def remove_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Texts are UTF-8 bytes; null texts are empty ones. Matches never cross documents. Rows of one doc_id don't remove each
    other's text; where their texts differ, each loses what documents with smaller ids hold of it. Rows without a doc_id lose
    nothing and are nobody's source.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for raw, a, b in _removals(part, length):
                kept = _kept(raw, a, b)
                out.append((len(raw), len(raw) - len(kept), len(a), hashlib.sha256(kept).hexdigest()))
            n, gone, spans, sha = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _with_runs(docs.select("doc_id", "text"), length)
    batches(docs.sparkSession)
    return rows.select("_row.doc_id", "_text", "_runs").mapInArrow(alone(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the bytes that an earlier one holds, with their own columns; those of which nothing is left go.

    A cut may fall inside a character at either end of a passage; what is left of that character goes as well. n_chars,
    where there is such a column, follows the text. Null and empty texts lost nothing and stay as they are.
    """
    own = docs.columns
    rows = _with_runs(docs, LENGTH)
    shape = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row")).schema["_row"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, changed = [], []
            for raw, a, b in _removals(part, LENGTH):
                texts.append(_kept(raw, a, b).decode("utf-8", "ignore"))
                changed.append(len(a) > 0)
            yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(texts, pa.string()), pa.array(changed)], names=["_row", "_new", "_changed"])

    batches(spark)
    cut = rows.select("_row", "_text", "_runs").mapInArrow(alone(run), f"_row {shape}, _new string, _changed boolean")
    cut = cut.filter(~F.col("_changed") | (F.trim("_new") != ""))
    out = {c: F.col(f"_row.`{c}`") for c in own}
    out["text"] = F.when(F.col("_changed"), F.col("_new")).otherwise(out["text"])
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("_changed"), F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return cut.select(*[v.alias(c) for c, v in out.items()])


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(read(spark, sf_dir, "documents"))
