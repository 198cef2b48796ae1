"""Token-ID output: Simple-8b word-aligned coding.

Ids are packed into 64-bit words. The top four bits of a word, its selector, say how many values of how many bits fill the
other sixty. Selector 0 is an escape: the next word is one whole 64-bit value. Values are coded in blocks of BLOCK; a list
of word offsets, one a block, lets blocks be decoded together on arrays, or one alone without what stands before it.

A file holds a row for each document, in ascending doc_id order: its id, how many values it has, its block offsets and its
words (little-endian). The container is Parquet, uncompressed, so Spark's commit protocol writes it to any file system and a
lost task is written again. Nothing is collected: document order is a range partitioning, and the only figures that span
partitions are one sum for each.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.chunks import ChunkStore, groups
from tidemill.llm.common import alone, batches, folder, held, ranges, read, shuffle_width, stored

#: Bits a value for selectors 1 to 14; selector 0 is the escape.
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
COUNT = np.array([1, *(60 // b for b in BITS), 1], np.int64)
BLOCK = 1024
_GAP = 60  # zeros after a block, so that the last word of one may be partly empty
_LENGTHS = np.array([int(i).bit_length() for i in range(1 << 16)], np.uint8)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    if not len(values) or int(values.max()) < 1 << 16:
        return _LENGTHS[values]
    out = np.zeros(len(values), np.uint8)
    rest = values.astype(np.uint64)
    for shift in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1) << np.uint64(shift)
        out[big] += np.uint8(shift)
        rest[big] >>= np.uint64(shift)
    return out + (rest > 0)


def pack(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks one after another, and how many words each block has. sizes: values of each block."""
    if not len(values):
        return np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64)
    starts = np.cumsum(sizes + _GAP) - sizes - _GAP
    wide = np.zeros(int((sizes + _GAP).sum()) + _GAP, np.uint64)
    wide[ranges(starts, sizes)] = values
    bits = bit_lengths(wide)
    # for each place the narrowest selector whose next values all fit
    selector = np.where(bits > 60, np.uint8(0), np.uint8(14))
    most, span = bits, 1  # of the next `span` values
    for s in range(13, 0, -1):
        n = int(COUNT[s])
        while 2 * span <= n:
            most, span = np.concatenate([np.maximum(most[:-span], most[span:]), most[-span:]]), 2 * span
        rest = n - span
        over = most if not rest else np.concatenate([np.maximum(most[:-rest], most[rest:]), most[-rest:]])
        selector[over <= BITS[s - 1]] = s
    # all blocks take their words in step
    is_word = np.zeros(len(wide), bool)
    at, end = starts[sizes > 0], (starts + sizes)[sizes > 0]
    while len(at):
        is_word[at] = True
        at = at + COUNT[selector[at]]
        on = at < end
        at, end = at[on], end[on]
    begin = np.flatnonzero(is_word)
    chosen = selector[begin]
    takes = 1 + (chosen == 0)
    place = np.cumsum(takes) - takes
    words = np.zeros(int(takes.sum()), np.uint64)
    words[place[chosen == 0] + 1] = wide[begin[chosen == 0]]
    for s in range(1, 15):
        own = np.flatnonzero(chosen == s)
        if len(own):
            w = np.full(len(own), np.uint64(s) << np.uint64(60))
            for j in range(int(COUNT[s])):
                w |= wide[begin[own] + j] << np.uint64(j * BITS[s - 1])
            words[place[own]] = w
    block = np.searchsorted(starts, begin, side="right") - 1
    return words, np.bincount(block, weights=takes, minlength=len(sizes)).astype(np.int64)


def unpack(words: np.ndarray, word_counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of all blocks one after another."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNT[selector]
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == 0).tolist():  # a raw word may look like an escape
        if not raw[i]:
            raw[i + 1] = True
    counts[raw] = 0
    ends = np.cumsum(counts)
    begin = ends - counts
    wide = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    escapes = np.flatnonzero((selector == 0) & ~raw)
    wide[begin[escapes]] = words[escapes + 1]
    for s in range(1, 15):
        own = np.flatnonzero((selector == s) & ~raw)
        if len(own):
            mask = np.uint64((1 << BITS[s - 1]) - 1)
            for j in range(int(COUNT[s])):
                wide[begin[own] + j] = (words[own] >> np.uint64(j * BITS[s - 1])) & mask
    first_word = np.cumsum(word_counts) - word_counts
    starts = np.zeros(len(sizes), np.int64)
    starts[word_counts > 0] = begin[first_word[word_counts > 0]]
    return wide[ranges(starts, sizes)]


def blocks_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the blocks of documents of these lengths, and how many blocks each document has."""
    n = -(-lengths // BLOCK)
    sizes = np.full(int(n.sum()), BLOCK, np.int64)
    last = np.cumsum(n)[n > 0] - 1
    sizes[last] = (lengths - (n - 1) * BLOCK)[n > 0]
    return sizes, n


class PieceEncoder:
    """Ids of a byte-level BPE file's tokenizer, by the tokenizers library, once for each distinct piece.

    A text may be cut before a single space or line feed that stands between two characters other than white space: the
    splitting pattern starts a new word there, whatever surrounds it, so the ids of the pieces are those of the text. Where
    all white space is like that, a piece is known by its word, with the line feed before it but without the space.
    Other pieces, and the first of a text, are tuples with the piece as it is.
    """

    _CUT = re.compile(r"(?<=\S) (?=\S)")
    #: Latin letters, which every version of Unicode calls letters: a piece of these alone is one word.
    _WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.store = ChunkStore(self._encode)
        tokens = self.library.get_vocab()
        self.begins = np.zeros(max(tokens.values()) + 1, bool)
        self.begins[[i for t, i in tokens.items() if t[0] in "\u0120\u010a"]] = True  # a space, a line feed
        splits = self.library.pre_tokenizer
        self.by_word = self.library.normalizer is None and isinstance(splits, pre_tokenizers.ByteLevel) and splits.use_regex and not splits.add_prefix_space
        # the letters that stand for bytes in the file: these bytes for themselves, the others from 256 on
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        letters = [chr(b) if b in own else chr(256 + b - sum(x < b for x in own)) for b in range(256)]
        self.letters = {c: "".join([letters[b] for b in chr(c).encode()]) for c in range(0x250)}

    def _encode(self, pieces: list) -> tuple[list, np.ndarray, np.ndarray]:
        plain, tailed, others = [], [], []
        known, encoded = self.store.index, self.store.encoded
        for p in list(pieces):
            if type(p) is not str or "<|" in p:
                others.append(p)
            elif (core := p.rstrip(string.punctuation)) != p and core and core[-1].isalpha():
                # marks after a letter, up to the end, are a word of their own
                tailed.append((p, core))
                if core not in known:
                    known[core]  # it gets a number as well
                    plain.append(core)
            else:
                plain.append(p)
        ids, sizes = [], []
        words, rest = [], []
        for p in plain if self.by_word else ():
            (words if self._WORD.fullmatch(p) else rest).append(p)
        if words:
            # the library's model takes words as they are split already
            model, letters = self.library.model, self.letters
            got, size = self._flat([[t.id for t in model.tokenize("\u0120" + (p if p.isascii() else p.translate(letters)))] for p in words])
            ids.append(got)
            sizes.append(size)
            plain = words + rest
        for k in range(len(words), len(plain), 5000):
            # many pieces as one text: each begins with the only white space that it has
            part = plain[k : k + 5000]
            got = np.array(self.library.encode_batch_fast(["".join([p if p[0] == "\n" else " " + p for p in part])], add_special_tokens=False)[0].ids, np.uint32)
            begin = np.flatnonzero(self.begins[got])
            if len(begin) != len(part):
                raise ValueError("the tokenizer doesn't start a word at white space")
            ids.append(got)
            sizes.append(np.diff(begin, append=len(got)))
        if others:
            got, size = self._one_by_one([p[0] if type(p) is tuple else p if p[0] == "\n" else " " + p for p in others])
            ids.append(got)
            sizes.append(size)
        new, new_sizes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, sizes))
        if not tailed:
            return plain + others, new.astype(np.uint32), new_sizes
        # cores from what was known before or is new; then their marks
        place = {p: i for i, p in enumerate(plain)}
        base, starts = self.store.used, np.cumsum(new_sizes) - new_sizes
        pool = np.concatenate([self.store.flat[:base], new.astype(np.uint32)])
        at = np.fromiter((n if (n := known[c]) < encoded else -1 - place[c] for _, c in tailed), np.int64, len(tailed))
        old = at >= 0
        first, size = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        first[old], size[old] = self.store.starts[at[old]], self.store.lengths[at[old]]
        first[~old], size[~old] = base + starts[-1 - at[~old]], new_sizes[-1 - at[~old]]
        marks = list({p[len(c) :] for p, c in tailed})
        mark_ids, mark_sizes = self._one_by_one(marks)
        mark_at = dict(zip(marks, range(len(marks)), strict=True))
        mark = np.fromiter((mark_at[p[len(c) :]] for p, c in tailed), np.int64, len(tailed))
        pool = np.concatenate([pool, mark_ids])
        both = np.stack([first, len(pool) - len(mark_ids) + (np.cumsum(mark_sizes) - mark_sizes)[mark]], 1).ravel()
        both_sizes = np.stack([size, mark_sizes[mark]], 1).ravel()
        whole = pool[ranges(both, both_sizes)]
        return plain + others + [p for p, _ in tailed], np.concatenate([new.astype(np.uint32), whole]), np.concatenate([new_sizes, size + mark_sizes[mark]])

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._flat([e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)])

    @staticmethod
    def _flat(each: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(chain.from_iterable(each), np.uint32, int(sizes.sum())), sizes

    def _pieces(self, text: str) -> list:
        if not text:
            return []
        words = text.split()
        if " ".join(words) == text.replace("\n", " "):
            parts = text.replace("\n", " \n").split(" ") if "\n" in text else words
            parts[0] = (parts[0],)
            return parts
        parts = self._CUT.split(text)
        return [(parts[0],), *[(" " + p,) for p in parts[1:]]]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, sizes) of runs of texts."""
        for run in groups(texts):
            yield self.store.ids([self._pieces(texts[i]) for i in run])


def encoder(path: str) -> PieceEncoder:
    return held(("simple8b", path), lambda: PieceEncoder(path))


def encode(docs: DataFrame, path: str, end_id: int | None = 0) -> DataFrame:
    """doc_id, n_ids, offsets (words before each block) and words of every row's text, with end_id after its ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = encoder(path)
        for part in parts:
            at = 0
            for ids, sizes in own.encode([t or "" for t in part.column("text").to_pylist()]):
                extra = int(end_id is not None)
                lengths = sizes + extra
                if extra:
                    ids = np.insert(ids, np.cumsum(sizes), end_id)
                block_sizes, per_doc = blocks_of(lengths)
                words, counts = pack(ids, block_sizes)
                edges = np.concatenate([[0], np.cumsum(counts)])
                doc_edges = np.concatenate([[0], np.cumsum(per_doc)])
                raw = words.astype("<u8").tobytes()
                bounds = edges[doc_edges]
                offsets = edges[:-1] - np.repeat(bounds[:-1], per_doc)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").slice(at, len(sizes)), pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(doc_edges, pa.int32()), pa.array(offsets, pa.int32())),
                    pa.array([raw[8 * a : 8 * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                ], names=["doc_id", "n_ids", "offsets", "words"])
                at += len(sizes)

    batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(alone(run), f"doc_id {kind}, n_ids long, offsets array<int>, words binary")


def write_files(docs: DataFrame, where: str, path: str, end_id: int | None = 0) -> None:
    """Write the ids of all documents to the folder `where` in ascending doc_id order (rows without an id first, equal ids in the
    order of the hashes of their texts). Part numbers and places within a part give the order of the whole."""
    # texts are dealt by id before they are encoded: dealing by range looks at its input twice
    parts = max(1, shuffle_width(docs.sparkSession))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = encode(docs.select("doc_id", "text").repartitionByRange(parts, *order).sortWithinPartitions(*order), path, end_id)
    placed = ordered.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    placed.write.option("compression", "none").parquet(where)


def read_files(spark: SparkSession, where: str, *, with_ids: bool = True) -> DataFrame:
    """What files in the folder `where` hold, a row for each document: doc_id, part, place, n_tokens, ids_crc32 and, with_ids, ids."""
    files = spark.read.parquet(where)
    kind = files.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lengths = part.column("n_ids").to_numpy()
            raw = part.column("words").to_pylist()
            words = np.frombuffer(b"".join(raw), "<u8")
            sizes, per_doc = blocks_of(lengths)
            doc_words = np.fromiter((len(r) // 8 for r in raw), np.int64, len(raw))
            offsets = part.column("offsets").flatten().to_numpy().astype(np.int64)
            first = np.cumsum(per_doc) - per_doc
            after = np.concatenate([offsets[1:], [0]])
            last = (first + per_doc - 1)[per_doc > 0]
            after[last] = doc_words[per_doc > 0]
            ids = unpack(words, after - offsets, sizes)
            edges = np.concatenate([[0], np.cumsum(lengths)])
            small = ids.astype("<u4")
            crc = [zlib.crc32(small[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            columns = [part.column("doc_id"), part.column("part"), part.column("place"), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "part", "place", "n_tokens", "ids_crc32"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int64))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    batches(spark)
    shape = f"doc_id {kind}, part int, place long, n_tokens long, ids_crc32 long" + (", ids array<bigint>" if with_ids else "")
    return files.mapInArrow(alone(run), shape)


def starts(decoded: DataFrame) -> DataFrame:
    """decoded with `start`: ids of all documents before, in the order of the files. Sums run within a part; the figures
    for parts are one row each."""
    totals = decoded.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = totals.withColumn("base", F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).select("part", "base")
    run = Window.partitionBy("part").orderBy("place")
    inside = decoded.withColumn("start", F.sum("n_tokens").over(run) - F.col("n_tokens"))
    return inside.join(F.broadcast(before), "part").withColumn("start", F.col("base") + F.col("start")).drop("base")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded, written, and read back. Null texts are empty texts: the end id alone."""
    where = folder(spark, "tokens")
    write_files(read(spark, sf_dir, "documents"), where, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    decoded = stored(read_files(spark, where, with_ids=False), "token-files")
    return starts(decoded).select("doc_id", "start", "n_tokens", "ids_crc32")
