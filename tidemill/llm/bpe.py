"""BPE encoding and decoding: speculate and verify.

Greedy longest match proposes the tokens of a word. A sequence of tokens is what the merges would give exactly if every
adjacent pair is compatible, that is, if no merge that comes before the ones that made the two tokens would have joined
symbols across their border. All adjacent pairs of a batch are tested together on arrays; only words with a failing pair
are merged exactly. Words are looked up by white-space separated chunks, so each distinct chunk is worked on once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.chunks import ChunkStore, groups
from tidemill.llm.common import alone, batches, held, read

END = "</w>"
#: Printable ASCII and precomposed Latin-1 letters: lower-casing them is all that normalising does.
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿªµº]+|[0-9]|[^\sa-zß-öø-ÿªµº0-9]+")


def byte_letters() -> list[str]:
    """The letter for each byte: itself where it prints, else the next code point from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b if b in own else more))
        more += b not in own
    return out


class WordBpe:
    """Encoder and decoder for a BPE vocabulary with word ends, read from a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)  # its normalizer and splitter, for characters out of the plain range
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for t, i in (self.vocab | self.special).items():
            self.tokens[i] = t
        self.letters = str.maketrans({b: c for b, c in enumerate(byte_letters())})
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): r for r, (a, b) in enumerate(merges)}
        # order: symbols that no merge makes, then tokens as the merges make them
        self.order = np.arange(size, dtype=np.int64)
        made = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        left, right = np.array(list(self.rank), np.int64).reshape(-1, 2).T
        self.order[made] = size + np.arange(len(made))
        self.first, self.last = np.arange(2 * size), np.arange(2 * size)  # in terms of order
        self.first[self.order[made]], self.last[self.order[made]] = self.order[left], self.order[right]
        self.width = 2 * size
        keys = self.order[left] * self.width + self.order[right]
        by = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[by], self.order[made][by]
        self.made = made.tolist()
        bare = [t.removesuffix(END) for t in self.vocab]
        self.begins = {t[:i] for t in bare for i in range(1, len(t) + 1)}
        self.merged = self.proposed = 0

    # -- words

    def propose(self, word: str) -> list[int]:
        """Longest match from the left. word: byte letters."""
        get, begins, n, i, out = self.vocab.get, self.begins, len(word), 0, []
        while i < n:
            best, size, j = None, 0, i + 1
            while j <= n and (part := word[i:j]) in begins:
                found = get(part + END) if j == n else get(part)
                if found is not None:
                    best, size = found, j
                j += 1
            if best is None:
                raise ValueError(f"no token for {word[i]!r}")
            out.append(best)
            i = size
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of each two tokens gives just these two tokens."""
        key, back = np.unique(left.astype(np.int64) * len(self.tokens) + right, return_inverse=True)
        a, b = self.order[key // len(self.tokens)], self.order[key % len(self.tokens)]
        good, open_ = np.ones(len(key), bool), np.arange(len(key))
        limit = np.full(len(key), np.iinfo(np.int64).max)
        while len(open_):
            want = a * self.width + b
            at = np.minimum(np.searchsorted(self.pair_keys, want), len(self.pair_keys) - 1)
            joins = (self.pair_keys[at] == want) & (self.pair_made[at] < limit)
            good[open_[joins]] = False
            # undo the later of the two tokens' merges; where that is a single symbol, the other's
            later = a > b
            na, nb, nl = a.copy(), b.copy(), limit.copy()
            stuck_a, stuck_b = self.last[a] == a, self.first[b] == b
            go_a = (later & ~stuck_a) | (~later & stuck_b & ~stuck_a)
            go_b = (~later & ~stuck_b) | (later & stuck_a & ~stuck_b)
            nl[go_a], na[go_a] = a[go_a], self.last[a[go_a]]
            nl[go_b], nb[go_b] = b[go_b] + 1, self.first[b[go_b]]
            on = ~joins & (go_a | go_b)
            a, b, limit, open_ = na[on], nb[on], nl[on], open_[on]
        return good[back]

    def merge(self, word: str) -> list[int]:
        """The merges, one by one: the lowest rank first, from the left. Open pairs wait in a heap, so a word of n letters takes
        about n log n steps."""
        symbols = [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + END]]
        rank, n = self.rank.get, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r, i) for i, p in enumerate(zip(symbols, symbols[1:])) if (r := rank(p)) is not None]
        heapify(waiting)
        while waiting:
            low, i = heappop(waiting)
            j = after[i]
            # a pair that has been merged or changed since is passed by
            if symbols[i] is None or j >= n or rank((symbols[i], symbols[j])) != low:
                continue
            symbols[i], symbols[j] = self.made[low], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank((symbols[i], symbols[after[i]]))) is not None:
                    heappush(waiting, (r, i))
            if before[i] >= 0 and (r := rank((symbols[before[i]], symbols[i]))) is not None:
                heappush(waiting, (r, before[i]))
        return [x for x in symbols if x is not None]

    def words(self, words: list[str]) -> list[list[int]]:
        """The tokens of each word (byte letters)."""
        proposed = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(words)), sizes)
        inside = np.flatnonzero(of[1:] == of[:-1]) if len(of) else np.zeros(0, np.int64)
        bad = np.unique(of[inside[~self.compatible(flat[inside], flat[inside + 1])]]) if len(inside) else []
        self.proposed += len(words)
        self.merged += len(bad)
        for i in bad:
            proposed[i] = self.merge(words[i])
        return proposed

    # -- chunks and texts

    def pieces(self, chunk: str) -> list[str | int]:
        """Words (byte letters) and ids of special tokens, of a chunk."""
        if "<|" in chunk and self.split_special:
            parts = self.split_special.split(chunk)
            if len(parts) > 1:
                return [x for p in parts if p for x in ([self.special[p]] if p in self.special else self.pieces(p))]
        if chunk.isascii() and _PLAIN.fullmatch(chunk):
            return _PIECES.findall(chunk.lower())
        if _PLAIN.fullmatch(chunk):
            return [p.encode().decode("latin-1").translate(self.letters) for p in _PIECES.findall(chunk.lower())]
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]

    def encode_chunks(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        pieces = [self.pieces(c) for c in chunks]
        words = list({w for p in pieces for w in p if isinstance(w, str)})
        tokens = dict(zip(words, self.words(words), strict=True))
        out = [[t for w in p for t in (tokens[w] if isinstance(w, str) else (w,))] for p in pieces]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return chunks, np.fromiter(chain.from_iterable(out), np.uint32, int(sizes.sum())), sizes

    @staticmethod
    def chunks(text: str) -> list[str]:
        return text.replace("\n", " ").replace("\t", " ").split(" ")

    def decode(self, ids: np.ndarray) -> str:
        """Tokens as they stand in the vocabulary, with spaces between: the file names no decoder."""
        return " ".join([self.tokens[i] for i in ids.tolist()])


def loaded(path: str) -> tuple[WordBpe, ChunkStore]:
    """The encoder of a file and its store of chunks; they stay with the worker for its next tasks."""

    def make() -> tuple[WordBpe, ChunkStore]:
        own = WordBpe(path)
        return own, ChunkStore(own.encode_chunks)

    return held(("bpe", path), make)


def encode_batch(texts: list[str], path: str) -> Iterator[np.ndarray]:
    own, store = loaded(path)
    for run in groups(texts):
        ids, sizes = store.ids([own.chunks(texts[i]) for i in run])
        yield from np.split(ids, np.cumsum(sizes)[:-1])


def encode(docs: DataFrame, path: str | None = None, *, keep: list[str] | None = None, keep_ids: bool = True, keep_text: bool = False) -> DataFrame:
    """Per row: the columns in `keep` (doc_id unless said otherwise), ids (array<int>, with keep_ids), decoded (the text that
    decoding the ids gives, with keep_text), n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and
    decoded_sha256 (of the decoded text in UTF-8).

    Null texts are empty texts: no ids, an empty decoded text. Rows are independent of each other; other columns aren't
    looked at. Kept columns come first; a name of the result that one of them has already gets a "bpe_" before it.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    keep = ["doc_id"] if keep is None else keep
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = loaded(path)
        for part in parts:
            texts = [t or "" for t in part.column("_text").to_pylist()]
            ids, decoded, counts, id_hashes, text_hashes = [], [], [], [], []
            for x in encode_batch(texts, path):
                counts.append(len(x))
                id_hashes.append(hashlib.sha256(x.astype("<u4").tobytes()).hexdigest())
                text = own.decode(x)
                text_hashes.append(hashlib.sha256(text.encode()).hexdigest())
                if keep_ids:
                    ids.append(x.astype(np.int32))
                if keep_text:
                    decoded.append(text)
            names = [f"_k{i}" for i in range(len(keep))]
            columns = [part.column(n) for n in names]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("_ids")
            if keep_text:
                columns.append(pa.array(decoded, pa.string()))
                names.append("_decoded")
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())], names=[*names, "_n", "_ids_sha", "_text_sha"])

    batches(docs.sparkSession)
    rows = docs.select(F.col("text").alias("_text"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)])
    shape = [f"_k{i} {k}" for i, k in enumerate(kinds)] + ["_ids array<int>"] * keep_ids + ["_decoded string"] * keep_text + ["_n long", "_ids_sha string", "_text_sha string"]
    names = ["ids"] * keep_ids + ["decoded"] * keep_text + ["n_tokens", "ids_sha256", "decoded_sha256"]
    return rows.mapInArrow(alone(run), ", ".join(shape)).toDF(*keep, *[f"bpe_{n}" if n in keep else n for n in names])


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their own columns (the text too), and their ids, how many they are, and both hashes."""
    return encode(docs, keep=docs.columns)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), keep_ids=False)
