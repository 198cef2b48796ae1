"""Language ID: a byte convolutional network.

Bytes have learned vectors; filters of several widths slide over fixed-length windows; each filter's largest value in a
window goes into a softmax over the languages. The network is trained in numpy on a sample of documented size, and applied
to batches of all windows of all texts. A document's language is that of the average of its windows' log probabilities.

For the scan, vectors and filters are multiplied out once into tables by byte pairs, so a position costs two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.chunks import groups
from tidemill.llm.common import alone, batches, held_out, read

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8  # of each width
DIM = 8
PAD = 3  # zero bytes between texts: no filter sees two
#: The most documents of each language, and windows of each document, that are learnt from.
MAX_DOCS = 500
MAX_WINDOWS = 4
EPOCHS = 12
RATE = 0.05
BATCH = 64
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    vectors: np.ndarray  # 256 x DIM; the vector of byte 0 is zero
    filters: dict[int, np.ndarray]  # width -> width x DIM x FILTERS
    offsets: np.ndarray  # one a filter
    layer: np.ndarray
    bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """By a pair of bytes: width 2; the first two bytes of width 3; the first and the last two of width 4. By a byte:
        the last one of width 3."""
        by = {w: np.einsum("bd,jdf->jbf", self.vectors, k) for w, k in self.filters.items()}

        def pair(w, j):
            return (by[w][j][:, None, :] + by[w][j + 1][None, :, :]).reshape(65536, FILTERS)

        return np.ascontiguousarray(np.concatenate([pair(2, 0), pair(3, 0), pair(4, 0), pair(4, 2)], 1), np.float32), np.ascontiguousarray(by[3][2], np.float32)

    def predict(self, texts: list[bytes], tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Log probabilities of the languages for each text; equal ones for an empty text."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(lengths + PAD) - lengths - PAD
        buf = np.frombuffer((b"\0" * PAD).join(texts) + b"\0" * (PAD + 1), np.uint8)
        n = -(-lengths // WINDOW)
        ends = np.cumsum(n)
        first = np.repeat(starts, n) + WINDOW * (np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n))
        size = np.minimum(WINDOW, np.repeat(starts + lengths, n) - first)
        pooled = np.empty((len(first), len(WIDTHS) * FILTERS), np.float32)
        pairs, single = tables
        for k in range(0, len(first), 64):  # few windows at a time: what they need stays in the cache
            lo, hi = int(first[k]), int(first[min(k + 63, len(first) - 1)] + WINDOW)
            part = np.zeros(hi - lo + PAD + 1, np.uint8)
            got = buf[lo : hi + PAD + 1]
            part[: len(got)] = got
            p = pairs[(part[:-1].astype(np.int32) << 8) | part[1:]]
            m = hi - lo
            conv = np.concatenate([p[:m, :8], p[:m, 8:16] + single[part[2 : m + 2]], p[:m, 16:24] + p[2 : m + 2, 24:]], 1)
            f, s = first[k : k + 64] - lo, size[k : k + 64]
            bounds = np.stack([f, f + s], 1).ravel()
            conv = np.concatenate([conv, np.full((1, conv.shape[1]), -np.inf, np.float32)])
            pooled[k : k + 64] = np.maximum.reduceat(conv, bounds, 0)[::2]
        logits = np.maximum(pooled + self.offsets, 0) @ self.layer + self.bias
        logits -= logits.max(1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(1, keepdims=True))
        out = np.zeros((len(texts), len(self.languages)))
        if (n > 0).any():
            out[n > 0] = np.add.reduceat(logits * size[:, None], (ends - n)[n > 0], 0) / lengths[n > 0, None]
        out -= out.max(1, keepdims=True)
        return out - np.log(np.exp(out).sum(1, keepdims=True))


def _windows(text: bytes, rng: np.random.Generator) -> np.ndarray:
    """Up to MAX_WINDOWS windows, from anywhere in the text."""
    n = max(1, -(-len(text) // WINDOW))
    picked = np.sort(rng.permutation(n)[:MAX_WINDOWS])
    out = np.zeros((len(picked), WINDOW + PAD), np.uint8)
    for row, w in zip(out, picked.tolist(), strict=True):
        got = np.frombuffer(text[w * WINDOW : (w + 1) * WINDOW + PAD], np.uint8)
        row[: len(got)] = got
    return out


def train(parts: list[np.ndarray], langs: list[str], seed: int = 11) -> Network:
    """parts: the windows of each document. Without any labelled document, the network knows no language."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(langs))
    net = Network(
        languages, (rng.standard_normal((256, DIM)) * 0.5), {w: rng.standard_normal((w, DIM, FILTERS)) * (1 / np.sqrt(w * DIM)) for w in WIDTHS},
        np.zeros(len(WIDTHS) * FILTERS), rng.standard_normal((len(WIDTHS) * FILTERS, len(languages))) * 0.1, np.zeros(len(languages)),
    )
    net.vectors[0] = 0
    if not languages:
        return net
    code = {lang: i for i, lang in enumerate(languages)}
    x = np.concatenate(parts)
    y = np.repeat([code[lang] for lang in langs], [len(p) for p in parts])
    params = [net.vectors, *net.filters.values(), net.offsets, net.layer, net.bias]
    means, squares, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) * 0.2
        order = rng.permutation(len(x))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            bx, by = x[rows], y[rows]
            pooled, where = [], []
            for w, kernel in net.filters.items():
                table = np.einsum("bd,jdf->jbf", net.vectors, kernel).astype(np.float32)
                conv = sum(table[j][bx[:, j : j + WINDOW]] for j in range(w))
                at = conv.argmax(1)
                where.append(at)
                pooled.append(np.take_along_axis(conv, at[:, None, :], 1)[:, 0])
            raw = np.concatenate(pooled, 1) + net.offsets
            hidden = np.maximum(raw, 0)
            logits = hidden @ net.layer + net.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), by] -= 1
            p /= len(rows)
            d_hidden = (p @ net.layer.T) * (raw > 0)
            grads = [np.zeros_like(net.vectors)]
            for i, (w, kernel) in enumerate(net.filters.items()):
                d = d_hidden[:, i * FILTERS : (i + 1) * FILTERS]
                g = np.zeros_like(kernel)
                for j in range(w):
                    byte = np.take_along_axis(bx, where[i] + j, 1)  # rows x FILTERS
                    g[j] = np.einsum("nf,nfd->df", d, net.vectors[byte])
                    np.add.at(grads[0], byte.ravel(), np.einsum("nf,df->nfd", d, kernel[j]).reshape(-1, DIM))
                grads.append(g)
            grads[0][0] = 0
            grads += [d_hidden.sum(0), hidden.T @ p, p.sum(0)]
            step += 1
            for q, g, m, s in zip(params, grads, means, squares, strict=True):
                m *= 0.9
                m += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def labelled_sample(docs: DataFrame, max_docs: int = MAX_DOCS) -> tuple[list[np.ndarray], list[str]]:
    """Windows of at most about max_docs texts of each language, and the languages. Rows without text or language, and
    held-out rows, are not learnt from. Windows are drawn in the tasks, so no text reaches the driver; a network of k
    languages has k rows of its layer anyway, and their counts are as many."""
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return [], []
    part = F.create_map(*[x for r in counts for x in (F.lit(r[0]), F.lit(min(1.0, max_docs / r[1])))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    taken = known.filter(draw < F.coalesce(part[F.col("lang")], F.lit(0.0))).select(F.xxhash64("doc_id", "text").alias("place"), "text", "lang")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            place = part.column("place")
            found = [_windows(t.encode(), np.random.default_rng(p & (2**63 - 1))).tobytes() for t, p in zip(part.column("text").to_pylist(), place.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([place, pa.array(found, pa.binary()), part.column("lang")], names=["place", "windows", "lang"])

    batches(docs.sparkSession)
    rows = taken.mapInArrow(alone(run), "place long, windows binary, lang string").orderBy("place", "lang").collect()
    return [np.frombuffer(r.windows, np.uint8).reshape(-1, WINDOW + PAD) for r in rows], [r.lang for r in rows]


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def identify(docs: DataFrame, net: Network, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, from its whole text alone, after the columns in `keep`.

    Null texts and texts without a letter are `und` with score 0, as is everything where no language was learnt.
    """
    keep = ["doc_id"] if keep is None else keep
    own = docs.select(F.col("text").alias("_text"), held_out().alias("_held"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)])
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net.languages else None
        for part in parts:
            texts = [t or "" for t in part.column("_text").to_pylist()]
            langs, sure = [], []
            for own_rows in groups(texts):
                raw = [texts[i].encode() for i in own_rows]
                found = net.predict(raw, tables) if tables else np.zeros((len(raw), 1))
                best = found.argmax(1)
                for i, b, p in zip(own_rows, best.tolist(), np.exp(found[np.arange(len(raw)), best]).tolist(), strict=True):
                    good = tables is not None and _has_letter(texts[i])
                    langs.append(net.languages[b] if good else UNKNOWN)
                    sure.append(min(1.0, p) if good else 0.0)
            yield pa.RecordBatch.from_arrays([*[part.column(f"_k{i}") for i in range(len(keep))], part.column("_held"), pa.array(langs, pa.string()), pa.array(sure, pa.float64())], names=[*[f"_k{i}" for i in range(len(keep))], "_held", "_lang", "_score"])

    batches(docs.sparkSession)
    shape = ", ".join([f"_k{i} {k}" for i, k in enumerate(kinds)] + ["_held boolean", "_lang string", "_score double"])
    return own.mapInArrow(alone(run), shape).toDF(*keep, "held_out", "lang_pred", "score")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, train(*labelled_sample(docs)))


#: Documents whose language is told with less certainty than this are rejected, as are those without any.
LEAST_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which a language was found, with their own columns.

    Rejected are null texts, texts without a letter, and those whose language is told with a score under LEAST_SCORE."""
    found = identify(docs, train(*labelled_sample(docs)), keep=docs.columns)
    # columns of the input may bear the names of the result: they come first, so they are told apart by place
    n = len(docs.columns)
    names = [f"_c{i}" for i in range(n)] + ["_held", "_lang", "_score"]
    return found.toDF(*names).filter((F.col("_lang") != UNKNOWN) & (F.col("_score") >= LEAST_SCORE)).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
