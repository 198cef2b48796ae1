"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words, n-grams of its UTF-8 bytes (so of its characters, where
they are ASCII) and word repetitions; a softmax layer over that average gives the label. Vectors and layer are fitted together by stochastic gradient descent in numpy, on a sample of labelled rows of
documented size (MAX_ROWS a class). Since the layer is linear, each hashed feature then has one number, its vector's share
of the logit, and a document's logit is the average of the numbers of its features: scoring whole texts is a few passes
over their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.chunks import groups
from tidemill.llm.common import alone, batches, held_out, joined, mix, powers, read

#: The most labelled rows of each class that are learnt from.
MAX_ROWS = 2500
#: Of a text that is longer than both together, so many pieces of so many characters, evenly spread, are learnt from.
PIECES = 16
PIECE = 1000
BUCKETS = 1 << 17
GRAMS = (2, 3, 4)
DIM = 8
#: Passes over the sample; more over a small one, until about this many rows have been seen, but MOST_EPOCHS at most.
EPOCHS = 6
ROWS_SEEN = 12_000
MOST_EPOCHS = 30
RATE = 0.5
BATCH = 32
CUT = 0.7

_SPACE = np.zeros(256, bool)
_SPACE[[0, 9, 10, 13, 32]] = True


def features(texts: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """For each kind of feature: buckets of all its occurrences, in order, and each text's first and past-the-last; and the
    number of features of each text."""
    buf, starts, lengths = joined(texts)
    wide = buf.astype(np.uint64)
    out, total = [], np.zeros(len(texts), np.int64)
    gram = wide
    for n in range(2, max(GRAMS) + 1):
        gram = (gram[:-1] << np.uint64(8)) | wide[n - 1 :] if len(gram) > 1 else gram[:0]
        if n in GRAMS:
            # the gram's length takes part in the hash
            key = ((gram + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 17)
            count = np.maximum(lengths - n + 1, 0)
            out.append((key.astype(np.int32), starts, starts + count))
            total += count
    gap = _SPACE[buf].view(np.int8)
    edge = np.diff(gap, prepend=np.int8(1))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)  # every text ends with a zero byte
    up, down = powers(len(buf) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((wide + np.uint64(1)) * up[: len(buf)])])
    key = mix((sums[end] - sums[begin]) * down[begin]) >> np.uint64(64 - 17)
    first, last = np.searchsorted(begin, starts), np.searchsorted(begin, starts + lengths)
    out.append((key.astype(np.int32), first, last))
    # a word that repeats the one before it is a feature, whatever the word
    again = np.flatnonzero((key[1:] == key[:-1]) & (np.searchsorted(starts, begin[1:], side="right") == np.searchsorted(starts, begin[:-1], side="right"))) + 1 if len(key) else key.astype(np.int64)
    first_again, last_again = np.searchsorted(again, first), np.searchsorted(again, last)
    out.append((np.full(len(again), BUCKETS, np.int32), first_again, last_again))
    return out, total + last - first + last_again - first_again


def _rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as sparse rows: buckets, shares, first entry of each text."""
    ids, shares, sizes = [], [], []
    for t in texts:
        kinds, total = features([t.encode()])
        found, count = np.unique(np.concatenate([k[a[0] : b[0]] for k, a, b in kinds]), return_counts=True)
        ids.append(found)
        shares.append((count / max(1, int(total[0]))).astype(np.float32))
        sizes.append(len(found))
    return np.concatenate(ids), np.concatenate(shares), np.concatenate([[0], np.cumsum(sizes)])


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Each bucket's share of the logit of label 1 against 0, and the bias. Without both labels: zeros, and a bias by the
    label there is (0 without any)."""
    if len(set(labels.tolist())) < 2:
        return np.zeros(BUCKETS + 1, np.float32), 0.0 if not len(labels) else 4.0 * (2 * int(labels[0]) - 1)
    rng = np.random.default_rng(seed)
    ids, shares, at = _rows(texts)
    vectors = (rng.standard_normal((BUCKETS + 1, DIM)) * 0.1).astype(np.float32)
    layer, bias = (rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32), np.zeros(2, np.float32)
    seen_v, seen_l, seen_b = np.full((BUCKETS + 1, DIM), 1e-8, np.float32), np.full((DIM, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    # both labels weigh the same, however many rows of each there are
    weight = (len(labels) / 2 / np.bincount(labels, minlength=2))[labels].astype(np.float32)
    for _ in range(min(MOST_EPOCHS, max(EPOCHS, -(-ROWS_SEEN // len(labels))))):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            sizes = at[rows + 1] - at[rows]
            spread = np.concatenate([np.arange(at[r], at[r + 1]) for r in rows])
            of, own, share = np.repeat(np.arange(len(rows)), sizes), ids[spread], shares[spread]
            hidden = np.zeros((len(rows), DIM), np.float32)
            full = sizes > 0
            if full.any():
                hidden[full] = np.add.reduceat(vectors[own] * share[:, None], (np.cumsum(sizes) - sizes)[full])
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p *= weight[rows, None] / len(rows)
            step_h, step_l, step_b = p @ layer.T, hidden.T @ p, p.sum(0)
            touched, back = np.unique(own, return_inverse=True)
            step = np.stack([np.bincount(back, weights=share * step_h[of, d], minlength=len(touched)) for d in range(DIM)], 1).astype(np.float32)
            seen_v[touched] += step * step
            vectors[touched] -= RATE * 0.1 * step / np.sqrt(seen_v[touched])
            seen_l += step_l * step_l
            layer -= RATE * 0.1 * step_l / np.sqrt(seen_l)
            seen_b += step_b * step_b
            bias -= RATE * 0.1 * step_b / np.sqrt(seen_b)
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def scores(texts: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 for each whole text; that of the bias alone for an empty one."""
    kinds, total = features([t.encode() for t in texts])
    logit = np.zeros(len(texts))
    for key, first, past in kinds:
        run = np.concatenate([[0.0], np.cumsum(table[key], dtype=np.float64)])
        logit += run[np.minimum(past, len(key))] - run[np.minimum(first, len(key))]
    return 1 / (1 + np.exp(-np.clip(logit / np.maximum(total, 1) + bias, -50, 50)))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray]:
    """At most about max_rows texts of each label, of documents that aren't held out: the same ones in every run.

    Of long texts PIECES pieces are learnt from, so the sample has a bounded size. The sampled labels are of a bounded number
    and are broadcast; the documents are scanned once. Documents without a
    label, with a null one, or with one other than 0 and 1, are not learnt from; of several labels for a document, the
    lowest counts.
    """
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality")).filter(~held_out() & F.col("doc_id").isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    part = F.create_map(*[x for q in (0, 1) for x in (F.lit(q), F.lit(min(1.0, max_rows / max(1, counts.get(q, 0)))))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    taken = known.filter(draw < part[F.col("quality").cast("int")])
    text = F.coalesce("text", F.lit(""))
    step = (F.length(text) - PIECE) / F.lit(PIECES - 1)
    pieces = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring(text, F.floor(i * step).cast("int") + 1, F.lit(PIECE))), " ")
    learnt = F.when(F.length(text) > PIECES * PIECE, pieces).otherwise(text)
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select(learnt.alias("text"), "quality", "doc_id").orderBy("doc_id", "text").collect()
    return [r[0] for r in rows], np.array([r[1] for r in rows], np.int64)


def score_documents(docs: DataFrame, table: np.ndarray, bias: float) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= CUT) of every row, from its whole text alone. Null texts are empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [t or "" for t in part.column("text").to_pylist()]
            found = [scores([texts[i] for i in own], table, bias) for own in groups(texts)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())], names=["doc_id", "held_out", "score"])

    batches(docs.sparkSession)
    scored = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(alone(run), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    table, bias = train(*labelled_sample(docs, read(spark, sf_dir, "labels")))
    return score_documents(docs, table, bias)
