"""Token ids of many texts by way of their distinct chunks: each chunk is encoded once in a worker, then looked up."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from itertools import chain, compress

import numpy as np

from tidemill.llm.common import ranges


class _Index(dict):
    """Numbers for chunks in the order in which they come; new ones are listed until they have been encoded."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, chunk):
        self.new.append(chunk)
        number = len(self)
        self[chunk] = number
        return number


class ChunkStore:
    """Ids of chunks, by chunk. Holds at most about `limit` chunks, or 5 * limit ids, and the largest batch's; then it goes on with
    those that came again since the last time, or anew if these are more than half of that."""

    def __init__(self, encode: Callable[[list], tuple[list, np.ndarray, np.ndarray]], limit: int = 800_000):
        """encode: the given chunks in some order (and others, if it has them), the ids of all of them in that order, and how
        many each has."""
        self.encode, self.limit = encode, limit
        self._reset()

    def _reset(self) -> None:
        self.index = _Index()
        self.encoded = 0  # numbers below this have ids
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.again = np.zeros(1 << 16, bool)  # chunks that came in a later batch than their first

    def _shrink(self) -> None:
        """Most chunks come once only: keep the others."""
        index, kept = self.index, np.flatnonzero(self.again[: self.encoded])
        starts, lengths = self.starts[kept], self.lengths[kept]
        ids = self.flat[ranges(starts, lengths)] if lengths.sum() <= 5 * self.limit // 2 else None
        chunks = compress(index, self.again[: len(index)].tolist())
        self._reset()
        if ids is not None and len(kept) <= self.limit // 2:
            self.index.update(zip(chunks, range(len(kept)), strict=True))
            self._put(np.arange(len(kept)), ids, lengths)

    def _add(self) -> None:
        chunks, ids, lengths = self.encode(self.index.new)
        self._put(np.fromiter(map(self.index.__getitem__, chunks), np.int64, len(chunks)), ids, lengths)
        self.index.new.clear()

    def _put(self, numbers: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        while len(self.index) > len(self.starts):
            self.starts, self.lengths, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.again))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.used : self.used + len(ids)] = ids
        self.lengths[numbers] = lengths
        self.starts[numbers] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.encoded = len(self.index)

    def ids(self, texts: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each a list of chunks, one after another; how many each text has."""
        if len(self.index) > self.limit or self.used > 5 * self.limit:
            self._shrink()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.fromiter(map(self.index.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        self.again[codes[codes < self.encoded]] = True
        if self.index.new:
            self._add()
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        out = self.flat[np.repeat(self.starts[codes] - ends + lengths, lengths) + np.arange(total)]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.concatenate([[0], ends])[edges]
        return out, np.diff(bounds)


def groups(texts: Iterable[str], chars: int = 2_000_000) -> Iterable[list[int]]:
    """Indices of texts in runs of at least one text and about `chars` characters, so that long texts don't pile up."""
    run, size = [], 0
    for i, t in enumerate(texts):
        run.append(i)
        size += len(t)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run
