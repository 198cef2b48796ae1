"""Suffix arrays by two-stage sorting, on arrays.

Only suffixes smaller than their successors are sorted directly, by their first `depth` bytes. The rest are induced: a scan of
the buckets (suffixes by first byte) in ascending order puts the predecessor of each suffix that it meets next in its own
bucket. The scan takes a bucket at a time: everything that one bucket induces is dealt out in one stable sort by byte.
"""

from __future__ import annotations

import numpy as np

DEPTH = 56  # bytes of the direct sort, unless more are asked for; a multiple of 8


def words(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The eight bytes from each place on as a number that sorts as they do; zeros follow the text."""
    wide = np.zeros(len(text) + depth + 8, np.uint8)
    wide[: len(text)] = text
    out = wide.astype(np.uint64)
    for width in (1, 2, 4):
        out = (out[:-width] << np.uint64(8 * width)) | out[width:]
    return out


def _order(keys: list[np.ndarray]) -> np.ndarray:
    """The order by several keys, the first one first. Two are sorted by at once; the others only decide among ties."""
    order = np.lexsort(keys[1::-1])
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys[:2]:
        same &= k[order[1:]] == k[order[:-1]]
    if len(keys) > 2 and same.any():
        tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
        group = np.cumsum(np.concatenate([[True], ~same]))[tied]
        rest = order[tied]
        order[tied] = rest[np.lexsort([*(k[rest] for k in keys[:1:-1]), group])]
    return order


def suffix_array(text: np.ndarray, eight: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """All suffixes of a text of bytes that ends with its smallest byte, in the order of their first `depth` bytes at least
    (ties in any order). eight: words(text, depth)."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # a suffix is smaller than the next if the first byte that differs from its own is larger
    edge = np.flatnonzero(text[1:] != text[:-1])
    run_end = np.concatenate([edge, [n - 1]])
    rises = np.concatenate([text[edge + 1] > text[edge], [True]])
    smaller = np.repeat(rises, np.diff(np.concatenate([[-1], run_end])))
    direct = np.flatnonzero(smaller)
    direct = direct[_order([eight[direct + 8 * j] for j in range(depth // 8)])]
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in np.flatnonzero(np.bincount(text, minlength=256)).tolist():
        part = waiting[c]
        k = 0
        while k < len(part):  # runs of one byte induce within their bucket
            before = part[k] - 1
            before = before[before >= 0]
            before = before[(text[before] == c) & ~smaller[before]]
            if len(before):
                part.append(before)
            k += 1
        part.append(direct[bounds[c] : bounds[c + 1]])
        bucket = np.concatenate(part)
        waiting[c] = []
        out.append(bucket)
        before = bucket - 1
        before = before[before >= 0]
        byte = text[before]
        up = byte > c
        before, byte = before[up], byte[up]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cuts = np.flatnonzero(np.diff(byte)) + 1
        for run in np.split(before, cuts) if len(before) else ():
            waiting[int(text[run[0]])].append(run)
    return np.concatenate(out)


def common_prefixes(order: np.ndarray, eight: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Bytes that each suffix in the order has in common with the one before it, at most `depth`; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for j in range(depth // 8):
        differ = eight[order[live] + 8 * j] ^ eight[order[live - 1] + 8 * j]
        same = differ == 0
        d = differ[~same]
        lead = np.zeros(len(d), np.int64)
        for b in range(1, 8):
            lead += d < np.uint64(1) << np.uint64(64 - 8 * b)
        out[live[~same]] = 8 * j + lead
        live = live[same]
    out[live] = depth
    return out
