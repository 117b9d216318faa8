"""Words, word hashes and windows of Arrow text columns, computed on whole buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  All texts of a slice share one byte buffer;
`Words` holds where each word lies and which text it belongs to.  Hashes are 64-bit polynomials over the bytes,
equal in every process.  Nothing here depends on Spark.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

SLICE_BYTES = 2 << 20
BLOCK = 1 << 18
U = np.uint64
P = 0x9E3779B97F4A7C15
Q = 0xD6E8FEB86659FD93

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PLAIN = LOWER.copy()
PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


@lru_cache(4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads low bits upwards and back (in place on a copy)."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xC2B2AE3D27D4EB4F)
    h ^= h >> U(29)
    return h


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about `limit` bytes of text each; one long text is a part of its own."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(a, b - a)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (a null is empty) and the n + 1 offsets into them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0]:at[-1]], at - at[0]


class Words:
    """`start` and `end` of every word in `buf`; `first[t]:first[t + 1]` are the words of text t."""

    def __init__(self, column: pa.Array, table: np.ndarray | None = None):
        """table: what each byte is replaced by first, such as LOWER."""
        self.buf, self.offsets = text_buffer(column)
        if table is not None:
            self.buf = table[self.buf]
        n = len(self.buf)
        space = SPACE[self.buf]
        edge = np.ones(n + 1, bool)
        edge[1:] = False
        edge[self.offsets] = True
        before = edge[:n].copy()
        before[1:] |= space[:-1]
        self.start = np.flatnonzero(before & ~space)
        after = edge[1:]
        after[:-1] |= space[1:]
        self.end = np.flatnonzero(after & ~space) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return span_hashes(self.buf, self.start, self.end, seed)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i]:self.end[i]].tobytes()

    def pieces(self, at: np.ndarray) -> pa.Array:
        """The words with these indices as an Arrow binary column."""
        return take_spans(self.buf, self.start[at], self.end[at])


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """One 64-bit value per range of bytes (in order, not overlapping), block by block so that the working set stays in the cache."""
    table = mix(np.arange(1, 257, dtype=U) + U(seed << 32))
    out = np.zeros(len(start), U)
    inverse = pow(P, -1, 1 << 64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, "right")))
        base, stop = int(start[i]), int(end[j - 1])
        size = BLOCK if stop - base <= BLOCK else stop - base
        total = np.zeros(stop - base + 1, U)
        np.cumsum(table[buf[base:stop]] * powers(P, size + 1)[: stop - base], out=total[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = (total[e] - total[s]) * powers(inverse, size + 1)[s]
        i = j
    return mix(out)


def take_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow binary column, gathered without a loop over ranges."""
    size = (end - start).astype(np.int64)
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    index = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(buf[index])])


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n values from each position on, by doubling; the last n - 1 are not meaningful across texts."""
    total = len(h) - n + 1
    if total <= 0:
        return np.zeros(0, U)
    out, done, block, size = None, 0, h, 1
    bits = n
    while bits:
        if bits & 1:
            part = block[done:done + total] if out is not None else block[:total]
            out = part.copy() if out is None else out * U(pow(Q, size, 1 << 64)) + part
            done += size
        bits >>= 1
        if bits:
            block = block[:-size] * U(pow(Q, size, 1 << 64)) + block[size:]
            size *= 2
    return mix(out)


def window_starts(count: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Indices of the words at which a window of n words of one text starts."""
    has = np.maximum(count - n + 1, 0)
    return np.arange(has.sum()) + np.repeat(first[:-1] - (np.cumsum(has) - has), has)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """The least of the w values from each position on."""
    out, size = values, 1
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:]) if len(out) > size else out[:0]
        size *= 2
    if size < w:
        d = w - size
        out = np.minimum(out[:-d], out[d:]) if len(out) > d else out[:0]
    return out


def covered(count: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of `count` positions lie in one of the ranges."""
    step = np.zeros(count + 1, np.int64)
    np.add.at(step, np.minimum(starts, count), 1)
    np.add.at(step, np.minimum(ends, count), -1)
    return np.cumsum(step[:-1]) > 0


class Remembered:
    """Lists of integers per distinct byte string, worked out once each; at most about `limit` strings are remembered.
    `work` returns a list for each string, or their sizes and all integers in a row.

    Strings are told apart by their 64-bit hash: with a quarter of a million remembered, two share one with a probability of 2e-9."""

    def __init__(self, work, limit: int = 1 << 18):
        self.work, self.limit = work, limit
        self.clear()

    def clear(self) -> None:
        self.row: dict[int, int] = {}
        self.size, self.used, self.values = np.zeros(1 << 16, np.int64), 0, np.zeros(1 << 18, np.int32)
        self.start = np.zeros(1 << 16, np.int64)

    @staticmethod
    def _grown(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])

    def lists(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of integers of each string, and all integers in a row."""
        if len(self.row) > self.limit:
            self.clear()
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        row = np.array([self.row.get(x, -1) for x in distinct.tolist()], np.int64)
        new = np.flatnonzero(row < 0)
        if len(new):
            found = self.work([buf[a:b].tobytes() for a, b in zip(start[first[new]], end[first[new]])])
            if isinstance(found, tuple):
                size, flat = found
            else:
                size = np.array([len(x) for x in found], np.int64)
                flat = np.fromiter((v for x in found for v in x), np.int32, size.sum())
            n = len(self.row)
            row[new] = np.arange(n, n + len(new))
            self.row.update(zip(distinct[new].tolist(), row[new].tolist()))
            self.size, self.start = self._grown(self.size, n + len(new)), self._grown(self.start, n + len(new))
            self.values = self._grown(self.values, self.used + len(flat))
            self.size[n:n + len(new)] = size
            self.start[n:n + len(new)] = self.used + np.cumsum(size) - size
            self.values[self.used:self.used + len(flat)] = flat
            self.used += len(flat)
        row = row[back]
        size = self.size[row]
        return size, self.values[np.arange(size.sum()) + np.repeat(self.start[row] - (np.cumsum(size) - size), size)]


def encoded(model, strings: list[str], some: int = 4096) -> Iterator[list[int]]:
    """Each string's ids by a model of the tokenizers library, a few at a time: what it returns for each is large."""
    for a in range(0, len(strings), some):
        yield from (e.ids for e in model.encode_batch_fast(strings[a:a + some], add_special_tokens=False))
