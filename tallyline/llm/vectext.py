"""Word hashing over whole Arrow batches with numpy.

A batch's text bytes are hashed in place: a wrapping prefix sum of
``table[byte] * BASE**position`` gives any word's polynomial hash from two
positions, so no Python object is made per word. Words are maximal runs of
bytes other than space and ``\\t..\\r``; ``A-Z`` count as ``a-z``. Null texts
count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; also spreads sums so that they can be summed again."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    folded = np.arange(256, dtype=np.uint64)
    folded[65:91] += U(32)
    space = np.zeros(256, dtype=bool)
    space[[0x20, 9, 10, 11, 12, 13]] = True
    return mix(folded + U(0x1234567)), space


BYTE_HASH, IS_SPACE = _tables()
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of the rows ``lo..hi`` of a column, in order."""

    lo: int
    hi: int
    data: np.ndarray  # bytes of these rows
    doc_start: np.ndarray  # byte offset of each row in data, and the end
    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    hash: np.ndarray  # uint64 of each word
    doc: np.ndarray  # row of each word, from 0
    count: np.ndarray  # words of each row
    total: np.ndarray  # prefix sums that any span's hash comes from

    @property
    def first(self) -> np.ndarray:
        """Number of the first word of each row."""
        return np.cumsum(self.count) - self.count


def texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    return column.cast(pa.large_string()) if column.type != pa.large_string() else column


def words(column: pa.Array | pa.ChunkedArray, chunk_bytes: int = CHUNK_BYTES, breaks: np.ndarray = IS_SPACE) -> Iterator[Words]:
    """Hash the words of a string column, a half megabyte of whole rows at a time. ``breaks`` marks the bytes that no word holds."""
    column = texts(column)
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk_bytes, "right")) - 1)
        yield _hashed(lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], breaks)
        lo = hi


def _hashed(lo: int, hi: int, data: np.ndarray, doc_start: np.ndarray, breaks: np.ndarray = IS_SPACE) -> Words:
    n = len(data)
    rows = hi - lo
    if not n:
        none = np.zeros(0, np.int64)
        return Words(lo, hi, data, doc_start, none, none, np.zeros(0, np.uint64), none, np.zeros(rows, np.int64), np.zeros(1, np.uint64))
    power, _ = _grown(n + 1)
    inside = ~breaks[data]
    cut = np.zeros(n + 1, bool)
    cut[doc_start] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_HASH[data] * power[:n], out=total[1:])
    hashed = span_hash(total, start, end)
    doc = np.searchsorted(doc_start, start, "right") - 1
    # empty rows share an offset with the next row: the right side search already passes them
    return Words(lo, hi, data, doc_start, start, end, hashed, doc, np.bincount(doc, minlength=rows)[:rows], total)


def span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[start]) * _powers[1][start] + (end - start).astype(np.uint64))


_STEP = mix(np.arange(1, 65, dtype=np.uint64) * U(0xD6E8FEB86659FD93)) | U(1)


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words inside a row, and the number of its first word."""
    m = len(w.hash) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = w.hash[:m] * _STEP[0]
    for j in range(1, size):
        total += w.hash[j : j + m] * _STEP[j]
    at = np.flatnonzero(w.doc[:m] == w.doc[size - 1 :])
    return mix(total[at]), at


def shingle_sets(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's set of distinct shingles: (hashes in rising order within a row, row, set size of each row).

    A row of fewer words has one shingle, its whole sequence; one without words none.
    """
    hashes, at = windows(w, size)
    doc = w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < size))
    if len(short):
        first = w.first[short]
        spread = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = w.count[short] > j
            spread[has] += w.hash[first[has] + j] * _STEP[j]
        hashes = np.concatenate([hashes, mix(spread + w.count[short].astype(np.uint64) * U(0xA24BAED4963EE407))])
        doc = np.concatenate([doc, short])
    order = np.argsort(hashes)
    doc = doc[order]
    small = doc.astype(np.uint16) if w.hi - w.lo <= 65536 else doc
    order = order[(by := np.argsort(small, kind="stable"))]
    doc, hashes = doc[by], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, doc, np.bincount(doc, minlength=w.hi - w.lo)[: w.hi - w.lo]
