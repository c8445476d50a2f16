"""Periodic runs of words: a suffix automaton with merged end-position sets.

The automaton of a text has a state for each class of substrings that end at
the same positions; suffix links make it a tree, in which a state's positions
are those of its children. Going up, the smaller ordered set goes into the
larger one, position by position. Where a position comes to lie ``d`` behind or
before its new neighbour and the state's longest substring has ``d`` words or
more, the two ends of that substring form a square of period ``d``: a seed. A
state where two positions first meet is as long as the text agrees before them,
so a seed knows where its run begins, and the last seed of one begin and period
knows where it ends. Neighbours are never further apart than the smallest
period, so no multiple of it is found.

Runs that are asked for hold every five-word window twice at a distance of a
period. Numpy finds the stretches where that is so, and only these go through
the automaton; each such run lies in one stretch as a whole.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import read_table, thrifty
from tallyline.llm.vectext import U, Words, mix, texts, windows, words

#: A run has at least ``LEAST`` words and ``TIMES`` periods.
LEAST, TIMES = 6, 4
#: Words of the windows that runs repeat: a run of six words and period one has windows of five twice.
WINDOW = 5
#: Positions of a block of an ordered set.
_BLOCK = 1024


class Positions:
    """An ordered set of numbers in blocks, so that an insertion moves one block at most."""

    __slots__ = ("blocks", "size")

    def __init__(self, first: int):
        self.blocks, self.size = [[first]], 1

    def add(self, x: int) -> tuple[int, int]:
        """Put ``x`` in; its neighbours before and after, or -1."""
        blocks, b = self.blocks, 0
        if len(blocks) > 1:
            b = max(0, bisect_left(blocks, x, key=lambda block: block[0]) - 1)
        block = blocks[b]
        at = bisect_left(block, x)
        before = block[at - 1] if at else blocks[b - 1][-1] if b else -1
        after = block[at] if at < len(block) else blocks[b + 1][0] if b + 1 < len(blocks) else -1
        block.insert(at, x)
        self.size += 1
        if len(block) > _BLOCK:
            blocks[b : b + 1] = [block[: _BLOCK // 2], block[_BLOCK // 2 :]]
        return before, after

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def automaton(text: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link, longest length, end position or -1 for a clone) of each state; state 0 is the start."""
    edges: list[dict[int, int]] = [{}]
    link, length, ends = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(text):
        new = len(link)
        edges.append({})
        link.append(0)
        length.append(i + 1)
        ends.append(i)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(link)
                edges.append(dict(edges[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                ends.append(-1)
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return link, length, ends


def all_runs(text: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal stretch of two periods or more, by start, then period."""
    link, length, ends = automaton(text)
    sets: list[Positions | None] = [Positions(e) if e >= 0 else None for e in ends]
    found: dict[tuple[int, int], int] = {}
    for state in sorted(range(1, len(link)), key=length.__getitem__, reverse=True):
        parent = link[state]
        if not parent:
            sets[state] = None  # nothing agrees before its positions
            continue
        small, large = sets[state], sets[parent]
        sets[state] = None
        if large is None:
            sets[parent] = small
            continue
        if small.size > large.size:
            small, large = large, small
        long = length[parent]
        last, coming = -1, list(small)
        for x, following in zip(coming, [*coming[1:], len(text)]):
            before, after = large.add(x)
            # neighbours that come with x have met before; one behind the next newcomer is none
            if before > last and x - before <= long:
                key = before - long + 1, x - before
                if found.get(key, -1) < x:
                    found[key] = x
            if 0 <= after < following and after - x <= long:
                key = x - long + 1, after - x
                if found.get(key, -1) < after:
                    found[key] = after
            last = x
        sets[parent] = large
    return sorted((start, end + 1 - start, period) for (start, period), end in found.items())


def _marked(w: Words) -> list[tuple[int, int]]:
    """Stretches (first word, end) of the chunk outside which no run of ``LEAST`` words and ``TIMES`` periods reaches."""
    hashed, at = windows(w, WINDOW)
    doc = w.doc[at]
    out: list[tuple[int, int]] = []
    if not len(at):
        return out
    while True:
        key = mix(hashed + doc.astype(np.uint64) * U(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = (hashed[order][1:] == hashed[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        back, here = order[:-1][same], order[1:][same]
        near = np.full(len(at), np.iinfo(np.int64).max)
        near[here] = at[here] - at[back]
        near[back] = np.minimum(near[back], at[here] - at[back])
        # a window belongs to a stretch of windows one after the other; there its distance is a period at most
        starts = np.ones(len(at), bool)
        starts[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
        of = np.cumsum(starts) - 1
        size = np.bincount(of) + WINDOW - 1
        keep = (near <= size[of] // TIMES) & (size[of] >= LEAST)
        if keep.all():
            break
        hashed, at, doc = hashed[keep], at[keep], doc[keep]
        if not len(at):
            return out
    first = np.flatnonzero(starts)
    return list(zip(at[first].tolist(), (at[first] + size).tolist()))


def _repeated(n: np.ndarray, ids: list[int | None]) -> dict[int, tuple[int, int]]:
    """Rows whose words are made periodic: (first word, period)."""
    out = {}
    for row, (size, doc) in enumerate(zip(n.tolist(), ids)):
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and size:
            g = h // 10
            a = g % size
            out[row] = a, 1 + (size - a) // (3 + g % 8)
    return out


_FIELDS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs) for each row of ``docs`` (doc_id, text).

    ``runs`` are all runs of at least six words and four periods, by start,
    then period; ``start`` to ``exponent_milli`` describe the longest (ties:
    smallest start, then period) and are null without one. ``planted`` makes
    the words of a tenth of the documents periodic first, by their doc_id.
    Null, empty and wordless texts have no runs and the digest of nothing;
    repeated rows and null ids stay as they are (a null id is never planted).
    Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids = batch.column(0)
            column = texts(batch.column(1))
            for w in words(column):
                ids = all_ids[w.lo : w.hi].to_pylist()
                yield pa.RecordBatch.from_arrays(_rows(w, ids, _repeated(w.count, ids) if planted else {}), [f.split()[0] for f in _FIELDS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(thrifty(run), _FIELDS)


def _rows(w: Words, ids: list, changes: dict[int, tuple[int, int]]) -> list[pa.Array]:
    first, doc_words = w.first, {}
    data = w.data.tobytes()

    def words_of(row: int) -> list[bytes]:
        if row not in doc_words:
            found = data[w.doc_start[row] : w.doc_start[row + 1]].split()
            if row in changes:
                a, p = changes[row]
                found[a:] = [found[a + i % p] for i in range(len(found) - a)]
            doc_words[row] = found
        return doc_words[row]

    for row, (a, p) in changes.items():
        lo, hi = first[row] + a, first[row] + w.count[row]
        w.hash[lo:hi] = w.hash[lo + np.arange(hi - lo) % p]
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for lo, hi in _marked(w):
        row = int(w.doc[lo])
        base = lo - int(first[row])
        number: dict[bytes, int] = {}
        part = [number.setdefault(x, len(number)) for x in words_of(row)[base : base + hi - lo]]
        kept = [(base + s, n, q) for s, n, q in all_runs(part) if n >= max(LEAST, TIMES * q)]
        if kept:
            runs.setdefault(row, []).extend(kept)
    out = []
    for row, doc in enumerate(ids):
        mine = sorted(runs.get(row, []), key=lambda r: (r[0], r[2]))
        kept = words_of(row)
        if mine:
            gone = np.zeros(len(kept) + 1, np.int64)
            for s, n, q in mine:
                gone[s + q] += 1
                gone[s + n] -= 1
            kept = [x for x, g in zip(kept, np.cumsum(gone).tolist()) if not g]
        s, n, q = min(mine, key=lambda r: (-r[1], r[0], r[2])) if mine else (None, None, None)
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in mine)
        out.append((doc, len(mine), s, n, q, mine and 1000 * n // q or None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"start": a, "length": b, "period": c} for a, b, c in mine]))
        doc_words.pop(row, None)
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [_RUN]
    return [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)]


def op13_word_runs(spark, sf_dir: str) -> DataFrame:
    """All documents, a tenth of them made periodic by their ids."""
    return word_runs(read_table(spark, sf_dir, "documents"), planted=True)
