"""Benchmark decontamination by template windows.

Words lose the punctuation around them; numbers, units and names become typed
placeholders. Five template tokens in a row are a window. Windows of documents
and benchmark items meet in a hash join, each with the hash of its slot values.
Per occurrence of an item in a document, the share of the item's windows that is
met says how much of the item is there, and the slot values say how: all equal
(``exact``), each item value always turned into the same other one
(``reparameterised``), or neither (``inconsistent``, not reported).

An occurrence is what lies around one alignment (place in the document less
place in the item): of each item window the nearest hit, at most half an item
away. So copies of an item and its variants in one document are judged apart. A
copy torn further apart is judged on all hits of the document.

A name is a capitalised word that doesn't begin a sentence. Windows of fewer
than two literal words go by their literal values, on both sides, and have no
slots: arithmetic and lists of names are met verbatim, and tables of other
numbers match nothing. As a variant can't meet these, an item's other windows
also count alone where their met share is greater. Items of fewer than five
words can't be told from chance and match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import read_table, saved, small_or_not, thrifty
from tallyline.llm.vectext import U, Words, mix, span_hash, words

WIDTH = 5
#: Share of an item's windows that makes a leak.
COVERAGE = 0.5
#: Benchmark windows that tasks hold to pass over other windows before the join (8 bytes each).
HELD_WINDOWS = 4_000_000
UNITS = "mm cm dm m km in ft yd mi mg g kg t oz lb lbs ml l s sec min h hr hrs ms hz khz mhz ghz kb mb gb tb kw kwh w v a j kj cal kcal pa kpa bar mph kmh usd eur gbp percent degrees meters metres kilometers kilometres miles feet inches grams kilograms pounds liters litres seconds minutes hours days weeks months years dollars euros cents".split()

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_EDGE = np.zeros(256, bool)
_EDGE[33:128] = ~(_LETTER | _DIGIT)[33:128]
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;"]] = True
NUMBER, UNIT, NAME, DENSE = (mix(np.array([0xC0FFEE + i], np.uint64))[0] for i in range(4))


def _unit_hashes() -> np.ndarray:
    w = next(words(pa.array([" ".join(UNITS)])))
    return np.sort(w.hash)


def templates(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template token, literal hash, whether it is a slot, row) of each word that holds a letter or digit."""
    start, end, data = w.start.copy(), w.end.copy(), w.data
    while (off := (end - start > 1) & _EDGE[data[end - 1]]).any():
        end[off] -= 1
    while (off := (end - start > 1) & _EDGE[data[start]]).any():
        start[off] += 1
    digits, letters = (np.r_[0, np.cumsum(t[data], dtype=np.int32)] for t in (_DIGIT, _LETTER))
    n_digits, n_letters = digits[end] - digits[start], letters[end] - letters[start]
    real = (n_digits + n_letters) > 0
    literal = span_hash(w.total, start, end)
    begins = np.ones(len(start), bool)
    if len(start) > 1:
        lines = np.r_[0, np.cumsum(data == 10, dtype=np.int32)]
        begins[1:] = (w.doc[1:] != w.doc[:-1]) | _STOP[data[w.end[:-1] - 1]] | (lines[w.start[1:]] > lines[w.start[:-1]])
    head = data[start] if len(start) else np.zeros(0, np.uint8)
    number = (n_digits > 0) & (n_letters == 0)
    units = _unit_hashes()
    unit = units[np.minimum(np.searchsorted(units, literal), len(units) - 1)] == literal
    unit &= np.r_[False, number[:-1]] if len(number) else False  # a unit follows a number
    name = ~begins & (head >= 65) & (head <= 90) & ~number & ~unit
    token = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, literal)))
    return token[real], literal[real], (number | unit | name)[real], w.doc[real]


def _windows(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window hash, number of its first token in the row, row, literal hashes, slot flags, whether it goes by literal values and so has no slots) of all windows."""
    token, literal, slot, doc = templates(w)
    m = len(token) - WIDTH + 1
    if m <= 0:
        none = np.zeros((0, WIDTH))
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), none.astype(np.uint64), none.astype(bool), np.zeros(0, bool)
    step = [mix(np.array([j + 1], np.uint64))[0] | U(1) for j in range(WIDTH)]
    total = np.zeros(m, np.uint64)
    slots = np.zeros(m, np.int8)
    for j in range(WIDTH):
        total += token[j : j + m] * step[j]
        slots += slot[j : j + m]
    dense = slots > WIDTH - 2
    full = np.flatnonzero(dense)
    total[full] = DENSE
    for j in range(WIDTH):
        total[full] += literal[j + full] * step[j]
    at = np.flatnonzero(doc[:m] == doc[WIDTH - 1 :])
    first = np.searchsorted(doc, np.arange(w.hi - w.lo))
    span = at[:, None] + np.arange(WIDTH)
    return mix(total[at]), at - first[doc[at]], doc[at], literal[span], slot[span] & ~dense[at, None], dense[at]


_WINDOW = "id long, pos long, win long, slots array<long>, dense boolean"


def _rows(ids: np.ndarray, pos: np.ndarray, win: np.ndarray, literal: np.ndarray, slot: np.ndarray, dense: np.ndarray) -> pa.RecordBatch:
    sizes = slot.sum(1)
    values = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(literal[slot].view(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(pos), pa.array(win.view(np.int64)), values, pa.array(dense)], ["id", "pos", "win", "slots", "dense"])


def template_windows(df: DataFrame, key: str, only=None) -> DataFrame:
    """(id, pos, win, slots, dense) of every window of (key, text), dense ones by literal values; ``only`` is a broadcast sorted array of wanted windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = seen = None
        if only is not None:
            wanted = only.value
            seen = np.zeros(1 << 22, bool)  # most windows end here, at one look-up
            seen[(wanted >> U(42)).astype(np.int64)] = True
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for w in words(batch.column(1)):
                win, pos, doc, literal, slot, dense = _windows_of(w, wanted, seen)
                if len(win):
                    yield _rows(ids[w.lo + doc], pos, win, literal, slot, dense)

    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), "text").mapInArrow(thrifty(run), _WINDOW)


def _windows_of(w: Words, wanted, seen):
    win, pos, doc, literal, slot, dense = _windows(w)
    if wanted is None:
        return win, pos, doc, literal, slot, dense
    near = np.flatnonzero(seen[(win >> U(42)).astype(np.int64)])
    if len(wanted) and len(near):
        near = near[wanted[np.minimum(np.searchsorted(wanted, win[near]), len(wanted) - 1)] == win[near]]
    else:
        near = near[:0]
    return win[near], pos[near], doc[near], literal[near], slot[near], dense[near]


def _kind(n_slots: int, n_changed: int, n_mixed: int) -> str:
    return "inconsistent" if 2 * n_mixed > n_slots else "reparameterised" if n_changed + n_mixed else "exact"


def _slots(was: np.ndarray, now: np.ndarray) -> tuple[int, int, int]:
    """(values, values turned into one other, values turned into several)."""
    if not len(was):
        return 0, 0, 0
    order = np.argsort(was, kind="stable")
    was, now = was[order], now[order]
    start = np.flatnonzero(np.r_[True, was[1:] != was[:-1]])
    lo, hi = np.minimum.reduceat(now, start), np.maximum.reduceat(now, start)
    return len(start), int(((lo == hi) & (lo != was[start])).sum()), int((lo != hi).sum())


def _best_occurrence(coverage: float):
    """The fullest consistent occurrence among the hits of one document and item; of equals the least changed."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("pos", "ascending"), ("item_pos", "ascending")])
        item_pos, dense = table["item_pos"].to_numpy(), table["item_dense"].to_numpy()
        n_windows, n_dense = table["n_windows"][0].as_py(), table["n_dense"][0].as_py()
        n_open = n_windows - n_dense

        def share(places: np.ndarray, dense: np.ndarray) -> tuple[float, int, int]:
            """Met share, and (met, number) of all windows, or of those with slots alone where it is greater."""
            n, m = len(places), int((~dense).sum())
            return (m / n_open, m, n_open) if n_open and m * n_windows > n * n_open else (n / n_windows, n, n_windows)

        offset = table["pos"].to_numpy() - item_pos
        order = np.argsort(offset, kind="stable")
        offset, item_pos, dense = offset[order], item_pos[order], dense[order]
        slots, item_slots = (table[c].combine_chunks().take(pa.array(order)) for c in ("slots", "item_slots"))
        now, was = slots.flatten().to_numpy(zero_copy_only=False), item_slots.flatten().to_numpy(zero_copy_only=False)
        sizes = slots.value_lengths().to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.r_[0, np.cumsum(sizes)]
        reach = (n_windows + WIDTH - 1) // 2
        anchors = np.unique(offset)
        lo, hi = np.searchsorted(offset, anchors - reach), np.searchsorted(offset, anchors + reach, "right")
        best = None
        for i in np.flatnonzero(hi - lo >= coverage * (n_open or n_windows)):
            away = np.abs(offset[lo[i] : hi[i]] - anchors[i])
            near = np.lexsort((away, item_pos[lo[i] : hi[i]]))
            places = item_pos[lo[i] : hi[i]][near]
            near = near[np.r_[True, places[1:] != places[:-1]]]
            met = share(near, dense[lo[i] : hi[i]][near])
            if met[0] < coverage or best and met[0] < best[0][0]:
                continue
            chosen = np.zeros(len(sizes), bool)[lo[i] : hi[i]]
            chosen[near] = True
            span = slice(ends[lo[i]], ends[hi[i]])
            use = chosen[of[span] - lo[i]]
            found = _slots(was[span][use], now[span][use])
            this = met, -found[1] - found[2], found
            if _kind(*found) != "inconsistent" and (best is None or this[:2] > best[:2]):
                best = this
                if len(near) == n_windows and not this[1]:  # none can be fuller
                    break
        if best is None:
            places, one = np.unique(item_pos, return_index=True)
            best = share(places, dense[one]), 0, _slots(was, now)
        (covered, n_met, n_windows), _, found = best
        row = {"doc_id": table["doc_id"][0].as_py(), "item_id": table["item_id"][0].as_py(), "n_windows": n_windows, "n_met": n_met, "coverage": covered, "n_slots": found[0], "n_changed": found[1], "kind": _kind(*found)}
        return pa.Table.from_pylist([row])

    return run


_LEAK = "doc_id long, item_id long, n_windows long, n_met long, coverage double, n_slots long, n_changed long, kind string"


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Leaks of ``benchmark`` (item_id, text) in ``docs`` (doc_id, text).

    Returns (doc_id, item_id, n_windows, n_met, coverage, n_slots, n_changed,
    kind) of each pair of which an occurrence meets a share of ``coverage`` or
    more of the item's windows and has consistent slots; the figures are those
    of the fullest one (``n_windows`` and ``n_met`` leave out windows by literal
    values where that makes a greater share). Null ids and texts, empty texts and empty
    tables give no rows; rows that repeat an id count as one text.
    """
    spark = docs.sparkSession
    items = saved(template_windows(benchmark, "item_id"), "items")
    sizes = items.groupBy("id").agg(F.countDistinct("pos").alias("n_windows"), F.countDistinct(F.when(F.col("dense"), F.col("pos"))).alias("n_dense"))
    only = None
    if items.count() <= HELD_WINDOWS:
        held = np.array([r[0] for r in items.select("win").distinct().toLocalIterator()], np.int64)
        only = spark.sparkContext.broadcast(np.sort(held.view(np.uint64)))
    # by its measured size; beyond the bound Spark splits the partitions of common windows where it joins them
    known = small_or_not(items.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "win", F.col("slots").alias("item_slots"), F.col("dense").alias("item_dense")))
    hits = saved(template_windows(docs, "doc_id", only).withColumnRenamed("id", "doc_id").drop("dense").join(known, "win"), "hits")
    met = hits.groupBy("doc_id", "item_id").agg(F.countDistinct("item_pos").alias("n_met"), F.countDistinct(F.when(~F.col("item_dense"), F.col("item_pos"))).alias("open_met"))
    enough = (F.col("n_met") / F.col("n_windows") >= coverage) | ((F.col("n_dense") < F.col("n_windows")) & (F.col("open_met") >= coverage * (F.col("n_windows") - F.col("n_dense"))))
    found = met.join(sizes.withColumnRenamed("id", "item_id"), "item_id").where(enough).drop("n_met", "open_met")
    near = hits.join(small_or_not(saved(found, "found")), ["doc_id", "item_id"])
    return near.groupBy("doc_id", "item_id").applyInArrow(_best_occurrence(coverage), _LEAK).where("kind <> 'inconsistent'")


def op3_template_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
