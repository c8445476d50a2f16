"""Ranked lexical search: document-at-a-time merge over compressed postings.

1. Documents are tokenised where they are read. A task sorts what it has read by
   doc_id and writes it as shards of at most ``SHARD_POSTINGS`` postings: per
   term the places of its documents in rising order as gaps, and its
   frequencies, both in bytes of seven bits. Nothing is shuffled.
2. Number of documents, total length and document frequencies come from the
   shards' small columns and give the weights of the items' terms.
3. A task goes through its shards. For each item a heap holds one cursor for
   each of its terms' posting lists and yields one document after the other;
   a bounded heap keyed by score and then doc_id keeps the best, from shard to
   shard. Lists whose largest scores together can't reach the worst of the
   best are not merged but looked into, so nothing that might enter is missed.
4. A window over each item merges the tasks' best.

Terms are told apart by 64-bit hashes. All sums are whole numbers.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import forget, read_table, saved, thrifty
from tallyline.llm.vectext import U, words

#: Postings and documents of a shard; a document is never split.
SHARD_POSTINGS, SHARD_DOCS = 1 << 19, 1 << 16
#: Terms of items that tasks hold at once. More items are ranked in blocks, each over all shards.
HELD_TERMS = 1 << 20

_BREAKS = np.zeros(256, bool)
_BREAKS[:0x80] = [not chr(b).isalnum() for b in range(0x80)]
_SHARD = "terms binary, dfs binary, doc_ids binary, lengths binary, gaps binary, tfs binary, n_docs long, n_terms long"
_BEST = "item_row long, item_id long, doc_id long, score long"


def pack(values: np.ndarray) -> np.ndarray:
    """Whole numbers as bytes of seven bits, lowest first; the last byte of each is below 128."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for shift in range(7, 64, 7):
        size += values >= U(1) << U(shift)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        more = (size[some] > k + 1).astype(np.uint8) << 7
        out[(end - size)[some] + k] = ((values[some] >> U(7 * k)) & U(127)).astype(np.uint8) | more
    return out


def unpack(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    size = ends - starts + 1
    out = np.zeros(len(ends), np.int64)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[some] |= (data[starts[some] + k].astype(np.int64) & 127) << (7 * k)
    return out


def term_counts(column: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(lo, hi, terms in all of each row, row, term, occurrences) for chunks of a column; only ``wanted`` terms (sorted), if given."""
    for w in words(column, breaks=_BREAKS):
        term, row = w.hash, w.doc
        if wanted is not None:
            at = np.minimum(np.searchsorted(wanted, term), len(wanted) - 1)
            keep = wanted[at] == term if len(wanted) else np.zeros(len(term), bool)
            term, row = term[keep], row[keep]
        order = np.lexsort((term, row))
        term, row = term[order], row[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        yield w.lo, w.hi, w.count, row[first], term[first], np.diff(np.append(first, len(term)))


def _shard(held: list[tuple]) -> pa.RecordBatch:
    """One shard of chunks (ids, lengths, row, term, tf), rows numbered by doc_id."""
    sizes = [len(h[0]) for h in held]
    base = np.cumsum(sizes) - sizes
    ids, lengths = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    row = np.concatenate([h[2] + b for h, b in zip(held, base)])
    term, tf = (np.concatenate([h[i] for h in held]) for i in (3, 4))
    by_id = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[by_id] = np.arange(len(ids))
    order = np.lexsort((place[row], term))
    term, at, tf = term[order], place[row][order], tf[order]
    first = np.ones(len(term), bool)
    first[1:] = term[1:] != term[:-1]
    gaps = at.copy()
    gaps[1:] -= np.where(first[1:], 0, at[:-1])
    starts = np.flatnonzero(first)
    blobs = [term[starts], np.diff(np.append(starts, len(term))), ids[by_id], lengths[by_id]]
    blobs = [np.ascontiguousarray(b).tobytes() for b in blobs] + [pack(gaps).tobytes(), pack(tf).tobytes()]
    return pa.RecordBatch.from_arrays([*(pa.array([b], pa.binary()) for b in blobs), pa.array([len(ids)]), pa.array([int(lengths.sum())])], [f.split()[0] for f in _SHARD.split(", ")])


#: Stands for a null doc_id inside a shard: such a document counts but isn't ranked.
_NO_ID = -(1 << 63)


def build_shards(docs: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """The compressed postings of ``docs`` (doc_id, text), a row a shard; of ``wanted`` terms only, if given.

    Documents without any term are in no shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_docs, n_postings = [], 0, 0
        for batch in batches:
            all_ids = batch.column(0).fill_null(_NO_ID).to_numpy()
            for lo, hi, count, row, term, tf in term_counts(batch.column(1), wanted):
                some = count > 0
                place = np.cumsum(some) - 1
                held.append((all_ids[lo:hi][some], count[some], place[row], term, tf))
                n_docs, n_postings = n_docs + int(some.sum()), n_postings + len(term)
                if n_postings >= SHARD_POSTINGS or n_docs >= SHARD_DOCS:
                    yield _shard(held)
                    held, n_docs, n_postings = [], 0, 0
        if n_docs:
            yield _shard(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(thrifty(run), _SHARD)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for terms, dfs in zip(batch.column(0), batch.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms.as_buffer(), np.int64)), pa.array(np.frombuffer(dfs.as_buffer(), np.int64))], ["term", "df"])


class Shard:
    """Posting lists of one shard, decoded term by term; scores include the term's weight."""

    def __init__(self, row: dict, n_all: int, l_all: int):
        self.terms = np.frombuffer(row["terms"], np.int64)
        dfs = np.frombuffer(row["dfs"], np.int64)
        self.ids = np.frombuffer(row["doc_ids"], np.int64).tolist()
        lengths = np.frombuffer(row["lengths"], np.int64)
        gaps, tf = (unpack(np.frombuffer(row[c], np.uint8)) for c in ("gaps", "tfs"))
        ends = np.cumsum(dfs)
        self.start = np.append(0, ends)
        total = np.cumsum(gaps)
        self.at = total - np.repeat(total[ends - dfs] - gaps[ends - dfs], dfs)
        m = 100 - 25 + 25 * lengths * n_all // l_all
        self.gain = 1000000000 * tf // (1000 * tf + 12 * m[self.at])
        self.by_hash = np.argsort(self.terms, kind="stable")
        self.seen: dict[int, tuple[list[int], list[int], int] | None] = {}

    def postings(self, term: int, weight: int) -> tuple[list[int], list[int], int] | None:
        """(places, scores, largest score) of a term."""
        if term not in self.seen:
            k = int(np.searchsorted(self.terms, term, sorter=self.by_hash))
            k = int(self.by_hash[k]) if k < len(self.terms) else -1
            found = None
            if k >= 0 and self.terms[k] == term:
                part = slice(self.start[k], self.start[k + 1])
                score = self.gain[part] * weight
                found = self.at[part].tolist(), score.tolist(), int(score.max())
            self.seen[term] = found
        return self.seen[term]


def merge(lists: list[tuple[list[int], list[int], int]], ids: list[int], k: int, best: list[tuple[int, int]]) -> None:
    """Offer all documents of posting lists (places, scores, largest) to ``best``, a heap of at most k (score, ~doc_id)."""
    lists = sorted(lists, key=lambda x: x[2])
    docs, scores = [x[0] for x in lists], [x[1] for x in lists]
    upto, m = list(accumulate((x[2] for x in lists), initial=0)), len(lists)
    least = best[0][0] if len(best) == k else 0
    out = bisect_left(upto, least) - 1 if least else 0  # so many lists can't make a document enter by themselves
    pos = [0] * m
    heap = [docs[i][0] * m + i for i in range(max(0, out), m)]
    heapify(heap)
    while heap:
        doc = heap[0] // m
        low, score = doc * m, 0
        while heap and (i := heap[0] - low) < m:
            if i < out:
                heappop(heap)
                continue
            at = pos[i]
            score += scores[i][at]
            pos[i] = at = at + 1
            if at < len(docs[i]):
                heapreplace(heap, docs[i][at] * m + i)
            else:
                heappop(heap)
        if not score:
            continue
        for j in range(out - 1, -1, -1):
            if score + upto[j + 1] < least:
                score = -1
                break
            there = docs[j]
            pos[j] = at = bisect_left(there, doc, pos[j])
            if at < len(there) and there[at] == doc:
                score += scores[j][at]
        if score < least or ids[doc] == _NO_ID:
            continue
        new = (score, ~ids[doc])
        if len(best) < k:
            heappush(best, new)
        elif new > best[0]:
            heapreplace(best, new)
        if len(best) == k and best[0][0] > least:
            least = best[0][0]
            out = max(out, min(m, bisect_left(upto, least) - 1))


def _ranked(shards: DataFrame, items: list[tuple], n_all: int, l_all: int, k: int) -> DataFrame:
    """Each task's best of all shards for items (row, id, [(term, weight, occurrences)])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, n_all, l_all)
                for heap, (_, _, terms) in zip(best, items):
                    lists = []
                    for term, weight, times in terms:
                        if found := shard.postings(term, weight):
                            at, score, most = found
                            lists.append(found if times == 1 else (at, [s * times for s in score], most * times))
                    if lists:
                        merge(lists, shard.ids, k, heap)
        flat = [(row, item, ~doc, score) for heap, (row, item, _) in zip(best, items) for score, doc in heap]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat)] if flat else [pa.array([], pa.int64())] * 4, [f.split()[0] for f in _BEST.split(", ")])

    return shards.mapInArrow(thrifty(run), _BEST)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, _, row, term, tf in term_counts(batch.column(2)):
            of = pa.array(row + lo)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(term.view(np.int64)), pa.array(tf.astype(np.int64))], ["item_row", "item_id", "term", "times"])


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` (item_id, text) the k best rows of ``docs`` (doc_id, text).

    Equal scores go to the smaller doc_id. Null and empty texts, and texts
    without a term, match nothing and don't count as documents. Rows are
    documents each, also where they repeat a doc_id; so are items. A document
    with a null doc_id counts in the statistics but isn't ranked. An empty
    table on either side gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    asked = items.select(F.monotonically_increasing_id().alias("item_row"), F.col("item_id").cast("long").alias("item_id"), "text")
    asked = saved(asked.mapInArrow(_terms, "item_row long, item_id long, term long, times long"), "items")
    vocabulary = asked.select("term").distinct()
    few = vocabulary.limit(HELD_TERMS + 1).count() <= HELD_TERMS
    wanted = np.sort(np.array([r[0] for r in vocabulary.collect()], np.int64).view(np.uint64)) if few else None
    shards = saved(build_shards(docs, wanted), "shards")
    n_all, l_all = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_all:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    df = shards.select("terms", "dfs").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_all + 2) / (2 * F.col("df") + 1)))
    weighed = asked.join(df, "term").select("item_row", "item_id", "term", weight.cast("long").alias("w"), "times").where("w > 0")
    by_item = saved(weighed.groupBy("item_row", "item_id").agg(F.collect_list(F.struct("term", "w", "times")).alias("terms")), "weighed")
    blocks = math.ceil((by_item.agg(F.sum(F.size("terms"))).first()[0] or 0) / HELD_TERMS)
    best = None
    for block in range(blocks):
        some = by_item.where(F.pmod(F.xxhash64("item_row"), F.lit(blocks)) == block)
        held = [(r.item_row, r.item_id, [tuple(t) for t in r.terms]) for r in some.collect()]
        part = _ranked(shards, held, n_all, l_all, k)
        best = part if best is None else best.union(part)
    forget(asked, by_item)
    if best is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_row").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_lexical_rank(spark, sf_dir: str) -> DataFrame:
    """All documents for every benchmark item."""
    return rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
with pattern as (select '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' as p),
words as (select row_number() over () as r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), (select p from pattern))) as term
  from (select doc_id, text from documents where text is not null)),
t as (select r, doc_id, term, count(*)::bigint as tf from words group by all),
d as (select r, sum(tf)::bigint as n from t group by r),
s as (select count(*)::bigint as n_all, sum(n)::bigint as l_all from d),
q as (select item_id, term, count(*)::bigint as times from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), (select p from pattern))) as term from benchmark where text is not null) group by all),
f as (select term, floor(1000 * ln((2.0::double * n_all + 2) / (2 * count(*) + 1)))::bigint as w from t, s group by term, n_all),
x as (select q.item_id, t.doc_id, t.r, sum(q.times * f.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * (100 - 25 + (25 * d.n * s.n_all) // s.l_all))))::bigint as score
  from q join f using (term) join t using (term) join d using (r), s where t.doc_id is not null group by all having score > 0),
k as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from x)
select item_id, rank, doc_id, score from k where rank <= 20
"""
