"""Exact top-k inner products with an impact-ordered index, score at a time.

Components become integers ``floor(scale * x)``. Rows and queries are dealt to
a grid of bounded cells (query block, row block). A cell indexes its rows by
impact: a posting is a row with one of its components; the postings of one
component and one magnitude level are a segment, and levels are processed in
falling order, each posting added to the accumulators of its row. What is still
to come is bounded per query and row by
``min(|q|_2 * |rest|_2, |q|_1 * largest impact left)``. A row stays a possible
member while its upper bound reaches the k-th best lower bound. A query leaves
the cell early only when that proves that rescoring its possible members costs
less than the postings left; the members are rescored exactly. A window merges
the cells' best.

Accumulators are floating-point numbers whose rounding error is part of the
bounds, and exact scores are whole numbers of any size, so every finite vector
takes part. A score beyond a 64-bit integer counts as the nearest one.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import read_table

#: Most queries and rows of a cell, and most components of a cell's queries and of its rows.
QUERY_BLOCK, ROW_BLOCK = 4096, 16384
QUERY_VALUES, ROW_VALUES = 1 << 18, 1 << 20
#: Magnitude levels: two end below half of the one before them; the last one holds all that is smaller.
LEVELS = 14
#: Queries whose accumulators are held at once.
_CHUNK = 256
#: Postings that are added at once.
_RUN = 512
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_FIELDS = "query_row long, query_id long, vec_id long, vec_row long, score long"


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.combine_chunks()
    flat, sizes = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.asarray(rows.value_lengths())
    out = np.zeros((len(rows), width))
    out[np.repeat(np.arange(len(rows)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _floored(values: np.ndarray, scale: float) -> tuple[np.ndarray, int]:
    """``floor(scale * value)`` as floats, and the power of two that all are divided by where squares of them might overflow."""
    most = float(np.abs(values).max(initial=0))
    down = max(0, math.frexp(most)[1] + math.frexp(scale)[1] - 480)
    with np.errstate(over="ignore"):
        whole = np.floor(scale * values)
    return (np.where(np.isinf(whole), np.ldexp(values, -down) * scale, np.ldexp(whole, -down)) if down else whole), down


def _whole(values: np.ndarray, scale: float) -> list[int]:
    return [math.floor(scale * v) if abs(v) < 1e15 else math.floor(Fraction(v) * Fraction(scale)) for v in values.tolist()]


def exact_scores(q: np.ndarray, x: np.ndarray, who: np.ndarray, what: np.ndarray, scale: float) -> np.ndarray:
    """Inner products of the pairs of rows in whole numbers; those beyond 64 bits become the nearest."""
    (fq, less_q), (fx, less_x) = _floored(q, scale), _floored(x, scale)
    size_q, size_x = np.abs(fq).sum(1), np.abs(fx).max(1, initial=0)
    out = np.zeros(len(who), np.int64)
    small = (size_q[who] * size_x[what] < 2**53) & (less_q + less_x == 0)
    near = np.flatnonzero(small)
    for at in np.array_split(near, len(near) // 8192 + 1):  # sums of whole numbers that floats hold exactly
        out[at] = np.einsum("ij,ij->i", fq[who[at]], fx[what[at]])
    wide = np.flatnonzero(~small)
    left, right = ({i: _whole(m[i], scale) for i in set(side[wide].tolist())} for m, side in ((q, who), (x, what)))
    for n in wide.tolist():
        out[n] = min(_MOST, max(_LEAST, sum(a * b for a, b in zip(left[int(who[n])], right[int(what[n])]))))
    return out


class Index:
    """Postings of rows (floats that are whole numbers) by falling impact level."""

    def __init__(self, x: np.ndarray, kind: type):
        size = np.abs(x)
        self.top = float(size.max(initial=0))
        cuts = [self.top / 2 ** (i / 2) for i in range(LEVELS)] + [0.0]
        self.levels: list[list[tuple[int, np.ndarray, np.ndarray]]] = []
        self.rest, self.largest, self.left = [], cuts[1:], []
        for high, low in zip(cuts[:-1], cuts[1:]):
            column, row = np.nonzero(((size <= high) & (size > low)).T)
            ends = np.searchsorted(column, np.arange(x.shape[1] + 1))
            self.levels.append([(c, row[lo:hi], x[row[lo:hi], c].astype(kind)) for c, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])) if hi > lo])
            below = np.where(size <= low, x, 0)
            self.rest.append(np.sqrt(np.einsum("ij,ij->i", below, below)))
            self.left.append(int(np.count_nonzero(below)))
            if not self.left[-1]:
                break


def best_of_cell(q: np.ndarray, x: np.ndarray, q_row: np.ndarray, x_row: np.ndarray, x_id: np.ndarray, k: int, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, score) of each query's k best rows other than itself, and the share of postings that each query needed."""
    (fq, less_q), (fx, less_x) = _floored(q, scale), _floored(x, scale)
    most = float(np.abs(fq).sum(1).max(initial=0)) * float(np.abs(fx).max(initial=0))
    kind = np.float32 if most < 2**24 else np.float64
    index = Index(fx, kind)
    rounding = 0.0 if most < 2**53 else (2 * x.shape[1] + 4) * 2.0**-52
    rounding = rounding or (less_q + less_x > 0) * 2.0**-40
    ceiling = math.ldexp(2.0**63 * (1 - 1e-9), -less_q - less_x)
    place = np.argsort(x_row)
    postings = max(1, index.left[0] + sum(len(r) for _, r, _ in index.levels[0]))
    needed, found = np.ones(len(q)), []
    for lo in range(0, len(q), _CHUNK):
        part = fq[lo : lo + _CHUNK]
        l2, l1 = np.sqrt((part**2).sum(1)), np.abs(part).sum(1)
        size2 = np.sqrt((fx**2).sum(1)) if rounding else None
        own = place[np.minimum(np.searchsorted(x_row[place], q_row[lo : lo + _CHUNK]), len(x) - 1)]
        own[x_row[own] != q_row[lo : lo + _CHUNK]] = -1
        some, weights = np.arange(len(part)), np.ascontiguousarray(part.T.astype(kind))
        score = np.zeros((len(x), len(part)), kind)
        looked = postings
        for n, level in enumerate(index.levels):
            for column, row, value in level:
                for at in range(0, len(row), _RUN):
                    score[row[at : at + _RUN]] += value[at : at + _RUN, None] * weights[column]
            last = index.left[n] == 0
            if not last and index.left[n] > looked / 2:
                continue  # a look at the bounds is worth it when half of what was left is done
            looked = index.left[n]
            bound = np.zeros((len(some), len(x))) if last else np.minimum(l2[some, None] * index.rest[n], (l1[some] * index.largest[n])[:, None]) * (1 + 1e-6) + 1e-3
            if rounding:
                bound += rounding * l2[some, None] * size2 + 1e-280
            at = np.arange(len(some))
            low = score.T - bound
            low[at[own[some] >= 0], own[some][own[some] >= 0]] = -np.inf
            take = min(k, low.shape[1])
            kth = np.partition(low, low.shape[1] - take, axis=1)[:, low.shape[1] - take]
            kth = np.where(kth <= -ceiling, -np.inf, np.minimum(kth, ceiling))  # scores beyond are ties
            possible = score.T + bound >= kth[:, None]
            possible[at[own[some] >= 0], own[some][own[some] >= 0]] = False
            stop = np.full(len(some), True) if last else possible.sum(1) * x.shape[1] <= index.left[n]
            if stop.any():
                needed[lo + some[stop]] = 1 - index.left[n] / postings
                who, what = np.nonzero(possible[stop])
                found.append((lo + some[stop][who], what))
                some = some[~stop]
                if not len(some):
                    break
                score, weights = np.ascontiguousarray(score[:, ~stop]), np.ascontiguousarray(weights[:, ~stop])
    who, what = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    values = exact_scores(q, x, who, what, scale)
    order = np.lexsort((x_row[what], x_id[what], ~values, who))  # ~ turns the order of whole numbers round
    who, what, values = who[order], what[order], values[order]
    keep = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[keep], what[keep], values[keep], needed


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row of ``vectors`` (vec_id, embedding) that is a query, against all other rows.

    Equal scores go to the smaller vec_id. Vectors that are null or hold a null
    or non-finite component, and null ids, take no part. Shorter vectors count
    as padded with zeros. Rows that repeat are rows each: a query row leaves
    out only itself. Fewer than k rows give all of them, one or none no result.
    Scores beyond a 64-bit integer count as the nearest one, and tie there.
    """
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.col("vec_id").isNotNull()
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(sound)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asks"), F.max(F.size("embedding")).alias("width")).first()
    width = max(1, stats.width or 1)
    across = max(1, math.ceil(stats.n / min(ROW_BLOCK, max(1, ROW_VALUES // width))))
    down = max(1, math.ceil(stats.asks / min(QUERY_BLOCK, max(1, QUERY_VALUES // width))))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    asking = rows.where("asks").select("row", "vec_id", "embedding", deal(down).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("c"))
    # own names on this side: both come from one table, and Catalyst must not take one's columns for the other's
    held = rows.select(F.col("row").alias("x_row"), F.col("vec_id").alias("x_id"), F.col("embedding").alias("x"), deal(across).alias("x_c"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("x_r"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:  # columns by place: row, vec_id, embedding
        if not len(left) or not len(right):
            who = what = np.zeros(0, np.int64)
            value = np.zeros(0, np.int64)
        else:
            q_row, x_row, x_id = (t.column(c).to_numpy() for t, c in ((left, 0), (right, 0), (right, 1)))
            who, what, value, _ = best_of_cell(_matrix(left.column(2), width), _matrix(right.column(2), width), q_row, x_row, x_id, k, scale)
        ask = left.select([0, 1]).take(pa.array(who))
        got = right.select([1, 0]).take(pa.array(what))
        return pa.table([ask.column(0), ask.column(1), got.column(0), got.column(1), pa.array(value)], ["query_row", "query_id", "vec_id", "vec_row", "score"])

    each = asking.groupBy("r", "c").cogroup(held.groupBy("x_r", "x_c")).applyInArrow(cell, _FIELDS)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark, sf_dir: str) -> DataFrame:
    """All embeddings; queries are the ids divisible by 20."""
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP6_SQL = """
with v as (select vec_id, [floor(64 * x::double) for x in embedding] as e from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
