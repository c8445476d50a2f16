"""Embedding near-duplicates by randomised-rotation binary codes.

1. Vectors of one label and equal components form a class; its smallest vec_id
   goes on with the number of copies.
2. A random rotation turns each unit vector ``o``; the signs of the turned
   components are its binary code ``b``. With it go the correction factor
   ``c = <b, o>``: ``<b, q> / c`` is an unbiased estimate of ``<o, q>`` for any
   ``q``, and its error has a bound of its own, see ``open_pairs``. More
   rotations give more bits. Slices of the code, one for each of several
   tables, are keys: two vectors of the least similarity share a slice of
   ``bits`` bits with a known chance, and the number of tables follows from
   the recall asked for and from the number of vectors.
3. Keys alone are shuffled and counted. Only vectors that share a key are sent
   to its bucket; buckets of more than ``GROUP`` are dealt to cells of two
   groups each.
4. In a cell the codes' estimates decide which pairs are computed exactly. A
   pair counts in the first table that it shares. A cell returns no pairs: per
   vector the number of its links, weighted by copies, and the smallest vector
   that it reaches inside the cell. Components follow from the latter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import forget, read_table, saved, small_or_not, thrifty
from tallyline.llm.components import components

#: Chance that a pair of the least similarity shares no table.
MISSED = 0.001
#: Standard errors of an estimate that count as its bound, where the certain bound isn't smaller.
ERRORS = 5.0
#: Members of a bucket that one cell side holds.
GROUP = 1024


@lru_cache(maxsize=2)
def rotations(width: int, count: int) -> np.ndarray:
    """``count`` random rotations, one below the other."""
    rng = np.random.default_rng(width)
    return np.concatenate([np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(count)])


def plan(most: int, least: float, missed: float = MISSED) -> tuple[int, int]:
    """(bits, tables) for the vectors of the largest label: unlike vectors share a key of as many bits about once."""
    bits = max(1, math.ceil(math.log2(max(2, most))))
    same = 1 - math.acos(least) / math.pi
    return bits, max(1, math.ceil(math.log(missed) / math.log1p(-(same**bits))))


def _dense(column: pa.Array, width: int) -> np.ndarray:
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.asarray(column.value_lengths())
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that no square overflows or vanishes; cosines stay."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def encode(x: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signs of the first rotation, correction factors, keys by table) of rows."""
    width = x.shape[1]
    turn = rotations(width, math.ceil(bits * tables / width))
    unit = scaled(x)
    unit /= norms(unit)[:, None]
    turned = unit @ turn.T
    signs = turned > 0
    factor = np.abs(turned[:, :width]).sum(1) / math.sqrt(width)
    sliced = signs[:, : bits * tables].reshape(len(x), tables, bits)
    return signs[:, :width], factor, sliced @ (1 << np.arange(bits, dtype=np.int64))


def open_pairs(signs: np.ndarray, factor: np.ndarray, turned: np.ndarray, least: float) -> np.ndarray:
    """Which of (row of signs, row of turned unit vectors) may reach the cosine ``least``.

    With ``t = <o, q>`` and ``s = sqrt(1 - c * c)``, ``<b, q>`` is ``c * t`` and
    ``s * sqrt(1 - t * t)`` times the cosine of an angle that a random rotation
    makes random: at most one, with a standard error of ``1 / sqrt(width - 1)``.
    For ``t >= least`` the error is largest at ``least``; the smaller bound holds.
    """
    width = signs.shape[1]
    estimate = (np.where(signs, 1.0, -1.0).astype(np.float32) @ turned.astype(np.float32).T) / (math.sqrt(width) * factor[:, None])
    off = np.sqrt(np.maximum(0, 1 - factor**2)) / factor * math.sqrt(1 - least * least)
    bound = off * min(1.0, ERRORS / math.sqrt(max(1, width - 1))) + 1e-4
    return estimate + bound[:, None] >= least


def cell_links(a: dict, b: dict | None, table: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``a`` and of ``b`` (or of ``a`` itself) that link and share no key of an earlier table."""
    other = b or a
    maybe = open_pairs(a["signs"], a["factor"], other["turned"], least)
    if b is None:
        maybe = np.triu(maybe, 1)
    i, j = np.nonzero(maybe)
    for t in range(table):
        apart = a["keys"][i, t] != other["keys"][j, t]
        i, j = i[apart], j[apart]
    near = np.zeros(len(i), bool)
    for lo in range(0, len(i), 1 << 16):
        p, q = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
        dot = np.einsum("ij,ij->i", a["x"][p], other["x"][q])
        near[lo : lo + (1 << 16)] = dot / (a["norm"][p] * other["norm"][q]) >= least
    return i[near], j[near]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of 0..n-1 over the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


_CELL = "h1 long, h2 long, vec_id long, linked long, root long"


def _cells(width: int, bits: int, tables: int, least: float):
    """Work through rows sorted by cell: (label, table, key, lo, hi, part, h1, h2, vec_id, copies, embedding)."""

    def side(rows: pa.Table) -> dict:
        x = _dense(rows["embedding"].combine_chunks(), width)
        signs, factor, keys = encode(x, bits, tables)
        x = scaled(x)
        norm = norms(x)
        return {"x": x, "norm": norm, "signs": signs, "factor": factor, "keys": keys, "turned": (x / norm[:, None]) @ rotations(width, math.ceil(bits * tables / width))[:width].T}

    def linked(rows: pa.Table, lo: int, hi: int, table: int) -> pa.RecordBatch | None:
        part = rows["part"].to_numpy()
        one, two = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        if lo == hi:
            i, j = cell_links(side(rows), None, table, least)
        elif len(one) and len(two):
            i, j = cell_links(side(rows.take(one)), side(rows.take(two)), table, least)
            i, j = one[i], two[j]
        else:
            return None
        if not len(i):
            return None
        copies, ids = rows["copies"].to_numpy(), rows["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        root = ids[order][roots(len(ids), place[i], place[j])[place]]
        count = np.zeros(len(ids), np.int64)
        np.add.at(count, i, copies[j])
        np.add.at(count, j, copies[i])
        some = pa.array(np.flatnonzero(count))
        out = rows.select(["h1", "h2", "vec_id"]).take(some).combine_chunks()
        return pa.table([*out.columns, pa.array(count[count > 0]), pa.array(root[count > 0])], ["h1", "h2", "vec_id", "linked", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        where: tuple | None = None

        def done() -> Iterator[pa.RecordBatch]:
            if held and sum(map(len, held)) > 1:
                found = linked(pa.concat_tables(held), where[3], where[4], where[1])
                if found is not None:
                    yield from found.to_batches()
            held.clear()

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            cell = [rows[c].to_numpy() for c in ("label", "table", "key", "lo", "hi")]
            new = np.zeros(len(rows), bool)
            for c in cell:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), len(rows)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                here = tuple(int(c[lo]) for c in cell) if hi > lo else where
                if here != where:
                    yield from done()
                    where = here
                held.append(rows.slice(lo, hi - lo))
        yield from done()

    return run


def _codes(width: int, bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _dense(batch.column(3), width)
            keys = encode(x, bits, tables)[2] if len(x) else np.zeros((0, tables), np.int64)
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(at, pa.array(keys.ravel()))], ["h1", "h2", "label", "keys"])

    return run


def embedding_duplicates(vectors: DataFrame, least: float = 0.98, missed: float = MISSED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label).

    Rows of one label link from a cosine of ``least`` on; none below it does,
    and a pair at ``least`` is overlooked with a chance of ``missed``, a closer
    one with less. ``n_links`` counts the other rows linked directly. Shorter
    vectors count as padded with zeros. Vectors that are null, empty, zero or
    hold a null or non-finite component, and null labels and ids, link with
    nothing and are kept. Rows that repeat an id are rows each and one node of
    their component. Other columns are not read.
    """
    if not 0 < least < 1:
        raise ValueError("least must lie between 0 and 1")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("embedding", lambda c: c != 0)
    kind = F.col("embedding").cast("array<double>")
    hashed = rows.select("vec_id", "label", "embedding", *(F.when(fine, F.xxhash64(F.lit(seed), "label", kind)).alias(h) for h, seed in (("h1", 1), ("h2", 2))))
    sound = hashed.where("h1 is not null")
    classes = saved(sound.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.min("label").alias("label"), F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies")), "vectors")
    most = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    width = classes.agg(F.max(F.size("embedding"))).first()[0] or 1
    bits, tables = plan(most, least, missed)
    keyed = classes.select("h1", "h2", "label", "embedding").mapInArrow(thrifty(_codes(width, bits, tables)), "h1 long, h2 long, label long, keys array<long>")
    thin = saved(keyed.select("h1", "h2", "label", F.posexplode("keys").alias("table", "key")), "keys")
    shared = saved(thin.groupBy("label", "table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    met = thin.join(small_or_not(shared), ["label", "table", "key"]).select("h1", "h2", "label", "table", "key", F.ceil(F.col("n") / GROUP).cast("long").alias("parts"))
    each = met.groupBy("h1", "h2", "label").agg(F.collect_list(F.struct("table", "key", "parts")).alias("met"))  # one a table at most
    member = classes.join(each.drop("label"), ["h1", "h2"]).select("h1", "h2", "label", "vec_id", "copies", "embedding", F.explode("met").alias("m"))
    part = F.pmod(F.xxhash64("h1", "h2"), F.col("m.parts"))
    dealt = member.withColumn("part", part).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m.parts") - 1)))
    dealt = dealt.select("label", "m.table", "m.key", F.least("part", "with").alias("lo"), F.greatest("part", "with").alias("hi"), "part", "h1", "h2", "vec_id", "copies", "embedding")
    by = ["label", "table", "key", "lo", "hi"]
    cells = dealt.repartition(*by).sortWithinPartitions(*by)
    found = saved(cells.mapInArrow(thrifty(_cells(width, bits, tables, least)), _CELL), "linked")
    comp = components(found.where("vec_id <> root").select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("h1", "h2").agg(F.sum("linked").alias("linked"))
    known = classes.select("h1", "h2", F.col("vec_id").alias("first"), "copies").join(counts, ["h1", "h2"], "left").where("copies > 1 or linked is not null")
    known = known.join(comp.withColumnRenamed("node", "first"), "first", "left").select("h1", "h2", "first", "copies", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("component", "first").alias("component"))
    known = saved(known, "known")
    forget(thin, shared, found)
    out = hashed.join(small_or_not(known), ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("copies") - 1 + F.col("linked"), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op12_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """All embeddings; cosine of 0.98 within a label."""
    return embedding_duplicates(read_table(spark, sf_dir, "embeddings"))
