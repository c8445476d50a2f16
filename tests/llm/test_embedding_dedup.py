from __future__ import annotations

import numpy as np
import pytest

from tallyline.llm import common
from tallyline.llm import embedding_dedup as E

VECTOR = "vec_id long, embedding array<float>, label int, component_id string"


def brute(rows, least=0.98):
    """Every pair by numpy in doubles."""
    width = max((len(v) for _, v, _ in rows if v), default=1)
    good = [n for n, (i, v, c) in enumerate(rows) if i is not None and c is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.zeros((len(good), width))
    for at, n in enumerate(good):
        x[at, : len(rows[n][1])] = np.float32(rows[n][1])
    x /= np.abs(x).max(1, keepdims=True)
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    label = np.array([rows[n][2] for n in good])
    link = (unit @ unit.T >= least) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in zip(*np.nonzero(link)):
        p, q = find(rows[good[a]][0]), find(rows[good[b]][0])
        root[max(p, q)] = min(p, q)
    out = {n: (0, i) for n, (i, _, _) in enumerate(rows)}
    out |= {n: (int(link[at].sum()), find(rows[n][0])) for at, n in enumerate(good)}
    return sorted(((rows[n][0], links, component, rows[n][0] == component) for n, (links, component) in out.items()), key=repr)


def groups(rng, width, sizes, spread):
    """Clusters around random directions, of vectors at about the least cosine and closer."""
    out = []
    for n in sizes:
        center = rng.standard_normal(width)
        center /= np.linalg.norm(center)
        for _ in range(n):
            off = rng.standard_normal(width)
            off -= off @ center * center
            off *= np.tan(np.arccos(0.98)) * rng.uniform(0, spread) / np.linalg.norm(off)
            out.append(((center + off) * rng.uniform(0.1, 9)).astype(np.float32).tolist())
    return out


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, "z") for r in rows], VECTOR).repartition(3)
    return sorted(map(tuple, E.embedding_duplicates(df, **more).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


@pytest.mark.parametrize("group, broadcast", [(1024, True), (3, True), (3, False)])
def test_equals_brute_force(spark, group, broadcast, monkeypatch):
    """Clusters of many sizes with copies in two labels; also with buckets dealt to cells of three, and without broadcasts."""
    monkeypatch.setattr(E, "GROUP", group)
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(1)
    vectors = groups(rng, 24, [1] * 40 + [2] * 10 + [5, 9, 30, 60], 0.9)
    rows = [(int(i), v, int(rng.integers(0, 2))) for i, v in zip(rng.permutation(len(vectors)), vectors)]
    rows += [(1000 + i, rows[7][1], rows[7][2]) for i in range(6)] + [(2000, rows[7][1], 5), (2001, [2 * x for x in rows[7][1]], 5)]
    found, want = got(spark, rows, missed=1e-6), brute(rows)
    assert found == want and sum(links for _, links, _, _ in want) > 800


def test_recall_and_precision(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v, 0) for i, v in enumerate(groups(rng, 64, [12] * 60, 0.75))]
    found, want = got(spark, rows), brute(rows)
    links = sum(r[1] for r in want)
    assert links > 2000 and sum(r[1] for r in found) >= 0.99 * links and all(a[1] <= b[1] for a, b in zip(found, want))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 2.0, 3.0]
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf], 0), (6, [None, 1.0], 0), (7, one, None), (None, one, 0), (8, one, 0), (9, one, 0), (10, one, 1), (11, [1.0, 2.0, 3.0, 0.0], 0), (8, [-1.0, -2.0, -3.0], 0), (12, [-2.0, -4.0, -6.0], 0), (13, [1e38, 2e38, 3e38], 0), (14, [1e-40, 2e-40, 3e-40], 0), (15, [5.0], 3), (16, [6.0], 3), (17, [-5.0], 3)]
    found, want = got(spark, rows, missed=1e-9), brute(rows)
    assert found == want
    assert dict((r[0], r[1:]) for r in found)[9] == (4, 8, False)


def test_nothing(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, 0), (2, [1.0], None)]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(3)
    width = 64
    o = rng.standard_normal((2000, width))
    q = o + 0.6 * rng.standard_normal((2000, width))
    o, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (o, q))
    signs, factor, _ = E.encode(o, 4, 4)
    turned = q @ E.rotations(width, 1).T
    estimate = (np.where(signs, 1.0, -1.0) * turned).sum(1) / (np.sqrt(width) * factor)
    assert abs((estimate - (o * q).sum(1)).mean()) < 0.005
    near = o + 0.1 * rng.standard_normal((2000, width)) / 8
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    cosine = o @ near.T
    open_ = E.open_pairs(signs, factor, near @ E.rotations(width, 1).T, 0.98)
    assert open_[cosine >= 0.98].all() and (cosine >= 0.98).sum() >= 1500 and open_.mean() < 0.01


def test_plan_grows_slowly():
    for most in (2, 100, 10**4, 10**6, 10**9):
        bits, tables = E.plan(most, 0.98)
        same = 1 - np.arccos(0.98) / np.pi
        assert (1 - same**bits) ** tables <= E.MISSED * 1.0001 and 2**bits >= most and tables < 60


def test_op12(spark):
    frame = E.op12_embedding_dedup(spark, "/root/testdata/sf0.001")
    assert frame.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted(map(tuple, frame.collect()), key=repr) == brute(rows)
