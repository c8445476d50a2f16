from __future__ import annotations

import math
import random
import re
from collections import Counter
from heapq import nlargest

import duckdb
import numpy as np
import pytest

from tallyline.llm import lexical_rank as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, items, k=20):
    sets = [(d, Counter(terms(t))) for d, t in docs]
    sets = [(d, c) for d, c in sets if c]
    n_all, l_all = len(sets), sum(sum(c.values()) for _, c in sets)
    df = Counter(w for _, c in sets for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n_all + 2) / (2 * f + 1))) for w, f in df.items()}
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for d, c in sets:
            m = 100 - 25 + 25 * sum(c.values()) * n_all // l_all
            score = sum(times * weight[w] * (1000000000 * c[w] // (1000 * c[w] + 12 * m)) for w, times in asked.items() if w in c)
            if score > 0 and d is not None:
                scored.append((score, -d))
        out += [(item, rank, -d, score) for rank, (score, d) in enumerate(nlargest(k, scored), 1)]
    return sorted(out, key=repr)


@pytest.fixture
def world():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "日本", "a1", "The", "the"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 10, 60])))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "--- \t\x00 !"), (1003, "w1_w2-w3\x7fw4"), (None, "w1 w2 w3 w59"), docs[5], (7, "w40 w41"), (2000, "w50 " * 3000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(25)] + [(90, None), (91, ""), (92, "unknown words only"), (93, "W59 w59 W59"), (94, "w40"), (94, "w41"), (None, "w2")]
    return docs, items


def frames(spark, world):
    docs, items = world
    return spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, score string").repartition(5), spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, rank string")


@pytest.mark.parametrize("postings, held, k", [(1 << 19, 1 << 20, 20), (50, 1 << 20, 3), (50, 40, 20), (7, 5, 1)])
def test_equals_brute_force(spark, world, postings, held, k, monkeypatch):
    """Also with many shards, several blocks of items, and an index of all terms."""
    monkeypatch.setattr(L, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(L, "HELD_TERMS", held)
    got = sorted(map(tuple, L.rank_documents(*frames(spark, world), k).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == brute(*world, k)


def test_bytes_of_seven_bits():
    rng = np.random.default_rng(1)
    x = np.r_[0, 1, 127, 128, 16383, 16384, 2**31, 2**62, rng.integers(0, 2**40, 1000)]
    assert (L.unpack(L.pack(x)) == x).all() and len(L.pack(np.array([127]))) == 1 and len(L.unpack(L.pack(np.zeros(0, np.int64)))) == 0


def test_merge_looks_into_lists_that_cannot_decide():
    """A list of small scores is looked into, not merged, once the best are known: fewer steps, the same result."""
    n = 30000
    rare = list(range(0, n, 50))
    lists = [(list(range(n)), [10] * n, 10), (list(range(0, n, 2)), [7] * len(range(0, n, 2)), 7), (rare, [1000 + i for i in range(600)], 1599)]
    steps = Counter()

    class Counted(list):
        def __getitem__(self, i):
            steps["n"] += 1
            return super().__getitem__(i)

    best: list = []
    L.merge([(Counted(a), b, c) for a, b, c in lists], list(range(n)), 5, best)
    total = {d: sum(s for at, scores, _ in lists for a, s in zip(at, scores) if a == d) for d in range(n)}
    assert sorted(best, reverse=True) == sorted(((s, ~d) for d, s in total.items()), reverse=True)[:5]
    assert steps["n"] < n


def test_empty_tables(spark, world, nothing):
    docs, items = frames(spark, world)
    assert L.rank_documents(nothing, items).count() == 0 == L.rank_documents(docs, items.limit(0)).count()


def test_equals_sql(spark):
    con = duckdb.connect()
    folder = "/root/testdata/sf0.001"
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    got = L.op11_lexical_rank(spark, folder)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(L.OP11_SQL).fetchall())
