from __future__ import annotations

import itertools
import random
import re
import string

import numpy as np
import pytest

from tallyline.llm import common
from tallyline.llm import jaccard_join as J
from tallyline.llm.partenum import signatures

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(FOLD)) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expected(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("hot, split, broadcast", [(32, False, True), (2, False, True), (2, True, False), (32, True, True)])
def test_equals_brute_force(docs, corpus, hot, split, broadcast, monkeypatch):
    """Also with every bucket of more than two hot, so that the prefix filter decides; with buckets split into groups of two; and without broadcasts."""
    monkeypatch.setattr(J, "SMALL_BUCKET", hot)
    if split:
        monkeypatch.setattr(J, "SAMPLED", 1)
        monkeypatch.setattr(J, "HOT", 3)
        monkeypatch.setattr(J, "GROUP", 2)
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    got = J.near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected(corpus)


def test_contract_columns(spark):
    got = J.op10_ngram_jaccard_join(spark, "/root/testdata/sf0.001")
    assert got.dtypes[:3] == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == expected(rows)


def test_empty_table(nothing):
    assert J.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("split", [False, True])
def test_template_families(spark, split, monkeypatch):
    """Pages of templates with more or fewer words of their own, of several lengths, that share common passages: every bucket is hot."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    passages = [rng.choices(words, k=k) for k in (12, 12, 25, 40)]
    rows = []
    for family in range(6):
        body = list(itertools.chain(*rng.sample(passages, rng.randint(1, 3))))
        for page in range(40):
            own = [f"f{family}p{page}x{i}" for i in range(rng.choice([0, 1, 2, 2, 3, 8]))]
            at = rng.choice([0, len(body), len(body) // 2])
            rows.append((len(rows), " ".join(body[:at] + own + body[at:])))
    monkeypatch.setattr(J, "SMALL_BUCKET", 2)
    if split:
        monkeypatch.setattr(J, "DIRECT", 2)
        monkeypatch.setattr(J, "SAMPLED", 1)
        monkeypatch.setattr(J, "HOT", 3)
        monkeypatch.setattr(J, "GROUP", 3)
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected(rows)


def test_pages_of_one_template_are_no_candidates(spark, monkeypatch):
    """Thousands of pages that share all but two words and link with none: candidates stay few."""
    n = 4000
    made = [(i, f"the quick brown fox jumps over a lazy dog and some more words x{i} y{i}") for i in range(n)]
    rows = {}
    keep = J.saved

    def counted(df, name):
        kept = keep(df, name)
        rows[name] = rows.get(name, 0) + kept.count()
        return kept

    monkeypatch.setattr(J, "saved", counted)
    got = J.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"))
    assert got.where("component_id <> doc_id").count() == 0
    assert rows["members"] >= n and rows["groups"] == rows["open"] == 0


def test_signatures_lose_no_pair():
    """Random pairs at and around the threshold share a signature whenever they link."""
    rng = np.random.default_rng(3)
    linked = 0
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        d = int(rng.integers(0, max(2, n // 4 + 1)))
        pool = rng.integers(1, 2**63, n + d, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(np.r_[pool[d // 2 : n], pool[n:]])
        common = len(np.intersect1d(a, b))
        if 5 * common >= 4 * (len(a) + len(b) - common):
            linked += 1
            h, row = np.r_[a, b], np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
            sig, of, _, _ = signatures(h, row, np.array([len(a), len(b)]), k2=1, n2=2, slack=0.3)
            assert set(sig[of == 0]) & set(sig[of == 1])
    assert linked > 500


def test_room_holds_for_every_linked_pair():
    """Both sets of a linked pair share ``room`` signatures of some band, or a prefix token; also if only one has prefix tokens."""
    rng = np.random.default_rng(4)
    one_scarce = 0
    for _ in range(4000):
        n = int(rng.integers(2, 40))
        d = int(rng.integers(0, max(2, n // 4 + 1)))
        pool = rng.integers(1, 2**63, n + d, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(np.r_[pool[d // 2 : n], pool[n:]])
        common = len(np.intersect1d(a, b))
        if 5 * common < 4 * (len(a) + len(b) - common):
            continue
        h, row = np.r_[a, b], np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
        sig, of, band, room = signatures(h, row, np.array([len(a), len(b)]), k2=1, n2=2, slack=0.3)
        one_scarce += len(set(of[band == 254])) == 1
        both = {(s, k) for s, k in zip(sig[of == 0], band[of == 0])} & {(s, k) for s, k in zip(sig[of == 1], band[of == 1])}
        shared = {k: sum(x == k for _, x in both) for _, k in both}
        assert 254 in shared or any(all(n >= room[(band == k) & (of == i)].max() for i in (0, 1)) for k, n in shared.items())
    assert one_scarce > 20


def test_sketch_bounds_from_below():
    rng = random.Random(5)
    from tallyline.llm.vectext import mix

    for _ in range(200):
        a = {rng.getrandbits(60) for _ in range(rng.randint(1, 80))}
        b = {x for x in a if rng.random() < 0.8} | {rng.getrandbits(60) for _ in range(rng.randint(0, 30))} or {1}

        def sketch(s):
            bits = J.sketch_bits(len(s))
            hit = np.bincount((mix(np.array(sorted(s), np.uint64)) & np.uint64(bits - 1)).astype(int), minlength=bits) & 1
            return np.packbits(hit.astype(bool), bitorder="little").tobytes()

        assert J.differing_bits(sketch(a), sketch(b)) <= len(a ^ b)


def test_components_of_long_chain(spark):
    from tallyline.llm.components import components

    edges = [(i, i + 1) for i in range(50)] + [(100, 99), (99, 98), (98, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[100] == got[99] == 98
