from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from tallyline.llm import repeats as R
from tallyline.llm import vectext


def periodic(t):
    """(start, length, period) of all maximal stretches of two periods or more, smallest periods only."""
    found = []
    for q in range(1, len(t) // 2 + 1):
        i = 0
        while i + q < len(t):
            j = i
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            if j - i >= q and not any(q % p == 0 and s <= i and s + n >= j + q for s, n, p in found if p < q):
                found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute(doc_id, text, planted):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    names = {x: i for i, x in enumerate(dict.fromkeys(w))}
    runs = [(s, n, q) for s, n, q in periodic([names[x] for x in w]) if n >= max(6, 4 * q)]
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def texts():
    rng = random.Random(6)
    out = [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "A a A a A a", "a\x0ba\x0ca\ra\ta a b", "é é é é é é é", "x y x y x y x y x y x y", "a b " * 3, "a b " * 4, "a b " * 4 + "a", "a b c " * 4, "ab ab a a b " * 9]
    for _ in range(150):
        words = [f"w{i}" for i in range(rng.choice([1, 2, 3, 30]))]
        body = rng.choices(words, k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            unit = rng.choices(words, k=rng.randint(1, 9))
            body += (unit * 9)[: rng.randint(1, 45)] + rng.choices(words, k=rng.randint(0, 9))
        out.append(rng.choice([" ", "\n", "  "]).join(body))
    return out


@pytest.mark.parametrize("planted, chunk", [(False, vectext.CHUNK_BYTES), (True, vectext.CHUNK_BYTES), (True, 64)])
def test_equals_brute_force(spark, planted, chunk, monkeypatch):
    rows = list(enumerate(texts())) + [(3, "b b b b b b"), (None, "c c c c c c c")]
    monkeypatch.setattr(R, "words", lambda column: vectext.words(column, chunk))
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, runs string, length int").repartition(3)
    got = R.word_runs(df, planted).drop("runs").collect()
    want = [brute(i, t, planted) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and sum(w[1] for w in want) > 100


def test_all_runs_of_small_texts():
    rng = random.Random(7)
    for _ in range(3000):
        t = rng.choices(range(rng.randint(1, 3)), k=rng.randint(0, 30))
        assert R.all_runs(t) == periodic(t)


def test_long_periodic_texts():
    """Half a million words of one period, and of one word: seconds, not hours; sets in blocks."""
    began = time.monotonic()
    assert R.all_runs([i % 1000 for i in range(200_000)]) == [(0, 200_000, 1000)]
    assert R.all_runs([0] * 100_000) == [(0, 100_000, 1)]
    some = R.Positions(5)
    order = list(range(10_000))
    random.Random(1).shuffle(order)
    held = {5}
    for x in order:
        if x != 5:
            before, after = some.add(x)
            assert before == max((y for y in (x - 1,) if y in held), default=before) and (before == -1 or before < x) and (after == -1 or after > x)
            held.add(x)
    assert list(some) == list(range(10_000)) and len(some.blocks) > 5
    assert time.monotonic() - began < 60


def test_prose_never_reaches_the_automaton(spark, monkeypatch):
    """Repeated lines far apart aren't periodic stretches."""
    rng = np.random.default_rng(8)
    line = " ".join(f"u{i}" for i in range(12))
    text = " ".join(line + " " + " ".join(f"v{i}" for i in rng.integers(0, 10**6, 200)) for _ in range(20))
    w = next(vectext.words(__import__("pyarrow").array([text, "a b c d e f g " * 5])))
    assert R._marked(w) == [(int(w.first[1]), int(w.first[1]) + 35)]


def test_op13(spark, nothing):
    folder = "/root/testdata/sf0.001"
    frame = R.op13_word_runs(spark, folder)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert frame.columns[:8] == names and {kind for _, kind in frame.dtypes[:6]} == {"bigint"}
    want = [brute(r.doc_id, r.text, True) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(map(tuple, frame.select(names).collect())) == sorted(want, key=lambda r: r[0]) and any(w[1] for w in want)
    assert R.word_runs(nothing).count() == 0
