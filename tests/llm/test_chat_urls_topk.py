from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import chat_format as C
from tallyline.llm import exact_topk
from tallyline.llm.exact_topk import best_of_cell, top_k
from tallyline.llm.url_rules import RULES, judge_urls, rule_table

TEXTS = ["plain", "", None, "<|turn|>user\nhi<|end|>\n", "\\<|x|>", "a\\", "ends <", "\\\\|", "\n\n", "<\\|end|>", "🙂 é"]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem", None, "r\\n", "<|turn|>"]), rng.choice(TEXTS)) for c in (1, 2, 3, None) for t in (0, 1, 1, 2, None)]
    rows.append(rows[0])
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn int, role string, text string, start string").withColumn("parts", C.text_part(F.col("text")))
    done = C.format_conversations(df)
    got = done.select("conv_id", "n_turns", C.parse_formatted(F.col("formatted")).alias("t"), F.transform("loss", lambda s: C.unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["chars"]))).alias("l")).collect()
    for r in got:
        mine = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == r.conv_id))
        assert [(x.role, x.text) for x in r.t] == [x[1:] for x in mine]
        assert r.l == [x[2] for x in mine if x[1] == "assistant"] and r.n_turns == len(mine)


def test_chat_parts(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [
        (1, 0, "user", [part("text", "see <|"), part("image", ref="a.png", w=56, h=29), part("audio", ref="b.wav", s=2.0)]),
        (1, 1, "assistant", [part("document", ref="c.pdf", p=3), part("text", "ok")]),
        (2, 0, "user", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {C.PARTS}")
    got = {r.conv_id: r for r in C.format_conversations(df).collect()}
    assert got[1].formatted == "<|turn|>user\nsee <\\|<|image:0|><|audio:1|><|end|>\n<|turn|>assistant\n<|document:2|>ok<|end|>\n"
    assert [(a.n, a.turn, a.type, a.ref, a.tokens) for a in got[1].attachments] == [(0, 0, "image", "a.png", 4), (1, 0, "audio", "b.wav", 50), (2, 1, "document", "c.pdf", 768)]
    assert got[1].n_expanded == 822 and got[2].formatted == "<|turn|>user\n<|end|>\n"


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


URLS = [None, "", "nohost/en/", "http://a.example.com/en/71?x", "HTTP://A.Example.COM/en/8", "https://com/en/", "x://notcom/en/", "x://b.com/EN/", "x://q.net/de/81", "x://example.net/de/8", "x://deexample.net/de/8", "x://a.org/es/#f", "x://a.org?es/", "x://", "x://a.com/en/\nb", "y://é.com/en/é", "a://b://c.com/en/", "x://a.b.c.d.e.f.com/en/1"]


def test_urls(spark):
    urls = [*URLS, URLS[3]]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, rule_table(spark)).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert {r.verdict for r in judge_urls(df, rule_table(spark).limit(0)).collect()} == {"allow"}
    assert judge_urls(df.limit(0), rule_table(spark)).count() == 0


def test_rules_are_those_of_the_contract(spark):
    """Each rule's own word, allow or block, as the contract lists them."""
    want = {"x://com/en/": "block", "x://example.com/en/7": "allow", "x://net/de/": "allow", "x://example.net/de/8": "block", "x://org/es/": "block", "x://example.net/de/7": "allow", "x://a.com/fr/": "allow"}
    df = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    assert {r.page_id: r.verdict for r in judge_urls(df, rule_table(spark)).collect()} == dict(enumerate(want.values()))


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 16)) / 4
    x[50:60] = x[40:50]
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows += [(200, None), (220, [float("nan")] * 16), (240, [None] * 16), (260, [float("inf")] * 16), (None, rows[0][1])]
    got = top_k(spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, rank string"), F.col("vec_id") % 20 == 0, k=7).collect()
    q = np.floor(64 * np.array([r[1] for r in rows[:120]], np.float32).astype(float)).astype(int)
    for i in range(0, 120, 20):
        s = q @ q[i]
        want = sorted((-s[j], j) for j in range(120) if j != i)[:7]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == want


def test_topk_edges(spark):
    schema = "vec_id long, embedding array<float>"
    ask = F.col("vec_id") % 20 == 0
    assert top_k(spark.createDataFrame([], schema), ask).count() == 0
    assert top_k(spark.createDataFrame([(0, [1.0])], schema), ask).count() == 0
    twice = top_k(spark.createDataFrame([(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, [0.5])], schema), ask).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in twice) == sorted([(0, 1, 0, 5120), (0, 2, 1, 2048)] * 2)


def best_by_hand(q, x, k, own=None, scale=1.0):
    """The k best of one query in Python's whole numbers."""
    whole = lambda v: [math.floor(Fraction(c) * Fraction(scale)) for c in v]
    scores = [(-min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(whole(q), whole(r))))), n) for n, r in enumerate(x) if n != own]
    return sorted(scores)[:k]


@pytest.mark.parametrize("kind", ["small", "wide", "heavy tail", "huge", "one huge", "beyond", "sparse"])
def test_cell_stops_only_on_proof(kind):
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(600, 8)) * (3 if kind == "small" else 30))
    q = np.floor(rng.normal(size=(9, 8)) * 30)
    if kind == "heavy tail":  # few large components, many small ones: the index stops early
        x, q = (np.where(rng.random(v.shape) < 0.6, v * 40, np.sign(v)) for v in (x, q))
    if kind == "huge":
        x, q = x * 1e7, q * 1e6
    if kind == "one huge":
        x[3], q[2] = 1e12, -1e11
    if kind == "beyond":
        x, q = x * 1e200, q * 1e100
    if kind == "sparse":
        x = np.where(rng.random(x.shape) < 0.2, x, 0)
    x[50:60] = x[40:50]
    who, what, value, needed = best_of_cell(q, x, np.arange(595, 604), np.arange(600), np.arange(600), 4)
    for i in range(9):
        assert [(-v, w) for v, w in zip(value[who == i].tolist(), what[who == i].tolist())] == best_by_hand(q[i], x, 4, 595 + i)
    assert (needed <= 1).all() and (kind != "heavy tail" or (needed < 1).any())


def test_topk_over_many_cells(spark, monkeypatch):
    """Cells of a few rows, and vectors of any finite size, against brute force."""
    monkeypatch.setattr(exact_topk, "ROW_VALUES", 100)
    monkeypatch.setattr(exact_topk, "QUERY_VALUES", 12)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 4))
    x[20:40] = x[:20]
    x[7], x[60], x[61] = 1e7, -1e30, 1.7e308
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = top_k(df, F.col("vec_id") % 20 == 0, k=6).collect()
    for i in range(0, 90, 20):
        mine = sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])
        assert [(-r.score, r.vec_id) for r in mine] == best_by_hand(x[i], x.tolist(), 6, i, 64.0)
