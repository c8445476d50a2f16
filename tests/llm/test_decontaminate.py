from __future__ import annotations

import pytest

from tallyline.llm.decontaminate import leaks

ITEM = "A train leaves Boston at 60 km per hour and meets Alice after 3 hours near the old bridge over the river"
SAME = "A train leaves Denver at 75 km per hour and meets Robert after 4 hours near the old bridge over the river"
MIXED = "A train leaves Boston at 75 km per hour while another train leaves"


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too few words"), (5, "from 3 to 3 is how far if one walks 3 steps and 3 more steps"), (None, ITEM)], "item_id long, text string")


def test_kinds(spark, benchmark):
    rows = [(10, "Some words before. " + ITEM + ". And words behind."), (11, "x y z " + SAME), (12, MIXED), (13, None), (14, ""), (15, ITEM.replace("old bridge", "new tower")), (16, "quite another text of no relation to any of the items in the table"), (10, "repeated id " + ITEM), (17, "walk from 5 to 7 is how far if one walks 8 steps and 9 more steps"), (18, ITEM.lower().replace(" at ", ", at "))]
    got = {(r.doc_id, r["item_id"]): r for r in leaks(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, win string"), benchmark).collect()}
    assert {k: r.kind for k, r in got.items() if k[1] == 1} == {(10, 1): "exact", (11, 1): "reparameterised", (15, 1): "exact", (18, 1): "exact"}
    assert (got[11, 1].n_changed, got[11, 1].n_slots) == (4, 6) and got[10, 1].coverage >= 0.9
    assert (17, 5) not in got  # one value became several: not the same question


def test_each_occurrence_is_judged_apart(spark, benchmark):
    """An item and its variant, two variants, and a verbatim item in a long text that holds its windows elsewhere too."""
    other = ITEM.replace("Boston", "Austin").replace("60", "90").replace("Alice", "Carol").replace("3 hours", "8 hours")
    torn = "A train leaves Boston at 60 km per hour and meets Alice " + "quite other words " * 30 + "after 3 hours near the old bridge over the river"
    generic = " ".join(f"leaves Town{i} at {i} km per hour and meets Person{i} after {i} hours near the old" + " filler" * (i % 7) for i in range(200))
    split = ITEM.replace("per hour and", "per full hour and")
    rows = {20: ITEM + ". " + SAME, 21: SAME + ". Then " + other, 22: generic + ". " + ITEM + ". " + generic, 23: torn, 24: split + ". " + SAME.replace("per hour and", "per full hour and"), 25: "walk from 5 to 7 is how far if one walks 8 steps and 9 more steps. " * 3}
    got = {(r.doc_id, r["item_id"]): r for r in leaks(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), benchmark).collect()}
    assert {k[0]: r.kind for k, r in got.items()} == {20: "exact", 21: "reparameterised", 22: "exact", 23: "exact", 24: "exact"}
    assert got[20, 1].coverage == got[21, 1].coverage == got[22, 1].coverage == 1.0


def test_dense_windows_match_verbatim(spark):
    """Arithmetic, series and lists of names; a variant of an item of both kinds of windows; other numbers match nothing."""
    sums, series, names = "Compute 12 + 30 - 7 * 2 = 28", "2 3 5 7 11 13 17 19", "the kings Alfred Edward Harold William Henry Stephen John"
    both = "Add the numbers 3 4 5 6 7 8 9 10 and give the sum as your answer"
    items = spark.createDataFrame(list(enumerate([sums, series, names, both])), "item_id long, text string")
    rows = [(10, "Some text. " + sums + ". More."), (11, "as 1 " + series + " 23"), (12, "We know " + names), (13, both.replace("3 4 5 6 7 8 9 10", "13 14 15 16 17 18 19 20")), (14, "Compute 13 + 31 - 8 * 3 = 20"), (15, " ".join(map(str, range(100, 400)))), (16, "x " + both)]
    got = {(r.doc_id, r["item_id"]): r for r in leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert {k: r.kind for k, r in got.items()} == {(10, 0): "exact", (11, 1): "exact", (12, 2): "exact", (13, 3): "reparameterised", (16, 3): "exact"}
    assert got[10, 0].n_windows == got[10, 0].n_met == 2 and got[16, 3].n_windows == 14


def brute(docs, items, coverage):
    """Items of words without slots but numbers: every placing of an item over a document, word by word."""
    import re

    cut = lambda t: re.findall(r"[a-z]+|[0-9]+", t)
    found = {}
    for d, text in docs:
        w = cut(text)
        for i, item in items:
            v = cut(item)
            best = None
            for at in range(-len(v) + 1, len(w)):
                met, values = 0, {}
                for j in range(len(v) - 4):
                    span = [(v[j + k], w[at + j + k] if 0 <= at + j + k < len(w) else None) for k in range(5)]
                    if all(x == y or x.isdigit() and y is not None and y.isdigit() for x, y in span):
                        met += 1
                        for x, y in span:
                            if x.isdigit():
                                values.setdefault(x, set()).add(y)
                share = met / (len(v) - 4)
                mixed, changed = sum(len(y) > 1 for y in values.values()), sum(y != {x} for x, y in values.items())
                if share >= coverage and 2 * mixed <= len(values) and (best is None or (share, -changed) > best):
                    best = share, -changed
            if best:
                found[d, i] = "exact" if not best[1] else "reparameterised"
    return found


def test_equals_brute_force(spark):
    """Random items with numbers; documents with copies, re-parameterised ones, torn and mixed ones among other words."""
    import random

    from tallyline.llm import decontaminate

    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    items = []
    for i in range(12):
        body = rng.choices(words, k=rng.randint(14, 24))
        for at in range(2, len(body), 6):
            body[at] = str(rng.randint(10, 99))
        items.append((i, " ".join(body)))
    docs, planted = [], 0
    for d in range(120):
        _, item = rng.choice(items)
        kind, text = rng.randrange(5), item.split()
        if kind in (1, 2):
            other = {}
            text = [other.setdefault(x, str(rng.randint(100, 999))) if x.isdigit() else x for x in text]
        elif kind == 3:
            text = [str(rng.randint(100, 999)) if x.isdigit() else x for x in text]
            text[rng.randrange(len(text))] = "zzz"
        elif kind == 4:
            text = text[: len(text) // 3]
        planted += kind < 3
        docs.append((d, " ".join(rng.choices(words, k=rng.randint(0, 40)) + text + rng.choices(words, k=rng.randint(0, 40)))))
    want = brute(docs, items, decontaminate.COVERAGE)
    got = {(r.doc_id, r["item_id"]): r.kind for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) >= planted > 40


def test_all_windows_without_the_held_set(spark, benchmark, monkeypatch):
    from tallyline.llm import decontaminate

    docs = spark.createDataFrame([(10, "before " + ITEM)], "doc_id long, text string")
    want = leaks(docs, benchmark).collect()
    monkeypatch.setattr(decontaminate, "HELD_WINDOWS", 0)
    assert leaks(docs, benchmark).collect() == want != []


def test_empty(spark, nothing, benchmark):
    assert leaks(nothing, benchmark).count() == 0
    assert leaks(spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), benchmark.limit(0)).count() == 0
