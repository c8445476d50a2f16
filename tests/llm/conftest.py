from __future__ import annotations

import random
import string

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, sig string"


@pytest.fixture(scope="session")
def corpus():
    """Texts with near copies of many degrees, short texts, repeated rows and nulls."""
    rng = random.Random(7)
    words = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(1, 8))) for _ in range(400)]
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n, text))
        n += 1

    shared = rng.choices(words, k=40)
    for _ in range(60):
        base = rng.choices(words, k=rng.choice([5, 6, 9, 12, 30, 80, 200]))
        if rng.random() < 0.3:
            base = shared + base
        add(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            other = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                kind, at = rng.randint(0, 2), rng.randrange(len(other))
                if kind == 0:
                    other[at] = rng.choice(words)
                elif kind == 1:
                    other.insert(at, rng.choice(words))
                elif len(other) > 1:
                    other.pop(at)
            add(rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.1 else w for w in other))
    for text in (None, "", "   ", "one", "ONE", "one two", "one two three four", "É é", "é É"):
        add(text)
    rows.append(rows[3])
    return rows


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in corpus], DOCS)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOCS)
