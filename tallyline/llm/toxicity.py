"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer (a character trie) turns words into symbols: insult, with
the weight of the stem met, threat, target, negation and reporting verb;
punctuation into quotes, commas and clause ends. Three small transducers,
negation, reported speech and target, are composed into one deterministic
table, which rewrites an insult or threat by what surrounds it in its clause:
plain, aimed, negated or reported. Clause sums of these events, capped so that
one clause counts once or twice, are a document's features, and a logistic
model over them gives the score.

Insult stems and their weights come from labelled rows: word prefixes that are
much commoner, by rate in words, in toxic texts than in others. Labels serve
only for this and for the logistic model, on a bounded sample of rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import read_table, saved, thrifty

#: Labelled rows, in expectation, that the lexicon and the model are fitted on.
TRAIN_ROWS = 12_000
#: Lengths of prefixes that may be stems, rows that must have one, and least log-ratio of its rates.
SHORTEST, LONGEST, LEAST_ROWS, LEAST_RATIO = 4, 12, 3, math.log(5)
#: Least surprise (log-likelihood) of a stem's count in toxic texts.
LEAST_SURPRISE = 12
SCORE = 0.7

OTHER, END, COMMA, QUOTE, NEGATION, REPORT, TARGET, THREAT, INSULT = range(9)

# Word lists of the grammar, in English, German, French and Spanish.
WORDS = {
    NEGATION: "not no never none nobody isn't aren't wasn't don't doesn't without hardly nicht kein keine keinen nie niemals ohne pas jamais aucun aucune sans ni nunca jamás sin ningún".split(),
    REPORT: "said says say claimed claims reported reports quoted called wrote writes according allegedly told sagte sagt behauptet berichtet laut schrieb dit disait selon déclaré écrit prétend dijo dice según afirmó escribió".split(),
    TARGET: "you your you're yours he she they them him these those people everyone du dich dir ihr euch sie tu toi vous te usted ustedes ellos ellas".split(),
    THREAT: "kill hurt destroy beat murder attack shoot stab burn die strangle töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir".split(),
}

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:,\n\"“”„«»]")
_MARKS = {"\n": END, ",": COMMA} | dict.fromkeys(".!?;:", END) | dict.fromkeys('"“”„«»', QUOTE)

PLAIN, AIMED, NEGATED, REPORTED, MENACE, AIMED_MENACE = range(6)
EVENTS = 6
CLAUSE_CAP = 8.0


class Transducer:
    """Deterministic: ``step[state][symbol] = (state, symbol)``; state 0 starts."""

    def __init__(self, step: list[list[tuple[int, object]]]):
        self.step = step

    def then(self, other: Transducer, symbols: list) -> Transducer:
        """Composition: this one's output is the other's input; ``symbols`` numbers what the other reads."""
        number = {s: i for i, s in enumerate(symbols)}
        states, order, step = {(0, 0): 0}, [(0, 0)], []
        for a, b in order:  # grows while new pairs are met
            row = []
            for symbol in range(len(self.step[a])):
                to_a, out = self.step[a][symbol]
                to_b, out = other.step[b][number[out]]
                if (to_a, to_b) not in states:
                    states[to_a, to_b] = len(order)
                    order.append((to_a, to_b))
                row.append((states[to_a, to_b], out))
            step.append(row)
        return Transducer(step)


def grammar() -> Transducer:
    """Negation, then reported speech, then target: symbols to events, or None."""
    base = list(range(9))
    negated = {INSULT: ("i",), THREAT: ("t",)}
    scope = 3  # words that a negation reaches
    rows = []
    for left in range(scope + 1):
        row = [(max(left - 1, 0), s) for s in base]
        row[END], row[COMMA] = (0, END), (0, COMMA)
        row[QUOTE] = (left, QUOTE)
        row[NEGATION] = (scope, NEGATION)
        if left:
            row[INSULT], row[THREAT] = (left, negated[INSULT]), (left, negated[THREAT])
        rows.append(row)
    negation = Transducer(rows)
    middle = [*base, ("i",), ("t",)]
    rows = []
    for state in range(3):  # 0 own speech, 1 after a reporting verb, 2 inside its quotation
        row = [(state, s) for s in middle]
        row[REPORT] = (max(state, 1), REPORT)
        row[QUOTE] = ((0, 2, 0)[state], QUOTE)
        row[END] = (2 if state == 2 else 0, END)
        if state:
            for s in (INSULT, THREAT, len(base), len(base) + 1):
                row[s] = (state, ("r",))
        rows.append(row)
    speech = Transducer(rows)
    last = [*middle, ("r",)]
    rows = []
    for state in range(2):  # whether a target stands in the clause
        row = [(state, None) for _ in last]
        row[END] = row[COMMA] = (0, None)
        row[TARGET] = (1, None)
        row[INSULT] = (state, AIMED if state else PLAIN)
        row[THREAT] = (state, AIMED_MENACE if state else MENACE)
        row[len(base)] = row[len(base) + 1] = (state, NEGATED)
        row[len(last) - 1] = (state, REPORTED)
        rows.append(row)
    return negation.then(speech, middle).then(Transducer(rows), last)


_GRAMMAR = grammar().step


class Lexicon(dict):
    """Word or mark to symbol; an insult's is ``INSULT + n`` of ``weights[n]``. Grows as words are met, within a bound."""

    HELD = 150_000

    def __init__(self, stems: dict[str, float]):
        self.stems = sorted(stems)
        self.weights = [stems[s] for s in self.stems]
        self.trie: dict = {}
        for n, stem in enumerate(self.stems):
            node = self.trie
            for c in stem:
                node = node.setdefault(c, {})
            node[""] = n
        self.fixed = {w: symbol for symbol, ws in WORDS.items() for w in ws} | _MARKS
        self.update(self.fixed)

    def __missing__(self, token: str) -> int:
        word, symbol = token.lower(), OTHER
        if word in self.fixed:
            symbol = self.fixed[word]
        else:
            node = self.trie
            for c in word:  # the longest stem that begins the word
                node = node.get(c)
                if node is None:
                    break
                symbol = INSULT + node[""] if "" in node else symbol
        if len(self) > self.HELD:
            self.clear()
            self.update(self.fixed)
        self[token] = symbol
        return symbol


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Per event: log of one plus its capped clause sums; then their sum by words, the log of words and of clauses met."""
    tokens = _TOKEN.findall(text or "")
    symbols = list(map(lexicon.__getitem__, tokens))
    total, met, state = [0.0] * EVENTS, 0, 0
    if symbols and max(symbols) >= THREAT:
        clause = [0.0] * EVENTS
        for s in symbols:
            state, event = _GRAMMAR[state][min(s, INSULT)]
            if event is not None:
                clause[event] += lexicon.weights[s - INSULT] if s >= INSULT else 1.0
            elif s in (END, COMMA) and any(clause):
                met += 1
                total = [t + min(c, CLAUSE_CAP) for t, c in zip(total, clause)]
                clause = [0.0] * EVENTS
        if any(clause):
            met += 1
            total = [t + min(c, CLAUSE_CAP) for t, c in zip(total, clause)]
    n = len(symbols)
    return [math.log1p(t) for t in total] + [10 * sum(total) / (n + 20), math.log1p(met), math.log1p(n) / 10]


WIDTH = EVENTS + 3


class Model:
    def __init__(self, stems: dict[str, float], weights: np.ndarray):
        self.stems, self.weights = stems, weights
        self._lexicon: Lexicon | None = None

    def __getstate__(self):
        return {"stems": self.stems, "weights": self.weights, "_lexicon": None}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self._lexicon is None:
            self._lexicon = Lexicon(self.stems)
        x = np.array([features(t, self._lexicon) for t in texts]).reshape(-1, WIDTH)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -40, 40)))


#: Without labelled rows of both kinds.
DEFAULT_WEIGHTS = np.array([-3.0, 1.5, 2.0, 0.3, 0.2, 1.0, 2.0, 0.5, 0.5, 0.0])


def _prefixes(text: str | None) -> tuple[Counter, int]:
    words = [w for w in (t.lower() for t in _TOKEN.findall(text or "")) if w not in _MARKS]
    found: Counter = Counter()
    for w in words:
        for n in range(SHORTEST, min(len(w), LONGEST) + 1):
            found[w[:n]] += 1
    return found, len(words)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch of (text, toxic): each prefix's times in toxic and in other texts, and its toxic rows; the empty one counts words."""
    for batch in batches:
        bad, good, rows = Counter(), Counter(), Counter()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found, n = _prefixes(text)
            (bad if toxic else good).update(found)
            (bad if toxic else good)[""] += n
            if toxic:
                rows.update(found.keys())
        names = sorted(bad.keys() | good.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[p] for p in names], pa.int64()) for c in (bad, good, rows))], ["stem", "bad", "good", "rows"])


def fit_stems(sample: DataFrame) -> dict[str, float]:
    """Stem weights from (text, toxic): each is the log of a stem's rate in toxic texts over that in others.

    Only prefixes that are surprising by these statistics reach the driver: at
    most a few of each toxic row of the bounded sample. None without toxic rows.
    """
    counts = saved(sample.select("text", "toxic").mapInArrow(thrifty(_counted), "stem string, bad long, good long, rows long").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.sum("rows").alias("rows")), "prefixes")
    words = counts.where("stem = ''").first()
    if words is None or not words.bad:
        return {}
    n_bad, n_good = words.bad + 1, words.good + 1
    expected = (F.col("bad") + F.col("good")) * (n_bad / (n_bad + n_good))
    rated = counts.where(f"stem <> '' and rows >= {LEAST_ROWS}").select(
        "stem",
        (F.log((F.col("bad") + 0.5) / n_bad) - F.log((F.col("good") + 0.5) / n_good)).alias("ratio"),
        (F.col("bad") * F.log(F.col("bad") / expected) - (F.col("bad") - expected)).alias("surprise"),
    )
    ranked = rated.where((F.col("ratio") >= LEAST_RATIO) & (F.col("surprise") >= LEAST_SURPRISE)).collect()
    stems: dict[str, float] = {}
    for r in sorted(ranked, key=lambda r: (-r.surprise, -len(r.stem), r.stem)):  # the best of each family of prefixes
        if not any(r.stem[:n] in stems for n in range(SHORTEST, len(r.stem))) and not any(s.startswith(r.stem) for s in stems):
            stems[r.stem] = min(r.ratio, 6.0)
    return stems


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 40) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * np.r_[0, w[1:]] * len(y) / 100
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * (ridge * len(y) / 100 + 1e-9)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on about ``rows`` labelled documents, chosen by the hash of their id, that aren't held out."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    known = saved(known, "known")
    share = min(1.0, rows / max(known.count(), 1))
    some = saved(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))), "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = saved(texts.join(F.broadcast(some), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")), "sample")
    stems = fit_stems(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(stems)
        for batch in batches:
            x = [features(t, lexicon) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    seen = sample.mapInArrow(thrifty(run), "x array<double>, y int").toPandas()
    y = seen["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return Model(stems, DEFAULT_WEIGHTS)
    return Model(stems, _logistic(np.stack(seen["x"]), y))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text); null and empty texts are scored by the model's constant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(thrifty(run), "doc_id long, score double")


def op8_toxicity_grammar(spark, sf_dir: str) -> DataFrame:
    """All documents; fitted on labelled rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= SCORE).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, score: float = SCORE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score less than ``score``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at).to_pylist()) < score))

    return docs.mapInArrow(thrifty(run), docs.schema)
