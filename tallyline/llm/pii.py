"""Personal data by weak supervision, in DataFrame functions throughout.

Base spans are those of four fixed patterns. Candidates of further kinds
(secrets, national phone numbers, identity numbers, account numbers) come from
one wide pattern. Five labelers vote on each candidate, for, against or not:
strict format of its body, gazetteers (issuers of keys, countries of account
numbers with their lengths, number ranges that are never issued), the words
before its body, shape, and a counter-indicator. The corpus is searched once and
what is found is saved. It is counted by vote pattern, of which there is a fixed
number; over these counts expectation-maximisation estimates each labeler's
reliability and each pattern's posterior. A logistic span classifier on votes,
kind and length is trained on the posteriors, and its weights go back into the
plan as literals. Nothing is shuffled but the pattern counts.

Patterns use possessive repeats and begin where a run begins, so they are linear
in very long runs and don't recurse.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import read_table, saved

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){15}", "phone": r"\+"}

_CUES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key"
CANDIDATE = (
    rf"(?<![A-Za-z0-9_])(?i:{_CUES}) ?[=:] ?[^\s,;]{{4,}}+"
    r"|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+=*+"
    r"|(?<![0-9+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
    r"|(?<![0-9+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"
)
# Beginnings of keys by issuer, and account numbers (IBAN) by country with their lengths.
ISSUERS = "AKIA ASIA ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- xoxa- xoxb- xoxp- xoxr- xoxs- sk- sk_live_ sk_test_ pk_live_ rk_live_ AIza ya29 eyJ npm_ pypi- hf_ SG dop_v1_ shpat_ EAAC".split()
ACCOUNTS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MT": 31, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "TN": 24, "TR": 26, "UA": 29,
}

#: Added kinds, in the order of their spans.
ADDED = ("account", "identity", "local_phone", "secret")
VOTES = ("format", "gazetteer", "context", "shape", "counter")
SPAN = "array<struct<kind:string,start:int,end:int>>"
FOUND = "array<struct<start:int,end:int,value:string>>"
EM_ROUNDS = 60


def found(text: Column, pattern: str, keep) -> Column:
    """Matches of a pattern that ``keep`` holds for, as structs of start, end (code points) and value."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        hit = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value")))
        return F.struct(end.alias("at"), F.when(x["m"].isNotNull() & keep(x["m"]), F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out")), step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=.)", "")
    return (F.length(bare) <= 3) & (F.substring(bare, 1, 3).cast("int") <= 255)


_KEEP = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, "\\."), _small),
    "card": lambda v: (F.length(_digits(v)).between(16, 19)) & luhn(_digits(F.substring(v, 1, 40))),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def base_spans(text: Column) -> dict[str, Column]:
    """Kind to its spans; a row without a sign of the kind isn't searched."""
    return {k: F.when(text.rlike(_HINT[k]), found(text, p, _KEEP[k])).otherwise(F.array().cast(FOUND)) for k, p in BASE.items()}


def _kind(v: Column) -> Column:
    return (
        F.when(v.rlike(rf"^(?i:{_CUES}) ?[=:]"), "secret")
        .when(v.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "identity")
        .when(v.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"), "local_phone")
        .when(v.rlike("^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?$"), "account")
        .otherwise("secret")
    )


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out.when(no, -1) if no is not None else out).otherwise(0)


def _gazetteer(kind: Column, body: Column) -> Column:
    """For: a known issuer, or a country's account number of its length. Against: a country or a number range that there isn't."""
    bare = F.regexp_replace(body, " ", "")
    length = F.element_at(F.create_map(*(F.lit(x) for pair in ACCOUNTS.items() for x in pair)), F.substring(bare, 1, 2))
    area = F.substring(F.regexp_replace(body, "[^0-9]", ""), 1, 3)
    return (
        F.when(kind == "account", F.when(length == F.length(bare), 1).otherwise(-1))
        .when(kind == "identity", F.when(area.isin("000", "666") | (area >= "900"), -1).otherwise(0))
        .when(kind == "local_phone", F.when((area < "200") | area.endswith("11"), -1).otherwise(0))
        .otherwise(F.when(body.rlike("^[\"']?(?:" + "|".join(ISSUERS) + ")"), 1).otherwise(0))
    )


def _votes(text: Column, x: Column) -> Column:
    """A candidate with its kind, length class and votes."""
    v = x["value"]
    kind = _kind(v)
    cue = F.regexp_extract(v, rf"^((?i:{_CUES}) ?[=:] ?)?", 1)
    body = v.substr(F.length(cue) + 1, F.length(v))
    before = F.lower(F.concat(F.substring(text, F.greatest(x["start"] - 29, F.lit(1)), F.least(F.lit(30), x["start"])), cue))
    letters, digits = body.rlike("[A-Za-z]"), body.rlike("[0-9]")
    return F.struct(
        x["start"].alias("start"),
        x["end"].alias("end"),
        kind.alias("kind"),
        F.least(F.length(body) / 8, F.lit(4)).cast("int").alias("size"),
        _vote(body.rlike(r"^[\"']?(?:(?=[0-9]*+[a-fA-F])(?:[0-9a-f]{16,}|[0-9A-F]{16,})|(?:AKIA|ASIA)[0-9A-Z]{16}|[A-Za-z]{2,4}_[A-Za-z0-9_]{20,}|[A-Za-z0-9+/]{24,}={1,2}|(?!000|666)[0-8][0-9]{2}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}|\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)[\"']?$")).alias("format"),
        _gazetteer(kind, body).alias("gazetteer"),
        _vote(before.rlike(rf"(?:{_CUES}|key|credential|login|ssn|social|security|iban|account|tel|phone|call|fax|mobile)\W{{0,12}}$")).alias("context"),
        _vote(letters & digits & (F.length(body) >= 12) & ~body.rlike("[a-z]{8}"), ~digits).alias("shape"),
        _vote(F.lit(False), body.rlike(r"^(?:19|20)[0-9]{2}[-/.]|^v?[0-9]+(?:\.[0-9]+)+$|^[A-Za-z]+(?:[-_/][A-Za-z]+)+$|(.)\1{7}")).alias("counter"),
    )


def candidates(text: Column) -> Column:
    """Candidates of a text with votes; empty without any sign of one."""
    sign = text.rlike("[0-9=:]") & text.rlike(rf"(?i:{_CUES}) ?[=:]|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16}}|[0-9]{{3}}[-). ]{{1,2}}[0-9]{{2}}|[A-Z]{{2}}[0-9]{{2}} ?[A-Z0-9]{{4}}")
    return F.when(sign, F.transform(found(text, CANDIDATE, lambda v: v.rlike("[0-9]|[=:]")), lambda x: _votes(text, x)))


def expectation_maximisation(counts: dict[tuple[int, ...], float], rounds: int = EM_ROUNDS) -> tuple[float, list[dict[int, tuple[float, float]]], dict[tuple[int, ...], float]]:
    """(share of true spans, per labeler P(vote | true), P(vote | false), posterior of each vote pattern)."""
    def start(p: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-1.5 * sum(p) + 1.0))

    post = {p: start(p) for p in counts}
    prior, said = 0.5, []
    for _ in range(rounds):
        total = sum(counts.values())
        true = sum(post[p] * n for p, n in counts.items())
        prior = min(max((true + 1) / (total + 2), 1e-4), 1 - 1e-4)
        said = []
        for i in range(len(VOTES)):
            # a vote for is at first believed thrice as often of true spans, one against of false ones
            yes, no = {1: 3.0, 0: 2.0, -1: 1.0}, {1: 1.0, 0: 2.0, -1: 3.0}
            for p, n in counts.items():
                yes[p[i]] += post[p] * n
                no[p[i]] += (1 - post[p]) * n
            said.append({v: (yes[v] / sum(yes.values()), no[v] / sum(no.values())) for v in yes})
        for p in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(said[i][v][0] / said[i][v][1]) for i, v in enumerate(p))
            post[p] = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
    return prior, said, post


#: Features of the span classifier: constant, votes for and against, kinds, length.
def _inputs(kind: str, size: int, votes: tuple[int, ...]) -> list[float]:
    return [1.0] + [float(v > 0) for v in votes] + [float(v < 0) for v in votes] + [float(kind == k) for k in ADDED] + [size / 4]


def train_classifier(rows: list[tuple[str, int, tuple[int, ...], float, float]], steps: int = 600, rate: float = 0.5, ridge: float = 0.002) -> list[float]:
    """Logistic weights from (kind, size, votes, posterior, count) rows."""
    total = sum(n for *_, n in rows) or 1.0
    data = [(_inputs(k, s, v), y, n / total) for k, s, v, y, n in rows]
    w = [0.0] * len(_inputs(ADDED[0], 0, (0,) * len(VOTES)))
    for _ in range(steps):
        slope = [ridge * x for x in w]
        for x, y, n in data:
            z = sum(a * b for a, b in zip(w, x))
            d = n * (1 / (1 + math.exp(-max(-40.0, min(40.0, z)))) - y)
            slope = [s + d * b for s, b in zip(slope, x)]
        w = [a - rate * s for a, s in zip(w, slope)]
    return w


def search(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """The columns of ``keep``, ``base`` (all base spans) and ``candidates`` (with votes) of each row of ``docs`` (text)."""
    rows = docs.select(F.struct(*keep).alias("kept"), F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.select("kept", "t", *(c.alias(k) for k, c in base_spans(F.col("t")).items()))
    tag = lambda k: F.transform(k, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return rows.select("kept.*", F.concat(*(tag(k) for k in BASE)).alias("base"), candidates(F.col("t")).alias("candidates"))


def fit_classifier(searched: DataFrame) -> list[float] | None:
    """Weights from the vote patterns of all ``candidates``; None without any."""
    each = searched.where(F.size("candidates") > 0).select(F.explode("candidates").alias("c")).select("c.*")
    counts = each.groupBy("kind", "size", *VOTES).count().collect()  # at most 4 * 5 * 3**5 rows
    if not counts:
        return None
    by_votes: dict[tuple[int, ...], float] = {}
    for r in counts:
        key = tuple(r[v] for v in VOTES)
        by_votes[key] = by_votes.get(key, 0.0) + r["count"]
    _, _, post = expectation_maximisation(by_votes)
    return train_classifier([(r["kind"], r["size"], key, post[key], float(r["count"])) for r in counts for key in [tuple(r[v] for v in VOTES)]])


def _accepted(weights: list[float]):
    def test(x: Column) -> Column:
        terms = [F.lit(weights[0])]
        n = len(VOTES)
        for i, v in enumerate(VOTES):
            terms += [F.when(x[v] > 0, weights[1 + i]).when(x[v] < 0, weights[1 + n + i]).otherwise(0.0)]
        for i, k in enumerate(ADDED):
            terms += [F.when(x["kind"] == k, weights[1 + 2 * n + i]).otherwise(0.0)]
        terms += [x["size"] / 4 * weights[-1]]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total > 0

    return test


def accepted_spans(searched: DataFrame, weights: list[float] | None) -> Column:
    """All spans of a row of ``search``: the base ones, then accepted candidates that overlap none of them, by kind and start."""
    if weights is None:
        return F.col("base")
    good = F.filter("candidates", lambda x: _accepted(weights)(x) & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    rank = F.create_map(*(F.lit(x) for n, k in enumerate(ADDED) for x in (k, n)))
    ordered = F.array_sort(F.transform(good, lambda x: F.struct(F.element_at(rank, x["kind"]).alias("n"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    added = F.transform(ordered, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return F.when(F.size("candidates") > 0, F.concat("base", added)).otherwise(F.col("base"))


def find_spans(docs: DataFrame, weights: list[float] | None = None, name: str = "searched") -> DataFrame:
    """(row, base, spans) of each row of ``docs``: the row as a struct, and arrays of (kind, start, end) in code points, ``end`` exclusive.

    The classifier's weights come from all candidates of ``docs`` if none are
    given. Spans are ordered by kind as listed (base kinds, then added ones) and
    start. Base spans are all kept; an added span that overlaps one is dropped.
    Null and empty texts have none; an empty table gives an empty one. Rows that
    repeat are searched each; columns of any name stay inside ``row``.
    """
    found = saved(search(docs, [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")]), name)
    weights = weights or fit_classifier(found)
    return found.select("row", "base", accepted_spans(found, weights).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping ones the first stands."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        put = F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), put.alias("out"))).otherwise(acc)

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op7_pii_weak_supervision(spark, sf_dir: str) -> DataFrame:
    """All documents; the classifier is trained on all their candidates. The texts themselves aren't saved."""
    docs = read_table(spark, sf_dir, "documents")
    found = saved(search(docs, [F.col("doc_id").cast("long").alias("doc_id")]), "searched")
    done = found.select("doc_id", "base", accepted_spans(found, fit_classifier(found)).alias("all_spans"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return done.select("doc_id", *(count(k) for k in BASE), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("all_spans")).alias("spans"))
