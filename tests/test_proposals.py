"""Patterns with and without their index; a model's answers: mended, verified, failed."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyline.operators import extraction as X
from tallyline.operators import proposals as P
from tallyline.queries.documents import SAMPLES

LINE = "id long, page int, line int, text string, bbox array<double>, next_text string, next_bbox array<double>"


def test_every_pattern_has_stems_and_a_sample():
    made = X.patterns()
    assert len(made) == 44 == len(SAMPLES) and {p.code for p in made} == {s[0] for s in SAMPLES}
    assert all(p.stems for p in made) and X.stems(r"a|b\w+") == ["a", "b"] and X.stems(r"\w+|b") == [] and X.stems(r"(?:аб)?вгд") == ["вгд"]


def test_index_changes_nothing(spark):
    """Lines made of pieces of samples, cut and joined at random, in any case: the same facts with the index as without."""
    rng = random.Random(9)
    pieces = [s[1] for s in SAMPLES] + [s[3] for s in SAMPLES if len(s) > 3] + ["12", "1 250,5", "м²", "мм", "—", ":", "кровли", "подземной", "EI 60"]
    rows = []
    for i in range(400):
        texts = []
        for _ in range(2):
            said = " ".join([*rng.choices(pieces, k=rng.randint(1, 4)), *rng.choices(["12", "— 1 250,5 м²", "В25", "II", ""], k=1)])
            texts.append(rng.choice([said, said.upper(), said.lower(), said[: rng.randint(1, len(said))]]))
        rows.append((i, 1, 0, texts[0], None, rng.choice([None, texts[1]]), None))
    rows.append((999, 1, 0, None, None, None, None))
    lines = spark.createDataFrame(rows, LINE)
    got, want = X.candidates(lines), X.candidates(lines, indexed=False)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and want.count() > 100


@pytest.mark.parametrize(
    "answer, codes",
    [
        ('{"facts": [{"param_code": "A"}, {"param_code": "B"}]}', ["A", "B"]), ('```json\n{"facts": [{"param_code": "A"}]}\n```', ["A"]), ('Вот ответ: {"facts": [{"param_code": "A"},]} — всё', ["A"]),
        ('{"facts": [{"param_code": "A"}, {"param_code": "B"}, {"par', ["A", "B"]), ('{"facts": {}}', None), ("[]", None), ("no", None), ("", None), ('{"facts": []}', []),
    ],
)
def test_mended(spark, answer, codes):
    got = spark.createDataFrame([(answer,)], "a string").select(F.transform(P.mended(F.col("a")), lambda f: F.try_variant_get(f, "$.param_code", "string")).alias("x")).first().x
    assert got == codes


def lines(spark):
    rows = [(1, p, n, t) for p, n, t in [(1, 0, "Площадь застройки — 1 250,5 м²"), (1, 1, "Класс бетона В 25"), (2, 0, "Цвет RAL 7035"), (2, 1, "x" * 50), (2, 2, "Цвет  RAL 7035 снова")]] + [(2, 1, 0, None), (2, 1, 1, "короткая")]
    return spark.createDataFrame(rows, "id long, page int, line int, text string").withColumn("bbox", F.when(F.col("page") == 2, F.array(*[F.lit(x) for x in (0.0, 0.1, 0.2, 0.3)])))


def test_chunks(spark):
    got = {(r.id, r.page, r.line): r.chunk for r in P.chunked(lines(spark), 60).collect()}
    assert [got[1, p, n] for p, n in ((1, 0), (1, 1), (2, 0), (2, 1), (2, 2))] == [0, 0, 1, 2, 3] and got[2, 1, 0] == got[2, 1, 1] == 0
    one = P.questions(P.chunked(lines(spark), 60), [("M-001", "Площадь", "м²")]).where("id = 1 and chunk = 0").first().question
    assert one.endswith("Текст документа:\n[1:0] Площадь застройки — 1 250,5 м²\n[1:1] Класс бетона В 25") and "M-001 | Площадь | м²" in one


def test_answers_become_candidates(spark):
    facts = [
        {"param_code": "M-001", "value": "1 250,5", "unit": "м²", "ref": "1:0"}, {"param_code": "M-055", "value": "в25", "ref": "1:0"}, {"param_code": "M-052", "value": "RAL7035", "ref": "2:0"}, {"param_code": "M-001", "value": "777", "ref": "1:0"},
        {"param_code": "M-999", "value": "1", "ref": "1:0"}, {"param_code": "M-001", "value": "застройки", "ref": "1:0"}, {"param_code": "M-052", "value": " ", "ref": "?"}, "text", {"value": "1"},
    ]
    asked = []

    def client(messages):
        asked.append(messages)
        if "короткая" in messages[1]["content"]:
            raise TimeoutError("slow")
        return "```json\n" + json.dumps({"facts": facts}) + "\n```"

    chunks = P.chunked(lines(spark))
    answers = P.ask(P.questions(chunks, []), client, P.Limits(tries=2, pause=0.0)).persist()
    assert {(r.id, r.error, r.tries) for r in answers.select("id", "error", "tries").collect()} == {(1, None, 1), (2, "TimeoutError: slow", 2)}
    kinds, units = {"M-001": "number", "M-055": "ordinal", "M-052": "string"}, {"M-001": "м²"}
    got = {r.param_code: r for r in P.candidates(answers, chunks, kinds, units).collect()}
    assert {c: (r.value_norm, r.unit, r.page, r.line, r.method, r.confidence) for c, r in got.items()} == {"M-001": ("1250.5", "м²", 1, 0, "llm", 0.7), "M-055": ("B25", None, 1, 1, "llm", 0.7), "M-052": ("RAL7035", None, 2, 0, "llm", 0.7)}
    assert got["M-052"].bbox == [0.0, 0.1, 0.2, 0.3] and got["M-052"].quote == "Цвет RAL 7035"
    assert [r.param_code for r in P.candidates(answers, chunks, kinds, units, {"M-055"}).collect()] == ["M-055"]
    whole = lines(spark).select("*", F.lit(None).cast("string").alias("next_text"), F.lit(None).cast("array<double>").alias("next_bbox"))
    assert sorted((r.param_code, r.method) for r in P.all_candidates(whole, answers, chunks, kinds, units).collect()) == [("M-001", "llm"), ("M-001", "vector_text"), ("M-052", "llm"), ("M-055", "llm")]


def test_budget_of_failures(spark):
    def client(messages):
        raise ConnectionError("down")

    asked = spark.range(30).select("id", F.lit(0).alias("chunk"), F.lit("q").alias("question")).coalesce(1)
    tries = [r.tries for r in P.ask(asked, client, P.Limits(at_once=1, tries=3, pause=0.0, budget=10)).collect()]
    assert max(tries) == 3 and tries.count(1) >= 25 and len(tries) == 30


def test_patterns_are_tried_where_a_match_can_begin(spark):
    """Not on the line before a label, nor where a text is missing that the match needs; matches over two lines stay."""
    from pyspark.sql import functions as F

    made = {p.code: p for p in X.patterns()}
    assert all(p.heads for p in made.values()) and not any(p.heads or p.needs for p in X.patterns(indexed=False))
    assert made["M-004"].heads == ["общий", "строительн"] and made["M-041"].needs == [["выход", "двер"]]
    rows = spark.createDataFrame([(0, "прочие показатели", "прочие показатели высота здания: 5 м"), (1, "высота здания: 5 м", "высота здания: 5 м"), (2, "высота", "высота здания: 5 м")], "i int, head string, lower string")
    tried = rows.select("i", *(p.may_match(F.col("head"), F.col("lower")).alias(c) for c, p in made.items())).orderBy("i").collect()
    assert [[c for c in made if r[c]] for r in tried] == [[], ["M-008"], ["M-008"]]
    texts = ["Прочие показатели", "Высота", "здания: 5 м", "Ширина дверей", "не менее 900 мм", "Площадь", "озеленения 12 м²"]
    lines = spark.createDataFrame([("a", 1, i, t, None, n, None) for i, (t, n) in enumerate(zip(texts, [*texts[1:], None]))], "id string, page int, line int, text string, bbox array<double>, next_text string, next_bbox array<double>")
    shown = lambda indexed: sorted((r.line, r.param_code, r.value_raw, r.quote) for r in X.candidates(lines, indexed=indexed).collect())
    assert shown(True) == shown(False) and [x[:2] for x in shown(True)] == [(1, "M-008"), (3, "M-041"), (5, "M-027")]
