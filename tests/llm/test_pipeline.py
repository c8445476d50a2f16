from __future__ import annotations

import os
import random
import sys

import corpus_pipeline as C
from pyspark.sql import functions as F
from tallyline.llm.decontaminate import leaks
from tallyline.llm.pii import base_spans
from tallyline.llm.toxicity import SCORE, fit, score_documents

sys.path.insert(0, os.path.dirname(__file__))
from test_jaccard_join import expected  # noqa: E402

TEXT = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark wood tonight"


def tables(spark, folder, docs, labels=()):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "who would ever have thought that this question leaks into the training corpus one day")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_in_order(spark, tmp_path):
    rows = [
        (1, TEXT), (2, TEXT.upper()), (3, TEXT + " again"), (4, "you idiot, you moron, you stupid scum. " * 6), (5, "so. who would ever have thought that this question leaks into the training corpus one day"),
        (6, "write to joe@example.com or 10.0.0.1 about the other thing that nobody else has mentioned"), (7, None), (8, ""), (8, ""), (9, "a plain text of no interest to anyone at all but itself"),
    ]
    rng = random.Random(1)  # the grammar has no words of its own: labelled documents from 100 on teach it
    prose = lambda: " ".join("".join(rng.choices("bcefglnopru", k=rng.randint(3, 8))) for _ in range(30))
    taught = [(100 + i, prose() + (". you idiot, you moron, you stupid scum. " if i % 4 == 1 else ". ") + prose()) for i in range(240)]
    rows += taught
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "b", "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, spans string, base string")
    folder = str(tmp_path)
    tables(spark, folder, docs, [(i, int(i % 4 == 1)) for i, _ in taught])
    kept, at = {}, docs
    for name, stage in C.STAGES:
        out = stage(spark, at, folder)
        out.write.parquet(f"{folder}/{name}")
        at = spark.read.parquet(f"{folder}/{name}")
        kept[name] = sorted(r.doc_id for r in at.collect() if r.doc_id < 100)
        if name != "encoding":
            assert at.columns == docs.columns
    assert kept["toxicity"] == [1, 2, 3, 5, 6, 7, 8, 8, 9]
    assert kept["near_duplicate"] == [1, 5, 6, 7, 8, 8, 9]
    assert kept["decontamination"] == kept["personal_data"] == kept["encoding"] == [1, 6, 7, 8, 8, 9]
    masked = {r.doc_id: r for r in spark.read.parquet(f"{folder}/personal_data").collect()}
    assert masked[6].text == "write to [EMAIL] or [IP] about the other thing that nobody else has mentioned"
    assert masked[6].n_chars == len(masked[6].text) and masked[6].spans == "b" and masked[7].text is None
    assert all(r.lossless for r in at.collect())


def test_run_equals_its_parts(spark):
    """The kept documents of the small table, by each operator's own brute force."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scores = {r.doc_id: r.score for r in score_documents(docs, fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    left = [(r.doc_id, r.text) for r in docs.collect() if scores[r.doc_id] < SCORE]
    groups = expected(left)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    found = {r.doc_id for r in leaks(spark.createDataFrame(left, "doc_id long, text string"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    want = sorted(i for i, _ in left if i not in found)
    got = C.run(spark, sf)
    assert sorted(r.doc_id for r in got.collect()) == want
    assert got.where("not lossless").count() == 0


def test_empty_tables(spark, tmp_path, nothing):
    tables(spark, str(tmp_path), nothing.select("doc_id", "text", "lang", "source", "n_chars"))
    assert C.run(spark, str(tmp_path)).count() == 0
    assert set(base_spans(F.lit("x"))) == {"email", "ip", "card", "phone"}
