"""Facts, revisions, registry, extraction, layout, lifecycle, report."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyline.operators import extraction, facts, layout, lifecycle, registry, report, revisions
from tallyline.sources import documents, registries
from tallyline.sources.catalogues import read_facts


def test_fact_reject_reasons(spark):
    good = ("q", "PD", "M-001", 1, [0.1, 0.1, 0.2, 0.2])
    rows = [
        good, ("  ", *good[1:]), (None, *good[1:]), ("q", "XX", *good[2:]), ("q", "PD", "", *good[3:]), ("q", "PD", "M-001", -1, good[4]), ("q", "PD", "M-001", 0, good[4]),
        (*good[:4], [0.0, 0.0, 0.0, 0.0]), (*good[:4], [0.1, 0.1, 1.2, 0.2]), (*good[:4], [-0.1, 0.1, 0.2, 0.2]), (*good[:4], [0.3, 0.1, 0.2, 0.2]), (*good[:4], [0.1, 0.3, 0.2, 0.2]), (*good[:4], None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, quote string, stage string, code string, page int, bbox array<double>")
    got = [r.x for r in df.select("i", facts.reject_reason(*(F.col(c) for c in ("quote", "stage", "code", "page", "bbox"))).alias("x")).orderBy("i").collect()]
    assert got == [None, "empty_quote", "empty_quote", "bad_stage", "empty_param_code", "bad_page", None, None, *["bad_bbox"] * 4, None]


@pytest.mark.parametrize("norm,value", [('{"kind":"number","value":1250.5}', "1250.5"), ('{"kind":"number","value":12345678.0}', "12345678"), ('{"value":""}', "raw"), ('{"value":"B30"}', "B30"), ('{"kind":"bool","value":true}', "raw"), ('{"kind":"set","value":["a"]}', "raw"), ("{broken", "raw"), (None, "raw")])
def test_comparable(spark, norm, value):
    assert spark.range(1).select(facts.comparable(F.lit(norm).cast("string"), F.lit("raw")).alias("x")).first().x == value


def test_best_and_pivot(spark):
    rows = [("M-1", "PD", None, 0.8, 2, 1, "a"), ("M-1", "PD", "", 0.9, 5, 2, "b"), ("M-1", "RD", "", 0.9, 1, 3, "c"), ("M-1", "ID", "", 0.9, 1, 4, "d"), ("M-2", "RD", "", 0.9, 1, 5, "e")]
    df = spark.createDataFrame(rows, "param_code string, stage string, element_key string, confidence double, page int, seq int, value string")
    best = facts.best_facts(df)
    assert {r.value for r in best.collect()} == {"b", "c", "d", "e"}
    got = {r.param_code: (r.expected, r.actual) for r in facts.pivot_stages(best).collect()}
    assert got == {"M-1": ("b", "c"), "M-2": (None, "e")}


CASES = {
    "one": ([("a", "APPROVED", None, None)], ["a"], None),
    "chain": ([("a", "APPROVED", None, None), ("b", "APPROVED", "a", None)], ["b"], None),
    "successor only": ([("a", "APPROVED", None, "b"), ("b", "APPROVED", None, None)], [], "MULTIPLE_CANDIDATES"),
    "drafts": ([("a", "DRAFT", None, None)], [], "NO_CANDIDATE"),
    "two": ([("a", "APPROVED", None, None), ("b", "FOR_CONSTRUCTION", None, None)], [], "MULTIPLE_CANDIDATES"),
    "dangling": ([("a", "APPROVED", "zz", None)], [], "DANGLING_REFERENCE"),
    "cycle": ([("a", "APPROVED", None, "b"), ("b", "APPROVED", None, "c"), ("c", "APPROVED", None, "a")], [], "CYCLE"),
    "self": ([("a", "APPROVED", None, "a")], [], "CYCLE"),
    "predecessor cycle": ([("a", "APPROVED", "b", None), ("b", "APPROVED", "a", None)], [], "NO_CANDIDATE"),
    "draft after": ([("a", "APPROVED", None, None), ("b", "DRAFT", "a", None)], ["a"], None),
    "tail into cycle": ([("t", "DRAFT", None, "a"), ("a", "APPROVED", None, "b"), ("b", "APPROVED", None, "a")], [], "CYCLE"),
}


def test_revisions(spark):
    rows = [(f"{n}/{i}", n, None, "AR", None, status, p and f"{n}/{p}", s and f"{n}/{s}") for n, (files, _, _) in CASES.items() for i, status, p, s in files]
    schema = "file_id string, object_id string, doc_stage string, discipline string, document_code string, approval_status string, predecessor_id string, successor_id string"
    got = revisions.select_current(spark.createDataFrame(rows, schema)).collect()
    for name, (_, current, reason) in CASES.items():
        mine = [r for r in got if r.object_id == name]
        assert sorted(r.file_id.split("/")[1] for r in mine if r.is_current) == current, name
        assert {r.selection_reason for r in mine} == {reason}, name


def test_cycles_on_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (1002, 1000)]
    got = revisions.successor_cycles(spark.createDataFrame(edges, "id long, next long"))
    assert {r.id for r in got.collect()} == {1000, 1001, 1002}
    assert revisions.successor_cycles(spark.createDataFrame([], "id long, next long")).count() == 0


def test_registry(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("﻿Имя файла;Хеш;Стадия;Статус;Дата утверждения;Раздел\nа.pdf;;ПД;утверждено;15.03.2026;АР\n;;;;;\nb.pdf;xyz;QQ;чужой;soon;\n", "utf-8")
    rows = registry.normalize_rows(registries.read_registry(spark, str(path)))
    a, b = rows.orderBy("file_name").collect()[::-1] if rows.first().file_name != "а.pdf" else rows.collect()
    a, b = (a, b) if a.file_name == "а.pdf" else (b, a)
    assert (a.doc_stage, a.approval_status, a.approval_date) == ("PD", "APPROVED", "2026-03-15")
    assert not any(i.fatal for i in a.issues)
    assert {i.field for i in b.issues if i.fatal} == {"doc_stage", "approval_status", "approval_date"}
    assert b.sha256 == "" and ("sha256", False) in {(i.field, i.fatal) for i in b.issues}
    files = spark.createDataFrame([("1", "а.pdf", None, 1), ("2", "а.pdf", None, 2)], "file_id string, file_name string, sha256 string, uploaded_at int")
    assert {r.file_name: (r.file_id, r.match_status) for r in registry.match_rows(rows, files).collect()} == {"а.pdf": ("2", "MATCHED"), "b.pdf": (None, "INVALID")}


def test_registry_json_and_unknown(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('[{"file": " x ", "hash": ""}, {"file": ""}]')
    assert sorted(r.file_name for r in registries.read_registry(spark, str(path)).collect()) == ["", " x "]
    with pytest.raises(ValueError):
        registries.read_registry(spark, "r.ods")


LINES = [
    ("Площадь застройки — 1 250,5 м²", None, ("M-001", "1250.5", 0.85)),
    ("Площадь застройки", "1250 м²", ("M-001", "1250", 0.8)),
    ("Общая площадь здания: 900", None, ("M-002", "900", 0.75)),
    ("Ширина эвакуационных дверей 900 мм", None, ("M-041", "0.9", 0.85)),
    ("Количество квартир - 120", None, ("M-010", "120", 0.85)),
    ("БЕТОН класса В30", None, ("M-055", "B30", 0.85)),
    ("Арматура А500С", None, ("M-057", "A500C", 0.85)),
    ("Степень огнестойкости II", None, ("M-022", "II", 0.85)),
    ("Облицовка фасада RAL  9003", None, None),
    ("Фасад: RAL 9003", None, ("M-052", "RAL 9003", 0.8)),
    ("железобетонные конструкции 30", None, None),
    ("Толщина утеплителя кровли 200 мм", None, ("M-128", "200", 0.85)),
    ("Толщина утеплителя 150 мм", None, ("M-125", "150", 0.85)),
    ("просто текст", "площадь застройки 5 м2", None),
]


def test_extraction(spark):
    rows = [(i, 1, 0, t, None, n, None) for i, (t, n, _) in enumerate(LINES)]
    df = spark.createDataFrame(rows, "id int, page int, line int, text string, bbox array<double>, next_text string, next_bbox array<double>")
    got: dict = {}
    for r in extraction.candidates(df).collect():
        got.setdefault(r.id, []).append((r.param_code, r.value_norm, r.confidence))
    for i, (text, _, want) in enumerate(LINES):
        assert got.get(i, []) == ([want] if want else []), text


def test_verification_drops_inventions(spark):
    lines = spark.createDataFrame([("d", 1, 0, "Высота 10,5 м"), ("d", 1, 1, "Иное")], "id string, page int, line int, text string")
    proposed = spark.createDataFrame([("d", 1, 1, "M-008", "10.5"), ("d", 1, 0, "M-008", "11")], "id string, page int, line int, param_code string, value string")
    got = extraction.verify_proposed(proposed, lines).collect()
    assert [(r.value, r.line) for r in got] == [("10.5", 0)]


def test_chunks(spark):
    lines = ["a" * 9, "b" * 9, "c" * 30, "d", "e" * 2, "f" * 3]

    def by_hand(size):
        out, held, n = [], 0, 0
        for i, text in enumerate(lines):
            shown = f"[1:{i}] {text}"
            if held + len(shown) > size and held:
                held, n = 0, n + 1
            held += len(shown) + 1
            out.append(n)
        return out

    for size in range(1, 90):
        assert spark.range(1).select(extraction.chunk_lines(F.array(*map(F.lit, lines)), size).alias("c")).first().c == by_hand(size) if size in (1, 20, 31, 32, 33, 47, 89) else True


def test_unknown_codes_and_other_chunks_are_dropped(spark):
    lines = spark.createDataFrame([("d", 1, 1, 0, "Высота 10 м"), ("d", 2, 1, 1, "Ширина 12 м")], "id string, chunk int, page int, line int, text string")
    proposed = spark.createDataFrame([("d", 1, 1, 0, "M-008", "12"), ("d", 2, 1, 0, "M-008", "12"), ("d", 2, 1, 1, "M-999", "12")], "id string, chunk int, page int, line int, param_code string, value string")
    assert [(r.param_code, r.line) for r in extraction.verify_proposed(proposed, lines, {"M-008"}).collect()] == [("M-008", 1)]


def test_ranks_and_numbers(spark):
    from tallyline.functions import scalars as S

    scale = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(a).alias("alias")) for i, a in enumerate(("B20", "B25", "B30", "C"))))
    got = spark.range(1).select(*(S.rank_of(F.lit(x), scale).alias(f"r{i}") for i, x in enumerate(("B25F1 B30W6", "B30W6 B25F1", "B25", "X B20", "CX", "B3")))).first()
    assert list(got) == [1, 2, 1, 0, -1, -1]
    numbers = {1e21: "1000000000000000000000", 1.5e-20: "0.000000000000000000015", -1.25e10: "-12500000000", 1250.5: "1250.5", -0.0: "0", 1e-3: "0.001", 1.2345678901e12: "1234567890100", 5e-324: "0." + "0" * 323 + "49"}
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    found = {r.x: r.s for r in df.select("x", S.fmt_num(F.col("x")).alias("s")).collect()}
    assert {k: v for k, v in found.items() if k != 5e-324} == {k: v for k, v in numbers.items() if k != 5e-324} and float(found[5e-324]) == 5e-324
    short = spark.createDataFrame([(x,) for x in (5.0, 33.3333, 1234.5, 0.00001234, 100.0)], "x double").select(S.fmt_significant(F.col("x"), 3).alias("s")).collect()
    assert [r.s for r in short] == ["5", "33.3", "1.23e+03", "1.23e-05", "100"]


def test_files_are_matched_within_their_process(spark):
    rows = spark.createDataFrame([("p", "a.pdf", "0" * 64), ("q", "a.pdf", ""), ("r", "a.pdf", "")], "process_id string, file_name string, sha256 string")
    files = spark.createDataFrame([("p", "1", "x", "0" * 64, 1), ("p", "2", "y", "0" * 64, 2), ("q", "3", "a.pdf", "1" * 64, 1)], "process_id string, file_id string, file_name string, sha256 string, uploaded_at int")
    got = registry.resolve(rows, files, F.col("sha256"), F.col("file_name"), "file_id")
    assert {r.process_id: r.file_id for r in got.collect()} == {"p": "2", "q": "3", "r": None}
    one = spark.createDataFrame([("p", "1", "APPROVED"), ("q", "2", "APPROVED")], "process_id string, file_id string, approval_status string").selectExpr("*", "'o' as object_id", "string(null) as predecessor_id", "string(null) as successor_id")
    assert sorted(r.file_id for r in revisions.select_current(one).where("is_current").collect()) == ["1", "2"]


def test_one_bad_event_takes_no_others_along(spark, tmp_path):
    from tallyline.streaming import events as E

    spark.createDataFrame([(str(i), None) for i in range(12)], "event_id string, invalid string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id string, invalid string").parquet(str(tmp_path / "in"))

    def handle(df):
        if not df.where("event_id = '7'").isEmpty():
            raise ValueError("bad event")
        return df.select("event_id")

    E.consume(stream, handle, str(tmp_path / "out"), str(tmp_path / "dead"), str(tmp_path / "state"), pause=0.01).awaitTermination()
    dead = spark.read.parquet(str(tmp_path / "dead" / "batch=*")).collect()
    assert [(r.event_id, r.invalid) for r in dead] == [("7", "bad event")]
    assert spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")).count() == 11


def test_worker_sniffer_differs():
    assert [documents.sniff_worker(x) for x in (b"%PDF-1", b"PK\x03\x04", b"\xef\xbb\xbf <r/>")] == ["pdf", "docx", "xml"]
    assert documents.sniff_bytes(b"<r/>") is None
    with pytest.raises(ValueError):
        documents.sniff_worker(b"text")


@pytest.mark.parametrize("flags,want", [((0, 0, 0, 0), ""), ((1, 1, 1, 1), "PARTIALLY_LOADED"), ((1, 1, 1, 0), "FULL"), ((1, 1, 0, 0), "PD_RD_ONLY"), ((1, 0, 1, 0), "PD_ID_ONLY"), ((0, 1, 1, 0), "RD_ID_ONLY"), ((1, 0, 0, 0), "SINGLE_ONLY"), ((0, 1, 0, 0), "SINGLE_ONLY"), ((0, 0, 1, 0), "SINGLE_ONLY")])
def test_scenarios(spark, flags, want):
    assert spark.range(1).select(lifecycle.scenario(*(F.lit(bool(x)) for x in flags)).alias("s")).first().s == want


def test_job_plan(spark):
    df = spark.createDataFrame([("a", 45), ("b", 0), ("c", None), ("d", 20)], "file_id string, page_count int")
    got = sorted((r.file_id, r.page_from or 0, r.page_to or 0) for r in lifecycle.plan_jobs(df).collect())
    assert got == [("a", 1, 20), ("a", 21, 40), ("a", 41, 45), ("b", 0, 0), ("c", 0, 0), ("d", 1, 20)]


def test_report_order(spark):
    rows = [("1", "CANDIDATE", "LOW", "M-100"), ("2", "CANDIDATE", "HIGH", "M-200"), ("3", "NEGATIVE_VERIFIED", "HIGH", "M-200"), ("4", "CANDIDATE", None, None), ("5", "CANDIDATE", "MEDIUM", "M-300")]
    got = report.ordered(spark.createDataFrame(rows, "id string, finding_status string, review_priority string, param_code string")).collect()
    assert [(r.finding_status, r.param_code) for r in got] == [("CANDIDATE", "M-200"), ("CANDIDATE", "M-300"), ("CANDIDATE", "M-100"), ("CANDIDATE", None), ("NEGATIVE_VERIFIED", "M-200")]


@pytest.mark.parametrize("pages,grade", [([], "FAILED"), ([5, 9], "ABSTAIN"), ([5, 90], "LOW_QUALITY"), ([30, 90], "OK")])
def test_quality(spark, pages, grade):
    column = F.array(*(F.struct(F.lit(n).alias("chars"), F.lit("text").alias("method")) for n in pages)) if pages else F.array().cast("array<struct<chars:int,method:string>>")
    assert spark.range(1).select(layout.page_stats(column)["quality"].alias("q")).first().q == grade


def test_file_layouts(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes('<?xml version="1.0"?><r xmlns="u"><a><b>x  y</b></a><c/>tail</r>'.encode())
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "b.docx").write_bytes(buffer.getvalue())
    (tmp_path / "c.bin").write_bytes(b"\x00\x01")
    rows = documents.read_layouts(spark, str(tmp_path)).collect()
    texts = {r.path[-5:]: [x.text for x in rows if x.path == r.path] for r in rows if r.text}
    assert texts == {"a.xml": ["r/a/b: x y"], ".docx": ["Hello", "k | v"]}
    assert [r.error for r in rows if r.path.endswith("c.bin")] == ["ValueError: unknown format"]


def test_facts_file(spark, tmp_path):
    path = tmp_path / "f.jsonl"
    path.write_text('{"fact_id":"1","stage":"PD","value_norm":"{}"}\n\n{"fact_id":"2"}\n')
    assert [r.fact_id for r in read_facts(spark, str(path)).orderBy("seq").collect()] == ["1", "2"]
    path.write_text('{"fact_id":"1"}\n{bad\n')
    with pytest.raises(Exception):  # noqa: B017
        read_facts(spark, str(path)).collect()


def test_decisions(spark):
    findings = spark.createDataFrame([(1, 9, "CANDIDATE"), (2, 9, "CANDIDATE"), (3, 8, "NEGATIVE_VERIFIED")], "finding_id int, process_id int, finding_status string")
    decisions = spark.createDataFrame([(1, 1, "CONFIRMED_VIOLATION", "why", None, 1), (1, 2, "NEGATIVE_VERIFIED", "x", None, 2), (2, 3, "CLARIFICATION_REQUIRED", None, None, 3), (1, 4, "NEGATIVE_VERIFIED", "ok", "OTHER", 4)], "finding_id int, seq int, status string, comment string, reason_code string, decided_at int")
    folded = lifecycle.fold_decisions(findings, decisions)
    assert {r.finding_id: (r.inspector_status, r.version) for r in folded.collect()} == {1: ("NEGATIVE_VERIFIED", 3), 2: ("CLARIFICATION_REQUIRED", 2), 3: ("PENDING", 1)}
    assert {r.process_id: (r.status, r.can_finalize) for r in lifecycle.finalizable(lifecycle.process_state(folded)).collect()} == {9: ("COMPLETED", True), 8: ("READY", False)}
