"""Operators that no registered query reaches, on a few rows each."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyline.functions import scalars as S
from tallyline.operators import lifecycle as L
from tallyline.operators import outputs as O
from tallyline.operators import registry, rules
from tallyline.streaming import events as E


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_checks_and_candidates(spark):
    checks = spark.createDataFrame([("c1", "p", "g1"), ("c2", "p", "g2"), ("c3", "q", "g3"), ("c4", "gone", "g4")], "check_id string, process_id string, group_id string")
    processes = spark.createDataFrame([("p", "READY"), ("q", "PARSING")], "process_id string, status string")
    assert {tuple(r) for r in O.process_of_checks(checks, processes).collect()} == {("c1", "p", "READY"), ("c2", "p", "READY"), ("c3", "q", "PARSING")}
    findings = spark.createDataFrame([("c1", "CANDIDATE", "PENDING"), ("c2", "CANDIDATE", "CONFIRMED_VIOLATION"), ("c2", "CANDIDATE", "PENDING"), ("c3", "NEGATIVE_VERIFIED", "PENDING")], "check_id string, finding_status string, inspector_status string")
    assert [tuple(r) for r in O.pending_candidates(findings, checks).collect()] == [("p", 2)]


def test_unfinalize(spark):
    rows = spark.createDataFrame([("a", "FINALIZED", "why"), ("b", "FINALIZED", "  "), ("c", "FINALIZED", None), ("d", "COMPLETED", "why")], "id string, status string, reason string")
    assert {r.id: r.status for r in O.unfinalize(rows, F.col("reason")).collect()} == {"a": "COMPLETED", "b": "FINALIZED", "c": "FINALIZED", "d": "COMPLETED"}


def test_registry_missing(spark):
    files = spark.createDataFrame([("a", "ACCEPTED", True), ("b", "ACCEPTED", False), ("c", "ACCEPTED", None), ("d", "REJECTED_SIZE", False)], "id string, check_status string, matched boolean")
    got = lambda n: {r.id: r.registry_missing for r in O.registry_missing(files, F.lit(n)).collect()}
    assert got(3) == {"a": False, "b": True, "c": True, "d": False} and set(got(0).values()) == {True}


def test_mark_duplicates(spark):
    files = spark.createDataFrame([(1, "p", "x", 5), (2, "p", "x", 3), (3, "q", "x", 9), (4, "p", None, 1), (5, "p", None, 2)], "file_id long, process_id string, sha256 string, uploaded_at long")
    assert {r.file_id: (r.sha256, r.note) for r in registry.mark_duplicates(files).collect()} == {1: (None, "duplicate content"), 2: ("x", None), 3: ("x", None), 4: (None, None), 5: (None, None)}


@pytest.mark.parametrize("http, attempt, want", [(200, 1, "SYNCED"), (204, 4, "SYNCED"), (500, 3, "PENDING_SYNC"), (503, 4, "SYNC_FAILED"), (408, 1, "PENDING_SYNC"), (None, 2, "PENDING_SYNC"), (None, 4, "SYNC_FAILED"), (404, 1, "SYNC_FAILED")])
def test_sync_outcome(spark, http, attempt, want):
    assert one(spark, L.sync_outcome(F.lit(http).cast("int"), F.lit(attempt))) == want


@pytest.mark.parametrize("quality, error, want", [("OK", None, "DONE"), ("LOW_QUALITY", "", "DONE"), ("FAILED", None, "FAILED"), ("ABSTAIN", None, "FAILED"), ("OK", "boom", "FAILED")])
def test_job_status(spark, quality, error, want):
    assert one(spark, L.job_status(F.lit(quality), F.lit(error).cast("string"))) == want


@pytest.mark.parametrize(
    "kind, expected, actual, allowed, want",
    [("presence", "a", None, None, "CANDIDATE"), ("presence", "a", "b", None, "NEGATIVE_VERIFIED"), ("presence", " ", None, None, "NOT_COMPARABLE"), ("set_difference", "a", "", None, "CANDIDATE"), ("tolerance", "10", "10.4", 0.5, "NEGATIVE_VERIFIED"), ("tolerance", "10", "10.6", 0.5, "CANDIDATE"), ("tolerance", "10", "x", 0.5, "NOT_COMPARABLE"), ("tolerance", "10", "11", None, "NOT_COMPARABLE"), ("other", "1", "1", None, "NOT_COMPARABLE")],
)
def test_extended_status(spark, kind, expected, actual, allowed, want):
    value = lambda x, t="string": F.lit(x).cast(t)
    assert one(spark, rules.extended_status(F.lit(kind), value(expected), value(actual), value(allowed, "double"))) == want


@pytest.mark.parametrize("text, want", [('```json\n[{"a": 1}]\n```', '[{"a": 1}]'), ("```\n[]\n```", "[]"), (" [1] ", "[1]"), ("Here:\n```json\n[2]\n``` ok", "[2]"), ("``` ```", "``` ```")])
def test_strip_fences(spark, text, want):
    assert one(spark, S.strip_fences(F.lit(text))) == want


def test_evidence_of_wanted_groups(spark):
    fragments = spark.createDataFrame([("g1", "actual", "f1"), ("g1", "expected", "f2"), ("g2", "actual", "gone")], "group_id string, role string, file_id string").select("*", F.lit("RD").alias("stage"), F.lit(1).alias("page"), F.lit("q").alias("quote"), F.lit("v").alias("extracted_value"))
    files = spark.createDataFrame([("f1", "a.pdf"), ("f2", "b.pdf")], "file_id string, file_name string")
    wanted = spark.createDataFrame([("g1",), ("g1",), ("g9",)], "group_id string")
    got = {r.group_id: [(e.role, e.file_name) for e in r.evidence] for r in O.evidence_by_group(fragments, files, wanted).collect()}
    assert got == {"g1": [("expected", "b.pdf"), ("actual", "a.pdf")]}
    assert {r.group_id: r.evidence[0].file_name for r in O.evidence_by_group(fragments, files).collect()}["g2"] == ""


def test_strict_decoding(spark):
    ident = "00000000-0000-4000-8000-000000000001"
    sound = f'{{"event_id":"{ident}","event_type":"doc.extract.completed","schema_version":1,"occurred_at":"2026-01-01T00:00:00Z","object_id":"{ident}","process_id":"{ident}","data":{{"job_id":"{ident}","facts_key":"k","suspicions_key":null}}}}'
    rows = [sound, sound.replace('"facts_key":"k"', '"facts_key":5'), sound.replace('"data"', '"more":1,"data"'), sound.replace("doc.extract.completed", "doc.other"), "{", "[1]", sound.replace('"event_type":"doc.extract.completed",', "")]
    got = [r.invalid for r in E.decode(spark.createDataFrame([(r,) for r in rows], "value string"), strict=True).collect()]
    assert got == [None, "data/facts_key: type", "<root>: additionalProperties", "foreign", "<root>: required event_type"]


def test_recompute_broadcasts_rules_alone(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from tallyline.operators import recompute
    from tallyline.plans.catalogue import rules

    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), write(self, *a, **k))[1])
    rows = [("p", "M-001", str(i), stage, 1, str(i), "f", f"{i}{stage}", [0.0], "q", 1) for i in range(20) for stage in ("PD", "RD")]
    facts = spark.createDataFrame(rows, "process_id string, param_code string, element_key string, stage string, page int, value string, file_id string, fact_id string, bbox array<double>, quote string, seq int")
    store = recompute.FindingVersions(spark, str(tmp_path / "v"))
    store.recompute(facts, rules(spark), 1)
    store.recompute(facts.where("element_key <> '3'"), rules(spark), 2)
    assert store.current().count() == 19
    assert [plan.count("BroadcastHashJoin") for plan in plans] == [1, 1]


def test_fan_in_over_batches_keeps_no_jobs_of_whole_processes():
    import pandas as pd

    from tallyline.streaming.events import FanIn

    class Value:
        def __init__(self):
            self.v = None

        def get(self):
            return self.v

        def exists(self):
            return self.v is not None

        def update(self, v):
            self.v = v

    class Map(dict):
        calls = 0

        def getValue(self, k):
            self.calls += 1
            return self.get(k)

        def containsKey(self, k):
            self.calls += 1
            return k in self

        def updateValue(self, k, v):
            self.calls += 1
            self[k] = v

    def fan(batches, held=FanIn.HELD):
        f = FanIn()
        f.HELD, f.jobs, f.counts, f.reported = held, Map(), Value(), Value()
        frames = [pd.DataFrame(b, columns=["job_id", "status"]) for b in batches]
        return [[int(r["n_jobs"].iloc[0]) for r in f.handleInputRows((1,), iter([frame]), None)] for frame in frames], f.jobs

    said, jobs = fan([[("a", "REQUESTED"), ("b", "REQUESTED"), ("a", "DONE"), ("b", "FAILED"), ("a", "REQUESTED")], [("a", "DONE"), ("c", "REQUESTED")]])
    assert said == [[2], []] and jobs.calls == 0
    for held in (1, 2, 100):
        said, jobs = fan([[("a", "REQUESTED"), ("b", "REQUESTED"), ("a", "DONE")], [("a", "REQUESTED"), ("b", "REQUESTED")], [("b", "DONE"), ("b", "DONE")], [("b", "FAILED")]], held)
        assert said == [[], [], [2], []] and not jobs
