"""The log of decisions on one process, step by step, and on one with many commands."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallyline.operators import decisions as D
from tallyline.operators import lifecycle as L

COMMAND = "process_id string, seq long, action string, finding_id string, decision string, reason_code string, comment string, expected_version long, actor string"


def command(seq, action, finding=None, decision=None, comment=None, reason=None, version=None, process="p"):
    return (process, seq, action, finding, decision, reason, comment, version, "me")


def test_one_process(spark):
    findings = spark.createDataFrame([("a", "p", "CANDIDATE"), ("b", "p", "CANDIDATE"), ("c", "p", "NEGATIVE_VERIFIED"), ("z", "q", "CANDIDATE")], "finding_id string, process_id string, finding_status string")
    steps = [
        (command(1, "finalize"), "process is READY", "READY"),
        (command(2, "decide", "a", "CONFIRMED_VIOLATION"), "needs a comment", "READY"),
        (command(3, "decide", "z", "CLARIFICATION_REQUIRED"), "no such finding", "READY"),
        (command(4, "decide", "c", "CLARIFICATION_REQUIRED", version=1), None, "VERIFYING"),
        (command(5, "decide", "a", "CONFIRMED_VIOLATION", "x", version=2), "version is 1", "VERIFYING"),
        (command(6, "decide", "a", "CONFIRMED_VIOLATION", "x"), None, "VERIFYING"),
        (command(7, "finalize"), "process is VERIFYING", "VERIFYING"),
        (command(8, "decide", "b", "NEGATIVE_VERIFIED", "y", "OTHER", 1), None, "COMPLETED"),
        (command(9, "decide", "a", "CLARIFICATION_REQUIRED", version=2), None, "COMPLETED"),
        (command(10, "unfinalize", comment="z"), "process is COMPLETED", "COMPLETED"),
        (command(11, "finalize"), None, "FINALIZED"),
        (command(12, "decide", "a", "CONFIRMED_VIOLATION", "x"), "process is FINALIZED", "FINALIZED"),
        (command(13, "finalize"), "process is FINALIZED", "FINALIZED"),
        (command(14, "unfinalize", comment=" "), "needs a reason", "FINALIZED"),
        (command(15, "unfinalize", comment="wrong"), None, "COMPLETED"),
        (command(16, "decide", "a", "CONFIRMED_VIOLATION", "x", version=3), None, "COMPLETED"),
        (command(17, None), "unknown action", "COMPLETED"),
        (command(18, "decide", "a", None), "bad status", "COMPLETED"),
    ]
    commands = spark.createDataFrame([c for c, _, _ in reversed(steps)], COMMAND).union(spark.createDataFrame([command(1, "decide", "z", "CLARIFICATION_REQUIRED", process="q")], COMMAND))
    log = D.decision_log(findings, commands).persist()
    got = {r.seq: r for r in log.where("process_id = 'p'").collect()}
    assert [(got[c[1]].refused, got[c[1]].process_after) for c, _, _ in steps] == [(refused, after) for _, refused, after in steps]
    assert (got[16].version_before, got[16].version_after, got[16].status_before) == (3, 4, "CLARIFICATION_REQUIRED") and got[11].sync_status == "PENDING_SYNC"
    now = {r.finding_id: (r.inspector_status, r.version, r.comment) for r in D.current_findings(findings, log).collect()}
    assert now == {"a": ("CONFIRMED_VIOLATION", 4, "x"), "b": ("NEGATIVE_VERIFIED", 2, "y"), "c": ("CLARIFICATION_REQUIRED", 2, None), "z": ("CLARIFICATION_REQUIRED", 2, None)}
    audit = {r.seq: r for r in D.audit_of(log.where("process_id = 'p'")).collect()}
    assert sorted(audit) == [4, 6, 8, 9, 11, 15, 16] and audit[11].action == "process.finalize" and json.loads(audit[15].details) == {"reason": "wrong"}
    assert json.loads(audit[8].details) == {"reason_code": "OTHER", "comment": "y"} and json.loads(audit[9].before) == {"inspector_status": "CONFIRMED_VIOLATION", "version": 2}
    states = {r.process_id: (r.status, r.sync_status) for r in D.process_states(log).collect()}
    assert states == {"p": ("COMPLETED", "PENDING_SYNC"), "q": ("COMPLETED", "NOT_REQUIRED")}
    tried = spark.createDataFrame([("p", 5, 200, 1), ("p", 12, 503, 1), ("p", 13, 404, 2)], "process_id string, seq long, http int, attempt int")
    outcome = L.sync_outcome(F.col("http"), F.col("attempt"))
    assert D.sync_state(log, tried, outcome).first().sync_status == "SYNC_FAILED"
    assert D.sync_state(log, tried.where("seq < 13"), outcome).first().sync_status == D.sync_state(log, tried.where("seq < 12"), outcome).first().sync_status == "PENDING_SYNC"


def test_process_that_begins_elsewhere(spark):
    findings = spark.createDataFrame([("a", "p", "CANDIDATE", "CONFIRMED_VIOLATION", 4)], "finding_id string, process_id string, finding_status string, inspector_status string, version long")
    processes = spark.createDataFrame([("p", "PARSING")], "process_id string, status string")
    commands = spark.createDataFrame([command(1, "decide", "a", "CLARIFICATION_REQUIRED", version=4)], COMMAND)
    assert D.decision_log(findings, commands, processes).first().refused == "process is PARSING"
    log = D.decision_log(findings, commands)
    assert (log.first().version_after, log.first().process_after) == (5, "COMPLETED")
    assert D.current_findings(findings, log).first().version == 5
    assert D.decision_log(findings.limit(0), commands.limit(0)).count() == 0


def test_many_commands_on_one_process(spark):
    """A process's commands go by in batches; the state of its findings is all that is held."""
    n = 30000
    findings = spark.range(100).select(F.col("id").cast("string").alias("finding_id"), F.lit("p").alias("process_id"), F.lit("CANDIDATE").alias("finding_status"))
    k = F.col("id")
    commands = spark.range(n).select(F.lit("p").alias("process_id"), k.alias("seq"), F.lit("decide").alias("action"), (k % 100).cast("string").alias("finding_id"), F.lit("CLARIFICATION_REQUIRED").alias("decision"), F.lit(None).cast("string").alias("reason_code"), F.lit(None).cast("string").alias("comment"), F.when(k % 2 == 0, F.lit(1)).alias("expected_version"), F.lit("me").alias("actor"))
    log = D.decision_log(findings, commands)
    # odd findings accept all their commands, even ones only the first
    assert {r.accepted: r["count"] for r in log.groupBy("accepted").count().collect()} == {True: n // 2 + 50, False: n // 2 - 50}


def test_commands_that_share_a_seq(spark):
    """The log doesn't depend on how rows lie, as it did where commands of one process share a seq."""
    findings = spark.createDataFrame([("a", "p", "CANDIDATE"), ("b", "p", "NEGATIVE_VERIFIED")], "finding_id string, process_id string, finding_status string")
    commands = [command(1, "decide", "a", "CLARIFICATION_REQUIRED"), command(1, "decide", "b", "CLARIFICATION_REQUIRED"), command(2, "finalize"), command(3, "unfinalize", comment=" "), command(3, "unfinalize", comment="x")]
    logs = [{tuple(r) for r in D.decision_log(findings, spark.createDataFrame(c, COMMAND).coalesce(1)).collect()} for c in (commands, commands[::-1])]
    assert logs[0] == logs[1] and len(logs[0]) == len(commands)
