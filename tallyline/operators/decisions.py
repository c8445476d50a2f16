"""Decisions as a log of commands: each is accepted or refused by the state that the ones before it left."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.operators.folds import ordered_fold
from tallyline.operators.lifecycle import invalid_decision

#: Statuses of a process in which its findings can be decided.
DECIDABLE = ("READY", "VERIFYING", "COMPLETED")
ACTIONS = ("decide", "finalize", "unfinalize")


@dataclass
class _Process:
    status: str = "READY"
    pending: int = 0
    sync: str = "NOT_REQUIRED"
    findings: dict = field(default_factory=dict)  # id to [is a candidate, inspector status, version]


def _refusal(p: _Process, row: dict) -> str | None:
    """Why a command can't be carried out in the state ``p``."""
    if row["invalid"]:
        return row["invalid"]
    if row["action"] == "finalize":
        if p.status != "COMPLETED":
            return f"process is {p.status}"
        return "candidates are pending" if p.pending else None
    if row["action"] == "unfinalize":
        return None if p.status == "FINALIZED" else f"process is {p.status}"
    finding = p.findings.get(row["finding_id"])
    if finding is None:
        return "no such finding"
    if p.status not in DECIDABLE:
        return f"process is {p.status}"
    if row["expected_version"] is not None and row["expected_version"] != finding[2]:
        return f"version is {finding[2]}"
    return None


def _carry_out(p: _Process, row: dict) -> Iterator[dict]:
    if row["action"] == "open":
        p.status = row["process_status"] or p.status
        if row["finding_id"] is not None:
            candidate, status = row["finding_status"] == "CANDIDATE", row["decision"] or "PENDING"
            p.findings[row["finding_id"]] = [candidate, status, row["expected_version"] or 1]
            p.pending += candidate and status == "PENDING"
        return
    was, finding = p.status, p.findings.get(row["finding_id"])
    before = (finding[1], finding[2]) if finding and row["action"] == "decide" else (None, None)
    after, refused = before, _refusal(p, row)
    if refused is None and row["action"] == "decide":
        p.pending -= finding[0] and finding[1] == "PENDING"
        finding[1:] = row["decision"], finding[2] + 1
        after = finding[1], finding[2]
        p.status = "VERIFYING" if p.status == "READY" else p.status
        p.status = "COMPLETED" if p.status == "VERIFYING" and not p.pending else p.status
    elif refused is None:
        p.status = "FINALIZED" if row["action"] == "finalize" else "COMPLETED"
        p.sync = "PENDING_SYNC" if row["action"] == "finalize" else p.sync
    yield {
        "process_id": row["process_id"], "seq": row["seq"], "action": row["action"], "finding_id": row["finding_id"], "actor": row["actor"],
        "decision": row["decision"], "reason_code": row["reason_code"], "comment": row["comment"], "accepted": refused is None, "refused": refused,
        "status_before": before[0], "version_before": before[1], "status_after": after[0], "version_after": after[1],
        "process_before": was, "process_after": p.status, "sync_status": p.sync,
    }


def decision_log(findings: DataFrame, commands: DataFrame, processes: DataFrame | None = None) -> DataFrame:
    """Every command with whether it was accepted, else why not, and the states before and after it.

    ``findings`` are (finding_id, process_id, finding_status) and may have
    inspector_status and version; ``processes`` (process_id, status) begin as
    READY where they aren't given. ``commands`` are (process_id, seq, action,
    finding_id, decision, reason_code, comment, expected_version, actor) in the
    order of ``seq`` within a process, which should be unique there: those that
    share one go by what they say, nulls first, so that the log is the same
    however the rows lie.

    A decision is refused if it lacks what it needs, if its finding isn't the
    process's, if the process isn't READY, VERIFYING or COMPLETED, or if
    ``expected_version`` is given and another one stands (it was made on an old
    state). The first decision makes a process VERIFYING, the last of its
    candidates COMPLETED. ``finalize`` needs COMPLETED and no pending candidate
    and asks for a sync; ``unfinalize`` needs a comment and goes back.
    """
    kinds = {f.name: f.dataType for f in commands.schema}
    none = lambda c, kind=None: F.lit(None).cast(kind or kinds[c]).alias(c)
    has = lambda df, c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind)
    empty = F.trim(F.coalesce("comment", F.lit(""))) == ""
    invalid = F.when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "unknown action").when(F.col("action") == "decide", F.coalesce(invalid_decision(F.col("decision"), F.col("comment"), F.col("reason_code")), F.when(F.col("decision").isNull(), "bad status"))).when((F.col("action") == "unfinalize") & empty, "needs a reason")
    asked = commands.select("process_id", F.lit(1).alias("later"), "seq", "action", "finding_id", "decision", "reason_code", "comment", F.col("expected_version").cast("long"), "actor", invalid.alias("invalid"), F.lit(None).cast("string").alias("finding_status"), F.lit(None).cast("string").alias("process_status"))
    opened = findings.select(
        F.col("process_id").cast(kinds["process_id"]), F.lit(0).alias("later"), none("seq"), F.lit("open").alias("action"), F.col("finding_id").cast(kinds["finding_id"]), has(findings, "inspector_status", "string").alias("decision"),
        none("reason_code", "string"), none("comment", "string"), has(findings, "version", "long").alias("expected_version"), none("actor"), none("invalid", "string"), "finding_status", none("process_status", "string"),
    )
    rows = opened.union(asked)
    if processes is not None:
        rows = rows.union(processes.select(F.col("process_id").cast(kinds["process_id"]), F.lit(0), none("seq"), F.lit("open"), none("finding_id"), none("decision", "string"), none("reason_code", "string"), none("comment", "string"), F.lit(None).cast("long"), none("actor"), none("invalid", "string"), none("finding_status", "string"), F.col("status")))
    sql = lambda c: kinds[c].simpleString()
    schema = f"process_id {sql('process_id')}, seq {sql('seq')}, action string, finding_id {sql('finding_id')}, actor {sql('actor')}, decision string, reason_code string, comment string, accepted boolean, refused string, status_before string, version_before long, status_after string, version_after long, process_before string, process_after string, sync_status string"
    said = ["finding_id", "action", "decision", "reason_code", "comment", "expected_version", "actor"]
    return ordered_fold(rows.where("process_id is not null"), "process_id", [F.col(c) for c in ("later", "seq", *said)], lambda _: _Process(), _carry_out, schema)


def audit_of(log: DataFrame) -> DataFrame:
    """An audit entry of each accepted command, with the states before and after as JSON."""
    decided = F.col("action") == "decide"
    state = lambda status, version: F.when(decided, F.to_json(F.struct(F.col(status).alias("inspector_status"), F.col(version).alias("version"))))
    details = F.when(decided, F.to_json(F.struct("reason_code", "comment"), {"ignoreNullFields": "false"})).when(F.col("action") == "unfinalize", F.to_json(F.struct(F.col("comment").alias("reason"))))
    return log.where("accepted").select(
        "process_id", "seq", F.col("actor").alias("user_id"),
        F.concat(F.when(decided, "finding.").otherwise("process."), "action").alias("action"),
        F.when(decided, "finding").otherwise("process").alias("object_type"),
        F.when(decided, F.col("finding_id").cast("string")).otherwise(F.col("process_id").cast("string")).alias("object_id"),
        state("status_before", "version_before").alias("before"), state("status_after", "version_after").alias("after"), details.alias("details"),
    )


def current_findings(findings: DataFrame, log: DataFrame) -> DataFrame:
    """``findings`` as the accepted decisions leave them."""
    last = log.where("accepted and action = 'decide'").groupBy("finding_id").agg(F.max_by(F.struct("decision", "reason_code", "comment", "actor", "version_after"), "seq").alias("d"))
    met = findings.join(last.hint("merge"), "finding_id", "left")  # decisions grow with the findings: never broadcast
    was = lambda c, kind, other: F.coalesce(F.col(c).cast(kind), F.lit(other)) if c in findings.columns else F.lit(other)
    plain = [c for c in findings.columns if c not in ("inspector_status", "version", "reason_code", "comment", "decided_by")]
    return met.select(*plain, F.coalesce("d.decision", was("inspector_status", "string", "PENDING")).alias("inspector_status"), F.col("d.reason_code").alias("reason_code"), F.col("d.comment").alias("comment"), F.col("d.actor").alias("decided_by"), F.coalesce("d.version_after", was("version", "long", 1)).alias("version"))


def process_states(log: DataFrame) -> DataFrame:
    """(process_id, status, sync_status) of processes that commands have met."""
    last = F.max_by(F.struct(F.col("process_after").alias("status"), "sync_status"), "seq").alias("p")
    return log.groupBy("process_id").agg(last).select("process_id", "p.*")


def sync_state(log: DataFrame, deliveries: DataFrame, outcome: Column) -> DataFrame:
    """(process_id, sync_status): that of the last delivery attempt since the last accepted ``finalize``, PENDING_SYNC before one.

    ``deliveries`` are (process_id, seq, ...) on the commands' clock; ``outcome``
    is the state that an attempt leaves, from their columns.
    """
    asked = log.where("accepted and action = 'finalize'").groupBy("process_id").agg(F.max("seq").alias("asked"))
    tried = deliveries.select("process_id", "seq", outcome.alias("outcome")).join(asked.hint("merge"), "process_id").where("seq > asked")
    last = tried.groupBy("process_id").agg(F.max_by("outcome", "seq").alias("outcome"))
    return asked.join(last.hint("merge"), "process_id", "left").select("process_id", F.coalesce("outcome", F.lit("PENDING_SYNC")).alias("sync_status"))
