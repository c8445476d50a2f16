"""Documented steps around an evaluation that the surveyed code doesn't take: extensions, with nothing to match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRIES = 2

# Tables of the protocol and the statuses that belong to them.
SECTIONS = {
    "completeness": ("MISSING_EVIDENCE", "NOT_APPLICABLE", "NOT_COMPARABLE", "CLARIFICATION_REQUIRED"),
    "candidates": ("CANDIDATE",),
    "confirmed": ("CONFIRMED_VIOLATION",),
    "negatives": ("NEGATIVE_VERIFIED",),
    "suspicions": ("SUSPICION",),
}


def completeness(pairs: DataFrame, sources: DataFrame, stages: DataFrame) -> DataFrame:
    """``pairs`` (process_id, param_code, ...) with completeness_status, null where they may be compared.

    ``sources`` (param_code, doc_stage, required) is the catalogue, ``stages``
    (process_id, doc_stage, upload_status, unclear) has three rows a process, so
    both arrays are bounded. A required stage that isn't loaded makes
    MISSING_EVIDENCE, another one NOT_APPLICABLE, and a stage whose revision is
    unclear CLARIFICATION_REQUIRED.
    """
    needs = sources.groupBy("param_code").agg(F.collect_set(F.struct("doc_stage", "required")).alias("_needs"))
    stage = F.col("doc_stage")
    known = stages.groupBy("process_id").agg(F.collect_set(F.when(F.col("upload_status") != "MISSING", stage)).alias("_loaded"), F.collect_set(F.when(F.col("unclear"), stage)).alias("_unclear"))
    met = pairs.join(needs, "param_code", "left").join(known, "process_id", "left")
    within = lambda n, some: F.array_contains(F.coalesce(some, F.array().cast("array<string>")), n["doc_stage"])
    absent = F.filter("_needs", lambda n: ~within(n, F.col("_loaded")))
    status = (
        F.when(F.exists(absent, lambda n: n["required"]), "MISSING_EVIDENCE")
        .when(F.size(absent) > 0, "NOT_APPLICABLE")
        .when(F.exists("_needs", lambda n: within(n, F.col("_unclear"))), "CLARIFICATION_REQUIRED")
    )
    return met.select(*pairs.columns, status.alias("completeness_status"))


def quality_gate(facts: DataFrame, keys: tuple[str, ...] = ("param_code", "element_key")) -> DataFrame:
    """(keys, usable, change_notice): a group is usable if any of its facts is of quality OK; a notice on any fact stays on the card."""
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return facts.groupBy(*keys).agg(flag(F.col("quality") == "OK").alias("usable"), flag(F.col("has_change_notice")).alias("change_notice"))


def gated(findings: DataFrame, gate: DataFrame, keys: tuple[str, ...] = ("param_code", "element_key")) -> DataFrame:
    """``findings`` in which groups without a usable fact are NOT_COMPARABLE and candidates carry their change notice."""
    met = findings.join(gate, list(keys), "left")
    status = F.when(F.coalesce("usable", F.lit(False)), F.col("finding_status")).otherwise("NOT_COMPARABLE")
    notice = F.coalesce("change_notice", F.lit(False)) & (status == "CANDIDATE")
    return met.withColumns({"change_notice": notice, "finding_status": status}).drop("usable")


def section(finding_status: Column, inspector_status: Column) -> Column:
    """The protocol's table of a finding: an inspector's decision counts before the finding's own status."""
    decided = F.coalesce(F.nullif(inspector_status, F.lit("PENDING")), finding_status)
    return F.coalesce(*(F.when(decided.isin(*statuses), name) for name, statuses in SECTIONS.items()))


def with_suspicions(findings: DataFrame, suspicions: DataFrame) -> DataFrame:
    """Findings and suspicions as one list; columns that one side lacks are null."""
    return findings.unionByName(suspicions.withColumn("finding_status", F.lit("SUSPICION")), allowMissingColumns=True)


def split_finding(findings: DataFrame, parts: DataFrame) -> DataFrame:
    """A new pending candidate for each of ``parts`` (parent_finding_id, comment) of a finding; parts of unknown findings are left out."""
    from tallyline.functions.scalars import uuid5

    parent = findings.select(F.col("id").alias("parent_finding_id"), "check_id", "process_id")
    return parts.join(parent, "parent_finding_id").select(
        uuid5(F.concat_ws("|", F.lit("part"), "parent_finding_id", "comment")).alias("id"), "parent_finding_id", "check_id", "process_id", "comment",
        F.lit("CANDIDATE").alias("finding_status"), F.lit("PENDING").alias("inspector_status"), F.lit(1).alias("version"),
    )


def overdue(jobs: DataFrame, now: Column, seconds: int, retries: int = RETRIES) -> DataFrame:
    """RUNNING ``jobs`` (status, attempts, started_at, ...) beyond the time limit start again, after ``retries`` of that they fail."""
    late = F.coalesce((F.col("status") == "RUNNING") & (F.unix_timestamp(now) - F.unix_timestamp("started_at") > seconds), F.lit(False))
    again = late & (F.coalesce("attempts", F.lit(0)) < retries)
    return jobs.withColumns({
        "status": F.when(again, "PENDING").when(late, "FAILED").otherwise(F.col("status")),
        "attempts": F.when(again, F.coalesce("attempts", F.lit(0)) + 1).otherwise(F.col("attempts")),
        "last_error": F.when(late & ~again, "timeout"),
    })
