"""Processes: completeness, scenario, jobs, decisions, finalisation, payload, catalogue merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGES_A_JOB = 20
MAX_FILE, MAX_BATCH = 50 << 20, 200 << 20


def scenario(pd: Column, rd: Column, id_: Column, partial: Column) -> Column:
    return (
        F.when(~(pd | rd | id_), "")
        .when(partial, "PARTIALLY_LOADED")
        .when(pd & rd & id_, "FULL")
        .when(pd & rd, "PD_RD_ONLY")
        .when(pd & id_, "PD_ID_ONLY")
        .when(rd & id_, "RD_ID_ONLY")
        .otherwise("SINGLE_ONLY")
    )


def upload_status(files: DataFrame, unmatched: DataFrame) -> DataFrame:
    """(process_id, doc_stage, upload_status) of the three stages of each process of ``files`` (process_id, doc_stage, is_current, selection_status); ``unmatched`` is (process_id, doc_stage)."""
    stages = files.select("process_id").distinct().select("process_id", F.explode(F.array(*map(F.lit, ("PD", "RD", "ID")))).alias("doc_stage"))
    seen = files.groupBy("process_id", "doc_stage").agg(F.bool_or("is_current").alias("current"), F.bool_or(F.coalesce(F.col("selection_status") == "CLARIFICATION_REQUIRED", F.lit(False))).alias("unclear"))
    rest = unmatched.select("process_id", "doc_stage").distinct().withColumn("unmatched", F.lit(True))
    met = stages.join(seen, ["process_id", "doc_stage"], "left").join(rest, ["process_id", "doc_stage"], "left")
    status = F.when(F.col("current").isNull(), "MISSING").when(F.col("current") & ~F.col("unclear") & F.col("unmatched").isNull(), "UPLOADED").otherwise("PARTIAL")
    return met.select("process_id", "doc_stage", status.alias("upload_status"))


def scenarios(status: DataFrame) -> DataFrame:
    has = lambda s: F.bool_or((F.col("doc_stage") == s) & (F.col("upload_status") != "MISSING"))
    return status.groupBy("process_id").agg(scenario(has("PD"), has("RD"), has("ID"), F.bool_or(F.col("upload_status") == "PARTIAL")).alias("scenario"))


def plan_jobs(files: DataFrame, size: int = PAGES_A_JOB) -> DataFrame:
    """Parse jobs of ``files`` (file_id, page_count): slices of pages, or one job without a range if the pages aren't known."""
    known = F.coalesce(F.col("page_count") > 0, F.lit(False))
    starts = F.when(known, F.sequence(F.lit(1), F.col("page_count").cast("int"), F.lit(size))).otherwise(F.array(F.lit(None).cast("int")))
    each = files.select("file_id", F.col("page_count").cast("int").alias("n"), F.explode(starts).alias("page_from"))
    return each.select("file_id", "page_from", F.least(F.col("page_from") + size - 1, "n").alias("page_to"))


def refused(files: DataFrame) -> DataFrame:
    """``files`` (batch_id, size) with why each is refused: empty or over 50 MiB, or its batch over 200 MiB."""
    total = F.sum("size").over(Window.partitionBy("batch_id"))
    return files.withColumn("refused", F.when((F.col("size") <= 0) | (F.col("size") > MAX_FILE), "REJECTED_SIZE").when(total > MAX_BATCH, "BATCH_SIZE"))


def job_status(quality: Column, error: Column) -> Column:
    return F.when(quality.isin("FAILED", "ABSTAIN") | (F.coalesce(error, F.lit("")) != ""), "FAILED").otherwise("DONE")


def fan_in(jobs: DataFrame, key: str = "process_id") -> DataFrame:
    """(key, n_jobs, n_open, ready): a process is ready when it has jobs and all are terminal."""
    counts = jobs.groupBy(key).agg(F.count(F.lit(1)).alias("n_jobs"), F.count_if(~F.col("status").isin("DONE", "FAILED")).alias("n_open"))
    return counts.withColumn("ready", F.col("n_open") == 0)


def invalid_decision(status: Column, comment: Column, reason: Column) -> Column:
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(~status.isin("CONFIRMED_VIOLATION", "NEGATIVE_VERIFIED", "CLARIFICATION_REQUIRED"), "bad status")
        .when((status == "CONFIRMED_VIOLATION") & empty(comment), "needs a comment")
        .when((status == "NEGATIVE_VERIFIED") & (empty(comment) | empty(reason)), "needs a reason and a comment")
    )


def fold_decisions(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """``findings`` (finding_id, ...) with the latest valid decision's status and the version, one more than the valid decisions."""
    valid = decisions.where(invalid_decision(F.col("status"), F.col("comment"), F.col("reason_code")).isNull())
    last = valid.groupBy("finding_id").agg(F.max_by(F.struct("status", "comment", "reason_code", "decided_at"), "seq").alias("d"), F.count(F.lit(1)).alias("n"))
    met = findings.join(last, "finding_id", "left")
    return met.select(findings["*"], F.coalesce("d.status", F.lit("PENDING")).alias("inspector_status"), F.col("d.comment").alias("comment"), F.col("d.reason_code").alias("reason_code"), F.col("d.decided_at").alias("decided_at"), (F.coalesce("n", F.lit(0)) + 1).alias("version"))


def process_state(findings: DataFrame) -> DataFrame:
    """(process_id, n_pending, n_decided, status): READY without a decision, COMPLETED once no candidate is pending, else VERIFYING."""
    pending = (F.col("finding_status") == "CANDIDATE") & (F.col("inspector_status") == "PENDING")
    counts = findings.groupBy("process_id").agg(F.count_if(pending).alias("n_pending"), F.count_if(F.col("inspector_status") != "PENDING").alias("n_decided"))
    return counts.withColumn("status", F.when(F.col("n_decided") == 0, "READY").when(F.col("n_pending") == 0, "COMPLETED").otherwise("VERIFYING"))


def finalizable(state: DataFrame) -> DataFrame:
    return state.withColumn("can_finalize", (F.col("status") == "COMPLETED") & (F.col("n_pending") == 0))


def confirmed_payload(findings: DataFrame) -> DataFrame:
    """(process_id, n, payload): confirmed findings of a process as JSON, by id."""
    rows = F.array_sort(F.collect_list(F.struct("finding_id", "comment", "decided_at")))
    return findings.where("inspector_status = 'CONFIRMED_VIOLATION'").groupBy("process_id").agg(F.count(F.lit(1)).alias("n"), F.to_json(rows).alias("payload"))


def sync_outcome(http_status: Column, attempt: Column) -> Column:
    """State after a delivery attempt: 5xx, 408 and no answer are retried up to three times, other 4xx fail at once."""
    again = http_status.isNull() | (http_status >= 500) | (http_status == 408)
    return F.when(http_status.between(200, 299), "SYNCED").when(again & (attempt < 4), "PENDING_SYNC").otherwise("SYNC_FAILED")


def merge_catalogue(current: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Upsert by key: rows of ``new`` are active with their values, rows only in ``current`` become inactive."""
    met = current.select(key, *(F.col(c).alias(f"_{c}") for c in columns)).join(new.select(key, *columns, F.lit(True).alias("is_active")), key, "full_outer")
    active = F.coalesce("is_active", F.lit(False))
    return met.select(key, *(F.when(active, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in columns), active.alias("is_active"))


def gold_split(findings: DataFrame, test_percent: int = 20) -> DataFrame:
    """Labelled examples from decisions, split by object: an extension, documented but not implemented to match."""
    label = F.when(F.col("inspector_status") == "CONFIRMED_VIOLATION", 1).when(F.col("inspector_status") == "NEGATIVE_VERIFIED", 0)
    bucket = F.pmod(F.crc32(F.col("object_id").cast("string").cast("binary")), F.lit(100))
    return findings.withColumn("label", label).where("label is not null").withColumn("split", F.when(bucket < test_percent, "test").otherwise("train"))
