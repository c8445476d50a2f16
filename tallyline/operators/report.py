"""Protocol: order of findings, evidence, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranks of statuses and priorities.
STATUS_ORDER = ("CANDIDATE", "CONFIRMED_VIOLATION", "MISSING_EVIDENCE", "CLARIFICATION_REQUIRED")
PRIORITY_ORDER = ("HIGH", "MEDIUM")


def _rank(x: Column, order: tuple[str, ...]) -> Column:
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(x == v, i).otherwise(out)
    return out


def status_rank(x: Column) -> Column:
    return _rank(x, STATUS_ORDER)


def priority_rank(x: Column) -> Column:
    return _rank(x, PRIORITY_ORDER)


def report_order() -> list[Column]:
    return [status_rank(F.col("finding_status")), priority_rank(F.col("review_priority")), F.col("param_code").asc_nulls_last(), F.col("id").asc()]


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*report_order())


def numbered(findings: DataFrame, process: str = "process_id") -> DataFrame:
    """Findings with their place in their process's protocol."""
    return findings.withColumn("place", F.row_number().over(Window.partitionBy(process).orderBy(*report_order())))


def protocol(findings: DataFrame, evidence: DataFrame, params: DataFrame) -> DataFrame:
    """Findings (id, process_id, group_id, param_code, ...) with the parameter's name and their evidence, ``actual`` first."""
    parts = evidence.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("role", "page", "quote", "file_id"))).alias("evidence"))
    met = findings.join(F.broadcast(params), "param_code", "left").join(parts, "group_id", "left")
    return numbered(met.withColumn("evidence", F.coalesce("evidence", F.array().cast(parts.schema["evidence"].dataType))))


def newest_first(rows: DataFrame, key: str, created: str = "created_at", row_id: str = "id") -> DataFrame:
    """Rows with their place among those of their key, the newest first; of one moment the higher id."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col(created).desc_nulls_last(), F.col(row_id).desc())))


def listed(rows: DataFrame, key: list[str], order: list, nulls_last: bool = True) -> DataFrame:
    """Rows with their place in the list of their key: files by uploaded_at, parameters by code, upload statuses by doc_stage. Give an order without ties."""
    by = [(F.col(c).asc_nulls_last() if nulls_last else F.col(c).asc()) if isinstance(c, str) else c for c in order]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*by)))


def group_order() -> list[Column]:
    """Evidence groups in the order of their evaluation; null keys count as empty."""
    return [F.coalesce("param_code", F.lit("")), F.coalesce("element_key", F.lit(""))]


def latest(versions: DataFrame, key: str, order: str = "version") -> DataFrame:
    """The row of the highest version of each key."""
    rows = F.struct(*[c for c in versions.columns if c != key])
    return versions.groupBy(key).agg(F.max_by(rows, order).alias("r")).select(key, "r.*")


def manifest_hash(files: DataFrame, key: str = "process_id") -> DataFrame:
    """SHA-256 of the sorted digests of a process's files."""
    return files.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256).alias("manifest_hash"))


def claimable(outbox: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """Outbox rows to publish: pending or failed and due, oldest first."""
    return outbox.where(F.col("status").isin("pending", "failed") & (F.col("available_at") <= now)).orderBy("created_at", "event_id").limit(limit)


def requeue_stuck(outbox: DataFrame, now: Column, seconds: int = 120) -> DataFrame:
    stuck = (F.col("status") == "publishing") & (F.unix_timestamp(now) - F.unix_timestamp("locked_at") > seconds)
    return outbox.withColumn("status", F.when(stuck, "pending").otherwise(F.col("status")))
