"""What an evaluation leaves behind, and the joins that show it.

Groups of facts become evidence groups, up to two fragments each, a check with
its rationale and a finding. Ids are name-based, so a repeated run writes the
same rows. All joins are equi-joins on a group's, check's or file's id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import scalars as S
from tallyline.operators import rules as R

GROUP = ("process_id", "param_code", "element_key")
_FACT = ("fact_id", "file_id", "stage", "page", "bbox", "quote", "value")


@dataclass
class Outputs:
    groups: DataFrame
    fragments: DataFrame
    checks: DataFrame
    findings: DataFrame


def evaluate_outputs(facts: DataFrame, rules: DataFrame) -> Outputs:
    """Outputs of sound ``facts`` (process_id, param_code, element_key, fact_id, file_id, stage, page, bbox, quote, value, seq).

    The first PD fact of a group in the order of ``seq`` is expected, the first
    RD or ID fact actual; a group without one has no fragment of that role. The
    box of a fragment is null where it is all zero. Null keys count as empty.
    """
    plain = facts.select(*(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in GROUP), "seq", F.struct(*_FACT).alias("fact"))
    first = lambda cond: F.min(F.when(cond, F.struct("seq", "fact")))["fact"]
    met = plain.groupBy(*GROUP).agg(
        first(F.col("fact.stage") == "PD").alias("e"),
        first(F.col("fact.stage").isin("RD", "ID")).alias("a"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("fact.fact_id").cast("string"))), ""), 256).alias("input_hash"),
    )
    met = met.withColumn("group_id", S.uuid5(F.concat_ws("|", F.lit("group"), *GROUP, "input_hash")))
    found = R.evaluate(met.withColumns({"expected": F.col("e.value"), "actual": F.col("a.value")}), rules)
    found = found.withColumn("check_id", S.uuid5(F.concat_ws("|", F.lit("check"), "group_id")))
    sides = F.array(*(F.struct(F.lit(role).alias("role"), F.col(side).alias("fact")) for role, side in (("expected", "e"), ("actual", "a"))))
    fragments = met.select("group_id", F.explode(F.filter(sides, lambda s: s["fact"].isNotNull())).alias("s"))
    box = F.col("s.fact.bbox")
    return Outputs(
        groups=met.select("group_id", *GROUP, "input_hash"),
        fragments=fragments.select("group_id", "s.role", "s.fact.file_id", "s.fact.stage", "s.fact.page", F.when(F.exists(box, lambda v: v != 0), box).alias("bbox"), "s.fact.quote", F.col("s.fact.value").alias("extracted_value")),
        checks=found.select("check_id", "process_id", "group_id", "expected_value", "actual_value", "delta", "finding_status", "rationale"),
        findings=found.select(S.uuid5(F.concat_ws("|", F.lit("finding"), "check_id")).alias("id"), "check_id", "finding_status", F.lit("PENDING").alias("inspector_status"), F.lit(1).alias("version")),
    )


def process_of_checks(checks: DataFrame, processes: DataFrame) -> DataFrame:
    """(check_id, process_id, process_status): inner, so a check without its process is left out."""
    return checks.select("check_id", "process_id").join(processes.select("process_id", F.col("status").alias("process_status")), "process_id").select("check_id", "process_id", "process_status")


def pending_candidates(findings: DataFrame, checks: DataFrame) -> DataFrame:
    """(process_id, n): candidates that nobody has decided."""
    open_ = findings.where("finding_status = 'CANDIDATE' and inspector_status = 'PENDING'").select("check_id")
    return open_.join(checks.select("check_id", "process_id"), "check_id").groupBy("process_id").agg(F.count(F.lit(1)).alias("n"))


def detailed_findings(findings: DataFrame, checks: DataFrame, groups: DataFrame, params: DataFrame) -> DataFrame:
    """Findings with their check, and where there are any their group and parameter: none is lost without them."""
    compared = checks.select("check_id", "process_id", "group_id", "expected_value", "actual_value", "delta", "rationale")
    met = findings.join(compared, "check_id").join(groups.select("group_id", "param_code"), "group_id", "left")
    return met.join(params.select("param_code", "parameter_name", "unit", "review_priority"), "param_code", "left")


def evidence_by_group(fragments: DataFrame, files: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(group_id, evidence) of the groups ``wanted`` (group_id), all without it: fragments with their file's name, expected side first.

    A fragment whose file is gone keeps an empty name. A group has two fragments
    at most, so its array is bounded.
    """
    some = fragments if wanted is None else fragments.join(wanted.select("group_id").distinct(), "group_id", "left_semi")
    named = some.join(files.select("file_id", F.col("file_name").alias("_name")), "file_id", "left")
    order = F.when(F.col("role") == "expected", 0).otherwise(1).alias("n")
    part = F.struct(order, "role", "file_id", F.coalesce("_name", F.lit("")).alias("file_name"), "stage", "page", "quote", "extracted_value")
    return named.groupBy("group_id").agg(F.array_sort(F.collect_list(part)).alias("evidence"))


def layouts_of_files(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Current accepted ``files`` with the layout keys of their DONE ``jobs`` in page order, those without a range first.

    The status is part of the join's condition, not a filter after it: a file
    without a finished job stays, with an empty array.
    """
    current = files.where("check_status = 'ACCEPTED' and is_current").select("process_id", "file_id", F.coalesce("doc_stage", F.lit("")).alias("doc_stage"), F.coalesce("discipline", F.lit("")).alias("discipline"), "uploaded_at")
    done = jobs.where("status = 'DONE' and layout_key is not null").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("page_from", F.lit(-1)).alias("page_from"), "layout_key"))).alias("k"))
    keys = F.coalesce(F.transform("k", lambda x: x["layout_key"]), F.array().cast("array<string>"))
    return current.join(done, "file_id", "left").select("process_id", "file_id", "doc_stage", "discipline", "uploaded_at", keys.alias("layout_keys"))


def can_start(processes: DataFrame, files: DataFrame) -> DataFrame:
    """(process_id, status, refused): PENDING processes with a current accepted file go to PARSING; others stay, with the reason."""
    ready = files.where("check_status = 'ACCEPTED' and is_current").select("process_id").distinct().withColumn("_ready", F.lit(True))
    met = processes.join(ready, "process_id", "left")
    refused = F.when(F.col("status") != "PENDING", "NOT_PENDING").when(F.col("_ready").isNull(), "NO_CURRENT_FILES")
    return met.select("process_id", F.when(refused.isNull(), "PARSING").otherwise(F.col("status")).alias("status"), refused.alias("refused"))


def unfinalize(processes: DataFrame, reason: Column) -> DataFrame:
    """FINALIZED processes go back to COMPLETED if a reason is given."""
    back = (F.col("status") == "FINALIZED") & ~S.blank(reason)
    return processes.withColumn("status", F.when(back, "COMPLETED").otherwise(F.col("status")))


def registry_missing(files: DataFrame, registry_rows: Column) -> DataFrame:
    """``files`` with registry_missing: all of an empty registry, else those accepted without a row (matched) of their own."""
    return files.withColumn("registry_missing", F.when(registry_rows == 0, F.lit(True)).otherwise((F.col("check_status") == "ACCEPTED") & ~F.coalesce("matched", F.lit(False))))
