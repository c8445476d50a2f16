"""From lines to findings: extract, choose the best facts, pivot by stage, compare, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.operators import extraction, facts, layout, report, rules
from tallyline.operators.lifecycle import PAGES_A_JOB
from tallyline.plans.catalogue import rules as catalogue


def facts_of_lines(lines: DataFrame, files: DataFrame, job: str = "job") -> DataFrame:
    """Facts of ``lines`` (id = file) of the ``files`` (file_id, process_id, stage) that have a stage; boxes default to the whole page.

    The join is left to Spark: files grow with the data. A fact's method is its
    page's where lines have one, ``vector_text`` for pages without OCR.
    """
    staged = files.where(F.col("stage").isin(*facts.STAGES)).select("file_id", "process_id", "stage")
    found = extraction.candidates(lines)
    if "method" in lines.columns:
        found = found.withColumn("method", F.when(F.col("method") == "ocr", "ocr").otherwise("vector_text"))
    else:
        found = found.withColumn("method", F.lit("vector_text"))
    met = found.join(staged, F.col("id") == F.col("file_id"))
    return met.select(
        facts.fact_id(F.lit(job), F.col("file_id"), F.col("param_code"), F.col("page"), F.col("quote")).alias("fact_id"),
        "process_id", "file_id", "stage", "param_code", F.lit("").alias("element_key"), "value_raw", "value_norm", "unit", "page",
        F.coalesce("bbox", F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0)))).alias("bbox"), "quote", "confidence", "method", F.lit("OK").alias("quality"),
        F.struct("page", "line", "param_code").alias("seq"),
    )


def facts_of_pages(pages: DataFrame, files: DataFrame, job: str = "job") -> DataFrame:
    """Facts of ``pages`` (path, page, kind, method, chars, lines, error), as a reader of files gives them, of ``files`` (path, file_id, process_id, stage).

    Slices of 20 pages of the grade ABSTAIN or FAILED give no facts: they have no text.
    """
    known = pages.join(files.select("path", F.col("file_id").alias("id")), "path").withColumn("slice", F.coalesce(F.floor((F.col("page") - 1) / PAGES_A_JOB), F.lit(0)))
    some = known.withColumn("quality", layout.page_quality(("id", "slice"))).where("error is null and quality in ('OK', 'LOW_QUALITY')")
    return facts_of_lines(layout.lines_of_pages(some), files, job)


def protocol_of_files(pages: DataFrame, files: DataFrame, job: str = "job") -> DataFrame:
    """From pages of files to the numbered findings of each process: extraction, best facts, comparison, order."""
    return protocol_of(findings_of_facts(facts_of_pages(pages, files, job)))


def findings_of_facts(found: DataFrame, keys=("process_id", "param_code", "element_key")) -> DataFrame:
    """Findings of valid facts: best fact a stage, first PD against first RD or ID in the order (stage, page)."""
    sound = found.where(facts.reject_reason(F.col("quote"), F.col("stage"), F.col("param_code"), F.col("page"), F.col("bbox")).isNull())
    best = facts.best_facts(sound, (*keys, "stage"))
    ready = best.withColumn("value", F.coalesce(F.nullif("value_norm", F.lit("")), "value_raw")).withColumn("seq", F.struct("stage", "page", "fact_id"))
    pairs = facts.pivot_stages(ready, keys)
    return rules.evaluate(pairs, catalogue(found.sparkSession))


def protocol_of(found: DataFrame) -> DataFrame:
    """Numbered findings of each process."""
    rows = found.withColumn("id", F.concat_ws("|", "param_code", "element_key")).withColumn("review_priority", F.lit(None).cast("string"))
    return report.numbered(rows)
