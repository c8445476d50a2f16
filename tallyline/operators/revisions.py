"""Current revision of each document group by its predecessor and successor references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = ("process_id", "object_id", "doc_stage", "discipline", "document_code")
APPROVABLE = ("APPROVED", "FOR_CONSTRUCTION")


def successor_cycles(edges: DataFrame) -> DataFrame:
    """Nodes (id) that lie on a cycle of (id, next), at most one ``next`` an id.

    Pointer doubling: after k joins each node points 2**k steps ahead, if its
    walk is that long. Once neither the nodes with a pointer nor the nodes
    pointed at get fewer, the step maps the latter onto themselves, so they are
    those on cycles. That takes a logarithmic number of joins in the longest walk.
    """
    spark, work = edges.sparkSession, []
    jump, now = _cut(spark, edges.where("id is not null and next is not null").groupBy("id").agg(F.min("next").alias("next")), work)
    before = None
    while now[0] and now != before:
        before = now
        far = jump.select(F.col("id").alias("next"), F.col("next").alias("after"))
        jump, now = _cut(spark, jump.join(far, "next").select("id", F.col("after").alias("next")), work)
    return jump.select(F.col("next").alias("id")).distinct()


def _cut(spark, df: DataFrame, work: list) -> tuple[DataFrame, tuple[int, int]]:
    """(frame, (nodes, nodes pointed at)), its lineage cut through the checkpoint folder if the session has one, else kept until the next one is."""
    df = df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.persist()
    sizes = df.agg(F.count(F.lit(1)), F.count_distinct("next")).first()
    while work:
        work.pop().unpersist()
    if not spark.sparkContext.getCheckpointDir():
        work.append(df)
    return df, tuple(sizes)


def select_current(files: DataFrame) -> DataFrame:
    """``files`` (file_id, group columns, approval_status, predecessor_id, successor_id) with is_current, selection_status and selection_reason.

    A reference out of the group is DANGLING_REFERENCE, then a cycle of
    successors CYCLE; else the one approvable file that no approvable file names
    as predecessor is current, none gives NO_CANDIDATE and several
    MULTIPLE_CANDIDATES. Null group columns, and absent ones, count as empty.
    """
    keys = [(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in files.columns else F.lit("")).alias(c) for c in GROUP]
    plain = files.select("file_id", *keys, "approval_status", "predecessor_id", "successor_id")
    ids = plain.select(*GROUP, F.col("file_id").alias("ref"))
    refs = plain.select(*GROUP, F.explode(F.array("predecessor_id", "successor_id")).alias("ref")).where("ref is not null")
    dangling = refs.join(ids, [*GROUP, "ref"], "left_anti").select(*GROUP).distinct().withColumn("dangling", F.lit(True))
    inside = plain.select("file_id", "successor_id", *GROUP).join(ids.withColumnRenamed("ref", "successor_id"), [*GROUP, "successor_id"], "left_semi")
    looped = successor_cycles(inside.select(F.col("file_id").alias("id"), F.col("successor_id").alias("next")))
    cyclic = plain.join(looped.withColumnRenamed("id", "file_id"), "file_id", "left_semi").select(*GROUP).distinct().withColumn("cyclic", F.lit(True))
    good = F.col("approval_status").isin(*APPROVABLE)
    replaced = plain.where(good & F.col("predecessor_id").isNotNull()).select(*GROUP, F.col("predecessor_id").alias("file_id")).distinct().withColumn("replaced", F.lit(True))
    marked = plain.join(replaced, [*GROUP, "file_id"], "left").withColumn("candidate", F.coalesce(good, F.lit(False)) & F.col("replaced").isNull())
    counts = marked.groupBy(*GROUP).agg(F.count_if("candidate").alias("n"))
    groups = counts.join(dangling, list(GROUP), "left").join(cyclic, list(GROUP), "left")
    reason = F.when(F.col("dangling"), "DANGLING_REFERENCE").when(F.col("cyclic"), "CYCLE").when(F.col("n") == 0, "NO_CANDIDATE").when(F.col("n") > 1, "MULTIPLE_CANDIDATES")
    out = marked.join(groups.select(*GROUP, reason.alias("selection_reason")), list(GROUP))
    return out.select(
        "file_id",
        *GROUP,
        (F.col("candidate") & F.col("selection_reason").isNull()).alias("is_current"),
        F.when(F.col("selection_reason").isNotNull(), "CLARIFICATION_REQUIRED").alias("selection_status"),
        "selection_reason",
    )
