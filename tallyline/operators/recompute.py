"""Incremental recomputation: findings in versions, evaluated again only where their facts have changed.

An extension: it is documented, but there is no implementation to match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import scalars as S
from tallyline.operators.outputs import GROUP, evaluate_outputs

VERSION = "finding_id string, process_id string, param_code string, element_key string, input_hash string, finding_status string, expected_value string, actual_value string, delta string, made_in int, retired_in int, superseded_by string, run int"


def group_hashes(facts: DataFrame) -> DataFrame:
    """(process_id, param_code, element_key, input_hash): what a group's evaluation depends on, without evaluating it."""
    plain = facts.select(*(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in GROUP), F.col("fact_id").cast("string").alias("fact_id"))
    return plain.groupBy(*GROUP).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("fact_id")), ""), 256).alias("input_hash"))


class FindingVersions:
    """Findings under a folder, one Parquet part a run that holds only what the run changed.

    A run that is repeated under its number overwrites its part, so a killed
    run is simply run again. Run numbers must rise.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, run: int | str) -> str:
        return f"{self.folder}/run={run}"

    def _exists(self, path: str) -> bool:
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(sc._jsc.hadoopConfiguration()).exists(where)

    def versions(self, before: int | None = None) -> DataFrame:
        """Each finding's last state, archived ones included; as runs before number ``before`` left them."""
        if not self._exists(self.folder):
            return self.spark.createDataFrame([], VERSION)
        parts = self.spark.read.schema(VERSION).parquet(self.folder)
        if before is not None:
            parts = parts.where(F.col("run") < before)
        last = parts.groupBy("finding_id").agg(F.max_by(F.struct(*[c for c in parts.columns if c != "finding_id"]), "run").alias("v"))
        return last.select("finding_id", "v.*")

    def current(self, before: int | None = None) -> DataFrame:
        """Findings that stand. Give ``before`` where a later run may be written before the frame is used."""
        return self.versions(before).where("retired_in is null")

    def recompute(self, facts: DataFrame, rules: DataFrame, run: int) -> DataFrame:
        """Bring the findings up to date with all sound ``facts`` and return what the run changed.

        A group whose facts are the same keeps its finding, and with the
        finding's id every decision on it. A group with other facts gets a new
        finding; the old one is archived with a link to it. A group without
        facts has its finding archived without a link. Only new and changed
        groups meet the rules. What grows with the facts is shuffled: by the
        size of packed columns Spark would take it for small and broadcast it.
        """
        old = self.current(run)
        now = group_hashes(facts)
        was = old.select(*(F.col(k).alias(f"_{k}") for k in GROUP), F.col("input_hash").alias("old_hash"), F.col("finding_id").alias("old_id"))
        met = now.join(was.hint("merge"), [F.col(k) == F.col(f"_{k}") for k in GROUP], "full_outer")
        met = met.where(~F.col("input_hash").eqNullSafe(F.col("old_hash"))).select(*(F.coalesce(k, f"_{k}").alias(k) for k in GROUP), "input_hash", "old_id")
        new_id = S.uuid5(F.concat_ws("|", F.lit("finding"), *GROUP, "input_hash", F.lit(str(run))))
        changed = met.withColumn("new_id", F.when(F.col("input_hash").isNotNull(), new_id))
        keys = [F.coalesce(facts[k].cast("string"), F.lit("")) == changed[k] for k in GROUP]
        some = facts.join(changed.where("new_id is not null").select(*GROUP).hint("merge"), keys, "left_semi")
        checks = evaluate_outputs(some, rules)
        found = checks.groups.join(checks.checks.drop("process_id").hint("merge"), "group_id")
        none = lambda kind: F.lit(None).cast(kind)
        made = found.join(changed.select(*GROUP, "new_id").hint("merge"), list(GROUP)).select(
            F.col("new_id").alias("finding_id"), *GROUP, "input_hash", "finding_status", "expected_value", "actual_value", "delta",
            F.lit(run).alias("made_in"), none("int").alias("retired_in"), none("string").alias("superseded_by"),
        )
        gone = old.join(changed.where("old_id is not null").select(F.col("old_id").alias("finding_id"), "new_id").hint("merge"), "finding_id")
        gone = gone.select(*[c for c in made.columns if c not in ("retired_in", "superseded_by")], F.lit(run).alias("retired_in"), F.col("new_id").alias("superseded_by"))
        made.unionByName(gone).write.mode("overwrite").parquet(self._path(run))
        return self.spark.read.parquet(self._path(run))


def affected_params(sources: DataFrame, loaded: DataFrame) -> DataFrame:
    """(process_id, param_code): parameters with a source among the newly loaded (process_id, doc_stage, discipline).

    ``sources`` are (param_code, doc_stage, discipline); a null discipline
    stands for all. This is the list that an extraction is asked for.
    """
    new = loaded.select("process_id", F.col("doc_stage").alias("_stage"), F.col("discipline").alias("_discipline")).distinct()
    fits: Column = (F.col("doc_stage") == F.col("_stage")) & (F.col("discipline").isNull() | (F.col("discipline") == F.col("_discipline")))
    return new.join(sources, fits).select("process_id", "param_code").distinct()
