"""Facts: validation, comparable values, best fact, pivot by stage, group hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions import scalars as S

STAGES = ("PD", "RD", "ID")


def reject_reason(quote: Column, stage: Column, param_code: Column, page: Column, bbox: Column) -> Column:
    """Why a fact is refused, by the first check that fails; null if it is sound. An all-zero box means no geometry."""
    box = F.coalesce(bbox, F.array(*[F.lit(0.0)] * 4))
    placed = F.exists(box, lambda v: v != 0)
    return (
        F.when(S.blank(quote), "empty_quote")
        .when(~F.coalesce(stage, F.lit("")).isin(*STAGES), "bad_stage")
        .when(F.coalesce(param_code, F.lit("")) == "", "empty_param_code")
        .when(page < 0, "bad_page")
        .when(placed & (F.exists(box, lambda v: (v < 0) | (v > 1)) | (box[0] >= box[2]) | (box[1] >= box[3])), "bad_bbox")
    )


def comparable(value_norm: Column, value_raw: Column) -> Column:
    """The number or non-empty string of ``value_norm.value`` in JSON, else the raw value."""
    kind = F.schema_of_variant(F.try_parse_json(value_norm))
    value = F.try_variant_get(F.try_parse_json(value_norm), "$.value", "string")
    typed = F.schema_of_variant(F.try_variant_get(F.try_parse_json(value_norm), "$.value", "variant"))
    number = typed.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT|INT)")
    exponent = F.when(value.contains("E"), S.fmt_num(value.try_cast("double"))).otherwise(value)
    return F.when(kind.isNull(), value_raw).when(number, exponent).when((typed == "STRING") & (value != ""), value).otherwise(value_raw)


def best_facts(facts: DataFrame, keys=("param_code", "stage", "element_key")) -> DataFrame:
    """One fact a key: the most confident, then the earliest page, then the first."""
    order = Window.partitionBy(*(F.coalesce(F.col(k), F.lit("")) for k in keys)).orderBy(F.desc("confidence"), F.col("page").asc_nulls_last(), "seq")
    return facts.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def pivot_stages(facts: DataFrame, keys=("param_code", "element_key")) -> DataFrame:
    """Per key the first PD value as ``expected`` and the first RD or ID value as ``actual``, in the order of ``seq``.

    Aggregates a minimum, so map-side combining leaves one row a key and
    task before the shuffle, however hot a key is.
    """
    first = lambda cond: F.min(F.when(cond, F.struct("seq", "value")))["value"]
    plain = facts.select(*(F.coalesce(F.col(k), F.lit("")).alias(k) for k in keys), "stage", "value", "seq")
    return plain.groupBy(*keys).agg(first(F.col("stage") == "PD").alias("expected"), first(F.col("stage").isin("RD", "ID")).alias("actual"))


def input_hash(facts: DataFrame, keys=("param_code", "element_key"), id_column: str = "fact_id") -> DataFrame:
    """Per key the SHA-256 of its sorted fact ids, joined by nothing."""
    return facts.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(id_column)), ""), 256).alias("input_hash"))


def fact_id(job: Column, file: Column, code: Column, page: Column, quote: Column) -> Column:
    return S.uuid5(F.concat_ws("|", job, file, code, page.cast("string"), quote))


def changed_groups(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose input hash is new (``added``), other (``changed``) or gone (``removed``)."""
    old, new = before.withColumnRenamed("input_hash", "old_hash"), after.withColumnRenamed("input_hash", "new_hash")
    both = old.join(new, keys, "full_outer")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "changed")
    return both.withColumn("change", change).where("change is not null").select(*keys, "change")
