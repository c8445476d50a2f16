"""Findings recomputed after facts have come, changed and gone, with decisions in between."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.operators import decisions as D
from tallyline.operators import recompute as R
from tallyline.plans.catalogue import rules
from tallyline.queries import outputs
from tallyline.queries.streams import _work


def _runs(spark, sf_dir):
    """The versions after two runs, and the log of decisions between them."""
    store = R.FindingVersions(spark, f"{_work(spark)}/findings")
    facts = outputs._facts(spark, sf_dir).withColumn("process_id", F.col("process_id").cast("string"))
    k = F.col("element_key").cast("long")
    store.recompute(facts.where(k % 13 != 0), rules(spark), 1)
    other = (k % 6 == 1) & (F.col("stage") == "RD")
    decided = store.current(2).where(F.col("element_key").cast("long") % 3 == 0).select(
        "process_id", F.col("element_key").cast("long").alias("seq"), F.lit("decide").alias("action"), "finding_id", F.lit("NEGATIVE_VERIFIED").alias("decision"),
        F.when(F.col("element_key").cast("long") % 2 == 0, "OTHER").alias("reason_code"), F.lit("seen").alias("comment"), F.lit(1).alias("expected_version"), F.lit("me").alias("actor"),
    )
    log = D.decision_log(store.current(2), decided)
    later = facts.where(k % 11 != 0).withColumns({"value": F.when(other, F.concat(F.lit("9"), "value")).otherwise(F.col("value")), "fact_id": F.when(other, F.concat("fact_id", F.lit("-b"))).otherwise(F.col("fact_id"))})
    store.recompute(later, rules(spark), 2)
    return store, log


def recompute_versions(spark, sf_dir):
    """Every version of every finding with its decision: kept where the facts are the same, open again where they aren't."""
    store, log = _runs(spark, sf_dir)
    met = D.current_findings(store.versions(), log)
    heir = met.select(F.col("finding_id").alias("_heir"), F.col("element_key").alias("heir"), F.col("made_in").alias("heir_run"))
    sought = F.coalesce("superseded_by", F.concat(F.lit("-"), "finding_id"))  # those without an heir don't meet in one task
    return met.withColumn("_heir", sought).join(heir.hint("merge"), "_heir", "left").select(
        F.col("element_key").cast("long").alias("p_partkey"), "made_in", "retired_in", F.col("heir").cast("long").alias("heir"), "heir_run", "finding_status", "delta", "inspector_status", "version",
    )


def _versions_sql() -> str:
    base = outputs._GROUPS
    moved = base.replace("(p_size + p_partkey % 3 - 1)", "('9' || (p_size + p_partkey % 3 - 1))::bigint")
    return f"""with a as (with {base} select *, case when finding_status = 'CANDIDATE' and rule_type like 'numeric%' then (actual - expected)::bigint::varchar end as delta from s),
b as (with {moved} select *, case when finding_status = 'CANDIDATE' and rule_type like 'numeric%' then (actual - expected)::bigint::varchar end as delta from s),
c as (select p_partkey as pk, p_partkey % 6 = 1 and p_partkey % 4 <> 0 as other, p_partkey % 13 = 0 as late, p_partkey % 11 = 0 as gone from part where p_partkey % 20 <> 0)
select pk as p_partkey, 1 as made_in, case when gone or other then 2 end::int as retired_in, case when other and not gone then pk end as heir, case when other and not gone then 2 end::int as heir_run, a.finding_status, a.delta,
  case when pk % 6 = 0 then 'NEGATIVE_VERIFIED' else 'PENDING' end as inspector_status, case when pk % 6 = 0 then 2 else 1 end::bigint as version from c join a on a.p_partkey = pk where not late
union all select pk, 2, null, null, null, case when other then b.finding_status else a.finding_status end, case when other then b.delta else a.delta end, 'PENDING', 1
  from c join a on a.p_partkey = pk join b on b.p_partkey = pk where not gone and (late or other)"""


def recompute_equals_full(spark, sf_dir):
    """Findings after two runs beside those of one full run on the same facts: the groups that differ, counted by status."""
    store, _ = _runs(spark, sf_dir)
    facts = outputs._facts(spark, sf_dir).withColumn("process_id", F.col("process_id").cast("string"))
    k = F.col("element_key").cast("long")
    other = (k % 6 == 1) & (F.col("stage") == "RD")
    later = facts.where(k % 11 != 0).withColumns({"value": F.when(other, F.concat(F.lit("9"), "value")).otherwise(F.col("value")), "fact_id": F.when(other, F.concat("fact_id", F.lit("-b"))).otherwise(F.col("fact_id"))})
    whole = R.FindingVersions(spark, f"{_work(spark)}/findings")
    whole.recompute(later, rules(spark), 1)
    keys = ["process_id", "param_code", "element_key", "input_hash", "finding_status", "expected_value", "actual_value", "delta"]
    both = store.current().select(*keys, F.lit(1).alias("side")).union(whole.current().select(*keys, F.lit(-1)))
    sides = both.groupBy(*keys).agg(F.sum("side").alias("off"), F.count(F.lit(1)).alias("n"))
    return sides.groupBy("finding_status").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.abs("off")).cast("long").alias("off"))


def _full_sql() -> str:
    return f"""with v as ({_versions_sql()}) select finding_status, count(*) as groups, 0::bigint as off from v where retired_in is null group by 1"""


QUERIES = {"recompute_versions": (recompute_versions, _versions_sql()), "recompute_equals_full": (recompute_equals_full, _full_sql())}
