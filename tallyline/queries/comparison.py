"""Stage comparison on orders (design) and lineitems (as built)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import scalars as S
from tallyline.operators import rules as R
from tallyline.plans.catalogue import scales

_SUMS = "(select l_orderkey, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as actual from lineitem group by l_orderkey)"
_PAIRS = f"(select o_orderkey, o_totalprice as expected, s.actual from orders o left join {_SUMS} s on o_orderkey = l_orderkey)"
_OFF = "(case when expected = 0 then case when actual = 0 then 0 else 'Infinity'::double end else abs(actual - expected) / abs(expected) * 100 end)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, expected, actual): the order's price and its lines' sum. Lines are summed before the join."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    sums = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum(net), 2).alias("actual"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("expected")).join(sums, "o_orderkey", "left")


def _numeric(kind: str, pct: float = 0.0, tolerance: float = 0.0):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, a = F.col("expected"), F.col("actual")
        status = R.numeric_status(kind, e, a, pct, tolerance)
        out = order_pairs(spark, sf_dir).withColumn("finding_status", status)
        return out.select("o_orderkey", "finding_status", e, a, F.when(F.col("finding_status") == R.CANDIDATE, F.round(a - e, 2)).alias("delta"))

    bad = {"numeric_equal": f"actual <> expected and not ({tolerance} > 0 and {_OFF} <= {tolerance})", "numeric_delta_pct": f"{_OFF} > {pct}", "numeric_decrease": "actual < expected", "numeric_increase": f"actual > expected and ({pct} = 0 or {_OFF} > {pct})"}[kind]
    sql = f"""select o_orderkey, finding_status, expected, actual, case when finding_status = 'CANDIDATE' then round(actual - expected, 2) end as delta
      from (select *, case when actual is null or expected is null then 'MISSING_EVIDENCE' when {bad} then 'CANDIDATE' else 'NEGATIVE_VERIFIED' end as finding_status from {_PAIRS})"""
    return query, sql


def _threshold(kind: str, column: str, limit: float):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        status = R.threshold_status(kind, F.col(column), limit)
        lines = read(spark, sf_dir, "lineitem").select("l_returnflag", status.alias("finding_status"))
        return lines.groupBy("l_returnflag", "finding_status").agg(F.count(F.lit(1)).alias("n"))

    sign = "<" if kind == "threshold_min" else ">"
    return query, f"select l_returnflag, case when {column} is null then 'MISSING_EVIDENCE' when {column} {sign} {limit} then 'CANDIDATE' else 'NEGATIVE_VERIFIED' end as finding_status, count(*) as n from lineitem group by 1, 2"


def rule_ordinal_decrease(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's last order priority against the first, on the scale of the order priorities."""
    at = F.struct("o_orderdate", "o_orderkey")
    ends = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", at).alias("expected"), F.max_by("o_orderpriority", at).alias("actual"))
    order = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
    aliases = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(name.split()[0]).alias("alias")) for i, name in enumerate(order)))
    status = R.status_of(F.lit("ordinal_decrease"), F.col("expected"), F.col("actual"), *[F.lit(0.0)] * 3, aliases)
    return ends.select("o_custkey", "expected", "actual", status.alias("finding_status"))


_ORDINAL = """select o_custkey, expected, actual, case when left(actual, 1) > left(expected, 1) then 'CANDIDATE' else 'NEGATIVE_VERIFIED' end as finding_status
  from (select o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) as expected, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) as actual from orders group by o_custkey)"""


def rule_text_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against upper-case ones with punctuation; of every fifth part one word is another."""
    said = F.concat(F.upper(F.translate("p_name", " ", "-")), F.when(F.col("p_partkey") % 5 == 0, " new").otherwise("."))
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("expected"), said.alias("actual"))
    return part.withColumn("finding_status", R.status_of(F.lit("text_mismatch"), F.col("expected"), F.col("actual"), *[F.lit(0.0)] * 3))


_NORM = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_TEXT = f"""select *, case when {_NORM.format("expected")} <> {_NORM.format("actual")} then 'CANDIDATE' else 'NEGATIVE_VERIFIED' end as finding_status
  from (select p_partkey, p_name as expected, upper(replace(p_name, ' ', '-')) || case when p_partkey % 5 = 0 then ' new' else '.' end as actual from part)"""

_CODES = [("numeric_equal", "M-001"), ("numeric_delta_pct", "M-024"), ("numeric_decrease", "M-003"), ("numeric_increase", "M-132"), ("threshold_min", "M-030"), ("threshold_max", "M-118"), ("unknown", "X-999")]


def rule_catalog_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings per rule and status: each part is compared by the rule its key falls to, under the whole catalogue."""
    from tallyline.plans.catalogue import rules

    codes = F.array(*(F.lit(c) for _, c in _CODES))
    part = read(spark, sf_dir, "part").select(
        F.get(codes, (F.col("p_partkey") % len(_CODES)).cast("int")).alias("param_code"),
        F.when(F.col("p_size") > 2, F.col("p_size").cast("string")).otherwise(F.lit(" ")).alias("expected"),
        F.concat((F.col("p_size") + F.col("p_partkey") % 3 - 1).cast("string"), F.lit(" units")).alias("actual"),
    )
    found = R.evaluate(part, rules(spark))
    return found.groupBy("param_code", "rule_type", "finding_status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("delta").cast("double")).alias("delta"))


_CATALOG = f"""
with r(k, param_code, rule_type, pct, threshold) as (values (0, 'M-001', 'numeric_equal', 0, 0), (1, 'M-024', 'numeric_delta_pct', 5, 0), (2, 'M-003', 'numeric_decrease', 0, 0), (3, 'M-132', 'numeric_increase', 5, 0), (4, 'M-030', 'threshold_min', 0, 4.2), (5, 'M-118', 'threshold_max', 0, 0.014), (6, 'X-999', null, 0, 0)),
p as (select r.*, case when p_size > 2 then p_size::double end as expected, (p_size + p_partkey % 3 - 1)::double as actual from part join r on p_partkey % {len(_CODES)} = k),
s as (select *, case when rule_type is null then 'NOT_COMPARABLE'
  when rule_type not like 'threshold%' and expected is null then 'MISSING_EVIDENCE'
  when (rule_type = 'numeric_equal' and actual <> expected) or (rule_type = 'numeric_delta_pct' and {_OFF} > pct) or (rule_type = 'numeric_decrease' and actual < expected)
    or (rule_type = 'numeric_increase' and actual > expected and {_OFF} > pct) or (rule_type = 'threshold_min' and actual < threshold) or (rule_type = 'threshold_max' and actual > threshold) then 'CANDIDATE'
  else 'NEGATIVE_VERIFIED' end as finding_status from p)
select param_code, rule_type, finding_status, count(*) as n, sum(case when finding_status = 'CANDIDATE' and rule_type like 'numeric%' then actual - expected end) as delta from s group by 1, 2, 3
"""


def scale_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks and aliases of the built-in scales."""
    return scales(spark).groupBy("scale").agg(F.max("rank").cast("int").alias("best"), F.count(F.lit(1)).alias("aliases"))


def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconciliation by order priority: counts by status and the money at stake."""
    pairs = order_pairs(spark, sf_dir).withColumn("finding_status", R.numeric_status("numeric_delta_pct", F.col("expected"), F.col("actual"), 12))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return pairs.join(orders, "o_orderkey").groupBy("o_orderpriority", "finding_status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs(F.col("actual") - F.col("expected"))), 1).alias("at_stake"))


_STAGE = f"""select o_orderpriority, finding_status, count(*) as n, round(sum(abs(actual - expected)), 1) as at_stake
  from (select *, case when actual is null then 'MISSING_EVIDENCE' when {_OFF} > 12 then 'CANDIDATE' else 'NEGATIVE_VERIFIED' end as finding_status from {_PAIRS}) join orders using (o_orderkey) group by 1, 2"""

QUERIES = {
    "order_reconciliation": _numeric("numeric_delta_pct", pct=1),
    "rule_numeric_equal": _numeric("numeric_equal", tolerance=2),
    "rule_numeric_delta_pct": _numeric("numeric_delta_pct", pct=12),
    "rule_numeric_decrease": _numeric("numeric_decrease"),
    "rule_numeric_increase": _numeric("numeric_increase", pct=10),
    "rule_threshold_min": _threshold("threshold_min", "l_discount", 0.03),
    "rule_threshold_max": _threshold("threshold_max", "l_quantity", 45),
    "rule_ordinal_decrease": (rule_ordinal_decrease, _ORDINAL),
    "rule_text_mismatch": (rule_text_mismatch, _TEXT),
    "rule_catalog_report": (rule_catalog_report, _CATALOG),
    "scale_catalogue": (scale_catalogue, "select * from (values ('concrete', 12, 13), ('rebar', 3, 4), ('steel', 5, 6), ('fire_resistance', 4, 10), ('kpo', 3, 4), ('energy_class', 8, 9), ('reliability', 2, 6), ('km', 5, 6)) t(scale, best, aliases)"),
    "stage_report": (stage_report, _STAGE),
}
