"""Outputs of an evaluation and the joins that show them, on parts, suppliers, customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.operators import outputs as O
from tallyline.plans.catalogue import rules
from tallyline.queries.comparison import _CODES, _OFF, read


def _facts(spark, sf_dir):
    """Facts of parts: a PD one of four fifths, an RD and a later ID one of three quarters."""
    k = F.col("p_partkey")
    codes = F.array(*(F.lit(c) for _, c in _CODES))
    seen = F.concat((F.col("p_size") + k % 3 - 1).cast("string"), F.lit(" units"))
    fact = lambda stage, page, value, prefix: F.struct(F.lit(stage).alias("stage"), F.lit(page).alias("page"), value.alias("value"), F.concat(F.lit(prefix), (k % 100).cast("string")).alias("file_id"))
    listed = F.array(
        F.when(k % 5 != 0, fact("PD", 1, F.col("p_size").cast("string"), "f")),
        F.when(k % 4 != 0, fact("ID", 3, F.lit("0"), "h")),
        F.when(k % 4 != 0, fact("RD", 2, seen, "g")),
    )
    rows = read(spark, sf_dir, "part").select((k % 50).alias("process_id"), F.get(codes, (k % len(_CODES)).cast("int")).alias("param_code"), k.cast("string").alias("element_key"), F.explode(F.filter(listed, lambda x: x.isNotNull())).alias("f"))
    return rows.select("process_id", "param_code", "element_key", "f.*", F.concat_ws("-", "element_key", "f.stage").alias("fact_id"), F.array(*[F.lit(0.0)] * 4).alias("bbox"), F.concat(F.lit("q "), F.col("f.value")).alias("quote"), F.col("f.page").alias("seq"))


def _params(spark):
    return spark.sql("select * from values ('M-001', 'area', 'm2', 'HIGH'), ('M-024', 'share', '%', 'LOW'), ('M-003', 'count', '', 'MEDIUM') as t(param_code, parameter_name, unit, review_priority)")


def evaluate_outputs(spark, sf_dir):
    """A row per finding: its group, check and rationale, with the number of its fragments."""
    out = O.evaluate_outputs(_facts(spark, sf_dir), rules(spark))
    sides = out.fragments.groupBy("group_id").agg(F.count(F.lit(1)).alias("fragments"), F.count("bbox").alias("boxes"))
    met = out.findings.select("check_id", "inspector_status").join(out.checks, "check_id").join(out.groups.drop("process_id"), "group_id").join(sides, "group_id", "left")
    return met.select(F.col("element_key").cast("long").alias("p_partkey"), F.col("process_id").cast("long").alias("process_id"), "param_code", "fragments", "boxes", "expected_value", "actual_value", "delta", "finding_status", "inspector_status", "rationale")


_GROUPS = f"""
r(k, param_code, rule_type, pct, threshold) as (values (0, 'M-001', 'numeric_equal', 0, 0), (1, 'M-024', 'numeric_delta_pct', 5, 0), (2, 'M-003', 'numeric_decrease', 0, 0), (3, 'M-132', 'numeric_increase', 5, 0), (4, 'M-030', 'threshold_min', 0, 4.2), (5, 'M-118', 'threshold_max', 0, 0.014), (6, 'X-999', null, 0, 0)),
p as (select *, case when p_partkey % 5 <> 0 then p_size::double end as expected, case when p_partkey % 4 <> 0 then (p_size + p_partkey % 3 - 1)::double end as actual,
  case when p_partkey % 5 <> 0 then p_size::varchar end as es, case when p_partkey % 4 <> 0 then (p_size + p_partkey % 3 - 1)::varchar || ' units' end as acts
  from part join r on p_partkey % {len(_CODES)} = k where p_partkey % 20 <> 0),
s as (select *, case when rule_type is null then 'NOT_COMPARABLE' when actual is null or (rule_type not like 'threshold%' and expected is null) then 'MISSING_EVIDENCE'
  when (rule_type = 'numeric_equal' and actual <> expected) or (rule_type = 'numeric_delta_pct' and {_OFF} > pct) or (rule_type = 'numeric_decrease' and actual < expected)
    or (rule_type = 'numeric_increase' and actual > expected and {_OFF} > pct) or (rule_type = 'threshold_min' and actual < threshold) or (rule_type = 'threshold_max' and actual > threshold) then 'CANDIDATE'
  else 'NEGATIVE_VERIFIED' end as finding_status from p)"""
_OUTPUTS = f"""with {_GROUPS}
select p_partkey, p_partkey % 50 as process_id, param_code, ((es is not null)::int + (acts is not null)::int)::bigint as fragments, 0::bigint as boxes,
  case when finding_status in ('CANDIDATE', 'NEGATIVE_VERIFIED') and rule_type not like 'threshold%' then es end as expected_value,
  case when finding_status in ('CANDIDATE', 'NEGATIVE_VERIFIED') then acts end as actual_value,
  case when finding_status = 'CANDIDATE' and rule_type like 'numeric%' then (actual - expected)::bigint::varchar end as delta, finding_status, 'PENDING' as inspector_status,
  case finding_status when 'NOT_COMPARABLE' then 'правило для параметра не реализовано (RULE_NOT_IMPLEMENTED)'
    when 'MISSING_EVIDENCE' then case when rule_type like 'threshold%' then 'нет значения в РД/ИД для проверки порога' else 'нет значения для сравнения (ПД или РД/ИД)' end
    when 'CANDIDATE' then case rule_type when 'numeric_equal' then 'значение в РД/ИД (' || acts || ') не совпадает с ПД (' || es || ')'
      when 'numeric_delta_pct' then 'расхождение ' || printf('%.3g', {_OFF}) || '% превышает допустимые ' || printf('%.3g', pct::double) || '%'
      when 'numeric_decrease' then 'значение в РД/ИД (' || acts || ') меньше, чем в ПД (' || es || ')'
      when 'numeric_increase' then 'значение в РД/ИД (' || acts || ') больше, чем в ПД (' || es || ')'
      when 'threshold_min' then 'значение ' || printf('%.4g', actual) || ' меньше минимально допустимого ' || printf('%.4g', threshold::double)
      else 'значение ' || printf('%.4g', actual) || ' больше максимально допустимого ' || printf('%.4g', threshold::double) end end as rationale
from s"""


def protocol_assembly(spark, sf_dir):
    """Findings with their parameter and evidence; suppliers are the files of expected sides, even ones also of actual sides."""
    out = O.evaluate_outputs(_facts(spark, sf_dir), rules(spark))
    s = read(spark, sf_dir, "supplier")
    files = s.select(F.concat(F.lit("f"), "s_suppkey").alias("file_id"), F.col("s_name").alias("file_name")).union(s.where("s_suppkey % 2 = 0").select(F.concat(F.lit("g"), "s_suppkey"), "s_name"))
    shown = O.detailed_findings(out.findings, out.checks, out.groups, _params(spark)).join(O.evidence_by_group(out.fragments, files), "group_id", "left")
    shown = shown.join(out.groups.select("group_id", "element_key"), "group_id")
    sides = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["role"], e["file_name"], e["stage"], e["page"].cast("string"), e["quote"], e["extracted_value"])), "|")
    return shown.select(F.col("element_key").cast("long").alias("p_partkey"), "param_code", "parameter_name", "review_priority", "finding_status", sides.alias("evidence"))


_PROTOCOL = f"""with {_GROUPS}, n(param_code, parameter_name, review_priority) as (values ('M-001', 'area', 'HIGH'), ('M-024', 'share', 'LOW'), ('M-003', 'count', 'MEDIUM'))
select p_partkey, s.param_code, parameter_name, review_priority, finding_status,
  concat_ws('|', case when es is not null then 'expected:' || coalesce(f.s_name, '') || ':PD:1:q ' || es || ':' || es end, case when acts is not null then 'actual:' || coalesce(g.s_name, '') || ':RD:2:q ' || acts || ':' || acts end) as evidence
from s left join n on n.param_code = s.param_code left join supplier f on f.s_suppkey = p_partkey % 100 left join supplier g on g.s_suppkey = p_partkey % 100 and g.s_suppkey % 2 = 0"""


def _files_and_jobs(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    files = c.select(F.col("c_nationkey").alias("process_id"), F.col("c_custkey").alias("file_id"), F.lit(None).cast("string").alias("doc_stage"), F.col("c_mktsegment").alias("discipline"), F.when(F.col("c_custkey") % 7 == 0, "REJECTED").otherwise("ACCEPTED").alias("check_status"), (F.col("c_custkey") % 5 != 0).alias("is_current"), F.col("c_custkey").alias("uploaded_at"))
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "DONE").otherwise("FAILED")
    jobs = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), status.alias("status"), F.when(k % 3 != 0, F.concat(F.lit("k"), k.cast("string"))).alias("layout_key"), F.when(k % 4 != 0, k).alias("page_from"))
    return files, jobs


def files_done_layouts(spark, sf_dir):
    """Layout keys of each current accepted file in page order; none for files without a finished job."""
    return O.layouts_of_files(*_files_and_jobs(spark, sf_dir)).select("process_id", "file_id", "doc_stage", "discipline", F.array_join("layout_keys", ",").alias("keys"))


_LAYOUTS = """select c_nationkey as process_id, c_custkey as file_id, '' as doc_stage, c_mktsegment as discipline,
  coalesce(string_agg('k' || o_orderkey, ',' order by case when o_orderkey % 4 <> 0 then o_orderkey end nulls first, 'k' || o_orderkey) filter (o_orderkey % 3 <> 0), '') as keys
from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'F' where c_custkey % 7 <> 0 and c_custkey % 5 <> 0 group by 1, 2, 3, 4"""


def process_start(spark, sf_dir):
    """Nations as processes: those with a current accepted customer file start."""
    files, _ = _files_and_jobs(spark, sf_dir)
    processes = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("process_id"), F.when(F.col("n_regionkey") == 1, "READY").otherwise("PENDING").alias("status"))
    return O.can_start(processes, files.where("process_id % 4 <> 0 or file_id % 35 = 0"))


_START = """with f as (select distinct c_nationkey as k from customer where c_custkey % 7 <> 0 and c_custkey % 5 <> 0 and (c_nationkey % 4 <> 0 or c_custkey % 35 = 0))
select n_nationkey as process_id, case when n_regionkey = 1 then 'READY' when k is null then 'PENDING' else 'PARSING' end as status,
  case when n_regionkey = 1 then 'NOT_PENDING' when k is null then 'NO_CURRENT_FILES' end as refused from nation left join f on k = n_nationkey"""

QUERIES = {
    "evaluate_outputs": (evaluate_outputs, _OUTPUTS),
    "protocol_assembly": (protocol_assembly, _PROTOCOL),
    "files_done_layouts": (files_done_layouts, _LAYOUTS),
    "process_start": (process_start, _START),
}
