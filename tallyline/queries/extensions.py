"""Catalogue columns, orders of lists and the documented extensions, on parts, orders, lineitems and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.operators import extensions as X
from tallyline.operators import lifecycle as L
from tallyline.operators import report
from tallyline.plans.catalogue import rules
from tallyline.queries.comparison import read
from tallyline.queries.lifecycle import _FOLD, _STATUS, _decisions, _findings, _uploads
from tallyline.sources import catalogues


def matrix_enrich(spark, sf_dir):
    """Parts as parameters of four codes: a numeric, an ordinal and a text rule, and none."""
    codes = F.array(*map(F.lit, ("M-001", "M-015", "M-043", "X-999")))
    params = read(spark, sf_dir, "part").select("p_partkey", F.get(codes, (F.col("p_partkey") % 4).cast("int")).alias("code"))
    return catalogues.enrich(params, rules(spark)).select("p_partkey", "code", "data_type", "rule_type", "scale")


_ENRICH = """select p_partkey, c.* exclude (k) from part join (values (0, 'M-001', 'number', 'numeric_equal', null), (1, 'M-015', 'ordinal', 'ordinal_decrease', 'reliability'),
  (2, 'M-043', 'string', 'text_mismatch', null), (3, 'X-999', 'string', null, null)) c(k, code, data_type, rule_type, scale) on k = p_partkey % 4"""


def matrix_version(spark, sf_dir):
    """Brands as versions; every third part isn't active."""
    params = read(spark, sf_dir, "part").select(F.col("p_brand").alias("matrix_version"), (F.col("p_partkey") % 3 != 0).alias("is_active"))
    return catalogues.active_version(params)


def processes_newest(spark, sf_dir):
    """Orders as processes of their customer, newest first."""
    t = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("object_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return report.newest_first(t, "object_id").select("object_id", "id", F.col("place").cast("long").alias("place"))


def protocol_sections(spark, sf_dir):
    """Table of the protocol of each event's finding."""
    found = L.fold_decisions(_findings(spark, sf_dir), _decisions(spark, sf_dir))
    return found.select("finding_id", X.section(F.col("finding_status"), F.col("inspector_status")).alias("section"))


_SECTIONS = f"""with {_FOLD} select finding_id, case case when inspector_status = 'PENDING' then finding_status else inspector_status end
  when 'CANDIDATE' then 'candidates' when 'CONFIRMED_VIOLATION' then 'confirmed' when 'NEGATIVE_VERIFIED' then 'negatives' else 'completeness' end as section from f"""


def quality_gate(spark, sf_dir):
    """Lineitems as facts of an order's findings: returned ones are of low quality, finished ones carry a change notice."""
    line = read(spark, sf_dir, "lineitem")
    quality = F.when(F.col("l_returnflag") == "N", "OK").when(F.col("l_returnflag") == "R", "LOW_QUALITY")
    facts = line.select(F.col("l_orderkey").alias("element_key"), quality.alias("quality"), (F.col("l_linestatus") == "F").alias("has_change_notice"))
    found = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("element_key"), F.when(F.col("o_orderkey") % 2 == 0, "CANDIDATE").otherwise("NEGATIVE_VERIFIED").alias("finding_status"))
    return X.gated(found, X.quality_gate(facts, ("element_key",)), ("element_key",)).select("element_key", "finding_status", "change_notice")


_GATE = """with s as (select o_orderkey as k, case when coalesce(bool_or(l_returnflag = 'N'), false) then case when o_orderkey % 2 = 0 then 'CANDIDATE' else 'NEGATIVE_VERIFIED' end else 'NOT_COMPARABLE' end as finding_status,
  coalesce(bool_or(l_linestatus = 'F'), false) as noticed from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey)
select k as element_key, finding_status, noticed and finding_status = 'CANDIDATE' as change_notice from s"""


def completeness(spark, sf_dir):
    """Three parameters of each customer: one needs PD and RD, one PD and may have ID, one needs none. Partial stages count as unclear."""
    stages = L.upload_status(*_uploads(spark, sf_dir)).withColumn("unclear", F.col("upload_status") == "PARTIAL")
    sources = spark.sql("select * from values ('M-001', 'PD', true), ('M-001', 'RD', true), ('M-002', 'PD', true), ('M-002', 'ID', false) as t(param_code, doc_stage, required)")
    codes = F.explode(F.array(*map(F.lit, ("M-001", "M-002", "M-003"))))
    pairs = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("process_id"), codes.alias("param_code"))
    return X.completeness(pairs, sources, stages)


_COMPLETE = f"""with {_STATUS}, w as (select c_custkey as process_id, max(upload_status) filter (doc_stage = 'PD') as pd, max(upload_status) filter (doc_stage = 'RD') as rd, max(upload_status) filter (doc_stage = 'ID') as i
  from customer left join st on process_id = c_custkey group by 1), n as (select process_id, coalesce(pd, 'MISSING') as pd, coalesce(rd, 'MISSING') as rd, coalesce(i, 'MISSING') as i from w)
select process_id, 'M-001' as param_code, case when 'MISSING' in (pd, rd) then 'MISSING_EVIDENCE' when 'PARTIAL' in (pd, rd) then 'CLARIFICATION_REQUIRED' end as completeness_status from n
union all select process_id, 'M-002', case when pd = 'MISSING' then 'MISSING_EVIDENCE' when i = 'MISSING' then 'NOT_APPLICABLE' when 'PARTIAL' in (pd, i) then 'CLARIFICATION_REQUIRED' end from n
union all select process_id, 'M-003', null from n"""


def job_timeouts(spark, sf_dir):
    """Events as jobs that run since their time; it is noon of their day, and an hour is the limit."""
    noon = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 86400) * 86400 + 43200)
    jobs = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "DONE").otherwise("RUNNING").alias("status"), (F.col("event_id") % 4).alias("attempts"), F.col("ts").alias("started_at"), noon.alias("noon"))
    return X.overdue(jobs, F.col("noon"), 3600).select("event_id", "status", "attempts", "last_error")


_TIMEOUTS = """with j as (select event_id, event_type, event_id % 4 as n, event_type <> 'view' and 43200 - floor(epoch(ts))::bigint % 86400 > 3600 as late from events)
select event_id, case when late and n < 2 then 'PENDING' when late then 'FAILED' when event_type = 'view' then 'DONE' else 'RUNNING' end as status,
  case when late and n < 2 then n + 1 else n end as attempts, case when late and n >= 2 then 'timeout' end as last_error from j"""

QUERIES = {
    "matrix_enrich": (matrix_enrich, _ENRICH),
    "matrix_version": (matrix_version, "select max(p_brand) as matrix_version from part where p_partkey % 3 <> 0"),
    "processes_newest": (processes_newest, "select o_custkey as object_id, o_orderkey as id, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as place from orders"),
    "protocol_sections": (protocol_sections, _SECTIONS),
    "quality_gate_status": (quality_gate, _GATE),
    "completeness": (completeness, _COMPLETE),
    "job_timeouts": (job_timeouts, _TIMEOUTS),
}
