"""Processes, jobs, decisions, reports and catalogue merges on orders, events and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.operators import lifecycle as L
from tallyline.operators import report
from tallyline.queries.comparison import read


def _uploads(spark, sf_dir):
    t = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    stage = F.get(F.array(*map(F.lit, ("PD", "RD", "ID"))), (k % 3).cast("int"))
    files = t.select(F.col("o_custkey").alias("process_id"), stage.alias("doc_stage"), (F.col("o_orderstatus") != "P").alias("is_current"), F.when(k % 17 == 0, "CLARIFICATION_REQUIRED").alias("selection_status"))
    return files, t.where("o_orderkey % 23 = 0").select(F.col("o_custkey").alias("process_id"), stage.alias("doc_stage"))


_STATUS = """st as (select p.process_id, s.doc_stage, case when cur is null then 'MISSING' when cur and not unclear and not un then 'UPLOADED' else 'PARTIAL' end as upload_status
  from (select distinct o_custkey as process_id from orders) p cross join (values ('PD', 0), ('RD', 1), ('ID', 2)) s(doc_stage, m)
  left join (select o_custkey as process_id, o_orderkey % 3 as m, bool_or(o_orderstatus <> 'P') as cur, bool_or(o_orderkey % 17 = 0) as unclear, bool_or(o_orderkey % 23 = 0) as un from orders group by 1, 2) f on f.process_id = p.process_id and f.m = s.m)"""


def upload_status(spark, sf_dir):
    return L.upload_status(*_uploads(spark, sf_dir))


def scenario(spark, sf_dir):
    return L.scenarios(L.upload_status(*_uploads(spark, sf_dir)))


_SCENARIO = f"""with {_STATUS}, h as (select process_id, bool_or(doc_stage = 'PD' and upload_status <> 'MISSING') as pd, bool_or(doc_stage = 'RD' and upload_status <> 'MISSING') as rd, bool_or(doc_stage = 'ID' and upload_status <> 'MISSING') as i, bool_or(upload_status = 'PARTIAL') as part from st group by 1)
select process_id, case when not (pd or rd or i) then '' when part then 'PARTIALLY_LOADED' when pd and rd and i then 'FULL' when pd and rd then 'PD_RD_ONLY' when pd and i then 'PD_ID_ONLY' when rd and i then 'RD_ID_ONLY' else 'SINGLE_ONLY' end as scenario from h"""


def parse_job_plan(spark, sf_dir):
    """Slices of 20 pages of documents of 100 characters a page; every tenth document's pages aren't known, 0 stands for no range."""
    t = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.when(F.col("doc_id") % 10 > 0, F.floor(F.col("n_chars") / 100)).alias("page_count"))
    return L.plan_jobs(t).select("file_id", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("page_from", "page_to")))


_PLAN = """with d as (select doc_id, case when doc_id % 10 > 0 then n_chars // 100 end as n from documents)
select doc_id as file_id, coalesce(f, 0)::bigint as page_from, case when f is null then 0 else least(f + 19, n) end::bigint as page_to from (select doc_id, n, unnest(case when n > 0 then range(1, n + 1, 20) else [null] end) as f from d)"""


def fan_in_ready(spark, sf_dir):
    jobs = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("process_id"), F.when(F.col("o_orderstatus") == "P", "RUNNING").when(F.col("o_orderstatus") == "F", "DONE").otherwise("FAILED").alias("status"))
    return L.fan_in(jobs)


def _findings(spark, sf_dir):
    """Events as findings of users; error and purchase events are candidates."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("finding_id"), F.col("user_id").alias("process_id"), F.when(F.col("event_type").isin("error", "purchase"), "CANDIDATE").otherwise("NEGATIVE_VERIFIED").alias("finding_status"))


def _decisions(spark, sf_dir):
    """Two decisions on most events of even users, some of them invalid."""
    e = read(spark, sf_dir, "events").where("user_id % 2 = 0 and event_id % 5 <> 0").select("event_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    k = F.col("event_id") + F.col("i")
    status = F.when(k % 3 == 0, "CONFIRMED_VIOLATION").when(k % 3 == 1, "NEGATIVE_VERIFIED").otherwise("CLARIFICATION_REQUIRED")
    return e.select(F.col("event_id").alias("finding_id"), (F.col("event_id") * 2 + F.col("i")).alias("seq"), status.alias("status"), F.when(k % 2 == 0, F.concat(F.lit("c"), k.cast("string"))).alias("comment"), F.lit("OTHER").alias("reason_code"), k.alias("decided_at"))


_FOLD = """d as (select event_id as finding_id, event_id * 2 + i as seq, event_id + i as k, case (event_id + i) % 3 when 0 then 'CONFIRMED_VIOLATION' when 1 then 'NEGATIVE_VERIFIED' else 'CLARIFICATION_REQUIRED' end as status,
    case when (event_id + i) % 2 = 0 then 'c' || (event_id + i) end as comment from events cross join (values (0), (1)) x(i) where user_id % 2 = 0 and event_id % 5 <> 0),
l as (select finding_id, arg_max(status, seq) as status, arg_max(coalesce(comment, ''), seq) as comment, arg_max(k, seq) as decided_at, count(*) as n from d where status = 'CLARIFICATION_REQUIRED' or comment is not null group by 1),
f as (select event_id as finding_id, user_id as process_id, case when event_type in ('error', 'purchase') then 'CANDIDATE' else 'NEGATIVE_VERIFIED' end as finding_status, coalesce(l.status, 'PENDING') as inspector_status, nullif(comment, '') as comment, decided_at, coalesce(n, 0) + 1 as version
  from events left join l on finding_id = event_id)"""


def decisions_fold(spark, sf_dir):
    return L.fold_decisions(_findings(spark, sf_dir), _decisions(spark, sf_dir)).select("finding_id", "inspector_status", "comment", "version")


def finalize_gate(spark, sf_dir):
    return L.finalizable(L.process_state(L.fold_decisions(_findings(spark, sf_dir), _decisions(spark, sf_dir))))


_GATE = f"""with {_FOLD}, s as (select process_id, count(*) filter (finding_status = 'CANDIDATE' and inspector_status = 'PENDING') as n_pending, count(*) filter (inspector_status <> 'PENDING') as n_decided from f group by 1)
select *, status = 'COMPLETED' and n_pending = 0 as can_finalize from (select *, case when n_decided = 0 then 'READY' when n_pending = 0 then 'COMPLETED' else 'VERIFYING' end as status from s)"""


def confirmed_payload(spark, sf_dir):
    return L.confirmed_payload(L.fold_decisions(_findings(spark, sf_dir), _decisions(spark, sf_dir)))


_PAYLOAD = f"""with {_FOLD} select process_id, count(*) as n, '[' || string_agg('{{"finding_id":' || finding_id || ',"comment":"' || comment || '","decided_at":' || decided_at || '}}', ',' order by finding_id) || ']' as payload
  from f where inspector_status = 'CONFIRMED_VIOLATION' group by 1"""


def protocol_ordered(spark, sf_dir):
    """Places of orders in their customer's protocol."""
    t = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("process_id"), F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "P", "CANDIDATE").when(F.col("o_orderstatus") == "F", "MISSING_EVIDENCE").otherwise("NEGATIVE_VERIFIED").alias("finding_status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "HIGH").when(F.col("o_orderpriority") == "2-HIGH", "MEDIUM").alias("review_priority"),
        F.when(F.col("o_orderkey") % 3 > 0, F.substring("o_orderpriority", 3, 9)).alias("param_code"),
    )
    return report.numbered(t).select("process_id", "id", F.col("place").cast("long").alias("place"))


_PROTOCOL = """select o_custkey as process_id, o_orderkey as id, row_number() over (partition by o_custkey order by case o_orderstatus when 'P' then 0 when 'F' then 2 else 4 end,
  case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 else 2 end, case when o_orderkey % 3 > 0 then substring(o_orderpriority, 3, 9) end nulls last, o_orderkey) as place from orders"""


def latest_version(spark, sf_dir):
    t = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("process_id"), F.struct("o_orderdate", "o_orderkey").alias("version"), "o_totalprice", "o_orderkey")
    return report.latest(t, "process_id").select("process_id", "o_orderkey", "o_totalprice")


def matrix_upsert(spark, sf_dir):
    """Parts as the catalogue; a new file has the odd ones, renamed, and one more."""
    cur = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size"))
    new = cur.where("code % 2 = 1").select("code", F.upper("name").alias("name"), F.col("size")).union(spark.createDataFrame([(-1, "new", 7)], "code long, name string, size long"))
    return L.merge_catalogue(cur, new, "code", ["name", "size"])


_UPSERT = "select p_partkey as code, case when p_partkey % 2 = 1 then upper(p_name) else p_name end as name, p_size::bigint as size, p_partkey % 2 = 1 as is_active from part union all select -1, 'new', 7, true"


def outbox_claim(spark, sf_dir):
    """The 100 oldest due rows of an outbox made of events."""
    e = read(spark, sf_dir, "events").select(F.col("event_id"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "published").otherwise("pending").alias("status"), F.col("ts").alias("available_at"), F.col("ts").alias("created_at"))
    return report.claimable(e, F.lit("2100-01-01").cast("timestamp")).select("event_id", "status")


def manifest_hash(spark, sf_dir):
    """Orders as files of their customer: a group is as small as a process's files are."""
    name = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    t = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("process_id"), F.sha2(name, 256).alias("sha256"))
    return report.manifest_hash(t)


def gold_dataset(spark, sf_dir):
    f = L.fold_decisions(_findings(spark, sf_dir), _decisions(spark, sf_dir)).withColumn("object_id", F.col("process_id"))
    return L.gold_split(f).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def upload_limits(spark, sf_dir):
    """Orders as uploads of their price in kilobytes, customers as batches."""
    t = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("batch_id"), (F.col("o_totalprice").cast("long") * 200).alias("size"))
    return L.refused(t).groupBy(F.coalesce("refused", F.lit("ok")).alias("refused")).agg(F.count(F.lit(1)).alias("n"))


_LIMITS = """select case when size <= 0 or size > 52428800 then 'REJECTED_SIZE' when t > 209715200 then 'BATCH_SIZE' else 'ok' end as refused, count(*) as n
  from (select size, sum(size) over (partition by o_custkey) as t from (select o_custkey, trunc(o_totalprice)::bigint * 200 as size from orders)) group by 1"""

def lists_in_order(spark, sf_dir):
    """Places in the lists that are shown: files of a process by upload, parameters by code, stages of a process by name, groups by their key."""
    files = report.listed(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("process_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("uploaded_at")), ["process_id"], ["uploaded_at", "id"])
    params = report.listed(read(spark, sf_dir, "part").select(F.col("p_brand").alias("section"), F.col("p_partkey").alias("id"), F.concat(F.lit("M-"), F.col("p_partkey").cast("string")).alias("code")), ["section"], ["code"])
    stages = report.listed(L.upload_status(*_uploads(spark, sf_dir)), ["process_id"], ["doc_stage"])
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("process_id"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("param_code"), F.col("l_linenumber").cast("string").alias("element_key"))
    groups = report.listed(line, ["process_id"], report.group_order(), False)
    one = lambda df, kind, key, item: df.select(F.lit(kind).alias("list"), F.col(key).cast("string").alias("key"), F.col(item).cast("string").alias("item"), F.col("place").cast("long").alias("place"))
    return one(files, "files", "process_id", "id").union(one(params, "params", "section", "id")).union(one(stages, "stages", "process_id", "doc_stage")).union(one(groups, "groups", "process_id", "element_key"))


_LISTS = f"""with {_STATUS} select 'files' as list, o_custkey::varchar as key, o_orderkey::varchar as item, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as place from orders
union all select 'params', p_brand, p_partkey::varchar, row_number() over (partition by p_brand order by 'M-' || p_partkey) from part
union all select 'stages', process_id::varchar, doc_stage, row_number() over (partition by process_id order by doc_stage) from st
union all select 'groups', l_orderkey::varchar, l_linenumber::varchar, row_number() over (partition by l_orderkey order by case when l_returnflag <> 'N' then l_returnflag else '' end, l_linenumber::varchar) from lineitem"""

QUERIES = {
    "lists_in_order": (lists_in_order, _LISTS),
    "upload_status": (upload_status, f"with {_STATUS} select * from st"),
    "scenario": (scenario, _SCENARIO),
    "parse_job_plan": (parse_job_plan, _PLAN),
    "fan_in_ready": (fan_in_ready, "select o_custkey as process_id, count(*) as n_jobs, count(*) filter (o_orderstatus = 'P') as n_open, count(*) filter (o_orderstatus = 'P') = 0 as ready from orders group by 1"),
    "decisions_fold": (decisions_fold, f"with {_FOLD} select finding_id, inspector_status, comment, version from f"),
    "finalize_gate": (finalize_gate, _GATE),
    "confirmed_payload": (confirmed_payload, _PAYLOAD),
    "protocol_ordered": (protocol_ordered, _PROTOCOL),
    "latest_version": (latest_version, "select o_custkey as process_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as o_totalprice from orders group by 1"),
    "matrix_upsert": (matrix_upsert, _UPSERT),
    "outbox_claim": (outbox_claim, "select event_id, case when event_type = 'error' then 'failed' else 'pending' end as status from events where event_type <> 'view' order by ts, event_id limit 100"),
    "manifest_hash": (manifest_hash, "select o_custkey as process_id, sha256(string_agg(h, '' order by h)) as manifest_hash from (select o_custkey, sha256(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority) as h from orders) group by 1"),
    "gold_dataset": (gold_dataset, f"with {_FOLD} select case inspector_status when 'CONFIRMED_VIOLATION' then 1 else 0 end as label, count(*) as n from f where inspector_status in ('CONFIRMED_VIOLATION', 'NEGATIVE_VERIFIED') group by 1"),
    "upload_limits": (upload_limits, _LIMITS),
}
