"""Registry matching and revision selection on documents, labels and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.operators import registry as O
from tallyline.operators import revisions
from tallyline.queries.comparison import read


def _files(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("uploaded_at"), "lang")


def _rows(spark, sf_dir):
    """Registry rows of labelled documents: by digest, by name, by a wrong name, or bad."""
    k = F.col("doc_id")
    sha = F.sha2("text", 256)
    t = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    values = {
        "object_id": F.lit("1"),
        "file_name": F.when(k % 4 == 1, F.concat(F.lit("doc-"), k.cast("string"), F.lit(".txt"))).when(k % 4 == 2, "nothing.txt").otherwise(F.lit("")),
        "sha256": F.when(k % 4 == 0, F.upper(sha)).otherwise(F.lit("")),
        "doc_stage": F.when(k % 3 == 0, " ПД ").when(k % 3 == 1, "rd").otherwise(F.lit("ИД")),
        "approval_status": F.when(k % 2 == 0, "В  производство работ").otherwise(F.lit("утв")),
        "approval_date": F.when(k % 5 == 0, "5.3.2026").otherwise(F.lit("2026-03-05")),
    }
    return t.select("doc_id", *(values.get(c, F.lit("")).alias(c) for c in O.COLUMNS))


def registry_match_coalesce(spark, sf_dir):
    """Files of registry rows, by digest and else by name."""
    rows = O.normalize_rows(_rows(spark, sf_dir))
    return O.match_rows(rows, _files(spark, sf_dir)).select("doc_id", F.coalesce("file_id", F.lit(-1)).alias("file_id"), "match_status", "doc_stage", "approval_status", "approval_date", F.size("issues").cast("long").alias("issues"))


_MATCH = """
with d as (select doc_id, sha256(text) as sha from documents), f as (select sha, max(doc_id) as last_id from d group by 1)
select l.doc_id, case l.doc_id % 4 when 0 then f.last_id when 1 then l.doc_id else -1 end as file_id,
  case when l.doc_id % 4 = 3 then 'INVALID' when l.doc_id % 4 = 2 then 'UNMATCHED' else 'MATCHED' end as match_status,
  case l.doc_id % 3 when 0 then 'PD' when 1 then 'RD' else 'ID' end as doc_stage,
  case when l.doc_id % 2 = 0 then 'FOR_CONSTRUCTION' else 'APPROVED' end as approval_status, '2026-03-05' as approval_date,
  (3 + (l.doc_id % 4 = 3)::int)::bigint as issues
from labels l join d using (doc_id) join f using (sha)"""


def registry_unmatched(spark, sf_dir):
    """Labelled ids that no document of English has."""
    docs = read(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return read(spark, sf_dir, "labels").join(docs, "doc_id", "left_anti").select("doc_id", F.col("quality").cast("long").alias("quality"))


def registry_references(spark, sf_dir):
    """Rows that name another document by digest, by name, by a digest that nothing has, or not at all; as successors their copies by name."""
    k = F.col("doc_id")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    near = docs.select((k + 1).alias("doc_id"), F.sha2("text", 256).alias("sha_before"))
    t = docs.join(near, "doc_id", "left")
    values = {
        "object_id": F.lit("1"), "file_name": F.concat(F.lit("doc-"), k.cast("string"), F.lit(".txt")), "sha256": F.lit(""), "doc_stage": F.lit("PD"), "approval_status": F.lit("APPROVED"), "approval_date": F.lit("2026-03-05"),
        "predecessor_ref": F.when(k % 4 == 0, F.coalesce("sha_before", F.lit(""))).when(k % 4 == 1, F.concat(F.lit("doc-"), (k - 1).cast("string"), F.lit(".txt"))).when(k % 4 == 2, F.lit("0" * 64)).otherwise(F.lit("")),
        "successor_ref": F.when(k % 5 == 0, F.concat(F.lit("doc-"), (k + 1).cast("string"), F.lit(".txt"))).otherwise(F.lit("")),
    }
    rows = O.normalize_rows(t.select("doc_id", *(values.get(c, F.lit("")).alias(c) for c in O.COLUMNS)))
    return O.match_rows(rows, _files(spark, sf_dir)).select("doc_id", "file_id", "predecessor_id", "successor_id", "match_status")


_REFERENCES = """with f as (select sha256(text) as sha, max(doc_id) as last_id from documents group by 1), d as (select doc_id as k, sha256(text) as sha from documents)
select d.k as doc_id, d.k as file_id, case d.k % 4 when 0 then f.last_id when 1 then p.k end as predecessor_id, case when d.k % 5 = 0 then n.k end as successor_id, 'MATCHED' as match_status
from d left join d p on p.k = d.k - 1 left join f on f.sha = p.sha left join d n on n.k = d.k + 1"""


def registry_status_counts(spark, sf_dir):
    """Registry rows by what became of them, through the matching operator."""
    rows = O.match_rows(O.normalize_rows(_rows(spark, sf_dir)), _files(spark, sf_dir))
    return rows.groupBy("match_status").agg(F.count(F.lit(1)).alias("n"), F.count("file_id").alias("with_file"))


def duplicates_marked(spark, sf_dir):
    """Documents as files of their language: a later one of a text keeps no digest and has a note."""
    files = _files(spark, sf_dir).withColumnRenamed("lang", "process_id")
    return O.mark_duplicates(files).select("file_id", "sha256", "note")


def _chains(spark, sf_dir):
    """Files made of events: a user's events are a group, each naming the one before as predecessor, some also a successor."""
    from pyspark.sql import Window

    t = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    by = Window.partitionBy("user_id").orderBy("event_id")
    status = F.create_map(*map(F.lit, ("purchase", "APPROVED", "signup", "FOR_CONSTRUCTION", "click", "DRAFT", "view", "SUPERSEDED", "error", "CANCELLED")))
    t = t.withColumns({"before": F.lag("event_id").over(by), "after": F.lead("event_id").over(by), "first": F.first("event_id").over(by), "n": F.row_number().over(by)})
    successor = F.when((F.col("user_id") % 7 == 0) & (F.col("n") < 4), F.when(F.col("n") == 3, F.col("first")).otherwise(F.col("after"))).when((F.col("user_id") % 11 == 0) & (F.col("n") == 1), F.lit(-1))
    return t.select(F.col("event_id").alias("file_id"), F.col("user_id").cast("string").alias("object_id"), F.lit(None).cast("string").alias("doc_stage"), F.lit("A").alias("discipline"), F.lit("").alias("document_code"), status[F.col("event_type")].alias("approval_status"), F.col("before").alias("predecessor_id"), successor.alias("successor_id"))


def revision_select(spark, sf_dir):
    """Current revision of each user's chain of events, or why there is none."""
    return revisions.select_current(_chains(spark, sf_dir)).groupBy(F.col("object_id").cast("long").alias("user_id"), F.col("selection_reason").alias("reason")).agg(F.max(F.when(F.col("is_current"), F.col("file_id"))).alias("current_id"), F.count(F.lit(1)).alias("n"))


_CHAIN = """e as (select *, lag(event_id) over w as before, lead(event_id) over w as after, first(event_id) over w as first_id, row_number() over w as n, event_type in ('purchase', 'signup') as good
  from events window w as (partition by user_id order by event_id))"""
_SELECT = f"""
with {_CHAIN}, c as (select *, good and not coalesce(lead(good) over (partition by user_id order by event_id), false) as candidate from e),
g as (select user_id, count(*) as n, count(*) filter (candidate) as k, max(case when candidate then event_id end) as m, count(*) filter (n <= 3) as head from c group by 1)
select user_id, case when user_id % 11 = 0 and user_id % 7 <> 0 then 'DANGLING_REFERENCE' when user_id % 7 = 0 and head = 3 then 'CYCLE' when k = 0 then 'NO_CANDIDATE' when k > 1 then 'MULTIPLE_CANDIDATES' end as reason,
  case when (user_id % 11 = 0 and user_id % 7 <> 0) or (user_id % 7 = 0 and head = 3) or k <> 1 then null else m end as current_id, n from g"""


def revision_cycle(spark, sf_dir):
    """Customers on cycles of the map id -> id * id + 3 modulo their number; the map is fixed, the table its whole domain."""
    t = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    n = t.agg(F.count(F.lit(1)).alias("n"))
    return revisions.successor_cycles(t.join(F.broadcast(n)).select("id", ((F.col("id") * F.col("id") + 3) % F.col("n")).alias("next")))


_CYCLE = """
with recursive e as (select c_custkey as id, (c_custkey * c_custkey + 3) % (select count(*) from customer) as nxt from customer),
w as (select id as root, nxt as cur, 1 as depth from e union select root, nxt, depth + 1 from w join e on e.id = w.cur where cur <> root and depth < 400)
select distinct root as id from w where root = cur"""

QUERIES = {
    "registry_match_coalesce": (registry_match_coalesce, _MATCH),
    "registry_unmatched": (registry_unmatched, "select doc_id, quality::bigint as quality from labels where doc_id not in (select doc_id from documents where lang = 'en')"),
    "registry_references": (registry_references, _REFERENCES),
    "registry_status_counts": (registry_status_counts, f"with m as ({_MATCH.strip()}) select match_status, count(*) as n, count(*) filter (file_id >= 0) as with_file from m group by 1"),
    "duplicates_marked": (duplicates_marked, "select doc_id as file_id, case when n = 1 then sha256(text) end as sha256, case when n > 1 then 'duplicate content' end as note from (select *, row_number() over (partition by lang, text order by doc_id) as n from documents)"),
    "revision_select": (revision_select, _SELECT),
    "revision_cycle": (revision_cycle, _CYCLE),
}
