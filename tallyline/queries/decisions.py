"""The log of decisions, its audit and what it leaves, on events as findings of users."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.operators import decisions as D
from tallyline.operators import lifecycle as L
from tallyline.queries.comparison import read


def _findings(spark, sf_dir):
    """Events as findings; an error in seven is a candidate."""
    candidate = (F.col("event_type") == "error") & (F.col("event_id") % 7 == 1)
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("finding_id"), F.col("user_id").alias("process_id"), F.when(candidate, "CANDIDATE").otherwise("NEGATIVE_VERIFIED").alias("finding_status"))


def _commands(spark, sf_dir):
    """Of each event two decisions, some without what they need, on old versions or on another process's finding; some events finalise their process or open it again."""
    k, i = F.col("event_id"), F.col("i")
    each = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("process_id"), F.explode(F.array(*map(F.lit, range(4)))).alias("i"))
    some = each.where("i < 2 and event_id % 5 <> 0 or i = 2 and event_id % 6 = 0 or i = 3 and event_id % 8 = 0")
    action = F.when(i < 2, "decide").when(i == 2, F.when(k % 36 == 0, "close").otherwise("finalize")).otherwise("unfinalize")
    decision = F.when((k + i) % 4 == 0, "CONFIRMED_VIOLATION").when((k + i) % 4 == 1, "NEGATIVE_VERIFIED").when((k + i) % 4 == 2, "CLARIFICATION_REQUIRED").otherwise(F.when(k % 10 == 3, "MAYBE").otherwise("CONFIRMED_VIOLATION"))
    return some.select(
        "process_id", ((k * 7919) % 100003 * 4 + i).alias("seq"), action.alias("action"),
        F.when(i < 2, F.when(k % 17 == 0, k + 1).otherwise(k)).alias("finding_id"),
        F.when(i < 2, decision).alias("decision"), F.when(k % 9 != 0, "OTHER").alias("reason_code"), F.when(k % 4 != 3, F.concat(F.lit("c"), k.cast("string"))).alias("comment"),
        F.when((i < 2) & (k % 3 == 1), i + 1).when((i < 2) & (k % 3 == 2), 1).alias("expected_version"), (k % 5).alias("actor"),
    )


_LOG = """with recursive f as (select event_id as finding_id, user_id as process_id, event_type = 'error' and event_id % 7 = 1 as candidate from events),
e as (select event_id as k, user_id as process_id, i from events cross join range(4) x(i) where i < 2 and event_id % 5 <> 0 or i = 2 and event_id % 6 = 0 or i = 3 and event_id % 8 = 0),
c as (select process_id, (k * 7919) % 100003 * 4 + i as seq, k, i, case when i < 2 then 'decide' when i = 3 then 'unfinalize' when k % 36 = 0 then 'close' else 'finalize' end as action,
  case when i < 2 then case when k % 17 = 0 then k + 1 else k end end as finding_id,
  case when i < 2 then case when (k + i) % 4 = 1 then 'NEGATIVE_VERIFIED' when (k + i) % 4 = 2 then 'CLARIFICATION_REQUIRED' when (k + i) % 4 = 3 and k % 10 = 3 then 'MAYBE' else 'CONFIRMED_VIOLATION' end end as decision,
  k % 9 <> 0 as reasoned, k % 4 <> 3 as commented, case when i < 2 then case k % 3 when 1 then i + 1 when 2 then 1 end end as want from e),
o as (select c.*, row_number() over (partition by c.process_id order by seq) as n, f.candidate from c left join f on f.finding_id = c.finding_id and f.process_id = c.process_id),
w as (select process_id, 0::bigint as n, null::bigint as seq, null::varchar as action, null::bigint as finding_id, null::varchar as decision, null::varchar as refused, 'READY' as was, 'READY' as status, [{'f': -1::bigint, 'd': ''}] as done, count(*) filter (candidate) as pending, null::bigint as version, null::varchar as before
    from f group by process_id
  union all select process_id, n, seq, action, finding_id, decision, refused, was,
    case when refused is not null then was when action = 'finalize' then 'FINALIZED' when action = 'unfinalize' then 'COMPLETED' when was = 'COMPLETED' or pending - fresh = 0 then 'COMPLETED' else 'VERIFYING' end,
    case when refused is null and action = 'decide' then list_append(done, {'f': finding_id, 'd': decision}) else done end, case when refused is null and action = 'decide' then pending - fresh else pending end, version, before
    from (select *, case when action = 'close' then 'unknown action'
        when action = 'decide' and decision = 'MAYBE' then 'bad status' when action = 'decide' and decision = 'CONFIRMED_VIOLATION' and not commented then 'needs a comment'
        when action = 'decide' and decision = 'NEGATIVE_VERIFIED' and not (commented and reasoned) then 'needs a reason and a comment'
        when action = 'unfinalize' and not commented then 'needs a reason'
        when action = 'finalize' and was <> 'COMPLETED' then 'process is ' || was when action = 'finalize' and pending > 0 then 'candidates are pending'
        when action = 'unfinalize' and was <> 'FINALIZED' then 'process is ' || was
        when action = 'decide' and candidate is null then 'no such finding' when action = 'decide' and was = 'FINALIZED' then 'process is ' || was
        when action = 'decide' and want <> version then 'version is ' || version end as refused,
      case when candidate and version = 1 then 1 else 0 end as fresh
      from (select o.process_id, o.n, o.seq, o.action, o.finding_id, o.decision, o.commented, o.reasoned, o.want, o.candidate, w.status as was, w.done, w.pending,
          case when o.candidate is not null then 1 + len(list_filter(w.done, lambda x: x.f = o.finding_id)) end as version,
          case when o.candidate is not null then coalesce(list_last(list_filter(w.done, lambda x: x.f = o.finding_id)).d, 'PENDING') end as before
        from w join o on o.process_id = w.process_id and o.n = w.n + 1)))"""


def decision_log(spark, sf_dir):
    """Each command with its outcome and the states around it."""
    log = D.decision_log(_findings(spark, sf_dir), _commands(spark, sf_dir))
    return log.select("process_id", "seq", "action", "finding_id", "accepted", "refused", "status_before", "version_before", "status_after", "version_after", "process_before", "process_after")


def decision_audit(spark, sf_dir):
    """Audit entries of what was accepted."""
    return D.audit_of(D.decision_log(_findings(spark, sf_dir), _commands(spark, sf_dir))).select("process_id", "seq", "action", "object_id", "before", "after")


def finding_states(spark, sf_dir):
    """Findings as the log leaves them."""
    found = _findings(spark, sf_dir)
    return D.current_findings(found, D.decision_log(found, _commands(spark, sf_dir))).select("finding_id", "inspector_status", "version")


def sync_states(spark, sf_dir):
    """Delivery attempts on every tenth event's place; its number decides on the answer."""
    log = D.decision_log(_findings(spark, sf_dir), _commands(spark, sf_dir))
    k = F.col("event_id")
    tried = read(spark, sf_dir, "events").where("event_id % 10 = 4").select(F.col("user_id").alias("process_id"), ((k * 7919) % 100003 * 4 + 3).alias("seq"), F.when(k % 3 == 0, 200).when(k % 3 == 1, 503).otherwise(404).alias("http"), (k % 6).alias("attempt"))
    return D.sync_state(log, tried, L.sync_outcome(F.col("http"), F.col("attempt")))


QUERIES = {
    "decision_log": (decision_log, f"""{_LOG} select process_id, seq, action, finding_id, refused is null as accepted, refused, case when action = 'decide' then before end as status_before, case when action = 'decide' then version end as version_before,
  case when action = 'decide' then case when refused is null then decision else before end end as status_after, case when action = 'decide' then case when refused is null then version + 1 else version end end as version_after, was as process_before, status as process_after from w where n > 0"""),
    "decision_audit": (decision_audit, f"""{_LOG} select process_id, seq, case when action = 'decide' then 'finding.' else 'process.' end || action as action, case when action = 'decide' then finding_id else process_id end::varchar as object_id,
  case when action = 'decide' then '{{"inspector_status":"' || before || '","version":' || version || '}}' end as before, case when action = 'decide' then '{{"inspector_status":"' || decision || '","version":' || version + 1 || '}}' end as after from w where n > 0 and refused is null"""),
    "finding_states": (finding_states, f"""{_LOG} select f.finding_id, coalesce(arg_max(w.decision, w.seq), 'PENDING') as inspector_status, 1 + count(w.seq) as version from f left join w on w.finding_id = f.finding_id and w.process_id = f.process_id and w.n > 0 and w.refused is null and w.action = 'decide' group by 1"""),
    "sync_states": (sync_states, f"""{_LOG}, a as (select process_id, max(seq) as asked from w where action = 'finalize' and refused is null group by 1),
d as (select user_id as process_id, (event_id * 7919) % 100003 * 4 + 3 as seq, case when event_id % 3 = 0 then 'SYNCED' when event_id % 3 = 1 and event_id % 6 < 4 then 'PENDING_SYNC' else 'SYNC_FAILED' end as o from events where event_id % 10 = 4)
select a.process_id, coalesce(arg_max(o, seq), 'PENDING_SYNC') as sync_status from a left join d on d.process_id = a.process_id and seq > asked group by 1"""),
}
