"""Contracts of events and facts, on documents made of events: the first error of each by place."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.queries.comparison import read
from tallyline.sources import contracts


def _uuid(k):
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(k.cast("string"), 12, "0"))


def _events(spark, sf_dir):
    """Events of the four kinds as JSON, each of eleven in another way broken."""
    k, e = F.col("event_id"), F.col("event_id") % 11
    kind = F.get(F.array(*(F.lit(x) for x in contracts.EVENTS), F.lit("doc.other")), (k % 5).cast("int"))
    ident = F.when(e == 1, F.lit("x")).otherwise(_uuid(k))
    job = F.when(e == 2, F.lit('"job"')).when(e == 3, F.lit("7")).otherwise(F.concat(F.lit('"'), _uuid(k + 1), F.lit('"')))
    quality = F.when(e == 4, "GOOD").otherwise("OK")
    item = F.concat(F.lit('{"file_id":"'), _uuid(k + 2), F.lit('","stage":"'), F.when(e == 5, "XX").when(e == 6, "").otherwise("RD"), F.lit('"}'))
    page = F.when(e == 7, F.lit("0")).when(e == 8, F.lit("1.5")).when(e == 9, F.lit("null")).otherwise(F.lit("3"))
    data = F.concat(F.lit('{"job_id":'), job, F.lit(',"file_id":"'), _uuid(k + 2), F.lit('","storage_key":"'), F.when(e == 10, "").otherwise("s"), F.lit('","quality":"'), quality, F.lit('","facts_key":"f","files":['), item, F.lit(","), item, F.lit('],"page_from":'), page, F.lit("}"))
    more = F.when(k % 13 == 0, ',"extra":1').otherwise("")
    version = F.when(k % 17 == 0, "2").otherwise("1")
    parts = [F.lit('{"event_id":"'), ident, F.lit('","event_type":"'), kind, F.lit('","schema_version":'), version, F.lit(',"occurred_at":"2026-01-01T00:00:00Z","object_id":"'), _uuid(k), F.lit('","process_id":"'), _uuid(k), F.lit('"'), more, F.when(k % 19 == 0, "").otherwise(F.concat(F.lit(',"data":'), data)), F.lit("}")]
    return read(spark, sf_dir, "events").select("event_id", F.concat(*parts).alias("value"))


def event_contracts(spark, sf_dir):
    """The first error of each event, null for sound ones."""
    return contracts.with_event_error(_events(spark, sf_dir), F.try_parse_json("value"), "error").select("event_id", "error")


_CONTRACTS = """with e as (select event_id as k, event_id % 11 as e, event_id % 5 as t from events)
select k as event_id, case when t = 4 then 'foreign' when k % 19 = 0 then '<root>: required data' when k % 13 = 0 then '<root>: additionalProperties'
  when t = 2 and k % 19 <> 0 and e = 5 then 'data/files/0/stage: oneOf'
  when t <> 2 and e = 2 then 'data/job_id: format' when t <> 2 and e = 3 then 'data/job_id: type' when t = 2 and e = 2 then 'data/job_id: format' when t = 2 and e = 3 then 'data/job_id: type'
  when t in (0) and e = 7 then 'data/page_from: minimum' when t in (0, 1) and e = 8 then 'data/page_from: type'
  when t = 1 and e = 4 then 'data/quality: enum' when t = 0 and e = 10 then 'data/storage_key: minLength'
  when e = 1 then 'event_id: format' when k % 17 = 0 then 'schema_version: const' end as error from e"""


def fact_contracts(spark, sf_dir):
    """Lineitems as facts in JSON, some with values that their contract refuses."""
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    box = F.when(k % 7 == 1, "[0,0.5,1]").when(k % 7 == 2, "[0,0,1,1.5]").when(k % 7 == 3, '[0,0,"1",1]').otherwise("[0,0,1,1]")
    norm = F.when(k % 5 == 1, "null").when(k % 5 == 2, '{"value":3}').when(k % 5 == 3, '{"kind":"size"}').otherwise('{"kind":"number","value":2.5}')
    fields = {
        "fact_id": quoted(_uuid(k)), "file_id": quoted(_uuid(k)), "stage": F.when(k % 11 == 0, "null").otherwise('"PD"'), "param_code": F.when(k % 13 == 0, '"M-1"').otherwise('"M-001"'), "value_raw": quoted(F.col("l_returnflag")),
        "value_norm": norm, "page": F.when(k % 17 == 0, "0").otherwise("1"), "bbox": box, "quote": F.when(k % 19 == 0, '""').otherwise('"q"'), "confidence": F.when(k % 23 == 0, "1.01").otherwise("0.5"),
        "method": F.lit('"regex"'), "quality": F.lit('"OK"'), "has_change_notice": F.when(k % 29 == 0, '"no"').otherwise("false"), "extractor_version": F.lit('"1"'),
    }
    body = F.concat_ws(",", *(F.concat(F.lit(f'"{name}":'), v) for name, v in fields.items()))
    made = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey"), F.col("l_linenumber"), F.concat(F.lit("{"), body, F.lit("}")).alias("v"))
    return contracts.with_first_error(made, F.parse_json("v"), contracts.FACT, "error").select("l_orderkey", "l_linenumber", "error")


_FACTS = """select l_orderkey, l_linenumber, case when k % 7 = 1 then 'bbox: minItems' when k % 7 = 2 then 'bbox/3: maximum' when k % 7 = 3 then 'bbox/2: type' when k % 23 = 0 then 'confidence: maximum' when k % 29 = 0 then 'has_change_notice: type'
  when k % 17 = 0 then 'page: minimum' when k % 13 = 0 then 'param_code: pattern' when k % 19 = 0 then 'quote: minLength' when k % 11 = 0 then 'stage: enum'
  when k % 5 = 2 then 'value_norm: required kind' when k % 5 = 3 then 'value_norm/kind: enum' end as error from (select *, l_orderkey * 10 + l_linenumber as k from lineitem)"""

QUERIES = {"event_contracts": (event_contracts, _CONTRACTS), "fact_contracts": (fact_contracts, _FACTS)}
