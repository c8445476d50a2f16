"""Fact operators on events and lineitems."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.functions import scalars as S
from tallyline.operators import facts as O
from tallyline.queries.comparison import read


def fact_validate(spark, sf_dir):
    """Reject reasons of facts made of events, with boxes, pages and stages that break here and there."""
    v, e = F.col("value"), F.col("event_id")
    edge = (e % 10) / 10
    t = read(spark, sf_dir, "events").select(
        F.when(e % 11 == 0, " ").otherwise(F.col("event_type")).alias("quote"),
        F.get(F.array(*map(F.lit, ("PD", "RD", "ID", "XX"))), (e % 4).cast("int")).alias("stage"),
        F.when(e % 13 == 0, "").otherwise("M-001").alias("code"),
        (e % 7 - 1).alias("page"),
        F.when(e % 3 == 0, F.array(*[F.lit(0.0)] * 4)).otherwise(F.array(edge, F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("bbox"),
    )
    reason = O.reject_reason(F.col("quote"), F.col("stage"), F.col("code"), F.col("page"), F.col("bbox"))
    return t.groupBy(F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_VALIDATE = """select case when event_id % 11 = 0 then 'empty_quote' when event_id % 4 = 3 then 'bad_stage' when event_id % 13 = 0 then 'empty_param_code' when event_id % 7 = 0 then 'bad_page'
  when event_id % 3 <> 0 and event_id % 10 >= 5 then 'bad_bbox' else 'ok' end as reason, count(*) as n from events group by 1"""


def fact_comparable_json(spark, sf_dir):
    """The comparable value of a normalised value in JSON; broken JSON and other kinds fall back to the raw value."""
    e = F.col("event_id")
    norm = F.when(e % 4 == 0, F.concat(F.lit('{"kind":"number","value":'), F.get_json_object("props", "$.k"), F.lit("}"))).when(e % 4 == 1, F.concat(F.lit('{"kind":"string","value":"'), F.col("event_type"), F.lit('"}'))).when(e % 4 == 2, '{"kind":"bool","value":true}').otherwise("{broken")
    return read(spark, sf_dir, "events").select("event_id", O.comparable(norm, F.concat(F.lit("raw "), F.col("event_type"))).alias("comparable"))


_COMPARABLE = "select event_id, case event_id % 4 when 0 then json_extract_string(props, '$.k') when 1 then event_type else 'raw ' || event_type end as comparable from events"


def fact_dedupe_best(spark, sf_dir):
    """The highest event of each type and user; of equals the first."""
    t = read(spark, sf_dir, "events").select("event_type", F.col("user_id"), F.col("value").alias("confidence"), F.lit(1).alias("page"), F.col("event_id").alias("seq"))
    best = O.best_facts(t.withColumn("user", F.col("user_id").cast("string")), ("event_type", "user"))
    return best.select("event_type", "user_id", F.col("seq").alias("event_id"), F.col("confidence").alias("value"))


_BEST = "select event_type, user_id, event_id, value from (select *, row_number() over (partition by event_type, user_id order by value desc, event_id) as n from events) where n = 1"


def fact_pivot_stages(spark, sf_dir):
    """First returned line's price against the first other line's, by order."""
    t = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("k"), F.when(F.col("l_returnflag") == "N", "PD").otherwise("RD").alias("stage"), F.col("l_extendedprice").alias("value"), F.struct("l_linenumber", "l_extendedprice").alias("seq"))
    return O.pivot_stages(t, ("k",)).select(F.col("k").cast("bigint").alias("l_orderkey"), "expected", "actual")


_PIVOT = "select l_orderkey, arg_min(l_extendedprice, (l_linenumber, l_extendedprice)) filter (l_returnflag = 'N') as expected, arg_min(l_extendedprice, (l_linenumber, l_extendedprice)) filter (l_returnflag <> 'N') as actual from lineitem group by 1"


def input_hash_groups(spark, sf_dir):
    t = read(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("string").alias("fact_id"))
    return O.input_hash(t, ("user_id",))


def fact_uuid5(spark, sf_dir):
    """Name-based fact ids; the SQL checks their form and number."""
    t = read(spark, sf_dir, "events")
    ids = t.select(O.fact_id(F.lit("job"), F.col("user_id").cast("string"), F.lit("M-001"), F.lit(1), F.concat_ws("-", "event_type", "event_id")).alias("id"))
    return ids.agg(F.count_distinct("id").alias("n"), F.count_if(F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).alias("wellformed"))


def incremental_changed_groups(spark, sf_dir):
    """Users whose events differ between the first nine tenths of the ids and all."""
    t = read(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").cast("string").alias("fact_id"))
    last = t.agg(F.max("event_id").alias("m"))
    before = O.input_hash(t.join(F.broadcast(last)).where("event_id * 10 < m * 9"), ("user_id",))
    return O.changed_groups(before, O.input_hash(t, ("user_id",)), ["user_id"])


_CHANGED = """select user_id, case when count(*) filter (event_id * 10 < m * 9) = 0 then 'added' else 'changed' end as change
  from events, (select max(event_id) as m from events) group by 1 having count(*) filter (event_id * 10 >= m * 9) > 0"""


def evidence_union_bbox(spark, sf_dir):
    """Smallest box around the boxes of neighbouring lines."""
    a = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.col("l_discount"), F.lit(0.2), F.lit(0.5), F.lit(0.6)))
    b = F.array(F.lit(0.05), F.col("l_tax"), F.lit(0.4), F.lit(0.9))
    box = S.union_bbox(a, b)
    t = read(spark, sf_dir, "lineitem").select("l_orderkey", box.alias("b"))
    return t.groupBy("l_orderkey").agg(F.min(F.col("b")[0]).alias("x0"), F.min(F.col("b")[1]).alias("y0"), F.max(F.col("b")[2]).alias("x1"), F.max(F.col("b")[3]).alias("y1"))


_UNION = "select l_orderkey, min(case when l_linenumber % 2 = 0 then least(l_discount, 0.05) else 0.05 end) as x0, min(case when l_linenumber % 2 = 0 then least(0.2, l_tax) else l_tax end) as y0, max(case when l_linenumber % 2 = 0 then 0.5 else 0.4 end)::double as x1, 0.9::double as y1 from lineitem group by 1"

QUERIES = {
    "fact_validate": (fact_validate, _VALIDATE),
    "fact_comparable_json": (fact_comparable_json, _COMPARABLE),
    "fact_dedupe_best": (fact_dedupe_best, _BEST),
    "fact_pivot_stages": (fact_pivot_stages, _PIVOT),
    "input_hash_groups": (input_hash_groups, "select user_id, sha256(string_agg(event_id::varchar, '' order by event_id::varchar)) as input_hash from events group by 1"),
    "fact_uuid5": (fact_uuid5, "select count(*) as n, count(*) as wellformed from (select distinct user_id, event_type, event_id from events)"),
    "incremental_changed_groups": (incremental_changed_groups, _CHANGED),
    "evidence_union_bbox": (evidence_union_bbox, _UNION),
}
