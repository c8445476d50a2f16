"""The outbox relay over events: claims, a batch that is lost, retries, published messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.queries.comparison import read
from tallyline.queries.streams import _work
from tallyline.streaming import relay as R


def _outbox(spark, sf_dir) -> DataFrame:
    """Events as an outbox: views are out already."""
    k = F.col("event_id")
    payload = F.to_json(F.struct(k.cast("string").alias("event_id"), "event_type", F.when(k % 2 == 0, k.cast("string")).alias("correlation_id"), F.struct("value").alias("data")))
    return read(spark, sf_dir, "events").select(
        k.cast("string").alias("event_id"), F.col("event_type").alias("topic"), F.col("user_id").cast("string").alias("msg_key"), payload.alias("payload"), F.lit(0).alias("attempts"),
        F.when(F.col("event_type") == "view", "published").otherwise("pending").alias("status"), F.lit("1970-01-01").cast("timestamp").alias("available_at"), F.col("ts").alias("created_at"),
    )


def _send(row: dict) -> None:
    """A broker that refuses every seventh event once, and every 91st for good."""
    k = int(row["event_id"])
    if k % 91 == 0 or k % 7 == 0 and not row["attempts"]:
        raise ConnectionError("broker")


def _run(spark, sf_dir) -> str:
    """Four passes: all is claimed and published or refused; the next one dies after its claim; then its claim holds; then it has run out."""
    path = _work(spark)
    outbox = _outbox(spark, sf_dir)
    for now, publish in ((1000.0, True), (1060.0, False), (1120.0, True), (1240.0, True)):
        R.tick(outbox, path, now, _send, None, publish=publish)
    return path


def outbox_relay(spark, sf_dir):
    """State of each outbox row after the passes."""
    return R.outbox_state(_outbox(spark, sf_dir), _run(spark, sf_dir), 1300.0).select(F.col("event_id").cast("long").alias("event_id"), "status", "attempts", "last_error")


def outbox_messages(spark, sf_dir):
    """Messages that consumers see, once each."""
    sent = R.published(spark, _run(spark, sf_dir))
    return sent.select(F.col("event_id").cast("long").alias("event_id"), "topic", "msg_key", "attempts", F.to_json("headers").alias("headers"))


QUERIES = {
    "outbox_relay": (outbox_relay, """select event_id, case when event_type = 'view' then 'published' when event_id % 91 = 0 then 'failed' else 'published' end as status,
  case when event_type = 'view' or event_id % 7 <> 0 then 0 when event_id % 91 = 0 then 2 else 1 end::int as attempts, case when event_type <> 'view' and event_id % 91 = 0 then 'broker' end as last_error from events"""),
    "outbox_messages": (outbox_messages, """select event_id, event_type as topic, user_id::varchar as msg_key, case when event_id % 7 = 0 then 1 else 0 end::int as attempts,
  '{"event_type":"' || event_type || '"' || case when event_id % 2 = 0 then ',"correlation_id":"' || event_id || '"' else '' end || '}' as headers from events where event_type <> 'view' and event_id % 91 <> 0"""),
}
