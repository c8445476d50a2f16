"""The relay's sink under lost batches: nothing is lost, nothing comes twice."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tallyline.streaming import relay as R


def row(i: int, **more) -> dict:
    return {"event_id": str(i), "topic": "t", "msg_key": "k", "headers": [], "payload": "{}", "attempts": 0, "batch": "b", "status": "published", "last_error": None, "at": 1.0} | more


def ids(spark, path) -> list[str]:
    return sorted(r.event_id for r in R.published(spark, str(path)).collect())


def test_staged_files_are_nobodys(spark, tmp_path):
    log = R.Log(str(tmp_path))
    lost = log.stage("b", map(row, range(3)))
    assert log.stage("b", iter([])) is None and ids(spark, tmp_path) == []
    kept = log.stage("b", map(row, range(12000)))
    assert log.commit("b", [kept]) and len(ids(spark, tmp_path)) == 12000
    again = log.stage("b", map(row, range(5)))
    assert not log.commit("b", [again]) and not log.exists("_staging", again) and log.exists("_staging", lost)
    assert len(ids(spark, tmp_path)) == 12000


def test_cut_off_while_files_move(spark, tmp_path):
    log = R.Log(str(tmp_path))
    files = [log.stage("b", map(row, range(i, i + 2))) for i in (0, 2)]
    move = log.system.move
    moved = []

    class Dying:
        def __getattr__(self, name):
            return getattr(log_system, name)

        def move(self, source, to):
            if "/messages/" in to and moved:
                raise KeyboardInterrupt
            moved.append(to)
            move(source, to)

    log_system, log.system = log.system, Dying()
    with pytest.raises(KeyboardInterrupt):
        log.commit("b", files)
    log.system = log_system
    assert R.Log(str(tmp_path)).recover() == ["b"] and R.Log(str(tmp_path)).recover() == []
    assert ids(spark, tmp_path) == ["0", "1", "2", "3"]


def outbox(spark, n=20):
    k = F.col("id")
    return spark.range(n).select(k.cast("string").alias("event_id"), F.lit("t").alias("topic"), F.lit("o").alias("msg_key"), F.lit('{"event_type":"x"}').alias("payload"), F.lit(0).alias("attempts"), F.lit("pending").alias("status"), F.lit("1970-01-01").cast("timestamp").alias("available_at"), F.timestamp_seconds(k).alias("created_at"))


def test_ticks(spark, tmp_path):
    box, path = outbox(spark), str(tmp_path)

    def send(message):
        if message["event_id"] == "3" and message["attempts"] < 2:
            raise TimeoutError("slow")

    assert R.tick(box, path, 100.0, send, limit=5) and ids(spark, path) == ["0", "1", "2", "4"]
    state = {r.event_id: r for r in R.outbox_state(box, path, 101.0).collect()}
    assert (state["3"].status, state["3"].attempts, state["3"].last_error, state["3"].available_at.second) == ("failed", 1, "slow", 42) and state["7"].status == "pending"
    R.tick(box, path, 101.0, send, limit=5)  # the failed one isn't due yet
    assert len(ids(spark, path)) == 9
    dead = R.tick(box, path, 102.0, send, limit=5, publish=False)  # dies with its claim; the failed one is in it
    held = R.outbox_state(box, path, 110.0).where("status = 'publishing'")
    assert dead and held.count() == 5 and {r.event_id for r in held.collect()} == {"3", "10", "11", "12", "13"}
    R.tick(box, path, 103.0, send, limit=100)
    assert len(ids(spark, path)) == 15
    R.tick(box, path, 102.0 + R.LEASE + 1, send, limit=100)
    assert len(ids(spark, path)) == 19
    assert R.tick(box, path, 400.0, send, limit=100) and ids(spark, path) == sorted(map(str, range(20)))
    assert R.tick(box, path, 500.0, send) is None
    assert R.published(spark, path).first().headers == {"event_type": "x"}


def test_late_batch_is_refused(spark, tmp_path):
    spark.dataSource.register(R.sink("late_relay"))
    rows = outbox(spark, 3).select("event_id", "topic", "msg_key", F.create_map().cast("map<string,string>").alias("headers"), "payload", "attempts")
    writer = rows.write.format("late_relay").option("path", str(tmp_path)).option("batch", "b").option("now", "200").mode("append")
    with pytest.raises(Exception, match="run out"):
        writer.option("deadline", "199").save()
    assert ids(spark, tmp_path) == [] and not [f for f in os.listdir(tmp_path / "_staging") if f.endswith(".parquet")]
    writer.option("deadline", "201").save()
    writer.option("deadline", "201").save()
    assert ids(spark, tmp_path) == ["0", "1", "2"]


@pytest.mark.parametrize("when", ["before", "after"])
def test_killed_stream_batch(spark, tmp_path, when):
    """A stream's batch dies before or after it is committed; the restarted query writes it again."""
    flag, out = tmp_path / "flag", str(tmp_path / "out")
    name = f"dying_{when}"

    class Dying(R.sink(name)):
        def streamWriter(self, schema, overwrite):  # noqa: N802
            import os

            from tallyline.streaming.relay import _Writer

            class Writer(_Writer):
                def commit(self, messages, batchId=None):  # noqa: N803
                    dies = os.path.exists(str(flag))
                    if dies:
                        os.remove(str(flag))
                    if dies and when == "before":
                        raise RuntimeError("killed")
                    super().commit(messages, batchId)
                    if dies:
                        raise RuntimeError("killed")

            return Writer(self.options, None, True)

    spark.dataSource.register(Dying)

    def drain():
        rows = spark.readStream.schema("event_id string").json(str(tmp_path / "in")).select("event_id", F.lit("t").alias("topic"), F.lit("k").alias("msg_key"), F.create_map().cast("map<string,string>").alias("headers"), F.lit("{}").alias("payload"), F.lit(0).alias("attempts"))
        query = rows.writeStream.format(name).option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()

    spark.range(50).select(F.col("id").cast("string").alias("event_id")).repartition(3).write.json(str(tmp_path / "in"))
    flag.write_text("")
    with pytest.raises(Exception, match="killed"):
        drain()
    assert len(ids(spark, out)) == (0 if when == "before" else 50)
    drain()
    spark.range(50, 60).select(F.col("id").cast("string").alias("event_id")).write.mode("append").json(str(tmp_path / "in"))
    drain()
    assert ids(spark, out) == sorted(map(str, range(60)))
