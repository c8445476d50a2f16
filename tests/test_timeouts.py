"""Jobs that run out of time: the same restarts and failures however events come in batches, and over a restart of the stream."""

from __future__ import annotations

import datetime as dt

import pytest

from tallyline.queries.streams import with_timers
from tallyline.streaming import events as E
from tallyline.streaming.timeouts import job_limits

SCHEMA = "job_id string, status string, at timestamp"


def at(seconds: int) -> dt.datetime:
    return dt.datetime(2026, 1, 1) + dt.timedelta(seconds=seconds)


#: Events by batch; the limit is 100 seconds.
BATCHES = [
    [("stuck", "RUNNING", 0), ("quick", "RUNNING", 0), ("slow", "RUNNING", 10), ("late", "RUNNING", 0)],
    [("quick", "DONE", 50), ("stuck", "RUNNING", 90), ("other", "DONE", 60)],
    [("slow", "DONE", 150), ("clock", "DONE", 160)],
    [("clock", "DONE", 250)],
    [("late", "FAILED", 290), ("clock", "DONE", 600)],
    [("clock", "DONE", 2000)],
    [("stuck", "DONE", 2100), ("quick", "RUNNING", 2100), ("clock", "DONE", 2120)],
    [("clock", "DONE", 5000)],
    [("clock", "DONE", 6000)],
]
WANT = [
    ("late", "restart", 1, 100), ("late", "restart", 2, 200), ("quick", "failed", 2, 2400), ("quick", "restart", 1, 2200), ("quick", "restart", 2, 2300),
    ("slow", "restart", 1, 110), ("stuck", "failed", 2, 300), ("stuck", "restart", 1, 100), ("stuck", "restart", 2, 200),
]


@pytest.mark.parametrize("together", [1, 2, 3])
def test_replay(spark, tmp_path, together):
    """Each group of batches is a run of the query of its own: what the state holds survives."""

    def drain():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        with_timers(spark, lambda: E.to_files(job_limits(stream, 100), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination())

    for first in range(0, len(BATCHES), together):
        rows = [(j, s, at(t)) for batch in BATCHES[first : first + together] for j, s, t in batch]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if first % 2 or first + together >= len(BATCHES):
            drain()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.job_id, r.action, r.attempts, int((r["at"] - at(0)).total_seconds())) for r in got) == WANT


def test_events_of_a_job_are_ordered_without_frames():
    import pandas as pd

    from tallyline.streaming.timeouts import ordered_events

    at = pd.to_datetime(["2026-01-01 00:00:01.0005", "2026-01-01 00:00:01.0004", "2026-01-01 00:00:01.0004", "2026-01-01 00:00:01.0004"])
    frame = pd.DataFrame({"at": at, "status": ["DONE", None, "DONE", "RUNNING"]})
    first = int(at[1].value // 1000)
    got = ordered_events(iter([frame[:2], frame[2:]]))
    assert got == [(first, "RUNNING"), (first, "DONE"), (first, None), (first + 100, "DONE")]


def test_query_on_events_in_several_files(spark, tmp_path):
    """A stream takes files as they were written, not by time: no event may count as late for that."""
    from pyspark.sql import functions as F

    from tallyline.queries.streams import stream_job_timeouts

    kinds = ["view", "click", "error", "signup"]
    rows = spark.range(400).select(
        F.col("id").alias("event_id"), F.col("id").alias("user_id"), F.array(*map(F.lit, kinds))[(F.col("id") % 4).cast("int")].alias("event_type"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 977 % 400 * 5000).alias("ts"),
    )
    rows.repartitionByRange(6, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # a task for each file
    try:
        found = stream_job_timeouts(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = sorted((r.job_id, r.attempts, r.action, int(r["at"].timestamp())) for r in found)
    limits = {"view": 0, "click": 1, "error": 2, "signup": 3}
    want = sorted((r.event_id, min(n, 2), "failed" if n == 3 else "restart", int(r.ts.timestamp()) + 3600 * n) for r in rows.collect() for n in range(1, limits[r.event_type] + 1))
    assert got == want


def test_jobs_of_a_group_share_calls_to_the_state():
    import pandas as pd

    from tallyline.streaming.timeouts import JobLimits

    class Value:
        calls, value = 0, None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def clear(self):
            self.calls, self.value = self.calls + 1, None

    class Handle:
        state, timers, calls = Value(), set(), 0

        def getValueState(self, *_):  # noqa: N802  Spark's name
            return self.state

        def registerTimer(self, at):  # noqa: N802
            self.calls += 1
            self.timers.add(at)

        def deleteTimer(self, at):  # noqa: N802
            self.calls += 1
            self.timers.remove(at)

    class Times:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 150_000

        getExpiryTimeInMs = lambda self: 100_000  # noqa: E731, N815

    handle, jobs = Handle(), JobLimits("bigint", 100, 2, 400)
    jobs.init(handle)
    frame = pd.DataFrame({"job_id": range(1000), "status": "RUNNING", "at": pd.to_datetime([i % 10 for i in range(1000)], unit="s")})
    assert not list(jobs.handleInputRows((0,), iter([frame]), Times()))
    assert handle.timers == {100_000} and handle.state.calls + handle.calls <= 4
    handle.timers.clear()  # Spark drops the timer that ran out
    out = list(jobs.handleExpiredTimer((0,), Times(), Times()))
    assert [len(f) for f in out] == [1000] and set(out[0]["attempts"]) == {1}
    assert handle.timers == {200_000} and handle.state.calls + handle.calls <= 8
