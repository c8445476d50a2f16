"""Time limits of jobs as a stream: a job that runs too long starts again, and fails after its retries.

An extension: it is documented, but there is no implementation to match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Times that a job starts again.
RETRIES = 2
#: Groups in which jobs are kept.
GROUPS = 256
ENDED = ("DONE", "FAILED")
_OUT = "job_id {kind}, action string, attempts int, at timestamp"


def ordered_events(frames: Iterator[pd.DataFrame], *more: str) -> list[tuple]:
    """(microseconds, status) and the columns ``more`` by time, of one time by status downwards with nulls last.

    Plain lists: frames joined and sorted for each key took most of its time.
    """
    events = [e for f in frames for e in zip(f["at"].to_numpy().astype("datetime64[us]").astype("int64").tolist(), (None if pd.isna(x) else x for x in f["status"].tolist()), *(f[c].tolist() for c in more))]
    events.sort(key=lambda e: (e[1] is not None, e[1] or ""), reverse=True)
    events.sort(key=lambda e: e[0])
    return events


class JobLimits(StatefulProcessor):
    """Of each job of a group: whether it runs, how often it has started again, and by when it must end.

    A call to the state or to a timer costs far more than an event, so a group's
    jobs share them: one look at the state, one update and one timer, for the
    job that is due first, in each batch.

    What happens depends on the times that events bear, not on how they come in
    batches: before an event is looked at, limits that ran out before it take
    effect. The timer does the same where no event comes. An ended job's state
    goes when ``keep`` seconds have passed; later events of it count as new.
    """

    def __init__(self, kind: str, seconds: float, retries: int, keep: float):
        self.kind, self.limit, self.retries, self.keep = kind, int(seconds * 1000), retries, int(keep * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("jobs", f"job_id array<{self.kind}>, status array<string>, attempts array<int>, due array<bigint>")

    def _moved(self, state: tuple, until: int, job, out: list) -> tuple | None:
        """The state at the time ``until``; None when there is nothing left to keep."""
        status, attempts, due = state
        while status == "RUNNING" and due <= until:
            again = attempts < self.retries
            attempts += again
            out.append((job, "restart" if again else "failed", attempts, due))
            status, due = ("RUNNING", due + self.limit) if again else ("FAILED", due + self.keep)
        return None if status in ENDED and due <= until else (status, attempts, due)

    def _known(self) -> dict:
        """(status, attempts, due) by job."""
        found = self.jobs.get()
        return {job: state for job, *state in zip(*found)} if found else {}

    def _kept(self, jobs: dict, timer: int | None) -> None:
        """Keep the jobs; ``timer`` is the time for which one is set."""
        due = min((state[2] for state in jobs.values()), default=None)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        if jobs:
            self.jobs.update((list(jobs), *map(list, zip(*jobs.values()))))
        else:
            self.jobs.clear()

    def _rows(self, out: list) -> Iterator[pd.DataFrame]:
        if out:
            job, action, attempts, at = map(list, zip(*out))
            yield pd.DataFrame({"job_id": job, "action": action, "attempts": attempts, "at": np.array(at, "datetime64[ms]").astype("datetime64[ns]")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        jobs, out = self._known(), []
        timer = min((state[2] for state in jobs.values()), default=None)
        for us, status, job in ordered_events(rows, "job_id"):
            at, state = us // 1000, jobs.pop(job, None)
            state = self._moved(state, at, job, out) if state else None
            if status in ENDED:
                if state is None or state[0] == "RUNNING":
                    state = status, state[1] if state else 0, at + self.keep
            elif state is None:
                state = "RUNNING", 0, at + self.limit
            jobs[job] = state
        self._kept(jobs, timer)
        yield from self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until, out = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), []  # no earlier event comes any more
        moved = {job: self._moved(state, until, job, out) for job, state in self._known().items()}
        self._kept({job: state for job, state in moved.items() if state}, None)  # Spark drops the timer that ran out
        yield from self._rows(out)

    def close(self) -> None:
        pass


def job_limits(events: DataFrame, seconds: float, delay: str = "0 seconds", retries: int = RETRIES, keep: float | None = None, groups: int = GROUPS) -> DataFrame:
    """(job_id, action, attempts, at) for each time that a job of the stream ``events`` (job_id, status, at) runs out of time.

    ``action`` is ``restart`` up to ``retries`` times, then ``failed``; ``at``
    is when the limit ran out. Statuses other than DONE and FAILED start a job
    that isn't known, and change nothing in one that is: a job started again
    runs from the restart on. The watermark follows ``at`` with the ``delay``:
    Spark drops events that are older, so it must cover how far they come out of
    order. Timers need the RocksDB state store.

    Jobs are kept in ``groups`` by their hash; a task holds the jobs of one that
    run, or ended less than ``keep`` seconds before the watermark. A stream that
    goes on from a checkpoint must have the number that it began with.
    """
    kind = events.schema["job_id"].dataType.simpleString()
    plain = events.where("job_id is not null and at is not null").select("job_id", "status", F.col("at").cast("timestamp").alias("at")).withWatermark("at", delay)
    limit = JobLimits(kind, seconds, retries, seconds * (retries + 2) if keep is None else keep)
    grouped = plain.withColumn("group", F.pmod(F.xxhash64("job_id"), F.lit(groups))).groupBy("group")
    return grouped.transformWithStateInPandas(limit, _OUT.format(kind=kind), "append", "eventTime")
