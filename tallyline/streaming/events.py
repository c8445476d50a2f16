"""Event handling as structured streams: decode, exactly-once effect, dead letters, fan-out, fan-in."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyline.sources.contracts import with_event_error

ENVELOPE = "event_id string, event_type string, schema_version int, occurred_at timestamp, correlation_id string, object_id string, process_id string, data string"
# Fields that an event's data must have.
REQUIRED = {
    "doc.parse.requested": "job_id file_id storage_key",
    "doc.parse.completed": "job_id file_id quality",
    "doc.extract.requested": "job_id files",
    "doc.extract.completed": "job_id facts_key",
}


def decode(raw: DataFrame, column: str = "value", strict: bool = False) -> DataFrame:
    """Envelopes of raw JSON with ``invalid``: why one breaks its contract. Malformed JSON is left out, as a consumer skips it.

    Without ``strict`` only fields that must be there are looked for; with it
    ``invalid`` is the first error by the whole contract.
    """
    met = raw.withColumn("_v", F.try_parse_json(column)).where("_v is not null and schema_of_variant(_v) like 'OBJECT%'")
    field = lambda name, kind="string": F.try_variant_get("_v", f"$.{name}", kind)
    if strict:
        met = with_event_error(met, F.col("_v"), "_e")
        return met.select(*(field(n, k).alias(n) for n, k in (part.strip().split(" ") for part in ENVELOPE.split(","))), F.col("_e").alias("invalid"))
    out = met.select(*(field(n, k).alias(n) for n, k in (part.strip().split(" ") for part in ENVELOPE.split(","))))
    missing = [F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in ("event_id", "event_type", "schema_version", "occurred_at", "process_id", "object_id", "data")]
    for kind, fields in REQUIRED.items():
        missing += [F.when((F.col("event_type") == kind) & F.get_json_object("data", f"$.{f}").isNull(), F.lit(f"no data.{f}")) for f in fields.split()]
    return out.withColumn("invalid", F.coalesce(*missing, F.when(~F.col("event_type").isin(*REQUIRED), F.lit("foreign"))))


def first_only(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Each event id once. With ``delay`` the state is bounded by a watermark and a later repeat passes."""
    if delay:
        return events.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def consume(events: DataFrame, handle: Callable[[DataFrame], DataFrame], out: str, dead: str, checkpoint: str, attempts: int = 3, pause: float = 1.0):
    """Run ``handle`` on valid events of each batch; broken ones and events that fail ``attempts`` times go to ``dead``.

    Attempts are ``pause`` seconds apart, then twice as many, and so on. A batch
    that keeps failing is halved by the hash of its event ids until what fails
    is small, so one bad event takes no others with it. Output is written under
    the batch's number and overwritten if the batch repeats, so a restart
    changes nothing.
    """

    def halves(good: DataFrame, path: str, depth: int) -> list[DataFrame]:
        """Handle ``good``; the events that can't be handled, with the reason."""
        for attempt in range(attempts if not depth else 1):
            try:
                handle(good).write.mode("overwrite").parquet(path)
                return []
            except Exception as e:  # noqa: BLE001  whatever the handler raises
                why = str(e)[:500]
                if not depth and attempt < attempts - 1:
                    time.sleep(pause * 2**attempt)
        if depth == 40 or good.select("event_id").distinct().limit(2).count() < 2:
            return [good.withColumn("invalid", F.lit(why))]
        side = F.pmod(F.shiftright(F.xxhash64("event_id"), depth), F.lit(2))
        return [x for n in (0, 1) for x in halves(good.where(side == n), f"{path}/part={depth}{'ab'[n]}", depth + 1)]

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        bad = df.where("invalid is not null and invalid <> 'foreign'")
        good = df.where("invalid is null")
        for failed in halves(good, f"{out}/batch={number}", 0):
            bad = bad.unionByName(failed)
        bad.write.mode("overwrite").parquet(f"{dead}/batch={number}")
        df.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_files(df: DataFrame, out: str, checkpoint: str):
    """Append what is available now to a folder, exactly once."""
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class FanIn(StatefulProcessor):
    """Keeps the status of each of a process's jobs and reports the process once, when all that were announced are terminal.

    Repeated events change nothing; a job that is announced after its end, or
    twice, is one job, and an ended one stays ended.
    """

    ENDED = ("DONE", "FAILED")
    #: Jobs of a process that are put together before its state is asked: each look at the state is a call to Spark.
    HELD = 100_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.jobs = handle.getMapState("jobs", "job_id string", "status string")
        self.counts = handle.getValueState("counts", "known int, ended int")  # so that no batch reads all jobs
        self.reported = handle.getValueState("reported", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        counts = self.counts.get()
        fresh, (known, ended) = counts is None, counts or (0, 0)
        done = not fresh and self.reported.exists()  # whatever comes later changes nothing
        news: dict[str, str] = {}
        for frame in rows:
            for job, status in zip(map(str, frame["job_id"].tolist()), () if done else frame["status"].tolist()):
                if isinstance(status, str) and news.get(job) not in self.ENDED:
                    news[job] = status
                if len(news) == self.HELD:
                    known, ended = self._keep(news, fresh, known, ended)
                    fresh, news = False, {}
        if done:
            return
        if fresh and news and all(status in self.ENDED for status in news.values()):
            known = ended = len(news)  # complete at once: its jobs are never asked for again
        else:
            known, ended = self._keep(news, fresh, known, ended)
        self.counts.update((known, ended))
        if known and known == ended:
            self.reported.update((known,))
            if not fresh:
                self.jobs.clear()
            yield pd.DataFrame({"process_id": [key[0]], "n_jobs": [known]})

    def _keep(self, news: dict[str, str], fresh: bool, known: int, ended: int) -> tuple[int, int]:
        """The counts with ``news`` in the state; a ``fresh`` process has none to look at."""
        for job, status in news.items():
            was = None if fresh else (self.jobs.getValue((job,)) or (None,))[0]
            if was not in self.ENDED and was != status:
                self.jobs.updateValue((job,), (status,))
                known += was is None
                ended += status in self.ENDED
        return known, ended

    def close(self) -> None:
        pass


def fan_in(jobs: DataFrame) -> DataFrame:
    """(process_id, n_jobs), once for each process of the stream ``jobs`` (process_id, job_id, status). Needs the RocksDB state store.

    A process counts as complete when all jobs met so far have ended, so its
    announcements must come before the end of the first of them.
    """
    key = jobs.schema["process_id"].dataType.simpleString()
    return jobs.groupBy("process_id").transformWithStateInPandas(FanIn(), f"process_id {key}, n_jobs int", "append", "none")
