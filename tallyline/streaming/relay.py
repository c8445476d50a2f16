"""Outbox relay: claim, publish, mark, with a sink that publishes a batch as a whole or not at all.

The sink stages what its tasks write, and a batch counts once its list of files
stands in the commit log; then the files move to where readers look. A batch
that is killed before that leaves files that nobody reads; one that is killed
after it is completed at the next start; one that is written again is dropped.
Published rows are their own mark, so there is no moment between publishing and
marking. The folder must be one that the driver and all executors share.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tallyline.functions import scalars as S

#: Seconds after which a claim without an outcome no longer holds.
LEASE = 120
#: What the sink takes, and what it leaves for each row: published, or failed with the error.
MESSAGE = "event_id string, topic string, msg_key string, headers map<string,string>, payload string, attempts int"
OUTCOME = f"{MESSAGE}, batch string, status string, last_error string, at double"
_ROW = pa.schema([*((c, pa.string()) for c in ("event_id", "topic", "msg_key")), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.string()), ("attempts", pa.int32()), ("batch", pa.string()), ("status", pa.string()), ("last_error", pa.string()), ("at", pa.float64())])
_CLAIM = "event_id string, batch string, at double"
_GROUP = 5000

Sender = Callable[[dict], None]


class ClosedBatch(RuntimeError):
    """A batch that came too late: its rows may have been claimed by another."""


class Log:
    """Staged files, the commit log and the messages under one folder."""

    def __init__(self, path: str):
        self.system, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.root = self.root.rstrip("/")

    def at(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def exists(self, *parts: str) -> bool:
        return self.system.get_file_info(self.at(*parts)).type != fs.FileType.NotFound

    def names(self, folder: str) -> list[str]:
        found = self.system.get_file_info(fs.FileSelector(self.at(folder), allow_not_found=True))
        return sorted(f.base_name for f in found)

    def stage(self, batch: str, rows: Iterator[dict]) -> str | None:
        """Write rows to a file of their own; its name, or None without rows."""
        writer, held = None, []
        name = f"{batch}-{uuid.uuid4().hex}.parquet"
        self.system.create_dir(self.at("_staging"))

        def flush() -> None:
            nonlocal writer
            writer = writer or pq.ParquetWriter(self.at("_staging", name), _ROW, filesystem=self.system)
            writer.write_batch(pa.RecordBatch.from_pylist(held, _ROW))
            held.clear()

        for row in rows:
            held.append(row)
            if len(held) == _GROUP:
                flush()
        if held:
            flush()
        if writer:
            writer.close()
        return name if writer else None

    def commit(self, batch: str, files: list[str]) -> bool:
        """Make a batch count; False if it does already, and then these files go."""
        if self.exists("_commits", f"{batch}.json") or self.exists("_done", f"{batch}.json"):
            self.drop(files)
            return False
        self.system.create_dir(self.at("_commits"))
        draft = self.at("_staging", f"{batch}-{uuid.uuid4().hex}.json")
        self.system.create_dir(self.at("_staging"))
        with self.system.open_output_stream(draft) as out:
            out.write(json.dumps({"batch": batch, "files": files}).encode())
        self.system.move(draft, self.at("_commits", f"{batch}.json"))
        self.complete(batch)
        return True

    def complete(self, batch: str) -> None:
        """Move a committed batch's files to the messages; may be repeated."""
        with self.system.open_input_stream(self.at("_commits", f"{batch}.json")) as listed:
            files = json.loads(listed.read())["files"]
        self.system.create_dir(self.at("messages"))
        self.system.create_dir(self.at("_done"))
        for name in files:
            if self.exists("_staging", name):
                self.system.move(self.at("_staging", name), self.at("messages", name))
        self.system.move(self.at("_commits", f"{batch}.json"), self.at("_done", f"{batch}.json"))

    def recover(self) -> list[str]:
        """Complete batches that were cut off while their files moved."""
        left = [name.removesuffix(".json") for name in self.names("_commits") if name.endswith(".json")]
        for batch in left:
            self.complete(batch)
        return left

    def drop(self, files: list[str]) -> None:
        for name in files:
            if self.exists("_staging", name):
                self.system.delete_file(self.at("_staging", name))


@dataclass
class _Staged(WriterCommitMessage):
    file: str | None


class _Writer(DataSourceWriter, DataSourceStreamWriter):
    """Writes a batch of ``MESSAGE`` rows. Options: path, batch (of a stream: its number), deadline in seconds since 1970."""

    def __init__(self, options: dict, send: Sender | None, streams: bool):
        self.path, self.batch = options["path"], options.get("batch")
        self.deadline = float(options["deadline"]) if "deadline" in options else None
        self.now = float(options["now"]) if "now" in options else None
        self.send, self.streams = send, streams

    def _sent(self, iterator: Iterator) -> Iterator[dict]:
        for row in iterator:
            row = row.asDict()
            error = None
            if self.send is not None:
                try:
                    self.send(row)
                except Exception as e:  # noqa: BLE001  whatever a broker's client raises
                    error = str(e)[:500]
            yield row | {"headers": list((row["headers"] or {}).items()), "attempts": (row["attempts"] or 0) + (error is not None), "batch": self.batch or "", "status": "failed" if error else "published", "last_error": error, "at": self.now if self.now is not None else time.time()}

    def write(self, iterator: Iterator) -> _Staged:
        return _Staged(Log(self.path).stage(self.batch or "stream", self._sent(iterator)))

    def commit(self, messages: list[_Staged | None], batchId: int | None = None) -> None:  # noqa: N803  Spark's name
        log, files = Log(self.path), [m.file for m in messages if m and m.file]
        now = self.now if self.now is not None else time.time()
        if self.deadline is not None and now > self.deadline:
            log.drop(files)
            raise ClosedBatch(f"the claim of batch {self.batch} has run out")
        log.recover()
        log.commit(self.batch or f"stream-{batchId}", files)

    def abort(self, messages: list[_Staged | None], batchId: int | None = None) -> None:  # noqa: N803
        Log(self.path).drop([m.file for m in messages if m and m.file])


def sink(name: str, send: Sender | None = None) -> type[DataSource]:
    """A data source to register: ``df.write.format(name)`` and ``df.writeStream.format(name)``.

    ``send`` hands a row to a broker and raises if it can't; the file log is
    exact, a broker outside it gets a row again if its batch is killed.
    """

    class Relay(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            return _Writer(self.options, send, False)

        def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802  Spark's name
            return _Writer(self.options, send, True)

    return Relay


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """What batches have left (``OUTCOME``): each attempt at each message."""
    if not Log(path).exists("messages"):
        return spark.createDataFrame([], OUTCOME)
    return spark.read.schema(OUTCOME).parquet(f"{path}/messages")


def published(spark: SparkSession, path: str) -> DataFrame:
    return outcomes(spark, path).where("status = 'published'")


def _claims(spark: SparkSession, path: str) -> DataFrame:
    if not Log(path).exists("claims"):
        return spark.createDataFrame([], _CLAIM)
    return spark.read.schema(_CLAIM).parquet(f"{path}/claims")


def outbox_state(outbox: DataFrame, path: str, now: float, lease: float = LEASE) -> DataFrame:
    """``outbox`` (event_id, status, attempts, available_at, ...) as its claims and outcomes under ``path`` leave it.

    A claim without an outcome makes a row ``publishing`` for ``lease`` seconds,
    then it is pending again. A failed row is available after the backoff of its
    attempts. The join is by event id, of one row a side.
    """
    spark = outbox.sparkSession
    tried = outcomes(spark, path).groupBy("event_id").agg(F.max_by(F.struct("status", "attempts", "last_error", "at", "batch"), "at").alias("o"))
    held = _claims(spark, path).groupBy("event_id").agg(F.max_by(F.struct("at", "batch"), "at").alias("c"))
    met = outbox.join(tried, "event_id", "left").join(held, "event_id", "left")
    open_ = F.col("c").isNotNull() & (F.col("o").isNull() | (F.col("o.batch") != F.col("c.batch")))
    was = F.coalesce("o.status", "status")
    status = F.when(was == "published", was).when(open_ & (F.lit(now) - F.col("c.at") <= lease), "publishing").when(open_, "pending").otherwise(was)
    attempts = F.coalesce("o.attempts", "attempts", F.lit(0))
    due = F.when(F.col("o.status") == "failed", F.timestamp_seconds(F.col("o.at") + S.relay_backoff(attempts))).otherwise(F.col("available_at"))
    changed = {"status": status, "attempts": attempts.cast("int"), "available_at": due, "last_error": F.col("o.last_error"), "locked_at": F.when(status == "publishing", F.timestamp_seconds("c.at"))}
    kept = [c for c in outbox.columns if c not in changed]
    return met.select(*kept, *(v.alias(c) for c, v in changed.items()))


def headers_of(payload: Column) -> Column:
    """The event's type, and its correlation id where it has one."""
    kind, link = (F.get_json_object(payload, f"$.{f}") for f in ("event_type", "correlation_id"))
    return F.map_concat(F.create_map(F.lit("event_type"), F.coalesce(kind, F.lit(""))), F.when(F.coalesce(link, F.lit("")) != "", F.create_map(F.lit("correlation_id"), link)).otherwise(F.create_map().cast("map<string,string>")))


def tick(outbox: DataFrame, path: str, now: float, send: Sender | None = None, limit: int | None = 100, lease: float = LEASE, publish: bool = True) -> str | None:
    """One pass: complete what was cut off, claim up to ``limit`` due rows, the oldest first, and publish them as one batch.

    Returns the batch's name, None if nothing was due. ``publish=False`` stops
    after the claim, as a relay that dies there. One relay works on a folder at
    a time; a batch that ends after its lease is refused.
    """
    from tallyline.operators.report import claimable

    spark = outbox.sparkSession
    Log(path).recover()
    batch = uuid.uuid4().hex
    state = outbox_state(outbox, path, now, lease)
    due = claimable(state, F.timestamp_seconds(F.lit(now)), limit) if limit else state.where(F.col("status").isin("pending", "failed") & (F.col("available_at") <= F.timestamp_seconds(F.lit(now))))
    due.select("event_id", F.lit(batch).alias("batch"), F.lit(float(now)).alias("at")).write.mode("append").parquet(f"{path}/claims")
    mine = _claims(spark, path).where(F.col("batch") == batch).select("event_id")
    if mine.isEmpty():
        return None
    if publish:
        name = f"relay_{batch}"
        spark.dataSource.register(sink(name, send))
        rows = state.join(mine, "event_id", "left_semi").select("event_id", "topic", "msg_key", headers_of(F.col("payload")).alias("headers"), "payload", "attempts")
        rows.write.format(name).option("path", path).option("batch", batch).option("now", str(now)).option("deadline", str(now + lease)).mode("append").save()
    return batch
