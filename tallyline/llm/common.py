"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows that may be broadcast. Beyond it a join shuffles.
BROADCAST_BYTES = 64 << 20

#: Rows and bytes of a batch handed to a Python worker. The row bound holds for texts of usual length, the byte bound for long ones.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. From here on Python workers of the session get small batches: lower settings stay."""
    for setting, most in ((_BATCH, BATCH_ROWS), (_BATCH_BYTES, BATCH_BYTES)):
        now = spark.conf.get(setting).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(setting, str(most))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which a worker gives back the memory that it no longer uses: it goes on to other tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library can
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see; a temporary one only where none is set and Spark is local."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tallyline.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tallyline-")
        spark.conf.set("tallyline.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tallyline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.saved_path = path
    return back


def forget(*frames: DataFrame) -> None:
    """Delete the files of ``saved`` frames that nothing will read again."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.saved_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _bytes(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(kind, T.StructType):
        return sum((_bytes(column[f.name], f.dataType) for f in kind), F.lit(8))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(column, F.lit(0), lambda a, x: a + _bytes(x, kind.elementType).cast("int")), F.lit(0)) + 16
    return F.lit(8)


def small_or_not(df: DataFrame, most: int | None = None) -> DataFrame:
    """A broadcast hint if the bytes of the (saved) frame's rows, measured, are within the bound."""
    size = df.agg(F.sum(sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(24)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= (BROADCAST_BYTES if most is None else most) else df
