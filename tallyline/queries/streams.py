"""Streams over a folder: each query drains what is there and returns the result."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.queries.comparison import read
from tallyline.streaming import events as E
from tallyline.streaming.timeouts import job_limits


def _work(spark) -> str:
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        import uuid

        return f"{folder.rstrip('/')}/streams-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="tallyline-streams-")


def _envelopes(spark, sf_dir) -> DataFrame:
    """Events as envelopes, every tenth twice, every seventh without its data, every ninth malformed."""
    t = read(spark, sf_dir, "events").withColumn("copy", F.explode(F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    data = F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.struct(F.lit("j").alias("job_id"), F.col("event_id").cast("string").alias("file_id"), F.lit("OK").alias("quality")))
    made = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), F.lit("doc.parse.completed").alias("event_type"), F.lit(1).alias("schema_version"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("occurred_at"), F.col("user_id").cast("string").alias("process_id"), F.lit("o").alias("object_id"), data.alias("data")))
    return t.select(F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("{"), made)).otherwise(made).alias("value"))


def _source(spark, sf_dir) -> tuple[DataFrame, str]:
    work = _work(spark)
    _envelopes(spark, sf_dir).write.text(f"{work}/in")
    return E.decode(spark.readStream.text(f"{work}/in")), work


def stream_dedupe(spark, sf_dir):
    """Valid events, once each."""
    events, work = _source(spark, sf_dir)
    E.to_files(E.first_only(events.where("invalid is null")), f"{work}/out", f"{work}/state").awaitTermination()
    return spark.read.parquet(f"{work}/out").select(F.col("event_id").cast("long").alias("event_id"), F.col("process_id").cast("long").alias("user_id"))


def stream_dlq(spark, sf_dir):
    """Events that break their contract, with the reason."""
    events, work = _source(spark, sf_dir)
    E.consume(events, lambda df: df.select("event_id"), f"{work}/out", f"{work}/dead", f"{work}/state").awaitTermination()
    return spark.read.parquet(f"{work}/dead/batch=*").groupBy("invalid").agg(F.count(F.lit(1)).alias("n"))


def stream_fan_in(spark, sf_dir):
    """Customers whose orders, as jobs, are all terminal: announced once each, though every fifth event comes twice."""
    work = _work(spark)
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("process_id"), F.col("o_orderkey").cast("string").alias("job_id"), "o_orderstatus")
    orders = orders.union(orders.where("cast(job_id as long) % 5 = 0"))  # every fifth is delivered twice
    jobs = orders.select("process_id", "job_id", F.lit("REQUESTED").alias("status")).union(orders.where("o_orderstatus <> 'P'").select("process_id", "job_id", F.when(F.col("o_orderstatus") == "F", "DONE").otherwise("FAILED")))
    jobs.write.parquet(f"{work}/in")
    with_timers(spark, lambda: E.to_files(E.fan_in(spark.readStream.schema(jobs.schema).parquet(f"{work}/in")), f"{work}/out", f"{work}/state").awaitTermination())
    return spark.read.parquet(f"{work}/out").select("process_id", F.col("n_jobs").cast("long").alias("n_jobs"))


def with_timers(spark, run):
    """``run()`` with the state store that timers need, on twice as many partitions as cores at most: each has a store and a worker of its own to start in every batch."""
    partitions = "spark.sql.shuffle.partitions"
    conf = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        partitions: str(min(int(spark.conf.get(partitions)), 2 * spark.sparkContext.defaultParallelism)),
    }
    was = {key: spark.conf.get(key) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        return run()
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)


def _in_time_order(rows: DataFrame, folder: str, slices: int = 4) -> tuple[int, int]:
    """Write ``rows`` so that a stream meets their times in order but for a slice of them: (files a slice at most, seconds of a slice).

    A stream takes files by the time they were written, so slices are written one after another.
    """
    n = rows.sparkSession.sparkContext.defaultParallelism
    second = F.unix_seconds("at")
    first, last = rows.agg(F.min(second), F.max(second)).first()
    width = 1 if first is None else (last - first) // slices + 1
    number = F.when(F.col("at").isNotNull(), F.floor((second - F.lit(first)) / width))  # a row without a time is in the first
    for i in range(slices):
        rows.where(F.coalesce(number, F.lit(0)) == i).repartition(n).write.mode("append").parquet(folder)
    return n, width


def stream_job_timeouts(spark, sf_dir):
    """Events as jobs of an hour at most: views end in time, clicks after an hour and a half, errors fail at two and a half, the rest never end."""
    work = _work(spark)
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    late = F.create_map(*map(F.lit, ("view", 600, "click", 5400, "error", 9000)))[F.col("event_type")]
    ends = events.where(late.isNotNull()).select("event_id", F.when(F.col("event_type") == "error", "FAILED").otherwise("DONE").alias("status"), F.timestamp_seconds(F.unix_timestamp("ts") + late).alias("at"))
    rows = events.select("event_id", F.lit("RUNNING").alias("status"), F.timestamp_seconds(F.unix_timestamp("ts")).alias("at")).union(ends)
    files, seconds = _in_time_order(rows.withColumnRenamed("event_id", "job_id"), f"{work}/in")
    # a day later something else happens, so that all limits run out
    spark.range(1, 4).select(F.lit(-1).cast("long").alias("job_id"), F.lit("DONE").alias("status"), (F.lit("2100-01-01").cast("timestamp") + F.make_dt_interval(F.col("id").cast("int"))).alias("at")).repartitionByRange(3, "at").write.mode("append").parquet(f"{work}/in")
    stream = spark.readStream.schema("job_id long, status string, at timestamp").option("maxFilesPerTrigger", files).parquet(f"{work}/in")
    with_timers(spark, lambda: E.to_files(job_limits(stream, 3600, f"{seconds} seconds"), f"{work}/out", f"{work}/state").awaitTermination())
    return spark.read.parquet(f"{work}/out")


QUERIES = {
    "stream_dedupe": (stream_dedupe, "select event_id, user_id from events where event_id % 7 <> 0 and event_id % 9 <> 0"),
    "stream_dlq": (stream_dlq, "select 'no data' as invalid, sum(case when event_id % 10 = 0 then 2 else 1 end)::bigint as n from events where event_id % 7 = 0 and event_id % 9 <> 0"),
    "stream_fan_in": (stream_fan_in, "select o_custkey as process_id, count(*) as n_jobs from orders group by 1 having count(*) filter (o_orderstatus = 'P') = 0"),
    "stream_job_timeouts": (stream_job_timeouts, """select event_id as job_id, case when n < 3 then 'restart' else 'failed' end as action, least(n, 2)::int as attempts, date_trunc('second', ts) + n * interval 1 hour as at
  from events cross join (values (1), (2), (3)) x(n) where event_type not in ('view') and (event_type <> 'click' or n = 1) and (event_type <> 'error' or n < 3)"""),
}
