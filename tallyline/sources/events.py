"""Event streams: a Kafka topic or a folder of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def kafka_events(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Raw (key, value) text of a topic from its beginning; needs Spark's Kafka package on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("kafka.isolation.level", "read_committed").load()
    return raw.selectExpr("cast(key as string) as key", "cast(value as string) as value")


def file_events(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Raw value lines of a folder, a bounded number of files a batch."""
    return spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder)


def in_key_order(events: DataFrame) -> DataFrame:
    """Events (key, seq, ...) so dealt that one task has all of a key and writes them by seq."""
    return events.repartition("key").sortWithinPartitions("key", "seq")


def to_kafka(events: DataFrame, servers: str, topic: str, state: str) -> StreamingQuery:
    """Publish a stream of events (key, seq, value), each key's in order; needs Spark's Kafka package on the class path."""

    def publish(batch: DataFrame, _: int) -> None:
        in_key_order(batch).selectExpr("cast(key as string) as key", "cast(value as string) as value").write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()

    return events.writeStream.foreachBatch(publish).option("checkpointLocation", state).trigger(availableNow=True).start()
