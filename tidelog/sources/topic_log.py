"""A topic as a Parquet log with the columns of Spark's Kafka source, so that the real source is a change of one line."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "topic string, partition int, offset long, timestamp timestamp, key string, value binary"


def read(spark: SparkSession, path: str, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Messages with start <= offset < stop. The range reaches the Parquet scan."""
    df = spark.read.parquet(path)
    check_range(start, stop)
    df = df.filter(F.col("offset") >= start) if start is not None else df
    return df.filter(F.col("offset") < stop) if stop is not None else df


def check_range(start: int | None, stop: int | None) -> None:
    if start is not None and start < 0 or stop is not None and start is not None and stop < start:
        raise ValueError(f"no such range: {start} to {stop}")


def read_stream(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def watermarks(log: DataFrame) -> DataFrame:
    """First offset and the one after the last, by partition."""
    return log.groupBy("topic", "partition").agg(F.min("offset").alias("low"), (F.max("offset") + 1).alias("high"))


def metadata(log: DataFrame) -> DataFrame:
    """Topics with their partitions, messages, and first and next offsets."""
    return log.groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("messages"), F.min("offset").alias("low"), (F.max("offset") + 1).alias("high"))


def scan(log: DataFrame, end: int | None = None, most: int | None = None) -> DataFrame:
    """Messages in order up to an offset, and at most some."""
    df = log.filter(F.col("offset") <= end) if end is not None else log
    return df.orderBy("offset").limit(most) if most is not None else df


def partition_of(gtid, n: int):
    """Partition of a topic of several; one is usual."""
    return F.pmod(F.xxhash64(gtid), F.lit(n))


def write(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def with_offsets(df: DataFrame, order: str, start: int = 0) -> DataFrame:
    """Messages with the offsets that a sink gives them: consecutive, in the order of a column."""
    from ..functions.sequence import with_running_sum
    from ..functions.stored import stored

    return with_running_sum(stored(df), order, F.lit(1).cast("long"), "_place").withColumn("offset", F.col("_place") - 1 + start).drop("_place")


def deliver(df: DataFrame, path: str, tries: int = 5, pause: float = 0.2) -> int:
    """Append a batch to a topic; a write that fails is tried again after a pause, tries times in all, and then raises. The number of attempts.
    A failed attempt leaves no messages: files count only when the write is committed."""
    for attempt in range(1, tries + 1):
        try:
            write(df, path)
            return attempt
        except Exception:
            if attempt == tries:
                raise
            time.sleep(pause)
    return tries


def write_stream(df: DataFrame, path: str, checkpoint: str, batch_rows: int | None = None):
    """A stream into a topic. Spark hands on the next batch only when the one before is written, which is the back-pressure."""
    return df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: deliver(batch, path) and None)


def acknowledged(pkg: DataFrame, acks: DataFrame) -> DataFrame:
    """Packages up to the first that is not acknowledged: pkg (trans_seq_no, seq_no, ...) with the offset of its acknowledgement, acks
    (trans_seq_no, seq_no, offset). A package acknowledged twice has its last offset."""
    a = acks.groupBy("trans_seq_no", "seq_no").agg(F.max("offset").alias("offset"))
    all_ = pkg.drop("offset").join(a, ["trans_seq_no", "seq_no"], "left")
    first = all_.filter("offset is null").agg(F.min(F.struct("trans_seq_no", "seq_no")).alias("_gap"))
    return all_.join(F.broadcast(first), F.col("_gap").isNull() | (F.struct("trans_seq_no", "seq_no") < F.col("_gap"))).drop("_gap")  # one row is broadcast
