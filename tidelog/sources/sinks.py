"""Files that results go to: checker reports, CSV lines, metrics, checkpoint state, dumps."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = ("flag", "timestamp", "topic", "offset", "gtid", "epoch", "seq_no")


def write_text(df: DataFrame, column: str, path: str, compression: str = "none") -> None:
    df.select(column).write.mode("overwrite").option("compression", compression).text(path)


def checkpoint_json(state: dict[str, object]) -> str:
    """Seven texts; a missing one is left out."""
    return json.dumps({k: str(state[k]) for k in STATE if state.get(k) is not None})


def state_json(states: DataFrame) -> DataFrame:
    """states with state, the JSON text of their seven fields; trans_seq_no is the number."""
    named = [F.col("trans_seq_no" if c == "seq_no" and "trans_seq_no" in states.columns else c).cast("string").alias(c) for c in STATE]
    return states.withColumn("state", F.to_json(F.struct(*named)))


def checkpoint_from_json(text: str) -> dict[str, str]:
    got = json.loads(text)
    if got.get("flag") not in (None, "0", "1"):
        raise ValueError("flag is 0 or 1")
    return got


def versions_of(spark: SparkSession, path: str) -> list[int]:
    """Whole versions of a saved state: those whose write came to its end."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("version=")]
    return sorted(int(p.getName()[8:]) for p in names if fs.exists(hadoop.Path(p, "_SUCCESS")))


def save_state(df: DataFrame, path: str, keep: int = 3) -> int:
    """Write a state table as the next version beside the ones before, of which the last `keep` stay. A write that fails leaves a version
    without its mark, which no reader takes, and the next write starts it anew: the state before is what is read. The number of the version."""
    spark = df.sparkSession
    whole = versions_of(spark, path)
    version = (whole[-1] if whole else 0) + 1
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for old in [*whole, version][:-keep]:
        p = hadoop.Path(f"{path}/version={old}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return version


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """The last whole version. ValueError if there is none."""
    whole = versions_of(spark, path)
    if not whole:
        raise ValueError(f"no state at {path}")
    return spark.read.parquet(f"{path}/version={whole[-1]}")


def rolling(lines: DataFrame, order: str, size: Column, most: int) -> DataFrame:
    """lines with file, the number of the file each goes to: a file ends with the line that brings all lines so far to the next multiple of most
    bytes, so that files hold about most each and every line is whole."""
    from ..functions.sequence import with_running_sum

    return with_running_sum(lines, order, size.cast("long"), "_bytes").withColumn("file", F.floor((F.col("_bytes") - size) / most).cast("long")).drop("_bytes")


def expired(files: DataFrame, now: Column, age: int) -> DataFrame:
    """Files whose last line is older than age seconds."""
    return files.filter(F.col("last_ts") < now - age)


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """name, length, digest, content: files as rows of a table."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("digest"), "content")
