"""Tables that are worked out once: written in the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder in local mode only."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidelog-")
        sc.setCheckpointDir(found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """df as a written table: what is derived from it in several places is worked out once, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tidelog-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> int:
    """Delete all tables that stored() has left in the shared folder; to be called when no query needs them. The number of tables."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(shared_dir(spark))
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    own = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("tidelog-")] if fs.exists(folder) else []
    return sum(fs.delete(p, True) for p in own)
