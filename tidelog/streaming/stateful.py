"""The folds of segmentation and acceptance as streams.

accept_stream() and segment_stream() keep their state in Spark's state store; a batch of one key must fit into a task. accept_to_files() and
segment_to_files() take batches of any size: each is read in ranges side by side, and a key's few numbers are kept with the checkpoint."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.accept import RULES, ConsumerV0, ConsumerV1, Recovery, accepted
from ..operators.segment import segment_sources, step

ACCEPTED = "topic string, part_no long, offset long, epoch long, trans_seq_no long, seq_no long, split_flag long, accepted boolean, can_save_offset boolean"


def accept_stream(pkg: DataFrame, rule: str = "recovery", **options) -> DataFrame:
    """accept() over a stream: a topic partition's state is three numbers. Rows of a batch are put in order of offset."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        r: Recovery | ConsumerV0 | ConsumerV1 = RULES[rule](**options)
        if state.exists:
            r.epoch, r.seq, part, whole = state.get
            if rule != "v0":
                r.part = part
            if rule == "v1":
                r.whole = whole
        pdf = pd.concat(list(frames)).sort_values("offset")
        got = []
        for row in zip(pdf.epoch.tolist(), pdf.trans_seq_no.tolist(), pdf.seq_no.tolist(), pdf.split_flag.tolist()):
            g = r.accept(*row)
            got.append(g if isinstance(g, tuple) else (g, g and row[3] != 1))
        state.update((r.epoch, r.seq, getattr(r, "part", 0), getattr(r, "whole", False)))
        yield pdf.assign(accepted=[g[0] for g in got], can_save_offset=[g[1] for g in got])

    own = pkg.select("topic", "part_no", "offset", "epoch", "trans_seq_no", "seq_no", "split_flag")
    return own.groupBy("topic", "part_no").applyInPandasWithState(run, ACCEPTED, "epoch long, seq long, part long, whole boolean", "append", GroupStateTimeout.NoTimeout)


SEGMENTED = "source string, order_key long, group_no long, boundary string, state string, error boolean, ends boolean, is_ddl boolean"


def segment_stream(ev: DataFrame, base: int = 0) -> DataFrame:
    """ev (source, order_key, boundary) with the state table's outcome: group_no goes up as a group ends; an error drops the open group."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, group, ddl = state.get if state.exists else ("NONE", base + 1, False)
        pdf, out = pd.concat(list(frames)).sort_values("order_key"), []
        for source, order_key, kind in zip(pdf.source, pdf.order_key, pdf.boundary):
            now, error, mark = step(now, kind)
            ddl = ddl or mark
            ends = now == "NONE" and not error
            out.append((source, order_key, group, kind, now, error, ends, ddl))
            if error:
                now, ddl = "NONE", False
            elif ends:
                group, ddl = group + 1, False
        state.update((now, group, ddl))
        yield pd.DataFrame(out, columns=["source", "order_key", "group_no", "boundary", "state", "error", "ends", "is_ddl"])

    return ev.select("source", "order_key", "boundary").groupBy("source").applyInPandasWithState(run, SEGMENTED, "now string, group_no long, ddl boolean", "append", GroupStateTimeout.NoTimeout)


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into a table in memory."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_to_files(df: DataFrame, path: str, checkpoint: str, schema: str) -> DataFrame:
    """Run a stream over all that is there, into Parquet files. A run that is stopped goes on from its checkpoint, and writes nothing twice."""
    q = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(schema).parquet(path)


def batches_to_files(df: DataFrame, step_: Callable[[DataFrame, dict], tuple[DataFrame, dict]], path: str, checkpoint: str, schema: str) -> DataFrame:
    """Run a stream over all that is there, batch by batch: step_(batch, states) gives rows and the states after them. A batch's rows and states are written
    under its number, and a batch that is tried again begins from the states of the one before and replaces both: nothing is written twice."""
    spark = df.sparkSession
    states = lambda n: f"{checkpoint}/folds/{n}"

    def run(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        known = {} if n == 0 else {tuple(json.loads(r["key"])): tuple(json.loads(r["state"])) for r in session.read.schema("key string, state string").json(states(n - 1)).collect()}
        out, after = step_(batch, known)
        out.write.mode("overwrite").parquet(f"{path}/batch-{n:09d}")
        rows = [(json.dumps(k), json.dumps(s)) for k, s in after.items()]
        session.createDataFrame(rows, "key string, state string").coalesce(1).write.mode("overwrite").json(states(n))

    q = df.writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch-*")


def accept_to_files(pkg: DataFrame, path: str, checkpoint: str, rule: str = "recovery", **options) -> DataFrame:
    """accept_stream() into files, for batches of any size. Offsets of a topic partition go up from batch to batch."""
    return batches_to_files(pkg, lambda batch, known: accepted(batch, rule, known, ends=True, **options), path, checkpoint, ACCEPTED)


def segment_to_files(ev: DataFrame, path: str, checkpoint: str, base: int = 0, **options) -> DataFrame:
    """segment_stream() into files, for batches of any size."""
    return batches_to_files(ev, lambda batch, known: segment_sources(batch, known, base, **options), path, checkpoint, SEGMENTED)
