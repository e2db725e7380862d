"""What the corpus operators share: reading, cutting lineage, Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stored import stored

#: What ends a lineage; its tables stay in the shared folder until clean_up() of the module it comes from.
store = stored

#: Rows of text handed to Python code at a time, whatever the size of Spark's own batches.
ROWS_AT_A_TIME = 512

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_batch(f: Callable[[dict[str, list]], dict[str, object]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: f gets columns as lists of a few hundred rows and returns columns, of any number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part = batch.slice(at, ROWS_AT_A_TIME)
                out = f({n: c.to_pylist() for n, c in zip(part.schema.names, part.columns, strict=True)})
                yield pa.RecordBatch.from_arrays([pa.array(out[k.name], type=k.type) for k in schema], schema=schema)

    return run


#: A key is hot from this share of all rows on, so that hot keys are as many as its inverse at most.
HOT_SHARE = 1 / 1000


def join_split(left: DataFrame, right: DataFrame, keys: list[str], n: str) -> DataFrame:
    """The inner join of left with right, a stored table of unique keys, whose column n is how many rows of left each key has.

    Keys are null-safe. Hot keys are 1,000 at most: their rows of right are broadcast, so that rows of left that share one are not
    brought together. All others are joined by a shuffle."""
    total = right.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = right.filter(F.col(n) > max(1, total * HOT_SHARE))

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(*[F.col(c).alias(f"_split_{c}") if c in keys else F.col(c) for c in b.columns])
        on = [a[k].eqNullSafe(b[f"_split_{k}"]) for k in keys]
        return a.join(b, on).drop(*[f"_split_{k}" for k in keys])

    if hot.isEmpty():
        return joined(left, right)
    own = hot.select(*[F.col(k).alias(f"_split_{k}") for k in keys])
    rest = left.join(F.broadcast(own), [left[k].eqNullSafe(own[f"_split_{k}"]) for k in keys], "left_anti")
    return joined(left, F.broadcast(hot)).unionByName(joined(rest, right.filter(F.col(n) <= max(1, total * HOT_SHARE))))


def tokenizer_path(name: str) -> str:
    """Where the public tokenizers' files are; TIDELOG_TOKENIZERS names another folder."""
    at = os.environ.get("TIDELOG_TOKENIZERS")
    if at:
        return f"{at}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
