"""A tree of small values with versions, as a table of changes: path, version, value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(changes: DataFrame) -> DataFrame:
    """The value of each path: that of its highest version. A null value deletes the path."""
    return changes.groupBy("path").agg(F.max("version").alias("version"), F.max_by("value", "version").alias("value")).filter("value is not null")


def set_value(changes: DataFrame, path: str, value: str, expected: int | None = None) -> DataFrame:
    """changes with a new version of a path; ValueError if expected is given and is not its version."""
    now = changes.filter(F.col("path") == path).agg(F.max("version")).first()[0]
    if expected is not None and now != expected:
        raise ValueError(f"{path} is at version {now}, not {expected}")
    return changes.unionByName(changes.sparkSession.createDataFrame([(path, (now or 0) + 1, value)], "path string, version long, value string"))


def children(nodes: DataFrame, path: str) -> DataFrame:
    """child: names right below a path, of nodes (path), whether or not they are nodes themselves."""
    start = path.rstrip("/") + "/"
    below = nodes.filter(F.col("path").startswith(start))
    return below.select(F.substring_index(F.expr(f"substring(path, {len(start) + 1})"), "/", 1).alias("child")).distinct().filter("child <> ''")
