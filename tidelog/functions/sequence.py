"""Windows over one global order that still run in many tasks.

A plain window without a partition puts all rows into one task. Here the order is cut into ranges of a key that hold about
equally many rows, whatever the key's values are; each range is a task's, however few bytes its rows are shuffled as, and what crosses a border goes
through a table of one row a range. The input is read more than once: hand over a stored table, or one that is cheap to derive, and the borders if they are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, about; and ranges, at least as many as Spark's shuffle partitions.
ROWS, FINEST = 1_000_000, 10_000


def ranges_of(df: DataFrame, key: str, rows: int = ROWS) -> list[int]:
    """Borders of ranges of about equally many rows: quantiles of key, as many as the shuffle has partitions, or as rows asks for."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = lambda parts: F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10_000)
    n, found = df.select(F.count(F.lit(1)), cut(least)).first()
    parts = min(FINEST, max(least, -(-n // rows)))
    if n <= 1 or parts <= 1:
        return []
    if parts > least:
        found = df.select(cut(parts)).first()[0]
    return sorted(set(found or []))


def range_number(key: Column, borders: list[int]) -> Column:
    """How many borders are at or below key, by two short searches: the borders are dealt into about as many lists as each is long."""
    if not borders:
        return F.lit(0)
    each = max(1, int(len(borders) ** 0.5))
    lists = [borders[i : i + each] for i in range(0, len(borders), each)]
    below = lambda bs: F.size(F.filter(bs, lambda b: b <= key))
    array = lambda bs: F.array(*[F.lit(int(b)).cast("long") for b in bs])
    at = F.greatest(below(array([x[0] for x in lists])) - 1, F.lit(0))
    return at * each + below(F.get(F.array(*[array(x) for x in lists]), at))


def ranged(df: DataFrame, key: str, rows: int = ROWS, borders: list[int] | None = None) -> DataFrame:
    return df.withColumn("_range", range_number(F.col(key), ranges_of(df, key, rows) if borders is None else borders))


def each_its_own(df: DataFrame, borders: list[int]) -> DataFrame:
    """A table of ranged() with a task for each range: tasks that hold a number of bytes would hold more and more rows, as numbers that go up compress well."""
    return df.repartitionById(len(borders) + 1, F.col("_range")) if borders else df


def with_previous(df: DataFrame, key: str, values: dict[str, Column], rows: int = ROWS, by: list[str] | None = None, borders: list[int] | None = None) -> DataFrame:
    """df and, by name, the values of the row before in the order of key (null for the first), within the columns `by`.

    Range borders: the last row of each range is taken by one aggregation, and a window over one row a range
    carries it to the next range that has rows."""
    by = by or []
    borders = ranges_of(df, key, rows) if borders is None else borders
    df = ranged(df, key, rows, borders)
    own = Window.partitionBy(*by, "_range").orderBy(key)
    row = F.struct(*[v.alias(n) for n, v in values.items()])
    tails = df.groupBy(*by, "_range").agg(F.max_by(row, F.col(key)).alias("_tail"))
    tails = tails.withColumn("_before", F.lag("_tail").over(Window.partitionBy(*by).orderBy("_range"))).drop("_tail")
    inner = each_its_own(df, borders).withColumn("_lag", F.lag(row).over(own)).withColumn("_first", F.row_number().over(own) == 1)
    joined = inner.join(tails if by else F.broadcast(tails), [*by, "_range"], "left")  # without `by`, a row a range
    before = F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lag"))
    return joined.withColumns({n: before[n] for n in values}).drop("_range", "_lag", "_first", "_before")


def with_running_sum(df: DataFrame, key: str, value: Column, name: str, rows: int = ROWS, borders: list[int] | None = None) -> DataFrame:
    """df and the sum of value up to and with the row, in the order of key."""
    borders = ranges_of(df, key, rows) if borders is None else borders
    df = ranged(df, key, rows, borders).withColumn("_value", value)
    own = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    return each_its_own(df, borders).withColumn("_own", F.sum("_value").over(own)).join(F.broadcast(sums), "_range").withColumn(name, F.col("_own") + F.col("_base")).drop("_range", "_value", "_own", "_base")
