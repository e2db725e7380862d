"""Folds over the rows of a key in their order, cut into ranges that are read side by side.

A key of few rows is read by one task from its beginning. One of many is cut into ranges, and a range is read from the state that the last row
before it would leave if it counted. Where the states meet, range after range, all were read rightly. Where they do not, a range is passed over if
its extremes show that no row of it can count, or else read again from its true state. So the result is that of reading row by row, whatever
the rows are; a log in which no state can be foretold is read a range at a time.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .sequence import range_number, ranges_of

#: Rows of a range, about, and of a key that is not cut.
SPAN = 250_000


def cut(df: DataFrame, by: list[str], order: str, opens: str | None = None, rows: int = SPAN) -> tuple[DataFrame, int | None]:
    """df with _range, which goes up with order within the columns `by`, and _cut, whether the key has several; and the number of tasks to deal it
    to, None for a small table. opens: ranges begin at rows for which it holds, so that what belongs together is seldom cut."""
    n, whole = df.count(), {"_range": F.lit(0), "_cut": F.lit(False)}
    if n <= rows:
        return df.withColumns(whole), None
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // rows))
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows).drop("_n")
    found = counts.collect()  # n / rows at most
    if not found:
        return df.withColumns(whole), tasks
    long_ = F.broadcast(df.sparkSession.createDataFrame(found, counts.schema).withColumn("_cut", F.lit(True)))
    borders = ranges_of(df.join(long_, by, "left_semi"), order, rows)
    df = df.join(long_, by, "left").withColumn("_cut", F.coalesce("_cut", F.lit(False))).withColumn("_range", F.when(F.col("_cut"), range_number(F.col(order), borders)).otherwise(0))
    if opens is not None:
        first = df.filter("_range > 0").filter(opens).groupBy(*by, "_range").agg(F.min(order).alias("_first"))
        first = df.sparkSession.createDataFrame(first.collect(), first.schema)  # a row a range
        late = (F.col("_range") > 0) & (F.col("_first").isNull() | (F.col(order) < F.col("_first")))
        df = df.join(F.broadcast(first), [*by, "_range"], "left").withColumn("_range", F.when(late, F.col("_range") - 1).otherwise(F.col("_range"))).drop("_first")
    return df, tasks


def dealt(df: DataFrame, by: list[str], order: str, tasks: int | None) -> DataFrame:
    """A table of cut() with each range in one task, in order. There are as many tasks as ranges, so that one holds a few of them."""
    parts = df.repartition(*by, "_range") if tasks is None else df.repartition(tasks, *by, "_range")
    return parts.sortWithinPartitions(*by, "_range", order)


def rows_of(b: pa.RecordBatch, columns: list[str]):
    return zip(*[b.column(c).to_pylist() for c in columns], strict=True)


def folded(df: DataFrame, by: list[str], order: str, fold, opens: str | None = None, begin: dict[tuple, tuple] | None = None, ends: bool = False, rows: int = SPAN) -> tuple[DataFrame, dict[tuple, tuple]]:
    """df and the columns that fold gives to each row; and, if ends are asked for, the state after the last row of each key.

    fold has columns (what it reads), gives (names and types), begin(state or None), take(*row) and state(), a tuple of numbers; counts(), the rows
    that guess(row) is made for, and passes(state, extremes). begin has the states of keys that go on. df is read several times: hand over a stored table."""
    df, tasks = cut(df, by, order, opens, rows)
    known, key_of, columns = begin or {}, [*by, "_range"], fold.columns
    starts: dict[tuple, tuple | None] = {}
    after: dict[tuple, tuple] = {}
    start = lambda key: starts[key] if key in starts else known.get(key[:-1])

    def read(part: DataFrame) -> None:
        """The states after the ranges of part."""
        keys = StructType([part.schema[c] for c in key_of])
        types = [to_arrow_type(f.dataType) for f in keys]

        def run(batches):
            own = None

            def result():
                return pa.RecordBatch.from_arrays([*[pa.array([k], t) for k, t in zip(own, types, strict=True)], pa.array([json.dumps(fold.state())])], names=[*key_of, "state"])

            for b in batches:
                for key, row in zip(rows_of(b, key_of), rows_of(b, columns), strict=True):
                    if key != own:
                        if own is not None:
                            yield result()
                        own = key
                        fold.begin(start(key))
                    fold.take(*row)
            if own is not None:
                yield result()

        few = part.select(*dict.fromkeys([*key_of, order, *columns]))
        for r in dealt(few, by, order, tasks).mapInArrow(run, keys.add("state", "string")).collect():  # a row a range
            state = json.loads(r["state"])
            after[tuple(r)[:-1]] = None if state is None else tuple(state)

    spans: dict[tuple, list] = {}
    if tasks is not None:
        extremes = [f(c).alias(f"{n}_{c}") for c in columns if c != order for n, f in (("least", F.min), ("most", F.max))]
        last_row = F.max_by(F.struct(*columns), F.when(fold.counts(), F.col(order))).alias("last")
        for r in df.filter("_cut").groupBy(*key_of).agg(last_row, *extremes).collect():  # a row a range
            spans.setdefault(tuple(r[c] for c in by), []).append(r)
    for key, ranges in spans.items():
        ranges.sort(key=lambda r: r["_range"])
        starts[(*key, ranges[0]["_range"])] = known.get(key)
        for before, r in zip(ranges, ranges[1:]):
            starts[(*key, r["_range"])] = None if before["last"] is None else fold.guess(before["last"])
    if spans or ends:
        read(df if ends else df.filter("_cut"))
    open_ = {key: (0, known.get(key)) for key in spans}
    while open_:
        again = set()
        for key, (at, state) in list(open_.items()):
            ranges = spans[key]
            while at < len(ranges):
                own = (*key, ranges[at]["_range"])
                if starts[own] != state:
                    starts[own] = state
                    if state is None or not fold.passes(state, ranges[at]):
                        again.add(own)
                        break
                    after[own] = state
                state, at = after[own], at + 1
            if at == len(ranges):
                del open_[key]
            else:
                open_[key] = (at, state)
        if again:
            same = lambda k: F.lit(True) if not by else F.array(*[F.col(c).cast("string") for c in by]) == F.array(*[F.lit(x).cast("string") for x in k[:-1]])
            wanted = F.lit(False)
            for k in again:
                wanted = wanted | (F.col("_range") == k[-1]) & same(k)
            read(df.filter("_cut").filter(wanted))
    last = dict(known)
    for key in sorted(after, key=lambda k: k[-1]):
        last[key[:-1]] = after[key]
    names = [c for c in df.columns if c not in ("_range", "_cut")]
    types = [to_arrow_type(f.dataType) for f in fold.gives]

    def run(batches):
        own = None
        for b in batches:
            out = []
            for key, row in zip(rows_of(b, key_of), rows_of(b, columns), strict=True):
                if key != own:
                    own = key
                    fold.begin(start(key))
                out.append(fold.take(*row))
            cols = list(zip(*out, strict=True)) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=[*names, *fold.gives.names])

    schema = StructType([*df.select(*names).schema.fields, *fold.gives.fields])
    return dealt(df, by, order, tasks).mapInArrow(run, schema), last if ends else {}
