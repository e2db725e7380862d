"""Transaction boundaries: classes of events, the state table, and grouping in batch."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import SPAN, cut, dealt, rows_of
from ..functions.sequence import ROWS, each_its_own, ranged, ranges_of
from ..functions.stored import stored

#: State after each class of event, from each state; errors are marked with `!`.
STATES = ("NONE", "GTID", "DDL", "DML", "ERROR")
NEXT = {
    "GTID": ("GTID", "GTID!", "GTID!", "GTID!", "GTID!"),
    "BEGIN_TRX": ("DML", "DML", "DML!", "DML!", "DML!"),
    "END_TRX": ("NONE!", "NONE!", "NONE!", "NONE", "NONE!"),
    "END_XA_TRX": ("NONE!", "NONE", "NONE!", "NONE", "NONE!"),
    "STATEMENT": ("NONE", "NONE", "NONE", "DML", "NONE!"),
    "PRE_STATEMENT": ("DDL", "DDL", "DDL", "DML", "NONE!"),
    "IGNORE": ("NONE", "GTID", "DDL", "DML", "ERROR"),
    "ERROR": ("ERROR!", "ERROR!", "ERROR!", "ERROR!", "ERROR!"),
}


def boundary_class(event_type: Column, statement: Column) -> Column:
    up = F.upper(statement)
    q = (
        F.when((statement == "BEGIN") | statement.startswith("XA START"), "BEGIN_TRX")
        .when(statement == "COMMIT", "END_TRX").when(up.startswith("ROLLBACK") & ~up.startswith("ROLLBACK TO "), "END_TRX")
        .when(up.startswith("XA ROLLBACK"), "END_XA_TRX").otherwise("STATEMENT")
    )
    return (
        F.when(event_type.isin(33, 34), "GTID").when(event_type == 2, q).when(event_type.isin(16, 38), "END_TRX").when(event_type.isin(5, 13, 14), "PRE_STATEMENT")
        .when(event_type.isin(17, 18, 9, 19, 29, 30, 31, 32, 23, 24, 25, 20, 21, 22, 37), "STATEMENT")
        .when(event_type.isin(4, 15, 27, 35, 1, 3, 6, 7, 8, 11, 12, 10, 26, 36), "IGNORE").otherwise("ERROR")
    )


def step(state: str, kind: str) -> tuple[str, bool, bool]:
    """New state, whether it is an error, and whether the group is marked as a schema change."""
    new = NEXT[kind][STATES.index(state)]
    return new.rstrip("!"), new.endswith("!"), kind == "STATEMENT" and state in ("GTID", "DDL") or new == "DDL"


#: States that a batch can be in before an event: after an error the open group is dropped and reading starts anew.
OPEN = ("NONE", "GTID", "DDL", "DML")
SEGMENTED = "order_key long, group_no long, attempt long, state string, error boolean, ends boolean, mark boolean"


def moves() -> list[tuple]:
    """By class, in the order of NEXT, and state number: new state number (NONE after an error), error, closes a group, marked as a schema change."""
    out = []
    for kind in NEXT:
        row = []
        for state in OPEN:
            new, error, mark = step(state, kind)
            row.append((0 if error else OPEN.index(new), error, new == "NONE" and not error, mark))
        out.append(tuple(row))
    return out


CLASSES, MOVES = list(NEXT), moves()


def follow(kinds: list[int]) -> list[tuple[int, int, int]]:
    """From each state: the state after these classes of events, groups closed, errors. Most classes lead from all states to one, and from
    there on one reading stands for all."""
    states, closed, errors = list(range(len(OPEN))), [0] * len(OPEN), [0] * len(OPEN)
    at = 0
    while at < len(kinds) and len(set(states)) > 1:
        row = MOVES[kinds[at]]
        for i, s in enumerate(states):
            states[i], error, closes, _ = row[s]
            closed[i] += closes
            errors[i] += error
        at += 1
    state, more, wrong = states[0], 0, 0
    for kind in kinds[at:]:
        state, error, closes, _ = MOVES[kind][state]
        more += closes
        wrong += error
    return [(state if at < len(kinds) else s, c + more, e + wrong) for s, c, e in zip(states, closed, errors, strict=True)]


def segment(ev: DataFrame, base: int = 0, rows: int = ROWS) -> DataFrame:
    """ev (order_key, event_type, statement) with the state table's outcome: group_no, attempt, state, error, ends, mark.

    A group ends where the state becomes NONE, and the next has the next number, from base + 1; an error drops the open group, whose
    number is used again in the next attempt. The order is cut into ranges. Each range is read from every state that it can start
    in, which gives a map of states; the maps, one a range, are chained, and each range is read once more from its true state. Ranges hold
    about rows events, and a task holds one range's classes, no statements; the join has as many tasks as there are ranges. ev is read several times: hand over a stored table."""
    kind = boundary_class(F.col("event_type"), F.col("statement"))
    code = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(CLASSES) for x in (k, i)]), kind)
    borders = ranges_of(ev, "order_key", rows)
    own = ranged(ev.select("order_key", code.cast("byte").alias("kind"), "event_type", "statement"), "order_key", rows, borders).select("_range", "order_key", "kind")
    own = each_its_own(own, borders)

    def in_order(t: pa.Table) -> tuple[int, pa.Table]:
        return t.column("_range")[0].as_py(), t.sort_by("order_key")

    def mapped(t: pa.Table) -> pa.Table:
        number, t = in_order(t)
        got = follow(t.column("kind").to_pylist())
        cols = list(zip(*[(number, s, *g) for s, g in enumerate(got)], strict=True))
        return pa.table([pa.array(c, x) for c, x in zip(cols, [pa.int32()] * 3 + [pa.int64()] * 2, strict=True)], names=["_range", "start", "state", "closed", "errors"])

    maps: dict[int, dict[int, tuple[int, int, int]]] = {}
    for r in own.groupBy("_range").applyInArrow(mapped, "_range int, start int, state int, closed long, errors long").collect():  # 4 rows a range
        maps.setdefault(r["_range"], {})[r["start"]] = (r["state"], r["closed"], r["errors"])
    state, group, attempt, begin = 0, base + 1, 0, {}
    for n in sorted(maps):
        begin[n] = (state, group, attempt)
        state, closed, errors = maps[n][state]
        group, attempt = group + closed, attempt + errors
    wrong = CLASSES.index("ERROR")

    def run(t: pa.Table) -> pa.Table:
        number, t = in_order(t)
        state, group, attempt = begin[number]
        groups_, attempts, states, errors, ends_, marks = [], [], [], [], [], []
        for kind in t.column("kind").to_pylist():
            state, error, ends, mark = MOVES[kind][state]
            groups_.append(group)
            attempts.append(attempt)
            states.append("ERROR" if kind == wrong else OPEN[state])
            errors.append(error)
            ends_.append(ends)
            marks.append(mark)
            group, attempt = group + ends, attempt + error
        return pa.table([t.column("order_key"), pa.array(groups_, pa.int64()), pa.array(attempts, pa.int64()), pa.array(states, pa.string()), pa.array(errors), pa.array(ends_), pa.array(marks)], names=["order_key", "group_no", "attempt", "state", "error", "ends", "mark"])

    read, tasks = own.groupBy("_range").applyInArrow(run, SEGMENTED), len(borders) + 1
    return ev.repartition(tasks, "order_key").join(read.repartition(tasks, "order_key"), "order_key") if borders else ev.join(read, "order_key")


class Paths:
    """What a range of events makes of each state that it can start in, unmarked: new state, groups closed, errors, the open group's mark, and whether
    a group ended or was dropped in it, so that a mark from before is gone."""

    def __init__(self):
        self.paths = [(s, 0, 0, False, False) for s in range(len(OPEN))]

    def follow(self, kinds: list[int]) -> None:
        at = 0
        while at < len(kinds) and len({(p[0], *p[3:]) for p in self.paths}) > 1:
            self.paths = [self.along(p, kinds[at : at + 1]) for p in self.paths]
            at += 1
        if at < len(kinds):  # one reading stands for all
            state, closed, errors, ddl, reset = self.along((self.paths[0][0], 0, 0, *self.paths[0][3:]), kinds[at:])
            self.paths = [(state, p[1] + closed, p[2] + errors, ddl, reset) for p in self.paths]

    @staticmethod
    def along(path: tuple, kinds: list[int]) -> tuple:
        state, closed, errors, ddl, reset = path
        for kind in kinds:
            state, error, closes, mark = MOVES[kind][state]
            if error or closes:
                closed, errors, ddl, reset = closed + closes, errors + error, False, True
            elif mark:
                ddl = True
        return state, closed, errors, ddl, reset


BY_SOURCE = "source string, order_key long, group_no long, boundary string, state string, error boolean, ends boolean, is_ddl boolean"


def segment_sources(ev: DataFrame, begin: dict[tuple, tuple] | None = None, base: int = 0, rows: int = SPAN) -> tuple[DataFrame, dict[tuple, tuple]]:
    """ev (source, order_key, boundary) of several sources with the state table's outcome, as segment_stream() gives it, from the states in begin on, by
    (source,): state number, number of the open group, whether it is marked. And the states after it. Long sources are read in ranges, as in segment()."""
    df, tasks = cut(stored(ev.select("source", F.col("order_key").cast("long").alias("order_key"), "boundary")), ["source"], "order_key", rows=rows)
    code = {k: i for i, k in enumerate(CLASSES)}

    def mapped(batches):
        own, paths = None, None

        def result():
            cols = list(zip(*[(*own, s, *p) for s, p in enumerate(paths.paths)], strict=True))
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["source", "_range", "start", "state", "closed", "errors", "ddl", "reset"])

        for b in batches:
            kinds: list[int] = []
            for source, number, kind in rows_of(b, ["source", "_range", "boundary"]):
                if (source, number) != own:
                    if own is not None:
                        paths.follow(kinds)
                        yield result()
                    own, paths, kinds = (source, number), Paths(), []
                kinds.append(code[kind])
            if own is not None:
                paths.follow(kinds)
        if own is not None:
            yield result()

    maps: dict[tuple, dict[int, tuple]] = {}
    for r in dealt(df, ["source"], "order_key", tasks).mapInArrow(mapped, "source string, _range int, start int, state int, closed long, errors long, ddl boolean, reset boolean").collect():  # 4 rows a range
        maps.setdefault((r["source"], r["_range"]), {})[r["start"]] = tuple(r)[3:]
    now, starts = dict(begin or {}), {}
    for source, number in sorted(maps, key=lambda k: k[1]):
        state, group, ddl = starts[source, number] = now.get((source,), (0, base + 1, False))
        state, closed, _, marked, reset = maps[source, number][state]
        now[(source,)] = (state, group + closed, marked or ddl and not reset)
    shown = [[step(s, k)[0] for s in OPEN] for k in CLASSES]

    def run(batches):
        own = None
        for b in batches:
            out = []
            for source, number, kind in rows_of(b, ["source", "_range", "boundary"]):
                if (source, number) != own:
                    own = (source, number)
                    state, group, ddl = starts[own]
                k = code[kind]
                name = shown[k][state]
                state, error, ends, mark = MOVES[k][state]
                ddl = ddl or mark
                out.append((group, name, error, ends, ddl))
                if error or ends:
                    group, ddl = group + ends, False
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]
            group_no, state_, *flags = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("source"), b.column("order_key"), group_no, b.column("boundary"), state_, *flags], names=[c.split()[0] for c in BY_SOURCE.split(", ")])

    return dealt(df, ["source"], "order_key", tasks).mapInArrow(run, BY_SOURCE), now


def groups(ev: DataFrame) -> DataFrame:
    """One row a group that ended: first place, events, bytes, whether it is a schema change, which its mark on any event tells. Groups
    dropped by an error and one left open at the end are not there."""
    g = ev.groupBy("group_no", "attempt").agg(F.min("order_key").alias("first_key"), F.count(F.lit(1)).alias("n_events"), F.sum("size").alias("bytes"), F.max(F.col("mark").cast("long")).alias("is_ddl"), F.max("ends").alias("ended"))
    return g.filter("ended").drop("ended", "attempt")


def truncate_large(ev: DataFrame, most: int = 786_432) -> DataFrame:
    """Row events past the size limit of a transaction lose their rows; the events stay. truncated tells which."""
    from pyspark.sql import Window

    w = Window.partitionBy("trans_seq_no").orderBy("ev_idx").rowsBetween(Window.unboundedPreceding, 0)
    cut = (F.sum("size").over(w) > most) & F.col("event_type").isin(30, 31, 32)
    return ev.withColumn("truncated", cut).withColumn("n_rows", F.when(F.col("truncated"), 0).otherwise(F.col("n_rows")).cast("long"))
