"""Acceptance of packages by recovery and consumers, checkpoints, recovery start.

The rules are folds over a partition in offset order; one class each serves batch and stream.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.folds import SPAN, folded
from ..functions.scalar import ROW_EVENTS_ALL
from ..functions.stored import stored
from . import gtid


@dataclass
class Recovery:
    """Epochs never fall; within one, numbers go up by one; parts of a split follow each other. The state moves on at a
    split's first part, so that parts sent again under a higher epoch are rejected."""

    epoch: int = 0
    seq: int = 0
    part: int = 0

    def accept(self, epoch: int, seq: int, part: int, flag: int) -> bool:
        if epoch < self.epoch or epoch == self.epoch and seq < self.seq:
            return False
        if epoch == self.epoch and seq == self.seq:
            if flag == 0 or part != self.part + 1:
                return False
        elif part != 0 or self.seq != 0 and seq != self.seq + 1:
            return False
        self.epoch, self.seq, self.part = epoch, seq, part
        return True


@dataclass
class ConsumerV0:
    """No splits; with transactions, epochs do not fall and numbers grow."""

    transactional: bool = True
    epoch: int = 0
    seq: int = 0

    def accept(self, epoch: int, seq: int, part: int, flag: int) -> tuple[bool, bool]:
        """(accepted, offset may be saved)"""
        if flag != 0:
            return False, not self.transactional
        if self.transactional:
            if not (epoch >= self.epoch and seq > self.seq):
                return False, False
            self.epoch, self.seq = epoch, seq
        return True, True


@dataclass
class ConsumerV1:
    """Splits are put together; with transactions, each number must be the last and one. Before the first whole
    transaction a part out of turn clears the buffer but is taken."""

    transactional: bool = True
    allow_merged_gaps: bool = False
    epoch: int = 0
    seq: int = 0
    part: int = -1
    whole: bool = False
    buffer: list = field(default_factory=list)
    merged: list = field(default_factory=list)

    def accept(self, epoch: int, seq: int, part: int, flag: int, payload: object = None) -> tuple[bool, bool]:
        """(accepted, offset may be saved); merged is what a whole transaction is made of, its parts' payloads in order."""
        self.merged = [payload]
        if not self.transactional:
            return True, True
        if self.whole:
            follows = seq > self.seq if self.allow_merged_gaps else seq == self.seq + 1
            if epoch < self.epoch or not follows:
                return False, False
            if flag != 0 and part not in (0, self.part + 1):
                return False, False
        if part == 0 or flag != 0 and part != self.part + 1:
            self.buffer = []
        self.part = part
        if flag == 1:
            self.buffer.append(payload)
            self.merged = []
            return True, False
        self.merged = [*self.buffer, payload]
        self.epoch, self.seq, self.part, self.whole, self.buffer = epoch, seq, -1, True, []
        return True, True


RULES = {"recovery": Recovery, "v0": ConsumerV0, "v1": ConsumerV1}


def fold(rows: Iterable[tuple[int, int, int, int]], rule) -> list[tuple[bool, bool]]:
    out = []
    for r in rows:
        got = rule.accept(*r)
        out.append(got if isinstance(got, tuple) else (got, got and r[3] != 1))
    return out


COLUMNS = "topic string, part_no long, offset long, epoch long, trans_seq_no long, seq_no long, split_flag long, accepted boolean, can_save_offset boolean"
PLACE = ["topic", "part_no"]
#: A range of a topic partition begins with a first part, so that the parts of a transaction are seldom cut.
OPENS = "seq_no = 0"


def none_counts(rule, own: tuple[int, int, bool], span) -> bool:
    """Whether extremes of a range show that the rule takes none of its rows in a state (epoch, number, whole), nor changes the state."""
    (epoch, seq, whole), low, high = own, span["least_trans_seq_no"], span["most_trans_seq_no"]
    if None in (low, span["most_epoch"]):
        return False
    old = span["most_epoch"] < epoch
    if isinstance(rule, ConsumerV0):
        return not rule.transactional or old or high <= seq
    if isinstance(rule, Recovery):
        return seq != 0 and (old or high < seq or low > seq + 1)
    return rule.transactional and whole and (old or (high <= seq if rule.allow_merged_gaps else high < seq + 1 or low > seq + 1))


class Accepting:
    """A rule as folded() reads it: its state is epoch, number, part, and whether a whole transaction was taken."""

    columns = ["epoch", "trans_seq_no", "seq_no", "split_flag"]
    gives = StructType().add("accepted", "boolean").add("can_save_offset", "boolean")
    parts = ("epoch", "seq", "part", "whole")

    def __init__(self, rule: str, options: dict):
        self.new = lambda: RULES[rule](**options)
        self.rule = self.new()

    def begin(self, state: tuple | None) -> None:
        self.rule = self.new()
        for name, value in zip(self.parts, state or ()):
            if hasattr(self.rule, name):
                setattr(self.rule, name, value)

    def state(self) -> tuple:
        return tuple(getattr(self.rule, name, 0) for name in self.parts)

    def take(self, epoch: int, seq: int, part: int, flag: int) -> tuple[bool, bool]:
        got = self.rule.accept(epoch, seq, part, flag)
        if isinstance(self.rule, ConsumerV1):
            self.rule.buffer.clear()  # payloads are not asked for
        return got if isinstance(got, tuple) else (got, got and flag != 1)

    def counts(self) -> Column:
        return F.col("split_flag") == 0 if isinstance(self.rule, ConsumerV0) else F.lit(True)

    def guess(self, row) -> tuple:
        self.begin(None)
        if getattr(self.rule, "transactional", True):
            self.rule.epoch, self.rule.seq = row["epoch"], row["trans_seq_no"]
            if isinstance(self.rule, Recovery):
                self.rule.part = row["seq_no"]
            elif isinstance(self.rule, ConsumerV1):
                self.rule.whole = True
        return self.state()

    def passes(self, state: tuple, span) -> bool:
        return none_counts(self.new(), (state[0], state[1], state[3]), span)


def accept(pkg: DataFrame, rule: str = "recovery", rows: int = SPAN, **options) -> DataFrame:
    """pkg (topic, part_no, offset, epoch, trans_seq_no, seq_no, split_flag) with accepted, can_save_offset.

    The rules are folds over a topic partition in the order of offsets. Topic partitions, and ranges of a long one, are read side by side, each as a
    stream of sorted batches with a state of a few numbers: see folds.py."""
    return accepted(pkg, rule, rows=rows, **options)[0]


def accepted(pkg: DataFrame, rule: str = "recovery", begin: dict[tuple, tuple] | None = None, ends: bool = False, rows: int = SPAN, **options) -> tuple[DataFrame, dict[tuple, tuple]]:
    """accept() from states by (topic, part_no) on, and the states after it if ends are asked for."""
    own = pkg.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in COLUMNS.split(", ")[:7]])
    return folded(stored(own), PLACE, "offset", Accepting(rule, options), OPENS, begin, ends, rows)


def first_occurrences(pkg: DataFrame) -> DataFrame:
    """What recovery accepts of a log without gaps whose epochs do not fall: the first of each (trans_seq_no, seq_no). Many tasks."""
    w = Window.partitionBy("topic", "part_no", "trans_seq_no", "seq_no").orderBy("offset")
    return pkg.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def checkpoint(pkg: DataFrame) -> DataFrame:
    """The state after these packages: only whole or last parts advance number and offset, the epoch is of any."""
    done = F.col("split_flag") != 1
    return pkg.groupBy("topic", "part_no").agg(F.max(F.when(done, F.col("trans_seq_no"))).alias("seq_no"), F.max(F.when(done, F.col("offset"))).alias("offset"), F.max("epoch").alias("epoch"))


def checkpoint_set(pkg: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The ids that are executed after these packages, as text: set_id 0, gtid_text. Only whole and last parts add theirs; before is the
    set of the state that reading began from, as intervals."""
    ids = gtid.parse(pkg.filter("split_flag <> 1 and gtid <> ''").select(F.lit(0).cast("long").alias("set_id"), F.col("gtid").alias("gtid_text")))
    return gtid.to_text(gtid.merge(ids) if before is None else gtid.add(before, ids))


def bootstrap(state: dict[str, str]) -> dict[str, object]:
    """Where a run begins. A state of flag 1 is a snapshot's: the topic is not read, numbering starts anew after its seq_no, and events
    follow its id set. Any other state goes on after its offset. Each run has an epoch of its own, one above the state's."""
    first = state.get("flag") == "1"
    return {"read_topic": not first, "offset": None if first else int(state["offset"]) + 1, "gtid": state.get("gtid", ""), "seq_no": int(state.get("seq_no") or 0), "epoch": int(state.get("epoch") or 0) + 1}


def due(changes: DataFrame, interval: int) -> DataFrame:
    """Which states are saved: of states (at ms, offset, ...) the last one before each tick of interval ms, if it is new since the tick before."""
    tick = F.floor(F.col("at") / interval)
    cols = [c for c in changes.columns if c != "at"]
    last = changes.withColumn("tick", tick).groupBy("tick").agg(F.max_by(F.struct("at", *cols), F.struct("at", "offset")).alias("s")).select(((F.col("tick") + 1) * interval).alias("saved_at"), "s.*")
    was = F.lag("offset").over(Window.orderBy("saved_at"))  # one row a tick
    return last.withColumn("_was", was).filter(F.col("_was").isNull() | (F.col("_was") != F.col("offset"))).drop("_was")


def may_run(ddl: DataFrame, acked: DataFrame) -> DataFrame:
    """Schema changes with waits_for, the number of the last data transaction before, and ready, whether it and all before are acknowledged:
    ddl (trans_seq_no), acked (trans_seq_no of acknowledged transactions). The acknowledged prefix ends before the first number that is missing."""
    seqs = acked.select("trans_seq_no").distinct()
    first = acked.agg(F.min("trans_seq_no").alias("trans_seq_no"))
    gap = seqs.select((F.col("trans_seq_no") + 1).alias("trans_seq_no")).join(seqs, "trans_seq_no", "left_anti").agg(F.min("trans_seq_no").alias("_gap"))
    return ddl.withColumn("waits_for", F.col("trans_seq_no") - 1).join(F.broadcast(gap.crossJoin(first.select(F.col("trans_seq_no").alias("_first"))))).withColumn("ready", F.col("waits_for") < F.greatest("_gap", "_first")).drop("_gap", "_first")  # one row is broadcast


def recovery_start(state: DataFrame, old_broker: bool = False, batch: int = 0) -> DataFrame:
    """Where reading begins again: after the saved offset, or a batch before it for old brokers, 0 at least."""
    at = F.greatest(F.col("offset") - batch, F.lit(0)) if old_broker else F.col("offset") + 1
    return state.withColumn("start_offset", at.cast("long"))


def token_bucket(rows: Iterable[tuple[int, int]], rate: int, cap_seconds: int = 10) -> list[int]:
    """Milliseconds that each (time ms, bytes) waits under a rate of bytes a second."""
    tokens, last, out = 0.0, None, []
    for at, size in rows:
        tokens = min(rate * cap_seconds, tokens + (0 if last is None else (at - last) * rate / 1000))
        wait = max(0.0, (size - tokens) * 1000 / rate)
        tokens, last = tokens - size + wait * rate / 1000, at + wait
        out.append(round(wait))
    return out


def limited(events: DataFrame, rate: int, cap_seconds: int = 10) -> DataFrame:
    """events (source, event_id, at ms, size) with wait_ms under a rate of bytes a second for each source: token_bucket() as a sorted stream."""

    def run(batches):
        own, bucket = None, None
        for b in batches:
            waits = []
            for source, at, size in zip(*(b.column(c).to_pylist() for c in ("source", "at", "size")), strict=True):
                if source != own:
                    own, bucket = source, [0.0, None]
                tokens, last = bucket
                tokens = min(rate * cap_seconds, tokens + (0 if last is None else (at - last) * rate / 1000))
                wait = max(0.0, (size - tokens) * 1000 / rate)
                bucket = [tokens - size + wait * rate / 1000, at + wait]
                waits.append(round(wait))
            yield pa.RecordBatch.from_arrays([b.column("source"), b.column("event_id"), pa.array(waits, pa.int64())], names=["source", "event_id", "wait_ms"])

    own = events.select(F.col("source").cast("long").alias("source"), F.col("event_id").cast("long").alias("event_id"), "at", "size")
    return own.repartition("source").sortWithinPartitions("source", "at", "event_id").mapInArrow(run, "source long, event_id long, wait_ms long")


def switched(old: ConsumerV0 | ConsumerV1, version: int) -> ConsumerV0 | ConsumerV1:
    """The state when a topic's messages change their version: down to 0 the epoch and number are carried over and the buffer is dropped; up to 1 all
    starts anew. The same version keeps its state."""
    if version == (1 if isinstance(old, ConsumerV1) else 0):
        return old
    if version == 0:
        return ConsumerV0(old.transactional, old.epoch, old.seq)
    return ConsumerV1(old.transactional)


class Consuming:
    """A consumer whose messages may change their version, as folded() reads it: whether a row hands on a transaction, whether its offset may be saved,
    and the offset of the transaction's first part. The state is version, epoch, number, part, whether a whole transaction was taken, and the
    first part that is held."""

    columns = ["offset", "epoch", "trans_seq_no", "seq_no", "split_flag", "version"]
    gives = StructType().add("_handed", "boolean").add("_save", "boolean").add("_first", "long")

    def __init__(self, transactional: bool):
        self.transactional, self.rule = transactional, None

    def new(self, version: int) -> ConsumerV0 | ConsumerV1:
        return ConsumerV1(self.transactional) if version else ConsumerV0(self.transactional)

    def begin(self, state: tuple | None) -> None:
        if state is None:
            self.rule = None
            return
        self.rule = self.new(state[0])
        self.rule.epoch, self.rule.seq = state[1:3]
        if state[0]:
            self.rule.part, self.rule.whole, self.rule.buffer = state[3], state[4], [] if state[5] is None else [state[5]]

    def state(self) -> tuple | None:
        r = self.rule
        if r is None:
            return None
        return (1, r.epoch, r.seq, r.part, r.whole, r.buffer[0] if r.buffer else None) if isinstance(r, ConsumerV1) else (0, r.epoch, r.seq, 0, False, None)

    def take(self, offset: int, epoch: int, seq: int, part: int, flag: int, version: int) -> tuple[bool, bool, int | None]:
        if self.rule is None:
            self.rule = self.new(version)
        elif isinstance(self.rule, ConsumerV1) != bool(version):
            self.rule = switched(self.rule, version)
        if isinstance(self.rule, ConsumerV0):
            took, save = self.rule.accept(epoch, seq, part, flag)
            return took, save, offset if took else None
        took, save = self.rule.accept(epoch, seq, part, flag, offset)
        if not took:
            return False, save, None
        if self.rule.merged:
            return True, save, self.rule.merged[0]
        del self.rule.buffer[1:]
        return False, save, self.rule.buffer[0]

    def counts(self) -> Column:
        return (F.col("version") != 0) | (F.col("split_flag") == 0)

    def guess(self, row) -> tuple | None:
        self.rule = self.new(row["version"])
        if self.transactional:
            self.rule.epoch, self.rule.seq = row["epoch"], row["trans_seq_no"]
            if row["version"]:
                self.rule.whole = True
        return self.state()

    def passes(self, state: tuple, span) -> bool:
        same = bool(span["least_version"]) == bool(span["most_version"]) == bool(state[0])
        return same and none_counts(self.new(state[0]), (state[1], state[2], state[4]), span)


def consume(pkg: DataFrame, transactional: bool = True, rows: int = SPAN) -> DataFrame:
    """What a consumer hands on: one row a converted transaction, trans_seq_no, epoch, offset, n_events, n_rows, can_save_offset.

    pkg: topic, part_no, offset, epoch, trans_seq_no, seq_no, split_flag, version and events, an array of (ev_idx, event_type, n_rows). Parts
    of a split are buffered and merged; only data events with rows are left, and a transaction without any gives none. Versions
    switch by switched(). What is taken is worked out from the numbers alone, in ranges that are read side by side: see folds.py. The parts of a
    transaction, which it names by the first of them, are then put together by its offset."""
    kept = F.filter(F.coalesce("events", F.array().cast("array<struct<ev_idx:bigint,event_type:bigint,n_rows:bigint>>")), lambda e: e["event_type"].isin(*sorted(ROW_EVENTS_ALL)) & (e["n_rows"] > 0))
    cols = pkg.select("topic", F.col("part_no").cast("long").alias("part_no"), "offset", "epoch", "trans_seq_no", "seq_no", "split_flag", "version", kept.alias("_kept"))
    cols = cols.withColumns({"_events": F.transform("_kept", lambda e: e["ev_idx"]), "_rows": F.aggregate("_kept", F.lit(0).cast("long"), lambda a, e: a + e["n_rows"])}).drop("_kept")
    got = stored(folded(stored(cols), PLACE, "offset", Consuming(transactional), OPENS, rows=rows)[0].filter("_first is not null").drop("seq_no", "split_flag", "version"))
    alone = F.col("_handed") & (F.col("_first") == F.col("offset"))
    found = [F.size(F.array_distinct("_events")).cast("long").alias("n_events"), F.col("_rows").alias("n_rows"), F.col("_save").alias("can_save_offset")]
    place = [*PLACE, "offset", "epoch", "trans_seq_no"]
    whole = got.filter(alone).select(*place, *found)
    last = F.max_by(F.struct("offset", "epoch", "trans_seq_no", "_save"), F.when(F.col("_handed"), F.col("offset"))).alias("_l")
    split = got.filter(~alone).groupBy(*PLACE, "_first").agg(last, F.flatten(F.collect_list("_events")).alias("_events"), F.sum("_rows").alias("_rows")).filter("_l is not null")
    split = split.select(*PLACE, "_l.*", "_events", "_rows").select(*place, *found)
    return whole.unionByName(split).filter("n_events > 0")
