"""Packages: clean, limit, split, checksum, envelope; and merging, ordered release, reassembly.

Sizes follow a stated model: HEADER bytes and the sum of the sizes of what is carried.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import ROWS, ranges_of, with_previous, with_running_sum
from ..functions.stored import stored
from .gtid import merge, parse, to_text

HEADER = 64


DDL_TEXT = r"(?i)^\s*(#.*\n)?(create|alter|drop|rename|truncate)"


def useful(ev: DataFrame) -> DataFrame:
    """ev with useful: whether its transaction has a data event with rows, or a schema change."""
    one = F.col("event_type").isin(30, 31, 32) & (F.col("n_rows") > 0) | F.col("statement").rlike(DDL_TEXT)
    return ev.withColumn("useful", F.max(F.when(one, 1).otherwise(0)).over(Window.partitionBy("trans_seq_no")) == 1)


def clean(ev: DataFrame) -> DataFrame:
    """The events that stay: transactions without a data event that has rows and without a schema change lose all of theirs.
    The transactions themselves stay, as shells: see shells()."""
    return useful(ev).filter("useful").drop("useful")


def shells(trx: DataFrame, ev: DataFrame) -> DataFrame:
    """Summaries of all transactions after clean(): one that lost its events keeps its place and id, with no events, rows and bytes."""
    one = F.max(F.when(F.col("event_type").isin(30, 31, 32) & (F.col("n_rows") > 0) | F.col("statement").rlike(DDL_TEXT), 1).otherwise(0))
    kept = ev.groupBy("trans_seq_no").agg(one.alias("_useful"))
    j = trx.join(kept, "trans_seq_no", "left")
    return j.withColumns({c: F.when(F.col("_useful") == 1, F.col(c)).otherwise(0).cast("long") for c in ("n_events", "n_rows", "bytes")}).drop("_useful")


def shrink(trx: DataFrame, limit: int) -> DataFrame:
    """(trans_seq_no, bytes, row_bytes) with how it is sent: whole, without rows, without events, or failed."""
    whole, bare = F.col("bytes") + HEADER, F.col("bytes") - F.col("row_bytes") + HEADER
    how = F.when(whole <= limit, "whole").when(bare <= limit, "no_rows").when(F.lit(HEADER) <= limit, "no_events").otherwise("error")
    return trx.withColumns({"sent_as": how, "sent_bytes": F.when(whole <= limit, whole).when(bare <= limit, bare).otherwise(HEADER).cast("long")})


def split_rows(items: DataFrame, limit: int, row_size: int) -> DataFrame:
    """Bisect (trans_seq_no, n_rows) until each part of equal rows fits: trans_seq_no, lo, hi (rows from 0, hi exclusive), seq_no, split_flag.

    The halves of n rows are n / 2 rounded down and the rest; a single row is not split further. With rows of one size the tree is that of
    the counts alone, so that parts are made level by level in one array expression, without Python."""
    most = max(1, (limit - HEADER) // row_size)
    start = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_rows").cast("long").alias("hi")))

    def halve(parts: Column) -> Column:
        big = lambda p: (p["hi"] - p["lo"]) > most
        middle = lambda p: p["lo"] + F.floor((p["hi"] - p["lo"]) / 2).cast("long")
        two = lambda p: F.array(F.struct(p["lo"].alias("lo"), middle(p).alias("hi")), F.struct(middle(p).alias("lo"), p["hi"].alias("hi")))
        return F.flatten(F.transform(parts, lambda p: F.when(big(p), two(p)).otherwise(F.array(F.struct(p["lo"].alias("lo"), p["hi"].alias("hi"))))))

    deep = F.ceil(F.log2(F.greatest(F.col("n_rows") / most, F.lit(1.0)))).cast("int") + 1
    parts = F.aggregate(F.sequence(F.lit(1), deep), start, lambda acc, _: halve(acc))
    # the last part is the one that reaches n_rows: asking for the size of parts would build them anew for every row
    out = items.select("trans_seq_no", F.col("n_rows").cast("long").alias("n"), F.posexplode(parts).alias("seq_no", "p"))
    last = F.col("p.hi") == F.col("n")
    flag = F.when(last & (F.col("seq_no") == 0), 0).when(last, 2).otherwise(1)
    return out.select("trans_seq_no", F.col("seq_no").cast("long").alias("seq_no"), "p.lo", "p.hi", flag.cast("long").alias("split_flag"))


def split_transactions(ev: DataFrame, limit: int, tasks: int | None = None) -> DataFrame:
    """Bisect transactions until each part fits: ev (trans_seq_no, ev_idx, base_size, row_sizes) becomes trans_seq_no, seq_no, split_flag,
    ev_idx, lo, hi (rows from 0, hi exclusive), part_bytes, cleared, a row for each event of each part.

    A part is HEADER bytes, and base_size and the sizes of its rows for each event. One that is too large is halved: by events, the first
    n / 2 rounded down and the rest; if it is one event, by rows in the same way, the event going into both halves. A single row that is too large is
    cleared: the event goes on without rows. An event that is too large without rows goes as it is. A work list in order of parts, in Python: a task
    holds the sizes of one batch of transactions, never their rows. tasks: to how many the transactions of a large log are dealt."""
    own = (ev.repartition(tasks, "trans_seq_no") if tasks else ev).groupBy("trans_seq_no").agg(F.sort_array(F.collect_list(F.struct("ev_idx", "base_size", "row_sizes"))).alias("e"))
    schema = "trans_seq_no long, seq_no long, split_flag long, ev_idx long, lo long, hi long, part_bytes long, cleared boolean"

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            lists = b.column("e")
            first = accumulate(pc.list_value_length(lists).to_pylist(), initial=0)
            idx, base, rows = lists.flatten().flatten()
            base, lengths = base.to_pylist(), pc.fill_null(pc.list_value_length(rows), 0).to_pylist()
            begin, sums = list(accumulate(lengths, initial=0)), list(accumulate(rows.flatten().to_pylist(), initial=0))
            whole = list(accumulate((x + sums[z] - sums[a] for x, a, z in zip(base, begin, begin[1:])), initial=0))
            idx, at = idx.to_pylist(), next(first)
            for seq, end in zip(b.column("trans_seq_no").to_pylist(), first, strict=True):
                parts = halved(at, end, base, begin, sums, whole, limit)
                for n, (a, z, lo, hi, size, cleared) in enumerate(parts):
                    flag = 0 if len(parts) == 1 else 2 if n == len(parts) - 1 else 1
                    if z - a == 1:
                        out.append((seq, n, flag, idx[a], lo, hi, size, cleared))
                    else:
                        out += [(seq, n, flag, idx[i], 0, lengths[i], size, cleared) for i in range(a, z)]
                at = end
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            types = [pa.int64()] * 7 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["trans_seq_no", "seq_no", "split_flag", "ev_idx", "lo", "hi", "part_bytes", "cleared"])

    return own.mapInArrow(run, schema)


def halved(at: int, end: int, base: list[int], begin: list[int], sums: list[int], whole: list[int], limit: int) -> list[tuple[int, int, int, int, int, bool]]:
    """Parts of the events from at to end, in order: first event, end, rows lo to hi of a single one, bytes, cleared. Of all events: base sizes, where
    their rows begin, and running sums of the sizes of rows and of whole events, so that a part's size is one subtraction however many it has."""
    work, done = [(at, end, 0, begin[end] - begin[at], False)], []
    while work:
        a, z, lo, hi, cleared = work.pop()
        if z - a == 1:
            size = HEADER + base[a] + sums[begin[a] + hi] - sums[begin[a] + lo]
        else:
            size = HEADER + whole[z] - whole[a]
        if size <= limit or z - a == 0 or z - a == 1 and hi == lo:
            done.append((a, z, lo, hi, size, cleared))
        elif z - a > 1:
            half = a + (z - a) // 2
            work += [(half, z, 0, begin[z] - begin[half], cleared), (a, half, 0, begin[half] - begin[a], cleared)]
        elif hi - lo > 1:
            half = lo + (hi - lo) // 2
            work += [(a, z, half, hi, cleared), (a, z, lo, half, cleared)]
        else:
            work.append((a, z, lo, lo, True))
    return done


def split_parts(events: list[tuple[int, int, list[int]]], limit: int) -> list[tuple[list[tuple[int, int, int]], int, bool]]:
    """Parts of (event, base size, row sizes) in order, each ([(event, lo, hi)], bytes, cleared)."""
    lengths = [len(sizes) for _, _, sizes in events]
    whole = list(accumulate((base + sum(sizes) for _, base, sizes in events), initial=0))
    sums = list(accumulate((x for _, _, sizes in events for x in sizes), initial=0))
    got = halved(0, len(events), [base for _, base, _ in events], list(accumulate(lengths, initial=0)), sums, whole, limit)
    return [([(events[a][0], lo, hi)] if z - a == 1 else [(events[i][0], 0, lengths[i]) for i in range(a, z)], size, cleared) for a, z, lo, hi, size, cleared in got]


def merged_events(parts: DataFrame, tasks: int | None = None) -> DataFrame:
    """The events of whole transactions from the parts of split_transactions(): trans_seq_no, ev_idx, n_rows, n_parts. An event that was split by
    rows is one again, and incomplete transactions give none. parts is read twice: hand over a stored table. tasks: to how many it is dealt."""
    if tasks:
        parts = parts.repartition(tasks, "trans_seq_no")
    per = parts.groupBy("trans_seq_no").agg(F.count_distinct("seq_no").alias("n_parts"), F.max("seq_no").alias("last"), F.max((F.col("split_flag") != 1).cast("int")).alias("ended")).filter("ended = 1 and n_parts = last + 1")
    return parts.join(per.select("trans_seq_no", "n_parts"), "trans_seq_no").groupBy("trans_seq_no", "ev_idx", "n_parts").agg(F.sum(F.col("hi") - F.col("lo")).alias("n_rows"))


def reassemble(parts: DataFrame) -> DataFrame:
    """Whole transactions from their parts: complete only if parts run from 0 without a gap to one flagged 0 or 2."""
    g = parts.groupBy("epoch", "trans_seq_no").agg(F.count_distinct("seq_no").alias("n_parts"), F.max("seq_no").alias("last"), F.max(F.when(F.col("split_flag") != 1, 1).otherwise(0)).alias("ended"), F.sum("n_rows").alias("n_rows"))
    return g.filter("ended = 1 and n_parts = last + 1").select("epoch", "trans_seq_no", "n_parts", "n_rows")


def checksum(payload: Column, enabled: bool = True) -> Column:
    return F.crc32(payload.cast("binary")) if enabled else F.lit(-1).cast("long")


def message_id() -> Column:
    return F.concat_ws(".", "epoch", "trans_seq_no", "seq_no")


def package_key() -> Column:
    return F.concat_ws("-", "trans_seq_no", "seq_no")


def envelope(pkg: DataFrame) -> DataFrame:
    """Both envelopes as one struct, with constant version and the length before compression."""
    inner = F.struct(F.col("epoch"), F.col("trans_seq_no"), F.col("gtid"), F.col("split_flag"), F.col("seq_no"), F.lit(0).alias("flag"), F.col("bytes").alias("source_data_len"), F.lit(1).alias("version"))
    return pkg.select(message_id().alias("message_id"), package_key().alias("key"), F.to_json(inner).alias("payload"))


def merge_empty(trx: DataFrame, batch: int | None = None, rows: int = ROWS) -> DataFrame:
    """Runs of empty transactions, each starting where the one before ended, become one: the number of its first, the place of its first, the
    end (file and position) of its last, and all their ids as one set, gtid_text. Transactions with events stay alone, with their id.

    batch: transactions a sink takes at a time, counted in the order of trans_seq_no; a run does not go on in the next batch."""
    trx = stored(trx)
    borders = ranges_of(trx, "trans_seq_no", rows)
    values = {"was_empty": F.col("n_events") == 0, "end_file": F.col("next_file_no"), "end_pos": F.col("next_position")}
    if batch:
        placed = with_running_sum(trx, "trans_seq_no", F.lit(1).cast("long"), "_place", rows, borders)
        trx = stored(placed.withColumn("_batch", F.floor((F.col("_place") - 1) / batch)).drop("_place"))
        values["was_batch"] = F.col("_batch")
    p = with_previous(trx, "trans_seq_no", values, rows, borders=borders)
    joined = (F.col("n_events") == 0) & F.coalesce(F.col("was_empty") & (F.col("end_file") == F.col("file_no")) & (F.col("end_pos") == F.col("position")), F.lit(False))
    if batch:
        joined = joined & (F.col("was_batch") == F.col("_batch"))
    r = stored(with_running_sum(p.withColumn("_new", F.when(joined, 0).otherwise(1).cast("long")), "trans_seq_no", F.col("_new"), "run", rows, borders))
    ord_ = F.col("trans_seq_no")
    runs = r.groupBy("run").agg(
        F.min("trans_seq_no").alias("trans_seq_no"), F.max("trans_seq_no").alias("last_seq_no"), F.count(F.lit(1)).alias("n_merged"), F.min_by("file_no", ord_).alias("file_no"), F.min_by("position", ord_).alias("position"),
        F.max_by("next_file_no", ord_).alias("next_file_no"), F.max_by("next_position", ord_).alias("next_position"), F.max("gtid").alias("gtid"),
    )
    several = runs.filter("n_merged > 1").select("run")
    sets = to_text(merge(parse(r.join(several, "run", "left_semi").filter("gtid <> ''").select(F.col("run").alias("set_id"), F.col("gtid").alias("gtid_text")))))
    named = runs.join(sets.withColumnRenamed("set_id", "run"), "run", "left")
    return named.withColumn("gtid_text", F.when(F.col("n_merged") > 1, F.coalesce("gtid_text", F.lit(""))).otherwise(F.coalesce("gtid", F.lit("")))).drop("run", "gtid")


def contiguous_prefix(pkg: DataFrame, base: int, most: int | None = None) -> DataFrame:
    """Packages of the unbroken run of numbers from base on, at most `most` of them: what an ordered sink may release.

    The first gap is found by aggregation: the least number, at base or above, whose successor is missing."""
    seqs = pkg.select("trans_seq_no").filter(F.col("trans_seq_no") >= base).distinct()
    after = seqs.select((F.col("trans_seq_no") + 1).alias("trans_seq_no")).unionAll(pkg.sparkSession.createDataFrame([(base,)], "trans_seq_no long"))
    gap = after.join(seqs, "trans_seq_no", "left_anti").agg(F.min("trans_seq_no").alias("gap"))
    stop = gap if most is None else gap.select(F.least("gap", F.lit(base + most)).alias("gap"))
    return pkg.filter(F.col("trans_seq_no") >= base).join(F.broadcast(stop), F.col("trans_seq_no") < F.col("gap")).drop("gap")  # one row is broadcast


RECORD = "gtid string, events array<struct<event_type bigint, database_name string, table_name string, position bigint, next_position bigint>>"


def records(ev: DataFrame) -> DataFrame:
    """trans_seq_no, record: each transaction as JSON with its events in order."""
    cells = ("event_type", "database_name", "table_name", "position", "next_position")
    g = ev.groupBy("trans_seq_no").agg(F.max("gtid").alias("gtid"), F.sort_array(F.collect_list(F.struct("ev_idx", *cells))).alias("e"))
    events = F.transform("e", lambda x: F.struct(*[x[c].alias(c) for c in cells]))
    return g.select("trans_seq_no", F.to_json(F.struct("gtid", events.alias("events"))).alias("record"))


def generated(texts: DataFrame, epoch: int, start: int) -> DataFrame:
    """Packages made of JSON transactions (trans_seq_no, record), moved so that each starts at start: gtid, events, position, next_position, message_id, key."""
    got = texts.withColumn("r", F.from_json("record", RECORD)).select("trans_seq_no", "r.*")
    shift = start - F.array_min(F.transform("events", lambda x: x["position"]))
    moved = F.transform("events", lambda x: x.withField("position", x["position"] + F.col("_shift")).withField("next_position", x["next_position"] + F.col("_shift")))
    out = got.withColumn("_shift", shift).withColumn("events", moved).drop("_shift").withColumns({"epoch": F.lit(epoch).cast("long"), "seq_no": F.lit(0).cast("long"), "position": F.lit(start).cast("long")})
    return out.withColumns({"next_position": F.array_max(F.transform("events", lambda x: x["next_position"])), "message_id": message_id(), "key": package_key()})
