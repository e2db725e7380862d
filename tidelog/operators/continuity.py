"""Transaction summaries and the continuity check of a change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import ROWS, ranges_of, with_previous


#: Rows of the tables of epochs, three numbers each, up to which they are broadcast; beyond, transactions are joined to them by a shuffle.
MOST_EPOCHS = 100_000


def summaries(ev: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row a transaction: place of its first event, place after its last, counts and sums. A rotate event moves the end to the next file.

    tasks: how many a large log asks for. Events are summed up within a file first, where the log is dealt by files, and what is left of transactions is
    dealt to so many."""
    place = lambda file, position: F.struct("ev_idx", F.col(file).alias("file_no"), F.col(position).alias("position"))
    parts = ev.groupBy("trans_seq_no", "file_no").agg(
        F.max("gtid").alias("gtid"), F.max("epoch").alias("epoch"), F.min(place("file_no", "position")).alias("first"), F.max(place("file_no", "next_position")).alias("last"),
        F.max(F.when(F.col("event_type") == 4, F.col("file_no") + 1)).alias("rotated"), F.count(F.lit(1)).alias("n_events"), F.sum("n_rows").alias("n_rows"), F.sum("size").alias("bytes"), F.max("ts").alias("ts"),
    )
    rotated = F.max("rotated")
    return (parts.repartition(tasks, "trans_seq_no") if tasks else parts).groupBy("trans_seq_no").agg(
        F.max("gtid").alias("gtid"), F.max("epoch").alias("epoch"), F.min("first")["file_no"].alias("file_no"), F.min("first")["position"].alias("position"),
        F.coalesce(rotated, F.max("last")["file_no"]).alias("next_file_no"), F.when(rotated.isNotNull(), F.lit(4).cast("long")).otherwise(F.max("last")["position"]).alias("next_position"),
        F.sum("n_events").alias("n_events"), F.sum("n_rows").alias("n_rows"), F.sum("bytes").alias("bytes"), F.max("ts").alias("ts"),
    )


def event_breaks(ev: DataFrame, tasks: int | None = None) -> DataFrame:
    """Events after which the next one of the same transaction and file does not follow on. tasks: how many a large log asks for."""
    w = Window.partitionBy("trans_seq_no").orderBy("ev_idx")
    ev = ev.repartition(tasks, "trans_seq_no") if tasks else ev
    n = ev.withColumns({"after": F.lead("position").over(w), "after_file": F.lead("file_no").over(w)})
    return n.filter((F.col("after_file") == F.col("file_no")) & (F.col("after") != F.col("next_position"))).select("trans_seq_no", "ev_idx", "next_position", "after")


def transaction_breaks(trx: DataFrame, rows: int = ROWS) -> DataFrame:
    """Transactions that do not start where the one before ended: trans_seq_no, gtid, file_no, position, prev_seq, prev_file_no, prev_position.

    After a restart (the epoch grew) those without a gtid that are not continuous are exempt, and are no predecessors: the next is
    compared with the same predecessor as they are. trx is in the order of trans_seq_no, and epochs do not fall in it.

    No fold over the log is needed. Of an epoch, only the rows before its first taken one can be exempt, all against the last
    row taken in epochs before; the first taken row is the first that has a gtid or continues that one, and from there on each row's
    predecessor is the row before. So only epochs depend on each other, and there is one row for each of them. trx is read several times:
    hand over a stored table."""
    seq, known = F.col("trans_seq_no"), F.coalesce(F.col("gtid"), F.lit("")) != ""
    end = F.struct("trans_seq_no", F.col("next_file_no").alias("file_no"), F.col("next_position").alias("position"))
    epochs = trx.groupBy("epoch").agg(F.max_by(end, seq).alias("tail"), F.max(known).alias("sure")).orderBy("epoch").collect()  # a row for each restart
    spark, meets = trx.sparkSession, {}
    small = (lambda df: F.broadcast(df)) if len(epochs) <= MOST_EPOCHS else (lambda df: df)
    if not all(r["sure"] for r in epochs):
        ends = spark.createDataFrame([(r["epoch"], r["tail"]["file_no"], r["tail"]["position"]) for r in epochs], "before long, file_no long, position long")
        lone = spark.createDataFrame([(r["epoch"],) for r in epochs if not r["sure"]], "epoch long")
        met = trx.join(small(lone), "epoch", "left_semi").join(small(ends), ["file_no", "position"]).filter("before < epoch")
        meets = {r["epoch"]: r["meets"] for r in met.groupBy("epoch").agg(F.collect_set("before").alias("meets")).collect()}
    last, before = None, []
    for r in epochs:
        before.append((r["epoch"], *((None, None) if last is None else (last["tail"]["file_no"], last["tail"]["position"]))))
        if last is None or r["sure"] or last["epoch"] in meets.get(r["epoch"], ()):
            last = r
    ended = spark.createDataFrame(before, "epoch long, end_file long, end_position long")
    taken = known | F.col("end_file").isNull() | (F.col("file_no") == F.col("end_file")) & (F.col("position") == F.col("end_position"))
    starts = trx.join(small(ended), "epoch").filter(taken).groupBy("epoch").agg(F.min(seq).alias("from_seq")).collect()
    starts = spark.createDataFrame([tuple(r) for r in starts], "epoch long, from_seq long")
    kept = trx.join(small(starts), "epoch").filter("trans_seq_no >= from_seq").drop("from_seq")
    t = with_previous(kept, "trans_seq_no", {"prev_seq": seq, "prev_file_no": F.col("next_file_no"), "prev_position": F.col("next_position")}, rows, borders=ranges_of(trx, "trans_seq_no", rows))
    return t.filter("prev_seq is not null and (file_no <> prev_file_no or position <> prev_position)").select("trans_seq_no", "gtid", "file_no", "position", "prev_seq", "prev_file_no", "prev_position")


def broken_counts(events: DataFrame, transactions: DataFrame) -> DataFrame:
    """error, broken_count: how many of each kind."""
    return events.select(F.lit("event").alias("error")).unionAll(transactions.select(F.lit("transaction").alias("error"))).groupBy("error").agg(F.count(F.lit(1)).alias("broken_count"))


def offset_ranges(packages: DataFrame, rows: int = ROWS) -> DataFrame:
    """begin_offset of each package: one after the end of the last, so that skipped messages count for the next."""
    p = with_previous(packages, "end_offset", {"last_end": F.col("end_offset")}, rows)
    return p.withColumn("begin_offset", F.coalesce(F.col("last_end") + 1, F.col("end_offset"))).drop("last_end")


def file_switches(trx: DataFrame) -> DataFrame:
    return trx.filter("position = 4").select("trans_seq_no", "file_no")


def report(breaks: DataFrame) -> DataFrame:
    """One JSON text a break, numbers as strings, keys in order."""
    text = lambda c: F.col(c).cast("string").alias(c)
    return breaks.select("trans_seq_no", F.to_json(F.struct("gtid", text("position"), text("prev_position"), F.col("trans_seq_no").cast("string").alias("trans_seqno"))).alias("report"))


def full_report(breaks: DataFrame, events: DataFrame, packages: DataFrame) -> DataFrame:
    """One JSON text for all: broken_count, start_offset and stop_offset of the packages read, trans_miss (both sides of each break) and
    event_miss; numbers as strings. packages: trans_seq_no, gtid, epoch, begin_offset, end_offset.

    Breaks are few in a log worth reporting on; their list is one row by the form of the report."""
    text = lambda c: F.col(c).cast("string")
    own = packages.select(F.col("trans_seq_no").alias("_seq"), F.struct(F.col("gtid").alias("GTID"), text("begin_offset").alias("begin_offset"), text("end_offset").alias("end_offset"), text("epoch").alias("epoch"), text("trans_seq_no").alias("trans_seqno")).alias("pkg"))
    both = breaks.select("trans_seq_no", "prev_seq").join(own.select(F.col("_seq").alias("prev_seq"), F.col("pkg").alias("pre")), "prev_seq").join(own.select(F.col("_seq").alias("trans_seq_no"), F.col("pkg").alias("next")), "trans_seq_no")
    missed = events.select("trans_seq_no").distinct().join(own, F.col("trans_seq_no") == F.col("_seq"))
    lists = both.agg(F.sort_array(F.collect_list(F.struct("trans_seq_no", "pre", "next"))).alias("t")).crossJoin(missed.agg(F.sort_array(F.collect_list(F.struct("trans_seq_no", "pkg"))).alias("e"))).crossJoin(packages.agg(F.min("begin_offset").alias("start"), F.max("end_offset").alias("stop")))  # one row each
    trans = F.transform("t", lambda x: F.struct(x["next"].alias("next"), x["pre"].alias("pre")))
    whole = F.struct((F.size("t") + F.size("e")).cast("string").alias("broken_count"), F.transform("e", lambda x: x["pkg"]).alias("event_miss"), text("start").alias("start_offset"), text("stop").alias("stop_offset"), trans.alias("trans_miss"))
    return lists.select(F.to_json(whole).alias("report"))


def csv_lines(ev: DataFrame) -> DataFrame:
    """One line a transaction: gtid, then four fields for each event."""
    e = F.concat_ws(",", "event_type", "database_name", "table_name", "position")
    g = ev.groupBy("trans_seq_no").agg(F.max("gtid").alias("gtid"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ev_idx", e.alias("e")))), lambda x: x["e"]), ",").alias("events"))
    return g.select("trans_seq_no", F.concat_ws(",", "gtid", "events").alias("line"))
