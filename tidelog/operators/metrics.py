"""Counters, meters, averages, lag, stage latencies; replicas and gates on their progress."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stored import stored


def counter(samples: DataFrame) -> DataFrame:
    """Total up to each tick, by metric."""
    t = samples.groupBy("metric_name", "tick").agg(F.sum("value").alias("added"))
    w = Window.partitionBy("metric_name").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("total", F.sum("added").over(w))


def meter(totals: DataFrame, seconds: int = 10) -> DataFrame:
    """Whole units a second since the tick before; 0 at the first."""
    w = Window.partitionBy("metric_name").orderBy("tick")
    span = (F.col("tick") - F.lag("tick").over(w)) * seconds
    rate = F.when(span >= 1, F.floor((F.col("total") - F.lag("total").over(w)) / span)).otherwise(0)
    return totals.withColumn("rate", rate.cast("long"))


def moving_average(samples: DataFrame, n: int = 5) -> DataFrame:
    """Whole-number mean of the last n values, by metric in the order of sample."""
    w = Window.partitionBy("metric_name").orderBy("sample").rowsBetween(1 - n, 0)
    return samples.withColumn("average", F.floor(F.sum("value").over(w) / F.count("value").over(w)).cast("long"))


def lag_seconds(df: DataFrame, now, ts, clock_diff: int = 0) -> DataFrame:
    return df.withColumn("lag", F.greatest(F.lit(0), now - ts - clock_diff).cast("long"))


def stage_latency(points: DataFrame, stages: list[str]) -> DataFrame:
    """Differences of neighbouring time stamps."""
    return points.withColumns({f"{b}_ms": F.col(b) - F.col(a) for a, b in zip(stages, stages[1:])})


def json_lines(samples: DataFrame) -> DataFrame:
    return samples.select(F.to_json(F.struct(F.col("metric_name").alias("metricName"), F.col("tick").alias("timestamp"), F.col("total").alias("longValue"))).alias("line"))


def replica_gate(trx: DataFrame, polls: DataFrame, timeout: int) -> DataFrame:
    """trans_seq_no, released_at: when each replica that was healthy at the commit (trx: trans_seq_no, ts) has executed the transaction or has
    turned unhealthy, at most timeout later; at once if none was healthy. polls: server_id, poll_id, poll_ts, healthy, executed_to.

    A replica's health at a commit is that of its last poll at or before it. Both lookups are joins on spans: of time, where a poll is dealt to
    the spans until the next poll of its replica, and of numbers, where a poll that raises what is executed is dealt to the spans it
    covers anew. Spans are as many as the polls need, so that pairs that meet are about one a transaction and replica."""
    w = Window.partitionBy("server_id").orderBy("poll_ts", "poll_id")
    # what follows, as a running minimum from the end: a frame that reaches to the end would be read anew for each row
    onward = Window.partitionBy("server_id").orderBy(F.desc("poll_ts"), F.desc("poll_id")).rowsBetween(Window.unboundedPreceding, -1)
    p = stored(polls.withColumns({"until": F.lead("poll_ts").over(w), "unhealthy_at": F.min(F.when(~F.col("healthy"), F.col("poll_ts"))).over(onward)}))
    covers = polls.filter("healthy").withColumn("before", F.coalesce(F.max("executed_to").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter("executed_to > before")
    trx = stored(trx)
    (t0, t1, s0, s1), n = trx.agg(F.min("ts"), F.max("ts"), F.min("trans_seq_no"), F.max("trans_seq_no")).first(), polls.count()
    if t0 is None:
        return trx.select("trans_seq_no", F.col("ts").alias("released_at"))
    by_time, by_seq = max(1, (t1 - t0 + 1) // max(1, n)), max(1, (s1 - s0 + 1) // max(1, n))
    at = p.filter((F.col("poll_ts") <= t1) & F.coalesce(F.col("until") > t0, F.lit(True))).withColumn("_last", F.least(F.coalesce("until", F.lit(t1)), F.lit(t1)))
    at = at.withColumn("_span", F.explode(F.sequence(F.floor((F.greatest("poll_ts", F.lit(t0)) - t0) / by_time), F.floor((F.greatest("_last", F.lit(t0)) - t0) / by_time))))
    own = trx.withColumn("_span", F.floor((F.col("ts") - t0) / by_time))
    waits = own.join(at, "_span").filter("healthy and poll_ts <= ts and (until is null or ts < until)").select("trans_seq_no", "ts", "server_id", "unhealthy_at")
    c = covers.filter((F.col("executed_to") >= s0) & (F.col("before") < s1)).withColumn("_span", F.explode(F.sequence(F.floor((F.greatest(F.col("before") + 1, F.lit(s0)) - s0) / by_seq), F.floor((F.least("executed_to", F.lit(s1)) - s0) / by_seq))))
    seen = waits.withColumn("_span", F.floor((F.col("trans_seq_no") - s0) / by_seq)).join(c.select("_span", "before", "executed_to", F.col("server_id").alias("_server"), F.col("poll_ts").alias("seen_at")), "_span")
    seen = seen.filter("server_id = _server and trans_seq_no > before and trans_seq_no <= executed_to").select("trans_seq_no", "server_id", "seen_at")
    j = waits.join(seen, ["trans_seq_no", "server_id"], "left")
    end = F.col("ts") + timeout
    done = F.least(F.greatest(F.coalesce(F.least("seen_at", "unhealthy_at"), end), F.col("ts")), end)
    released = j.groupBy("trans_seq_no").agg(F.max(done).alias("released_at"))
    return trx.join(released, "trans_seq_no", "left").select("trans_seq_no", F.coalesce("released_at", "ts").alias("released_at"))


def reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    """server_id, change: added, kept or evicted."""
    o, n = old.select("server_id", F.lit(1).alias("o")), new.select("server_id", F.lit(1).alias("n"))
    return o.join(n, "server_id", "full_outer").select("server_id", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "evicted").otherwise("kept").alias("change"))


def health_changes(polls: DataFrame) -> DataFrame:
    """Polls at which a replica's health differs from the one before."""
    w = Window.partitionBy("server_id").orderBy("poll_ts", "poll_id")
    return polls.withColumn("was", F.lag("healthy").over(w)).filter("was is not null and was <> healthy").select("server_id", "poll_id", "poll_ts", "healthy")


def alarm_text(message):
    return F.translate(F.substring(message, 1, 100), ":", " ")


def registered() -> dict[str, Column]:
    """The metrics of a log, by name: what each event adds."""
    kind = F.col("event_type")
    one = lambda c: F.when(c, 1).otherwise(0)
    return {
        "event_count": F.lit(1), "row_count": F.col("n_rows"), "byte_count": F.col("size"), "transaction_count": one(kind == 33), "ddl_count": one((kind == 2) & (F.col("statement") != "BEGIN")),
        "insert_count": one(kind == 30), "update_count": one(kind == 31), "delete_count": one(kind == 32), "rotate_count": one(kind == 4),
    }


def report(ev: DataFrame, tick: Column) -> DataFrame:
    """tick, metric_name, value of all registered metrics, in one pass."""
    names = registered()
    wide = ev.groupBy(tick.alias("tick")).agg(*[F.sum(c).cast("long").alias(n) for n, c in names.items()])
    return wide.unpivot("tick", list(names), "metric_name", "value")


def observed(ev: DataFrame, name: str):
    """ev and an Observation that holds the registered metrics of all of it once a query over it has run."""
    from pyspark.sql import Observation

    o = Observation(name)
    return ev.observe(o, *[F.sum(c).alias(n) for n, c in registered().items()]), o


def due(ticks: DataFrame, interval: int) -> DataFrame:
    """Moments (at, in seconds) at which a report is due: interval or more have passed since the last due one. A fold, by name, over the
    moments at which the clock was looked at; each name's are few."""
    def run(pdf):
        last, out = None, []
        for at in sorted(pdf["at"].tolist()):
            if last is None or at - last >= interval:
                last = at
                out.append(at)
        return pd.DataFrame({"metric_name": [pdf["metric_name"].iloc[0]] * len(out), "at": out})

    return ticks.select("metric_name", "at").groupBy("metric_name").applyInPandas(run, "metric_name string, at long")


def batch_sizes(pkg: DataFrame, most: int) -> DataFrame:
    """batch, n, bytes of what an ordered sink takes at a time: most packages in the order of trans_seq_no."""
    from ..functions.sequence import with_running_sum

    placed = with_running_sum(stored(pkg.select("trans_seq_no", "bytes")), "trans_seq_no", F.lit(1).cast("long"), "_place")
    return placed.groupBy(F.floor((F.col("_place") - 1) / most).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def leader(children: DataFrame) -> DataFrame:
    """Of each parent, the child of the smallest sequence number, the last ten digits of its name: parent, child."""
    n = F.regexp_extract("child", r"(\d{1,10})$", 1).cast("long")
    return children.withColumn("_n", n).groupBy("parent").agg(F.min_by("child", F.struct("_n", "child")).alias("child"))


def truncation_alarm(ev: DataFrame) -> DataFrame:
    """trans_seq_no, alarm of transactions that were cut: id, place, length, the first database and table, `...` if there are others."""
    own = ev.filter(F.col("event_type").isin(30, 31, 32)).groupBy("trans_seq_no").agg(F.min_by(F.struct("database_name", "table_name"), "ev_idx").alias("f"), F.count_distinct("database_name", "table_name").alias("kinds"))
    place = ev.groupBy("trans_seq_no").agg(F.max("gtid").alias("gtid"), F.min_by("file_no", "ev_idx").alias("file_no"), F.min_by("position", "ev_idx").alias("position"), F.max_by("next_position", "ev_idx").alias("next_position"))
    text = F.concat(F.lit("GTID:"), F.col("gtid"), F.lit(" Binlog:"), F.col("file_no").cast("string"), F.lit(":"), F.col("position").cast("string"), F.lit("~"), F.col("next_position").cast("string"), F.lit(" Len:"), (F.col("next_position") - F.col("position")).cast("string"), F.lit(" DB:"), F.col("f.database_name"), F.lit(" Table:"), F.col("f.table_name"), F.when(F.col("kinds") > 1, " ...").otherwise(""))
    return own.join(place, "trans_seq_no").select("trans_seq_no", text.alias("alarm"))


def assigned(topics: DataFrame, threads: int) -> DataFrame:
    """topics (topic_no) and threads dealt to each other in turn: a row for each topic if there are as many at least, else for each thread."""
    n = topics.count()
    if n >= threads:
        return topics.withColumn("thread", F.col("topic_no") % threads)
    return topics.withColumn("thread", F.explode(F.sequence(F.col("topic_no"), F.lit(threads - 1), F.lit(max(1, n)))))


def liveness(beats: DataFrame, now: Column, timeout: int, safe: float = 0.4) -> DataFrame:
    """name, silence (seconds since its last beat), mode of each member: `live`, `safe` from safe x timeout of silence on, in which nothing is
    written any more, and `gone` from timeout on."""
    last = beats.groupBy("name").agg(F.max("at").alias("last")).withColumn("silence", now - F.col("last"))
    mode = F.when(F.col("silence") >= timeout, "gone").when(F.col("silence") >= safe * timeout, "safe").otherwise("live")
    return last.select("name", "silence", mode.alias("mode"))
