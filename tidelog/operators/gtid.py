"""Sets of transaction ids as tables of closed intervals: (set_id, uuid, lo, hi)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stored import stored


def parse(sets: DataFrame) -> DataFrame:
    """From (set_id, gtid_text `uuid:1-5:7,uuid2:3`) to intervals, not merged yet."""
    one = sets.select("set_id", F.explode(F.split("gtid_text", ",")).alias("part")).withColumn("bits", F.split(F.trim("part"), ":"))
    each = one.select("set_id", F.lower(F.trim(F.col("bits")[0])).alias("uuid"), F.explode(F.slice("bits", 2, 100_000_000)).alias("span"))
    lo, hi = F.substring_index("span", "-", 1).cast("long"), F.substring_index("span", "-", -1).cast("long")
    return each.select("set_id", "uuid", lo.alias("lo"), hi.alias("hi"))


#: Numbers of a range, so that one uuid with many of them is many tasks: of the lookups by number, and within which intervals are joined first.
SPAN, NEAR = 1 << 20, 1 << 17
#: Intervals of a task, about, and of a table that is not dealt out; rows of a table that is broadcast, four numbers and a uuid each, at most.
ROWS, MOST = 500_000, 100_000


def islands(intervals: DataFrame, *by: str) -> DataFrame:
    w = Window.partitionBy("set_id", "uuid", *by).orderBy("lo", "hi")
    far = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("start", F.when(far.isNull() | (F.col("lo") > far + 1), 1).otherwise(0)).withColumn("island", F.sum("start").over(w))
    return marked.groupBy("set_id", "uuid", *by, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def merge(intervals: DataFrame, rows: int = ROWS, near: int = NEAR) -> DataFrame:
    """The same sets with touching and overlapping intervals joined.

    Intervals are joined within ranges of `near` numbers first. Of what is left, only the last interval of a range can touch the next one, and those that
    it or one before touches in a later range are one with it; so a window over a whole set sees two rows a range at most, and all others stay where they are."""
    key = ["set_id", "uuid", "_span"]
    own = stored(intervals.select("set_id", "uuid", "lo", "hi"))
    tasks = -(-own.count() // rows)
    own = own.withColumn("_span", F.floor(F.col("lo") / near))
    if tasks <= 1:
        return islands(islands(own, "_span").drop("_span"))
    left = stored(islands(own.repartition(max(tasks, int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *key), "_span"))
    last = F.floor((F.col("hi") + 1) / near) > F.col("_span")
    sets = left.filter(last).select("set_id", "uuid").distinct()
    tops = left.groupBy(*key).agg(F.max("hi").alias("hi")).join(sets, ["set_id", "uuid"], "left_semi")  # a row a range before a set is one task's
    far = F.max("hi").over(Window.partitionBy("set_id", "uuid").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    met = stored(tops.select(*key, far.alias("_far")).filter(F.floor((F.col("_far") + 1) / near) >= F.col("_span")))
    small = (lambda df: F.broadcast(df)) if met.count() <= MOST else (lambda df: df)
    both = left.join(small(met), key, "left").withColumn("_met", F.coalesce(F.col("lo") <= F.col("_far") + 1, F.lit(False)))
    edges = both.filter(F.col("_met") | last).groupBy(*key, "_met").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    columns = ["set_id", "uuid", "lo", "hi"]
    return both.filter(~(F.col("_met") | last)).select(*columns).unionByName(islands(edges.select(*columns)))


def add(sets: DataFrame, more: DataFrame) -> DataFrame:
    """Sets and single ids, or other sets, of the same set_id as one."""
    return merge(sets.select("set_id", "uuid", "lo", "hi").unionByName(more.select("set_id", "uuid", "lo", "hi")))


def to_text(intervals: DataFrame) -> DataFrame:
    """set_id, gtid_text of merged intervals, uuids in order. The text of a large set is made of pieces, one for each range of numbers."""
    span = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    joined = lambda order: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "s"))), lambda x: x["s"]), ":")
    pieces = intervals.select("set_id", "uuid", "lo", F.floor(F.col("lo") / NEAR).alias("_piece"), span.alias("s")).groupBy("set_id", "uuid", "_piece").agg(joined("lo").alias("s"))
    u = pieces.groupBy("set_id", "uuid").agg(joined("_piece").alias("s"))
    return u.groupBy("set_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "uuid", "s"))), ",").alias("gtid_text"))


def contains(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """set_id, contained for each set of inner: whether the merged set of outer (one set) holds all of it.

    One sweep in the order of numbers: of merged intervals only the last outer one that starts at or before an inner one can hold it."""
    o = merge(outer.withColumn("set_id", F.lit(0))).select("uuid", F.lit(None).cast("long").alias("set_id"), "lo", "hi", F.lit(0).alias("side"))
    both = o.unionByName(merge(inner).select("uuid", F.col("set_id").cast("long").alias("set_id"), "lo", "hi", F.lit(1).alias("side")))
    w = Window.partitionBy("uuid").orderBy("lo", "side").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("side") == 0, F.col("hi"))).over(w)
    return both.withColumn("reach", reach).filter("side = 1").groupBy("set_id").agg(F.min(F.coalesce(F.col("hi") <= F.col("reach"), F.lit(False))).alias("contained"))


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    """Intervals of left (each set) that the set of right lacks: a sweep over borders."""
    b = merge(right.withColumn("set_id", F.lit(0))).select("uuid", "lo", "hi")
    a = merge(left)
    b = a.select("set_id", "uuid").distinct().join(b, "uuid")
    plus = lambda df, v: df.select("set_id", "uuid", F.col("lo").alias("at"), F.lit(v).alias("d")).unionAll(df.select("set_id", "uuid", (F.col("hi") + 1).alias("at"), F.lit(-v).alias("d")))
    e = plus(a, 2).unionAll(plus(b, 1)).groupBy("set_id", "uuid", "at").agg(F.sum("d").alias("d"), F.sum(F.when(F.abs("d") == 2, F.col("d") / 2).otherwise(0)).alias("da"), F.sum(F.when(F.abs("d") == 1, F.col("d")).otherwise(0)).alias("db"))
    w = Window.partitionBy("set_id", "uuid").orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    s = e.withColumns({"ina": F.sum("da").over(run), "inb": F.sum("db").over(run), "next": F.lead("at").over(w)})
    return merge(s.filter("ina > 0 and inb = 0").select("set_id", "uuid", F.col("at").alias("lo"), (F.col("next") - 1).alias("hi")))


def split_id(gtid):
    """uuid and number of one id; an id domain-server-number, which has no colon, has the server as its uuid."""
    colon = F.instr(gtid, ":") > 0
    server = F.regexp_extract(gtid, r"^[^-]*-([^-]*)-", 1)
    return F.when(colon, F.substring_index(gtid, ":", 1)).otherwise(server), F.when(colon, F.substring_index(gtid, ":", -1)).otherwise(F.substring_index(gtid, "-", -1)).try_cast("long")


def binary(intervals: DataFrame) -> DataFrame:
    """set_id, data: the form on the wire, little-endian 64-bit numbers: how many uuids, and for each its 16 bytes, how many intervals, and
    each with its end exclusive. intervals are merged."""
    def number(c):
        return F.unhex(F.concat(*[F.substring(F.lpad(F.hex(c), 16, "0"), i, 2) for i in range(15, 0, -2)]))

    span = F.concat(number(F.col("lo")), number(F.col("hi") + 1))
    u = intervals.groupBy("set_id", "uuid").agg(F.sort_array(F.collect_list(F.struct("lo", span.alias("b")))).alias("s"))
    one = F.concat(F.unhex(F.replace("uuid", F.lit("-"), F.lit(""))), number(F.size("s").cast("long")), F.aggregate("s", F.lit(b""), lambda acc, x: F.concat(acc, x["b"])))
    sets = u.select("set_id", "uuid", one.alias("b")).groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("uuid", "b"))).alias("u"))
    return sets.select("set_id", F.concat(number(F.size("u").cast("long")), F.aggregate("u", F.lit(b""), lambda acc, x: F.concat(acc, x["b"]))).alias("data"))


def at_boundary(trx: DataFrame) -> DataFrame:
    """The set that is committed after each transaction ends, as (set_id = 0) intervals of all ids up to it: only the last one's is kept,
    as a log that is read in order needs no others. trx: gtid of ended transactions; empty ids add nothing."""
    uuid, n = split_id(F.col("gtid"))
    return merge(trx.filter("gtid <> ''").select(F.lit(0).cast("long").alias("set_id"), uuid.alias("uuid"), n.alias("lo"), n.alias("hi")))
