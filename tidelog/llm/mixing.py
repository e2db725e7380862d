"""Mixing sources to target weights, with DataFrame functions alone.

Sizes are summed per source; targets are filled up by weight until a source's cap stops it; each source has
a repetition rate target / size. A document is emitted floor(rate) times, and once more if a hash of its id
falls below the fraction, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, store

#: Weights of the sources in the order of their names, repeating; share of all sizes; most repetitions.
WEIGHTS, SHARE, CAP, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, "mix-1:"
#: The table of rates is broadcast up to so many sources and characters in their names; beyond, sources are salted.
FEW_SOURCES, FEW_CHARS, SALTS = 10_000, 1 << 20, 64


def word_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; 0 for null."""
    t = F.coalesce(text, F.lit(""))
    return F.size(F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 to below 1 that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 12), 16, 10).cast("long") / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target, rate from (source, source_size), one row a source.

    Filling by weight with caps has a closed form: sources reach their caps in the order of cap / weight, so
    running sums over that order give the water level. The windows see one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", cap * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # a running sum from the end: a frame that reaches to the end would be summed anew for each source
    after = Window.orderBy((F.col("cap") / F.col("w")).desc(), F.col("source").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(whole)["level"]
    target = F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap")))
    return s.withColumn("target", target).select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(0.0).alias("rate"))


def copies(rate: Column, doc_id: Column) -> Column:
    return (F.floor(rate) + F.when(draw(doc_id) < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every row. A null source is a source of its own, the last;
    a null or empty text has size 0 and takes nothing; equal rows are drawn alike. An empty table gives no rows."""
    sized = store(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))  # each text is split once
    goal = store(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumnRenamed("source", "name"))
    joined = with_rates(sized, goal, "name")
    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", copies(F.col("rate"), F.col("doc_id")).alias("copies")).withColumn("taken", F.col("size") * F.col("copies")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def with_rates(docs: DataFrame, goal: DataFrame, name: str) -> DataFrame:
    """docs with the columns of goal, whose column name matches source. No text is shuffled if goal is small, which is counted;
    else each source is spread over SALTS parts, by a row's place in its input."""
    n, chars = goal.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(name)), F.lit(0))).first()
    same = docs["source"].eqNullSafe(goal[name])
    if n <= FEW_SOURCES and chars <= FEW_CHARS:
        return docs.join(F.broadcast(goal), same)
    salt, own = fresh(docs, "mix_salt"), fresh(docs, "mix_part")
    parts = goal.withColumn(own, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = docs.withColumn(salt, (F.monotonically_increasing_id() % SALTS).cast("int"))
    return rows.join(parts.hint("shuffle_merge"), rows["source"].eqNullSafe(parts[name]) & (rows[salt] == parts[own]))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents: every row of docs as often as it is taken, with the columns of docs."""
    name, rate, copy = (fresh(docs, x) for x in ("mix_name", "mix_rate", "mix_copy"))
    sizes = docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    goal = store(targets(sizes.select("source", "source_size")).select(F.col("source").alias(name), F.col("rate").alias(rate)))
    kept = with_rates(docs, goal, name).withColumn(copy, copies(F.col(rate), F.col("doc_id")))
    kept = kept.filter(F.col(copy) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy))))
    return kept.select(*docs.columns)
