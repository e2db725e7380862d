"""URL filters, with DataFrame functions alone.

A URL is expanded into expressions, a suffix of its host and a prefix of its path; they are joined to rules on the
first bytes of a digest, the full digest confirms a match, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, join_split, store

#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Verdict of a URL that no rule fits. Rules that are broadcast, at most. Hex digits of a short hash.
DEFAULT, MOST_RULES, SHORT = "allow", 100_000, 8


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def as_rules(spark: SparkSession, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """verdict, rule, n, whole, short, labels, chars of distinct rules (verdict, host, path); of one rule with two verdicts `allow` holds."""
    known = rules.select("verdict", "host", "path") if isinstance(rules, DataFrame) else spark.createDataFrame(rules, "verdict string, host string, path string")
    known = known.filter("verdict is not null").withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    whole = F.concat("host", "path")
    known = known.withColumns({"rule": whole, "labels": F.size(F.split("host", r"\.")), "chars": F.length("path")})
    known = known.groupBy("host", "path", "rule", "labels", "chars").agg(F.min("verdict").alias("verdict"))
    return known.withColumn("whole", F.sha2(F.concat_ws("\n", "host", "path"), 256)).select("verdict", "rule", F.length("rule").alias("n"), "whole", F.substring("whole", 1, SHORT).alias("short"), "labels", "chars")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame | None = None, default: str = DEFAULT, most: int = MOST_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row, judged where it is: no url is a key. A URL that is null or has no `://` has an
    empty host and path and gets the default; repeated rows are judged each for itself. Of rules of equal length the smaller text wins.

    rules: (verdict, host, path), a list or a table of any size. Up to most of them are broadcast. Of more, those whose short hash
    some URL has are found first, by distinct hashes; if these are still more than most, URLs' expressions and rules are joined by
    a shuffle, hot expressions apart."""
    spark = pages.sparkSession
    known = as_rules(spark, RULES if rules is None else rules)
    if rules is not None:
        known = store(known)
    count, labels, chars = known.agg(F.count(F.lit(1)), F.sort_array(F.collect_set("labels")), F.sort_array(F.collect_set("chars"))).first()
    own = pages.select(F.monotonically_increasing_id().alias("uid"), F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("url").isNotNull().alias("some"))
    # only suffixes of as many labels, and prefixes of as many characters, as some rule has can match one
    split = F.split("host", r"\.")
    suffix = F.transform(F.filter(F.array(*map(F.lit, labels or [0])), lambda n: n <= F.size(split)), lambda n: F.array_join(F.slice(split, F.size(split) - n + 1, n), "."))
    prefix = F.transform(F.filter(F.array(*map(F.lit, chars or [0])), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    e = own.withColumn("suffix", F.explode_outer(F.when(F.col("some"), suffix))).withColumn("prefix", F.explode_outer(prefix)).withColumn("digest", F.sha2(F.concat_ws("\n", "suffix", "prefix"), 256))
    e = e.withColumn("digest", F.when(F.col("suffix").isNotNull() & F.col("prefix").isNotNull(), F.col("digest"))).select("uid", "page_id", "host", "path", "digest", F.substring("digest", 1, SHORT).alias("short"))
    if count > most:
        e = store(e)
        used = e.filter("short is not null").groupBy("short").agg(F.count(F.lit(1)).alias("uses"))
        known = store(known.join(used, "short"))
        if known.count() > most:
            # a short hash is a unique key with the few rules that share it
            grouped = store(known.groupBy("short").agg(F.first("uses").alias("uses"), F.collect_list(F.struct("whole", "verdict", "rule", "n")).alias("rules")))
            met = join_split(e.filter("short is not null"), grouped, ["short"], "uses").select(*e.columns, F.inline("rules"))
            return best(met.unionByName(e, allowMissingColumns=True), default)
    return best(e.join(F.broadcast(known.select("short", "whole", "verdict", "rule", "n")), "short", "left"), default)


def best(met: DataFrame, default: str) -> DataFrame:
    """One row a page from its expressions and the rules that they met by short hash: only equal digests count, and the longest rule."""
    found = F.min(F.when(F.col("digest") == F.col("whole"), F.struct((-F.col("n")).alias("n"), "rule", "verdict"))).alias("best")
    one = met.groupBy("uid", "page_id", "host", "path").agg(found)
    return one.select("page_id", "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
