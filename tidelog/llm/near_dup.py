"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within 3 bits meet when each moves by at most half the radius. The odd third bit is
taken up in one of two ways.

1. All fingerprints: one third of the bits is erased (a third that holds a difference leaves at most two), and
   each emits the ball of radius 1 of the rest, about 132 variants in all. Fingerprints that share a variant
   are candidates, and are verified, a pair in one of its variants only.
2. Members of variants that more than DENSE fingerprints share (up to there, comparing them costs less than the
   variants below): balls over all 64 bits, radius 1 for each and,
   for fingerprints of odd parity, the flips of two bits in the same half. Of three differing bits two lie in the same
   half, and a distance of 3 means unlike parity, so the pair meets. Such a variant needs no verification: all
   its members are within 3 bits of any member of the radius-1 ball, so a star replaces all pairs, and
   a variant has at most 65 + 992 members whatever the data are.

Fingerprints are made distinct first, so copies never meet in a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import by_batch, fresh, join_split, store

RADIUS, SEED, DENSE = 3, 42, 1024
#: The thirds of a fingerprint, as masks.
THIRDS = [(1 << 22) - 1, ((1 << 43) - 1) ^ ((1 << 22) - 1), ((1 << 64) - 1) ^ ((1 << 43) - 1)]
#: Words hashed at a time.
STEP = 1 << 16


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None) -> int:
    """SimHash of the 3-word shingles (XXH64, seed 42); 0 for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < 3:
        return xxh64_intdigest(b" ".join(words), SEED)
    ones, n = np.zeros(64, np.int64), len(words) - 2
    for at in range(0, n, STEP):
        own = words[at : at + STEP + 2]
        joined = b" ".join(own)
        ends = np.cumsum([len(w) + 1 for w in own])
        starts = (ends - [len(w) + 1 for w in own])[: len(own) - 2].tolist()
        h = np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, (ends[2:] - 1).tolist())), np.uint64, len(starts))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and digest (a hash of the text) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("digest", pa.int64())])

    def run(x: dict[str, list]) -> dict[str, list]:
        return {"doc_id": x["doc_id"], "fp": [signed(fingerprint(t)) for t in x["text"]], "digest": x["digest"]}

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
    return own.mapInArrow(by_batch(run, schema), "doc_id long, fp long, digest long")


def erased_variants(fps: DataFrame) -> DataFrame:
    moves = [f"struct({signed(m)}L as m, {signed(f)}L as f)" for m in THIRDS for f in [0] + [1 << i for i in range(64) if not m >> i & 1]]
    moves = [x.replace(f"{-(1 << 63)}L", "shiftleft(1L, 63)") for x in moves]
    return fps.select("fp", F.expr(f"inline(array({', '.join(moves)}))")).select("fp", F.expr("(fp | m) ^ f").alias("key"))


def ball_variants(fps: DataFrame) -> DataFrame:
    one = ["0L"] + [f"shiftleft(1L, {i})" for i in range(64)]
    two = [f"(shiftleft(1L, {i}) | shiftleft(1L, {j}))" for half in (range(32), range(32, 64)) for i in half for j in half if i < j]
    near = fps.select("fp", F.lit(True).alias("near"), F.expr(f"explode(array({', '.join(one)}))").alias("f"))
    far = fps.filter("bit_count(fp) % 2 = 1").select("fp", F.lit(False).alias("near"), F.expr(f"explode(array({', '.join(two)}))").alias("f"))
    return near.unionByName(far).select("fp", "near", F.expr("fp ^ f").alias("key"))


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within RADIUS bits, such that their components are those of all such pairs."""
    per_key = Window.partitionBy("key")
    hits = store(erased_variants(fps).withColumn("n", F.count(F.lit(1)).over(per_key)).filter("n > 1"))
    few = hits.filter(F.col("n") <= DENSE)
    x = "((a ^ b) & ~m)"
    meet = f"transform(array({', '.join(f'{signed(m)}L' for m in THIRDS)}), m -> struct(bit_count{x} as far, CASE WHEN bit_count{x} = 2 THEN (a | m) ^ ({x} & -{x}) ELSE a | m END as key))"
    first = f"element_at(filter({meet}, t -> t.far <= 2), 1).key"
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").filter(f"a < b and bit_count(a ^ b) <= {RADIUS}").filter(f"key = {first}").select("a", "b").distinct()
    dense = hits.filter(F.col("n") > DENSE).select("fp").distinct()
    stars = ball_variants(dense).withColumn("a", F.min(F.when(F.col("near"), F.col("fp"))).over(per_key)).filter("a is not null and a <> fp").select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")).distinct()
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node) of every node of an edge (a, b), by alternating large and small stars until they rest.

    Each round is written to the shared folder; rounds grow with the logarithm of the longest chain."""
    now = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = store(small)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored tables: the rows' fingerprints; and fp, n (rows), low (smallest doc_id), root of each distinct fingerprint."""
    rows = store(fingerprints(docs))
    fps = store(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")))
    root = components(links(fps.select("fp")))
    return rows, store(fps.join(root, fps["fp"] == root["node"], "left").select("fp", "n", "low", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each row of docs.

    A null or empty text has no words and fingerprint zero, linked like any other. Equal rows all appear. A row
    with a null doc_id takes part, but never names a component; its component_id is null if no other row does."""
    rows, owned = linked(docs)
    low = owned.groupBy("root").agg(F.min("low").alias("component_id"))
    named = store(owned.join(low, "root").select("fp", "n", "component_id"))
    return join_split(rows, named, ["fp"], "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are the first of their group: one row a group, of the smallest doc_id, null last, and of
    the rows of one id that of the smallest hash of its text.

    A group is a component of near duplicates, so that every group keeps a row, whatever repeats: rows of one doc_id with unlike
    texts are of different groups. Equal rows are one. An empty table stays empty."""
    rows, owned = linked(docs)
    every = join_split(rows, owned.select("fp", "n", "root"), ["fp"], "n").groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    first = every.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "n")).alias("k"))
    own, digest, n = (fresh(docs, x) for x in ("near_dup_id", "near_dup_digest", "near_dup_n"))
    keep = store(first.select(F.col("k.doc_id").alias(own), F.col("k.digest").alias(digest), F.col("k.n").alias(n)))
    keyed = docs.withColumn(own, F.col("doc_id").cast("long")).withColumn(digest, F.xxhash64("text"))
    kept = join_split(keyed, keep, [own, digest], n)
    once, again = kept.filter(F.col(n) == 1), kept.filter(F.col(n) > 1).dropDuplicates([own, digest])
    return once.unionByName(again).select(*docs.columns)
