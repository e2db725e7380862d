"""Document fingerprints by SpotSigs.

A signature is a common word (an anchor) and the chain of the next content words. Every text also has the SHINGLES
lowest hashes of its runs of four words, so that a text with few anchors, or none, is no special case. A fingerprint is the set of
both. Sets are compared by Jaccard similarity, and only sets of lengths that can reach the
threshold are compared at all: sets are partitioned by length, so that each is matched within its own partition and the next, and a
comparison ends as soon as what is left cannot reach the threshold.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from .common import by_batch, join_split, partitions, store

#: Words that start a chain, the commonest of each language; and words that are no content.
ANCHORS = frozenset("the is to der die ist le la est el los es".split())
STOP = ANCHORS | frozenset("a an and are as at be by for from had has have he in it of on or she that this was were with und den das ein eine dem zu mit von im auf nicht sich auch les des un une et en du au que qui dans par pour sur ne pas de y las del se una con no su al lo como para".split())
#: Content words of a chain; runs of words that each text gives besides its chains, at most.
CHAIN, SHINGLES = 3, 64
#: Words of which a worker keeps the hashes.
CACHE = 300_000
WORD = re.compile(r"\w+")
RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_signatures", pa.int64()), ("length_part", pa.int32()), ("alike_edited", pa.bool_()), ("alike_next", pa.bool_())])
#: Likeness from which two documents are near copies; signatures compared at a time.
ALIKE, AT_A_TIME = 0.8, 64


class Hashes(dict):
    """32-bit hashes of words."""

    def __missing__(self, word: str) -> int:
        h = xxh32_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < CACHE and len(word) < 64:
            self[word] = h
        return h


hashes = Hashes()


def shingles(words: list[str], width: int, most: int) -> np.ndarray:
    """The lowest distinct 32-bit hashes of the runs of so many words; a shorter text is one run."""
    if not words:
        return np.zeros(0, np.uint32)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)) + np.uint64(1)
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique((h >> np.uint64(32)).astype(np.uint32))[:most]


def signatures(text: str, chain: int = CHAIN, most: int = SHINGLES) -> np.ndarray:
    """The sorted distinct 32-bit hashes of a text's signatures: its anchors' chains and its lowest runs of words."""
    words = WORD.findall(text.lower())
    found: set[str] = set()
    content = [w for w in words if w not in STOP]
    if len(content) != len(words):
        at, n = 0, len(content)
        for w in words:
            if w not in STOP:
                at += 1
            elif w in ANCHORS and at + chain <= n:
                found.add(" ".join((w, *content[at : at + chain])))
    chains = np.fromiter((xxh32_intdigest(s.encode("utf-8", "surrogatepass")) for s in found), np.uint32, len(found))
    return np.union1d(chains, shingles(words, chain + 1, most))


def written(sig: np.ndarray) -> str:
    """A fingerprint as text: 8 hexadecimal digits a signature, ascending."""
    return sig.astype(">u4").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """1 for two empty sets."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def length_part(n: int, threshold: float = ALIKE) -> int:
    """The partition of a set of so many signatures: sets that reach the threshold are in the same one or in neighbours. -1 for none."""
    return int(np.floor(np.log(n) / -np.log(threshold) + 1e-9)) if n else -1


def alike(a: np.ndarray, b: np.ndarray, threshold: float = ALIKE) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity: those of partitions apart are not compared, and others only as
    long as they may reach it. Two empty sets are alike."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or abs(length_part(len(a), threshold) - length_part(len(b), threshold)) > 1 or len(a) < threshold * len(b) - 1e-9:
        return len(a) == len(b)
    need, both = threshold / (1 + threshold) * (len(a) + len(b)) - 1e-9, 0
    for at in range(0, len(a), AT_A_TIME):
        own = a[at : at + AT_A_TIME]
        both += len(np.intersect1d(own, b[np.searchsorted(b, own[0]) : np.searchsorted(b, own[-1], side="right")], assume_unique=True))
        if both + len(a) - at - len(own) < need:
            return False
    return True


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, n_signatures of every row's whole text; an empty fingerprint for a null text or one without words."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string()), ("n_signatures", pa.int64())])

    def run(x: dict[str, list]) -> dict[str, list]:
        sig = [signatures(t or "") for t in x["text"]]
        return {"doc_id": x["doc_id"], "fingerprint": [written(s) for s in sig], "n_signatures": [len(s) for s in sig]}

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(by_batch(run, schema), "doc_id long, fingerprint string, n_signatures long")


def similar(docs: DataFrame, threshold: float = ALIKE) -> DataFrame:
    """a, b, likeness: pairs of distinct fingerprints whose Jaccard similarity is threshold or more.

    A set goes to the partition of its length and the next one up. There, sets meet on the rarest signatures only: two sets that
    reach the threshold share one among the first n - ceil(threshold n) + 1 of each. Rows that meet carry a number for a set, not the
    set; sets are joined to the pairs that are left. Copies are one fingerprint; null and empty texts have no signatures and no pairs."""
    fps = store(fingerprints(docs).select("fingerprint", "n_signatures").filter("n_signatures > 0").distinct().withColumn("id", F.monotonically_increasing_id()))
    sigs = F.expr("transform(sequence(0, cast(n_signatures as int) - 1), i -> cast(conv(substring(fingerprint, 1 + 8 * i, 8), 16, 10) as bigint))")
    each = store(fps.select("id", F.col("n_signatures").cast("int").alias("n"), F.explode(sigs).alias("sig")))
    rare = store(each.groupBy("sig").agg(F.count(F.lit(1)).alias("df")))
    ordered = join_split(each, rare, ["sig"], "df").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("s"))
    part = F.floor(F.log(F.col("n").cast("double")) / -F.log(F.lit(threshold)) + 1e-9).cast("int")
    n = F.col("n")
    prefix = store(ordered.select("id", "n", part.alias("part"), F.explode(F.slice("s", F.lit(1), (n - F.ceil(n * threshold - 1e-9) + 1).cast("int"))).alias("s")).select("id", "n", "part", "s.sig").filter("sig is not null"))
    left = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "part", "sig")
    right = prefix.withColumn("to", F.explode(F.array(F.col("part"), F.col("part") - 1))).select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("to").alias("part"), "sig")
    longer = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = left.join(right, ["part", "sig"]).filter(longer & (F.col("na") >= threshold * F.col("nb") - 1e-9)).select("a", "b").distinct()
    own = lambda c: fps.select(F.col("id").alias(f"_{c}"), F.col("fingerprint").alias(f"{c}_set"))
    met = pairs.join(own("a"), F.col("a") == F.col("_a")).join(own("b"), F.col("b") == F.col("_b")).select(F.col("a_set").alias("a"), F.col("b_set").alias("b"))

    def verify(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = [i for i, (x, y) in enumerate(zip(map(read, a), map(read, b), strict=True)) if alike(x, y, threshold)]
            like = [jaccard(read(a[i]), read(b[i])) for i in keep]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.string()), pa.array([b[i] for i in keep], pa.string()), pa.array(like, pa.float64())], names=["a", "b", "likeness"])

    return met.mapInArrow(verify, "a string, b string, likeness double")


def with_next(docs: DataFrame) -> DataFrame:
    """docs as runs of neighbours by doc_id: columns part, mark, doc_id, text, each part in one task and in order.

    Bounds are quantiles of doc_id, so parts are even; an id that takes up several quantiles is cut by a hash of the text into as many. The first row of each
    part also goes, with mark 1, to the end of the part before, and that of the first to the end of the last, so that no task needs another's rows. Null ids
    come first; rows of one id are in the order of the hash, then of the text."""
    spark = docs.sparkSession
    low = -(1 << 63)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("key"), F.xxhash64("text").alias("h"))
    n = partitions(spark)
    found = d.select(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] if n > 1 else []
    times = sorted(Counter(found or []).items())
    keys = np.array([k for k, r in times for _ in range(r)], np.int64)
    cuts = np.array([low + (j << 64) // r for _, r in times for j in range(r)], np.int64)

    @F.pandas_udf("int")
    def part_of(key, h):
        import pandas as pd

        key, h = key.to_numpy(np.int64), h.to_numpy(np.int64)
        part, high = np.searchsorted(keys, key, side="left"), np.searchsorted(keys, key, side="right")
        for at in np.unique(part[high - part > 1]):  # ids of several parts
            own = (part == at) & (high - part > 1)
            high[own] = at + np.searchsorted(cuts[at : high[own][0]], h[own], side="right")
        return pd.Series(high.astype(np.int32))

    parted = d.withColumn("part", part_of("key", "h"))
    firsts = sorted((r["part"], r["first"]["key"], r["first"]["h"]) for r in parted.select("part", "key", "h").groupBy("part").agg(F.min(F.struct("key", "h")).alias("first")).collect())
    if not firsts:
        return parted.select("part", F.lit(0).alias("mark"), "doc_id", "text")
    of_part = lambda values: F.element_at(F.create_map(*[F.lit(x) for r, v in zip(firsts, values, strict=True) for x in (r[0], v)]), F.col("part"))
    here = F.struct(F.col("part"), F.lit(0).alias("mark"))
    back = F.struct(of_part([firsts[i - 1][0] for i in range(len(firsts))]).alias("part"), F.lit(1).alias("mark"))
    first = (F.col("key") == of_part([r[1] for r in firsts])) & (F.col("h") == of_part([r[2] for r in firsts]))
    dealt = parted.select("doc_id", "text", "key", "h", F.explode(F.when(first, F.array(here, back)).otherwise(F.array(here))).alias("to")).select("doc_id", "text", "key", "h", "to.part", "to.mark")
    return dealt.repartitionById(len(keys) + 1, "part").sortWithinPartitions("part", "mark", "key", "h", "text").select("part", "mark", "doc_id", "text")


def compare_edited(docs: DataFrame) -> DataFrame:
    """The rows of RESULT for every whole text, the text edited by the start of the next document's, and the next document.

    A null text is an empty one. Among equal doc_ids the order is by a hash of the text, then by text. A table of one row is its own next. alike_edited and
    alike_next tell whether the pruned comparison makes them near copies; the likeness of these given pairs is exact whatever it is."""

    def row(doc_id: int | None, text: str, sig: np.ndarray, after: str, after_sig: np.ndarray) -> tuple:
        n = len(text)
        edited = text[: n - n // 4] + after[: n // 4]
        own = signatures(edited)
        return (doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(sig), written(own), jaccard(sig, own), jaccard(sig, after_sig), len(sig), length_part(len(sig)), alike(sig, own), alike(sig, after_sig))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        for b in batches:
            for at in range(0, b.num_rows, 512):
                cut = b.slice(at, 512).to_pydict()
                for part, mark, doc_id, text in zip(cut["part"], cut["mark"], cut["doc_id"], cut["text"], strict=True):
                    text = text or ""
                    sig = signatures(text)
                    if held and held[0] == part:
                        out.append(row(*held[1:], text, sig))
                    held = None if mark else (part, doc_id, text, sig)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), RESULT, strict=True)], schema=RESULT)
                    out = []

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long, length_part int, alike_edited boolean, alike_next boolean")
