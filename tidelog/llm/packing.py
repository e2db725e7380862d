"""Best-fit packing with Martello-Toth dominance reduction.

Sizes are integers up to the capacity, so an instance of any number of pieces is a histogram of at most 1024
counts. The driver packs the histogram: sets of one or two pieces that provably dominate every other
way to fill their sequence are fixed for good, and the rest is placed best fit, largest first, many equal
pieces at a time. The outcome is a short table of runs (equal pieces in equal places of consecutive sequences);
executors rank the pieces of each size and look their places up.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, store, tokenizer_path

CAPACITY, END_ID = 1024, 2
#: Shards in which the pieces of one size are ranked, so that a hot size is no single task: so many at least, and as many as keep a shard at PER_SHARD pieces.
SHARDS, PER_SHARD = 64, 500_000
#: Words of which a worker keeps the ids.
CACHE = 300_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---- packing a histogram


@dataclass
class Bins:
    """count sequences that hold the same: (size, how many) in order, as many as their place says."""

    count: int
    items: list[tuple[int, int]] = field(default_factory=list)


def dominated(counts: dict[int, int], capacity: int) -> list[Bins]:
    """Fix sets that dominate all others that hold the same largest piece; counts keeps what is left.

    For the largest piece s and the largest partner k that fits beside it:
    no partner fits: {s}. s + k is the capacity: {s, k}. Only one more piece fits, whichever it is: {s, k}.
    At most two more fit, and no two that fit together are larger than k: {s, k}."""
    out = []
    sizes = sorted(counts, reverse=True)
    for s in sizes:
        while counts.get(s, 0):
            room = capacity - s
            counts[s] -= 1
            rest = [x for x in sorted(counts) if counts[x] and x <= room]
            k = rest[-1] if rest else 0
            some = [x for x in rest for _ in range(min(counts[x], 3))]
            counts[s] += 1
            if not k:
                n = counts[s]
                out.append(Bins(n, [(s, 1)]))
                counts[s] -= n
                continue
            two, three = sum(some[:2]) if len(some) > 1 else room + 1, sum(some[:3]) if len(some) > 2 else room + 1
            if not (s + k == capacity or two > room or (three > room and most_of_two(some, room) <= k)):
                break
            n = counts[s] // 2 if s == k else min(counts[s], counts[k])
            # while a k is left, taking pieces away leaves every test above true: all n are fixed at once
            out.append(Bins(n, [(s, 2)] if s == k else [(s, 1), (k, 1)]))
            counts[s] -= n * (2 if s == k else 1)
            if s != k:
                counts[k] -= n
    return out


def most_of_two(some: list[int], room: int) -> int:
    """The largest sum of two of these that fits."""
    lo, hi, best = 0, len(some) - 1, 0
    while lo < hi:
        if some[lo] + some[hi] <= room:
            best = max(best, some[lo] + some[hi])
            lo += 1
        else:
            hi -= 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Bins]:
    """Best fit, largest first, with equal pieces placed together."""
    by_room: dict[int, list[Bins]] = defaultdict(list)
    for s in sorted((x for x in counts if counts[x]), reverse=True):
        left = counts[s]
        while left:
            room = min((r for r, b in by_room.items() if b and r >= s), default=None)
            if room is None:
                each = capacity // s
                full, rest = divmod(left, each)
                if full:
                    by_room[capacity - each * s].append(Bins(full, [(s, each)]))
                if rest:
                    by_room[capacity - rest * s].append(Bins(1, [(s, rest)]))
                break
            b = by_room[room].pop()
            each = room // s
            full = min(b.count, left // each)
            if full:
                by_room[room - each * s].append(Bins(full, [*b.items, (s, each)]))
                left -= full * each
            if full < b.count:
                rest = min(left, each) if left < each else 0
                if rest:
                    by_room[room - rest * s].append(Bins(1, [*b.items, (s, rest)]))
                    left -= rest
                over = b.count - full - (1 if rest else 0)
                if over:
                    by_room[room].append(Bins(over, b.items))
    return [b for bins in by_room.values() for b in bins]


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    left = {int(s): int(n) for s, n in counts.items() if n}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("every size is from 1 to the capacity")
    return dominated(left, capacity) + best_fit(left, capacity)


def runs(bins: list[Bins]) -> np.ndarray:
    """Rows (size, first rank, how many side by side, first sequence, offset), by size and rank."""
    out, used, sequence = [], defaultdict(int), 0
    for b in bins:
        offset = 0
        for s, k in b.items:
            out.append((s, used[s], k, sequence, offset))
            used[s] += k * b.count
            offset += s * k
        sequence += b.count
    return np.array(sorted(out), np.int64).reshape(-1, 5)


# ---- pieces and their places


class Odd(Exception):
    """A word that no plain space bounds."""


class Words(dict):
    """Ids, as bytes, of words with the space before them. Such a word's ids do not depend on its neighbours."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        body = word[1:] if word[0] == " " else word
        if not body or body[0].isspace() or body[-1].isspace():
            raise Odd
        ids = np.array(self.encode(word), "<u4").tobytes()
        if len(self) < CACHE and len(word) < 64:
            self[word] = ids
        return ids


class Tokenizer:
    """Ids of the byte-level BPE vocabulary, as little-endian unsigned 32-bit numbers.

    Its pre-tokenizer cuts before each single space that has other characters on both sides, so a text's
    ids are those of its words, each with its space; words come back often and are kept. Texts with other white space
    next to a space, or at an end, are encoded whole."""

    def __init__(self, name: str = "byte_bpe_50k.tiktoken") -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(tokenizer_path(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = Words(self.encoding.encode_ordinary)

    def __call__(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            return (self.words[first] if first else b"") + b"".join([self.words[f" {w}"] for w in rest])
        except Odd:
            return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()


class Added:
    """Ids of texts that may hold added tokens of the JSON file, such as <|endoftext|>: each is its own id wherever it stands, and the
    parts between are encoded each for itself."""

    def __init__(self, encode: Tokenizer, name: str = "byte_bpe_50k.json") -> None:
        with open(tokenizer_path(name), encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        odd = [t["content"] for t in added if t["single_word"] or t["lstrip"] or t["rstrip"]]
        if odd:
            raise ValueError(f"added tokens that take in or look at their neighbours: {odd}")
        self.encode = encode
        self.ids = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.ids, key=len, reverse=True))) + ")").split if added else None

    def __call__(self, text: str) -> bytes:
        if not any(t in text for t in self.ids):
            return self.encode(text)
        parts = self.split(text)  # every other one is an added token
        return b"".join(self.ids[p] if i % 2 else self.encode(p) for i, p in enumerate(parts))


_tokenizer: dict[str, Tokenizer] = {}
_added: dict[str, Added] = {}


def tokenizer(name: str = "byte_bpe_50k.tiktoken") -> Tokenizer:
    if name not in _tokenizer:
        _tokenizer[name] = Tokenizer(name)
    return _tokenizer[name]


def with_added(name: str = "byte_bpe_50k") -> Added:
    if name not in _added:
        _added[name] = Added(tokenizer(f"{name}.tiktoken"), f"{name}.json")
    return _added[name]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the ids of each whole text and an end id, cut where longer than capacity."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def run(x: dict[str, list]) -> dict[str, list]:
        encode = with_added()
        rows = []
        for doc_id, text in zip(x["doc_id"], x["text"], strict=True):
            ids = encode(text or "") + end
            rows += [(doc_id, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
        return {f.name: [r[i] for r in rows] for i, f in enumerate(schema)}

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(by_batch(run, schema), PIECES)


def place(items: DataFrame, capacity: int = CAPACITY, per_shard: int = PER_SHARD) -> DataFrame:
    """items (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    # the driver gets a count for each size, and one for each shard: capacity x SHARDS + pieces / per_shard rows at most
    n = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        n[r["length"]] = r["n"]
    shards = np.maximum(SHARDS, -(-n // per_shard))
    start = np.cumsum(shards) - shards
    of_size = F.element_at(F.array(*[F.lit(int(x)) for x in shards[1:]]), F.col("length").cast("int"))
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), of_size).cast("int"))
    counted = np.zeros(shards.sum(), np.int64)
    for r in items.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n")).collect():
        counted[start[r["length"]] + r["shard"]] = r["n"]
    before = np.cumsum(counted) - counted
    before -= np.repeat(before[start], shards)
    table = runs(pack_histogram({s: int(c) for s, c in enumerate(n) if c}, capacity))
    span = np.int64(1 << 48)
    keys = table[:, 0] * span + table[:, 1]
    w = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")
    ranked = items.withColumn("rank", F.row_number().over(w))
    shared = items.sparkSession.sparkContext.broadcast((start, before, table, keys))

    def run(batches):
        start, before, table, keys = shared.value
        for b in batches:
            size, shard, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "shard", "rank"))
            rank = before[start[size] + shard] + rank - 1
            row = table[np.searchsorted(keys, size * span + rank, side="right") - 1] if b.num_rows else table[:0]
            along = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(row[:, 3] + along // row[:, 2]), pa.array(row[:, 4] + along % row[:, 2] * size)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every whole text.

    A null text is an empty one: a piece of the end id alone. Equal rows are packed each for itself. An empty table gives no rows."""
    return place(store(pieces(docs, capacity, end_id)), capacity)
