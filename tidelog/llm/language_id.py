"""Language identification by prediction by partial matching (PPM, escape method C).

Every language has a context tree over bytes of orders 0 to ORDER, with frozen counts. A text's exact code
length under a tree is the sum, over its bytes, of the escapes from contexts that have not seen the byte and
of the byte's own code in the longest context that has. The language with the shortest code wins.

The trees share one node numbering, so that a text is walked once for all languages: node k-grams come from
child tables, dense while they are small and sorted keys beyond, code lengths from a table of one row per node and one column per language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROWS_AT_A_TIME, by_batch

#: Cells of a dense child table, at most; a larger one is kept as its sorted keys, with the same outcome.
DENSE_CELLS = 1 << 24
#: Longest context, in bytes.
ORDER = 4
#: The training sample: documents a language at most (in expectation), their longest text, and bytes a language.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_BYTES = 400, 20_000, 600_000
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
RESULT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


@dataclass
class Children:
    """The number of a child by the number of its parent (0 is none) and a byte class."""

    width: int
    table: np.ndarray | None
    keys: np.ndarray | None

    @classmethod
    def of(cls, parents: int, width: int, parent: np.ndarray, last: np.ndarray, most: int = DENSE_CELLS) -> Children:
        """Children numbered from 1 in the order given, which is that of (parent, last)."""
        if parents * width > most:
            return cls(width, None, parent.astype(np.int64) * width + last)
        table = np.zeros((parents, width), np.int32)
        table[parent, last] = np.arange(1, len(parent) + 1)
        return cls(width, table, None)

    def __call__(self, parent: np.ndarray | int, last: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[parent, last]
        key = parent * np.int64(self.width) + last
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at + 1, 0).astype(np.int32)


@dataclass
class Model:
    """children[k]: child of the k-gram numbered i (from 1; 0 is none) by byte class. cost[k], escape[k]: bits, a column a language."""

    langs: list[str]
    classes: np.ndarray
    children: list[Children]
    cost: list[np.ndarray]
    escape: list[np.ndarray]

    def bits(self, data: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Code length of each byte in each language. data: bytes of many texts, doc: the place of each byte in its text."""
        x = self.classes[data]
        order = len(self.children) - 1
        ids = [self.children[0](0, x)]
        for k in range(1, order + 1):
            node = np.zeros(len(x), np.int32)
            if len(x) > k:
                node[1:] = self.children[k](ids[-1][:-1], x[1:])
                node[doc < k] = 0
            ids.append(node)
        out = np.empty((len(x), len(self.langs)), np.float32)
        out[:] = self.cost[order][ids[order]]
        at = np.flatnonzero(ids[order] == 0)
        if len(at):
            extra = np.zeros((len(at), len(self.langs)), np.float32)
            for k in range(order, -1, -1):
                node = ids[k][at]
                hit = node > 0
                out[at[hit]] = extra[hit] + self.cost[k][node[hit]]
                at, extra = at[~hit], extra[~hit]
                if not len(at):
                    break
                if k == 0:
                    out[at] = extra + self.escape[0][0] + 8.0  # no language has the byte: one of 256 after the last escape
                else:
                    deep = doc[at] >= k
                    before = np.where(deep, ids[k - 1][at - 1], 0)
                    extra = extra + self.escape[k][before]
        return out


def grams(texts: list[bytes], k: int) -> np.ndarray:
    """The k-byte strings of all texts as numbers, none across two texts."""
    out = []
    for t in texts:
        x = np.frombuffer(t, np.uint8).astype(np.uint64)
        if len(x) < k:
            continue
        g = np.zeros(len(x) - k + 1, np.uint64)
        for i in range(k):
            g = (g << np.uint64(8)) | x[i : len(x) - k + 1 + i]
        out.append(g)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def fit(samples: dict[str, list[bytes]], order: int = ORDER) -> Model:
    """Freeze the statistics of each language's sample into one model."""
    langs = sorted(samples)
    seen = np.zeros(256, bool)
    for texts in samples.values():
        for t in texts:
            seen[np.frombuffer(t, np.uint8)] = True
    classes = np.zeros(256, np.int32)
    classes[seen] = np.arange(1, seen.sum() + 1)
    width = int(seen.sum()) + 1
    keys: list[np.ndarray] = []
    children, cost, escape = [], [], []
    for k in range(order + 1):
        counted = [np.unique(grams(samples[lang], k + 1), return_counts=True) for lang in langs]
        union = np.unique(np.concatenate([c[0] for c in counted])) if counted else np.zeros(0, np.uint64)
        keys.append(union)
        # a child table: from the number of the k-gram (its first bytes) and the class of the last byte
        parent = np.searchsorted(keys[k - 1], union >> np.uint64(8)) + 1 if k else np.zeros(len(union), np.int64)
        above = len(keys[k - 1]) + 1 if k else 1
        children.append(Children.of(above, width, parent, classes[(union & np.uint64(255)).astype(np.int64)]))
        c = np.zeros((len(union) + 1, len(langs)), np.float32)
        e = np.zeros((above, len(langs)), np.float32)
        for j, (g, n) in enumerate(counted):
            own = np.searchsorted(union, g)
            total, kinds = np.zeros(above), np.zeros(above)
            np.add.at(total, parent[own], n)
            np.add.at(kinds, parent[own], 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                esc = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                p = -np.log2(n / (total + kinds)[parent[own]])
            e[:, j] = esc
            if k:  # what this language lacks costs an escape and what the shorter context takes
                shorter = np.searchsorted(keys[k - 1], union & np.uint64((1 << (8 * k)) - 1)) + 1
                c[1:, j] = esc[parent] + cost[k - 1][shorter, j]
            else:
                c[1:, j] = esc[0] + 8.0
            c[own + 1, j] = p
        cost.append(c)
        escape.append(e)
    return Model(langs, classes, children, cost, escape)


def training_sample(rows: DataFrame, max_docs: int = SAMPLE_DOCS, max_chars: int = SAMPLE_CHARS, max_bytes: int = SAMPLE_BYTES) -> dict[str, list[bytes]]:
    """A bounded sample of whole labelled texts: about max_docs different ones a language by a hash of the text, of up to max_chars code
    points each, cut off at max_bytes a language. Copies of a text are one, however many there are."""
    rows = rows.filter("text is not null and lang is not null").select("text", "lang").filter(F.length("text") <= max_chars).withColumn("h", F.xxhash64("text", F.lit(1)))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, max_docs / n)))])
    rank = F.col("h").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    drawn = rows.withColumn("rank", rank).filter(F.col("rank") < F.element_at(share, F.col("lang")))
    got = drawn.groupBy("lang", "rank").agg(F.min("text").alias("text")).collect()
    out: dict[str, list[bytes]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["rank"])):
        own = out.setdefault(r["lang"], [])
        own.append(r["text"].encode())
    for lang, texts in out.items():
        room = np.cumsum([len(t) for t in texts]) <= max_bytes
        out[lang] = [t for t, ok in zip(texts, room, strict=True) if ok] or texts[:1]
    return out


def predict_batch(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    names, scores, rates = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    todo = [i for i, t in enumerate(texts) if model is not None and t and LETTER.search(t)]
    step = 1 << 20
    group: list[tuple[int, np.ndarray, int]] = []
    sums = {i: np.zeros(len(model.langs)) for i in todo} if model is not None else {}

    def flush() -> None:
        if not group:
            return
        data = np.concatenate([g[1] for g in group])
        lengths = np.array([len(g[1]) for g in group])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        place = np.arange(len(data)) - np.repeat(starts, lengths)
        total = np.add.reduceat(model.bits(data, place), starts, axis=0, dtype=np.float64)
        for (i, _, skip), t, s in zip(group, total, starts, strict=True):
            if skip:  # bytes repeated from the chunk before, for their contexts only
                t = t - model.bits(data[s : s + skip], place[s : s + skip]).sum(axis=0, dtype=np.float64)
            sums[i] += t
        group.clear()

    size, length = 0, {}
    for i in todo:
        raw = np.frombuffer(texts[i].encode("utf-8", "surrogatepass"), np.uint8)
        length[i] = len(raw)
        for at in range(0, len(raw), step):
            skip = min(at, ORDER)
            group.append((i, raw[at - skip : at + step], skip))
            size += len(group[-1][1])
            if size >= step:
                flush()
                size = 0
    flush()
    for i in todo:
        bits = sums[i]
        best = int(np.argmin(bits))
        odds = np.exp2(np.maximum(bits[best] - bits, -1000.0))
        names[i], scores[i], rates[i] = model.langs[best], float(1 / odds.sum()), float(bits[best] / length[i])
    return names, scores, rates


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte of every whole text. A null text, one without a letter, or an absent model gives `und` and score 0.

    Of languages of equal code length the first by name wins. Repeated rows are judged each for itself; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(x: dict[str, list]) -> dict[str, list]:
        lang, score, rate = predict_batch(shared.value, x["text"])
        return {"doc_id": x["doc_id"], "lang_pred": lang, "score": score, "bits_per_byte": rate}

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(by_batch(run, RESULT), "doc_id long, lang_pred string, score double, bits_per_byte double")


def learn(docs: DataFrame) -> Model | None:
    """Fit on the bounded sample of labelled documents whose crc32(doc_id) mod 3 is not 1; None if there are none."""
    sample = training_sample(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    return fit(sample) if sample else None


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, all columns, whose language is determined. Nothing is shuffled.

    Null texts and those without a letter go, and no others: without a model, which is so if no row has a language, texts with a letter
    stay. Repeated rows stay or go alike; null ids are like any."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part = batch.slice(at, ROWS_AT_A_TIME)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                if shared.value is None:
                    keep = [bool(t and LETTER.search(t)) for t in texts]
                else:
                    keep = [x != UNDETERMINED for x in predict_batch(shared.value, texts)[0]]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
