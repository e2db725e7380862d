"""Quality classification by co-training.

Two views of a document: its text (hashed runs of three bytes) and its page metadata. The documents have no metadata but source,
language and size, so that this view adds the layout: shares of kinds of characters, lines and their length, which the text view has no feature for.
A classifier is fitted to each on the labelled sample; over some rounds each hands the rows of an unlabelled pool that it is
most sure of to the other, with its pseudo-labels. Both are calibrated on held-back labels, and the mean of their calibrated log-odds scores every document.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

#: Labelled documents and unlabelled documents that the classifiers are fitted on, at most, and their longest text.
LABELLED, POOL, SAMPLE_CHARS = 4000, 4000, 20_000
BUCKETS, ROUNDS, GROWTH, CONFIDENT = 1 << 12, 4, 200, 0.95
#: Documents of at least this score are kept.
KEEP = 0.5
RESULT = pa.schema([("doc_id", pa.int64()), ("text_score", pa.float64()), ("meta_score", pa.float64()), ("score", pa.float64()), ("keep", pa.bool_())])


def text_view(texts: list[str | None]) -> np.ndarray:
    """Shares of hashed byte trigrams, square roots, one row a text."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, t in enumerate(texts):
        x = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        for at in range(0, max(0, len(x) - 2), 1 << 20):
            own = x[at : at + (1 << 20) + 2]
            g = (own[:-2] << 16 | own[1:-1] << 8 | own[2:]) * np.uint32(2654435761) >> np.uint32(20)
            out[i] += np.bincount(g, minlength=BUCKETS)
        if len(x) > 2:
            out[i] = np.sqrt(out[i] / (len(x) - 2))
    return out


def meta_view(rows: dict[str, list]) -> np.ndarray:
    """Size, layout and hashed names, one row a document."""
    n = len(rows["text"])
    out = np.zeros((n, 12 + 32), np.float32)
    for i, (t, source, lang) in enumerate(zip(rows["text"], rows["source"], rows["lang"], strict=True)):
        x = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)
        c = np.bincount(x, minlength=256)
        total, lines = max(1, len(x)), (t or "").count("\n") + 1
        upper, lower, digit, space = c[65:91].sum(), c[97:123].sum(), c[48:58].sum(), c[32] + c[9:14].sum()
        odd = c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum()
        out[i, :12] = (1, np.log1p(len(x)) / 10, np.log1p(lines) / 5, np.log1p(total / lines) / 8, upper / total, lower / total, digit / total * 5, odd / total * 5, space / total * 3, c[128:].sum() / total, c[124] / total * 20, c[33] / total * 20)
        for name, base in ((source, 12), (lang, 28)):
            out[i, base + (zlib.crc32(name.encode("utf-8", "surrogatepass")) % 15 if name else 15)] = 0.3
    return out


@dataclass
class Logistic:
    w: np.ndarray
    b: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log-odds."""
        return self.slope * self.raw(x) + self.shift


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 300, l2: float = 1e-4) -> Logistic:
    """Full-batch gradient descent with momentum, classes weighed alike."""
    scale = np.maximum(np.maximum(x.max(axis=0), -x.min(axis=0)), 1e-6)
    weight = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
    w, b, vw, vb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    for _ in range(steps):  # columns are scaled by way of the weights: the rows are never copied
        g = (weight * (sigmoid(x @ (w / scale) + b) - y) / len(y)).astype(np.float32)
        vw, vb = np.float32(0.9) * vw - np.float32(0.5) * ((x.T @ g) / scale + np.float32(l2) * w), 0.9 * vb - 0.5 * float(g.sum())
        w, b = w + vw, b + vb
    return Logistic(w / scale, float(b))


def calibrate(m: Logistic, x: np.ndarray, y: np.ndarray, steps: int = 400) -> None:
    """Platt scaling on held-back rows."""
    s, a, b = m.raw(x), 1.0, 0.0
    for _ in range(steps):
        g = (sigmoid(a * s + b) - y) / len(y)
        a, b = a - 0.2 * float((g * s).sum()), b - 0.2 * float(g.sum())
    m.slope, m.shift = max(a, 1e-3), b


@dataclass
class Model:
    text: Logistic | None
    meta: Logistic | None


def exchange(p: list[np.ndarray], growth: int = GROWTH, confident: float = CONFIDENT) -> list[tuple[np.ndarray, np.ndarray]]:
    """What each view is taught of a pool, rows and labels, from both views' probabilities.

    Of the rows that the other view is sure of, the surest are taught, growth of each label at most. Rows of which both are sure are
    not taught if they disagree."""
    out = []
    for taught, teacher in ((0, 1), (1, 0)):
        for_it, against = p[teacher] >= confident, p[teacher] <= 1 - confident
        for_it, against = for_it & ~(p[taught] <= 1 - confident), against & ~(p[taught] >= confident)
        rows = []
        for mask, order in ((for_it, -p[teacher]), (against, p[teacher])):
            some = np.flatnonzero(mask)
            rows.append(some[np.argsort(order[some], kind="stable")[:growth]])
        out.append((np.concatenate(rows), np.concatenate([np.ones(len(rows[0])), np.zeros(len(rows[1]))])))
    return out


def co_train(labelled: dict[str, list], y: np.ndarray, pool: dict[str, list], rounds: int = ROUNDS) -> Model:
    """Views exchange confident pseudo-labels; a row that was taught leaves the pool for good. The last fifth of the labelled rows is held back for calibration."""
    if len(y) < 10 or y.min() == y.max():
        return Model(None, None)
    views = [text_view(labelled["text"]), meta_view(labelled)]
    open_ = [text_view(pool["text"]), meta_view(pool)] if pool["text"] else [v[:0] for v in views]
    held = np.arange(len(y)) % 5 == 4
    own = [(v[~held], y[~held]) for v in views]
    models = [fit_logistic(*o) for o in own]
    for _ in range(rounds):
        if not len(open_[0]):
            break
        taught = exchange([sigmoid(m.raw(o)) for m, o in zip(models, open_, strict=True)])
        gone = np.union1d(taught[0][0], taught[1][0])
        if not len(gone):
            break
        own = [(np.vstack([x, o[rows]]), np.concatenate([z, marks])) for (x, z), o, (rows, marks) in zip(own, open_, taught, strict=True)]
        open_ = [np.delete(o, gone, axis=0) for o in open_]
        models = [fit_logistic(*o) for o in own]
    for m, v in zip(models, views, strict=True):
        if y[held].min() != y[held].max():
            calibrate(m, v[held], y[held])
    return Model(*models)


def one_each(rows: DataFrame, *more: str) -> DataFrame:
    """One row of each doc_id, the smallest by text, source and language; reduced before anything is shuffled."""
    return rows.groupBy("doc_id", *more).agg(F.min(F.struct("text", "source", "lang")).alias("r")).select("doc_id", *more, "r.*")


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Model:
    """Fit on bounded samples by a hash of the id: whole texts of up to SAMPLE_CHARS, labelled, and unlabelled for the pool."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang").filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("doc_id is not null and quality in (0, 1)").dropDuplicates(["doc_id"])
    rank = F.xxhash64("doc_id", F.lit(11)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    sizes = marks.groupBy("quality").count().collect()
    if len(sizes) < 2:
        return Model(None, None)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["quality"], min(1.0, labelled / 2 / r["count"]))])
    drawn = marks.filter(rank < F.element_at(share, F.col("quality"))).orderBy(rank, "doc_id").limit(2 * labelled).collect()
    known = d.sparkSession.createDataFrame([(r["doc_id"], r["quality"]) for r in drawn], "doc_id long, quality int")
    # 2 x labelled ids at most, and one row of each, whatever repeats: no other text is shuffled
    got = one_each(d.join(F.broadcast(known), "doc_id"), "quality").collect()
    got = sorted(got, key=lambda r: (r["doc_id"] * 2654435761 % (1 << 32), r["doc_id"]))
    ids = d.agg(F.approx_count_distinct("doc_id")).first()[0]
    some = d.filter(rank < min(1.0, 1.2 * pool / max(ids, 1))).join(marks, "doc_id", "left_anti")
    free = sorted(one_each(some).collect(), key=lambda r: (r["doc_id"] * 2654435761 % (1 << 32), r["doc_id"]))[:pool]
    column = lambda rows: {k: [r[k] for r in rows] for k in ("text", "source", "lang")}
    return co_train(column(got), np.array([float(r["quality"]) for r in got]), column(free))


def score(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """doc_id, text_score, meta_score, score (0 to 1), keep of every row's whole text.

    A null text counts as an empty one, which has no quality: scores 0, not kept. A null source or lang is a name of its own.
    Without labels of both kinds every score is 0.5, and every document that has text is kept. Equal rows score alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(x: dict[str, list]) -> dict[str, list]:
        m = shared.value
        some = np.array([bool(t) for t in x["text"]])
        if m.text is None:
            a = b = np.zeros(len(some))
        else:
            a, b = m.text.odds(text_view(x["text"])), m.meta.odds(meta_view(x))
        p = [np.where(some, sigmoid(z), 0.0) for z in (a, b, (a + b) / 2)]
        return {"doc_id": x["doc_id"], "text_score": p[0], "meta_score": p[1], "score": p[2], "keep": some & (p[2] >= keep)}

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang").mapInArrow(by_batch(run, RESULT), "doc_id long, text_score double, meta_score double, score double, keep boolean")
