"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one word from each of M full-dimensional codebooks. Codebooks are fitted to residuals on a
bounded sample; codes are chosen by beam search. The index holds a row's codes, the squared norm of its
reconstruction and its distance from it, the error. A query scores a row from M table lookups and that norm: its true distance is
the score give or take the error. Every row that may be among the k nearest by these bounds is ranked by its exact distance, on
the original vectors, so none of the k is lost; good books only make the rows to rank fewer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

BOOKS, WORDS, BEAM, ROUNDS, REFITS = 8, 256, 8, 10, 2
#: What holds a refitted word back, in rows that have it.
RIDGE = 8.0
#: Vectors that the codebooks are fitted on, at most.
SAMPLE = 8192
#: Rows of a block of the index and bytes of its vectors, at most; queries of a block.
ROW_BLOCK, BLOCK_BYTES, QUERY_BLOCK = 16_384, 16 << 20, 256


@dataclass
class Codebooks:
    words: np.ndarray  # books x words x dimensions

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared norms of the reconstructions, by beam search."""
        n, books = len(x), len(self.words)
        residual, codes, rows = x[:, None, :], np.zeros((n, 1, books), np.uint8), np.arange(n)[:, None]
        for m, c in enumerate(self.words):
            score = (residual**2).sum(-1)[:, :, None] - 2 * residual @ c.T + (c**2).sum(-1)
            flat = score.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            src, word = best // len(c), best % len(c)
            codes = codes[rows, src]
            codes[:, :, m] = word
            residual = residual[rows, src] - c[word]
            last = np.take_along_axis(flat, best, 1)
        top = last.argmin(axis=1)
        codes = codes[np.arange(n), top]
        return codes, (self.decode(codes) ** 2).sum(-1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(c[codes[:, m]] for m, c in enumerate(self.words))


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, refits: int = REFITS, seed: int = 7) -> Codebooks:
    """Residual k-means, one codebook after another; then all books are refitted to the codes at once by least squares, and the
    sample is encoded anew, as long as the error of every tenth vector, which no book is fitted to, falls. A sample of under 100 is fitted to whole."""
    x = sample.astype(np.float64)
    held, x = (x[::10], np.delete(x, np.s_[::10], axis=0)) if len(x) >= 100 else (x, x)
    rng, residual, out = np.random.default_rng(seed), x, []
    for _ in range(books):
        k = min(words, len(residual))
        c = residual[rng.choice(len(residual), k, replace=False)]
        for _ in range(rounds):
            near = ((c**2).sum(-1) - 2 * residual @ c.T).argmin(1)
            total = np.zeros_like(c)
            np.add.at(total, near, residual)
            count = np.bincount(near, minlength=k)[:, None]
            c = np.where(count > 0, total / np.maximum(count, 1), c)
        residual = residual - c[((c**2).sum(-1) - 2 * residual @ c.T).argmin(1)]
        out.append(np.vstack([c, np.zeros((words - k, c.shape[1]))]))
    best = Codebooks(np.stack(out))
    wrong = lambda c: ((held - c.decode(encoded(c, held))) ** 2).sum()
    codes, error = encoded(best, x), wrong(best)
    for _ in range(refits):
        tried = Codebooks(best.words + least_squares(codes, x - best.decode(codes), words))
        if not (new := wrong(tried)) < error:
            break
        best, error, codes = tried, new, encoded(tried, x)
    return best


def encoded(books: Codebooks, x: np.ndarray) -> np.ndarray:
    return np.concatenate([books.encode(x[at : at + 1024])[0] for at in range(0, len(x), 1024)])


def least_squares(codes: np.ndarray, rest: np.ndarray, words: int, ridge: float = RIDGE) -> np.ndarray:
    """What to add to all words so that the sums over the codes come nearest to rest."""
    books = codes.shape[1]
    at = codes.astype(np.int64) + np.arange(books) * words
    both = np.zeros((books * words, books * words))
    for m in range(books):
        for o in range(books):
            np.add.at(both, (at[:, m], at[:, o]), 1.0)
    side = np.zeros((books * words, rest.shape[1]))
    for m in range(books):
        np.add.at(side, at[:, m], rest)
    return np.linalg.solve(both + ridge * np.eye(len(both)), side).reshape(books, words, -1)


def nearest(x: np.ndarray, own: int, k: int, books: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norm: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact distances of the k nearest rows of a block sorted by id, without rows of the id own; ties go to the smaller id."""
    tables, xx = books @ x, x @ x
    square = norm - 2 * sum(tables[m][codes[:, m]] for m in range(len(books))) + xx
    # what rounding can do to the square, by the largest numbers that take part
    slack = 1e-10 * (np.sqrt((books**2).sum(-1)).max(1).sum() ** 2 + xx)
    high = np.sqrt(np.maximum(square, 0) + slack) + error
    low = np.sqrt(np.maximum(square - slack, 0)) - error
    other = ids != own
    high[~other] = np.inf
    take = min(k, len(ids))
    maybe = np.flatnonzero(~(low > np.partition(high, take - 1)[take - 1]) & other)
    exact = np.sqrt(((vectors[maybe] - x) ** 2).sum(1))
    best = np.argsort(exact, kind="stable")[:k]
    return maybe[best], exact[best]


def usable(v: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(v) > 0) & F.forall(v, number) & F.exists(v, lambda x: x != 0.0), F.lit(False))


def search(vectors: DataFrame, queries: Column, k: int = 10, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance in double precision) of the k nearest rows of each query row.

    vectors: vec_id, embedding. queries: which rows are queries. Rows whose vector is null, empty, zero, not finite or
    not of the commonest length take no part, nor do rows with a null vec_id. Repeated rows are candidates each; ties go
    to the smaller vec_id. A row is no candidate for its own vec_id. An empty table gives no rows."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = v.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    d, n = sizes[0]["d"], sizes[0]["n"]
    v = v.filter(F.size("embedding") == d)
    drawn = v.withColumn("r", F.xxhash64("vec_id", F.lit(3)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)).filter(F.col("r") < min(1.0, 1.2 * sample / n)).select("embedding", "r").orderBy("r").limit(sample).collect()
    books = spark.sparkContext.broadcast(fit(np.array([r["embedding"] for r in drawn]) if drawn else np.zeros((1, d))))
    per_block = max(1, min(ROW_BLOCK, BLOCK_BYTES // (8 * d)))
    groups = max(1, -(-n // per_block))

    # the index: a row of codes, norm, error and vector for each vector, packed into blocks of about per_block
    def encode(frames):
        for f in frames:
            for at in range(0, len(f), 1024):
                part = f.iloc[at : at + 1024]
                x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                codes, norm = books.value.encode(x)
                error = np.sqrt(((x - books.value.decode(codes)) ** 2).sum(1)) * (1 + 1e-9)
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "codes": [c.tobytes() for c in codes], "norm": norm, "error": error, "vector": [r.tobytes() for r in x]})

    index = store(v.mapInPandas(encode, "vec_id long, codes binary, norm double, error double, vector binary").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")))
    blocks = index.groupBy("block").agg(F.collect_list(F.struct("vec_id", "codes", "norm", "error", "vector")).alias("rows"))
    n_asked = v.filter(queries).select(F.count_distinct("vec_id")).first()[0]
    asked = v.filter(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(max(1, -(-n_asked // QUERY_BLOCK)))).cast("int"))
    packed = asked.groupBy("part").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("asked"))
    tasks = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(blocks, "block").select("asked", "rows")

    def score(frames):
        for f in frames:
            for asked, rows in zip(f["asked"], f["rows"], strict=True):
                ids = np.array([r["vec_id"] for r in rows], np.int64)
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                codes = np.frombuffer(b"".join(bytes(r["codes"]) for r in rows), np.uint8).reshape(len(rows), -1)[order]
                held = np.frombuffer(b"".join(bytes(r["vector"]) for r in rows), np.float64).reshape(len(rows), -1)[order]
                norm, error = np.array([r["norm"] for r in rows])[order], np.array([r["error"] for r in rows])[order]
                for q in asked:
                    best, exact = nearest(np.asarray(q["embedding"], np.float64), q["vec_id"], k, books.value.words, ids, held, codes, norm, error)
                    yield pd.DataFrame({"query_id": np.full(len(best), q["vec_id"]), "vec_id": ids[best], "score": exact})

    scored = tasks.mapInPandas(score, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
