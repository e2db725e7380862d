import numpy as np
from pyspark.sql import functions as F

from tidelog.llm import ann


def test_recall_and_exact_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    pdf = df.toPandas()
    x, ids = np.stack(pdf.embedding).astype(float), pdf.vec_id.to_numpy()
    got = ann.search(df, F.col("vec_id") % 20 == 0).toPandas()
    found = 0
    for q in ids[ids % 20 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 11))
        assert np.allclose(own.score, [d[ids == v][0] for v in own.vec_id], rtol=1e-12)
        found += len(set(own.vec_id) & set(ids[order]))
    assert found / (10 * (ids % 20 == 0).sum()) >= 0.9


def test_beam_search_is_no_worse_than_greedy():
    x = np.random.default_rng(0).normal(size=(400, 16))
    books = ann.fit(x, books=4, words=16)
    error = [((x - books.decode(books.encode(x, beam)[0])) ** 2).sum() for beam in (1, 8)]
    assert error[1] <= error[0]
    codes, norm = books.encode(x)
    assert np.allclose(norm, (books.decode(codes) ** 2).sum(1))


def test_refit_is_no_worse_on_rows_not_fitted_to():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 12))[rng.integers(0, 50, 3000)] + 0.3 * rng.normal(size=(3000, 12))
    error = lambda b: ((x[::10] - b.decode(ann.encoded(b, x[::10]))) ** 2).sum()
    plain, refitted = ann.fit(x, books=4, words=16, refits=0), ann.fit(x, books=4, words=16, refits=3)
    assert error(refitted) < error(plain)
    codes = ann.encoded(plain, x)
    at = codes.astype(int) + np.arange(4) * 16
    one_hot = np.zeros((len(x), 64))
    one_hot[np.arange(len(x))[:, None], at] = 1
    rest = x - plain.decode(codes)
    want = np.linalg.solve(one_hot.T @ one_hot + 2.0 * np.eye(64), one_hot.T @ rest)
    assert np.allclose(ann.least_squares(codes, rest, 16, 2.0).reshape(64, -1), want)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]), (9, [4.0, 4.0]), (10, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, codes string, block int")
    got = [(r.rank, r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert [g[:2] for g in got] == [(1, 1), (2, 2), (3, 2), (4, 9)] and got[0][2] == 0.0 and got[3][2] == 5.0
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.search(df.filter("vec_id = 4"), F.col("vec_id") == 4).count() == 0


def test_no_neighbour_is_lost_on_many_scattered_rows(spark):
    """Far more rows than the sample of the books tells apart: the neighbours are those of brute force, copies and ties included."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[100:400] = x[0]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 1000 == 0, sample=500).toPandas()
    for q in range(0, 20_000, 1000):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == order
