import duckdb
import pytest

from tests.llm.helpers import docs, empty, odd
from tidelog.llm import mixing as M
from tidelog.llm.queries import MIXING


def filled(sizes, weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(w[s] for s in open_)
        add = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            out[s] += add[s]
            if out[s] >= cap * sizes[s]:
                left += out[s] - cap * sizes[s]
                out[s] = cap * sizes[s]
                open_.discard(s)
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 1000, "c": 1000, "d": 10, None: 40}, {"a": 7}, {"a": 0, "b": 3}, {"é": 10, "z": 20, "Z": 30, "": 40}])
def test_targets_against_repeated_sharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in M.targets(df).collect()}
    assert got == pytest.approx(filled(sizes))


def test_sql_and_reruns_agree(spark):
    d = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{d}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    rows = [sorted(map(tuple, M.plan(df.repartition(n)).drop("copies").collect())) for n in (1, 3)]
    assert rows[0] == rows[1] == sorted(con.sql(MIXING).fetchall())


def test_odd_rows_and_real_copies(spark):
    plan = M.plan(odd(spark)).toPandas()
    assert len(plan) == 11 and (plan.taken <= 2 * plan["size"]).all() and plan[plan.doc_id.isin([1, 2])].taken.sum() == 0
    mixed = M.mix(odd(spark))
    assert mixed.columns == odd(spark).columns and mixed.count() == plan.copies.sum()
    assert M.plan(empty(spark)).count() == 0 and M.mix(empty(spark)).count() == 0
    taken = M.plan(docs(spark, [(i, "w " * (i % 7 + 1), "en", f"s{i % 2}") for i in range(4000)])).groupBy("target").sum("taken").collect()
    assert all(abs(r[1] / r[0] - 1) < 0.05 for r in taken)


def test_many_sources_are_salted(spark, monkeypatch):
    df = docs(spark, [(i, "w " * (i % 7 + 1), "en", f"s{i % 5}" if i % 3 else None) for i in range(600)])
    few = sorted(map(tuple, M.mix(df).collect()), key=repr)
    monkeypatch.setattr(M, "FEW_SOURCES", 0)
    assert few == sorted(map(tuple, M.mix(df).collect()), key=repr)
    assert M.mix(odd(spark)).count() == M.plan(odd(spark)).toPandas().copies.sum() and M.mix(empty(spark)).count() == 0
