import corpus_pipeline as C
from tests.llm.helpers import empty, odd
from tidelog.llm import near_dup, packing, secret_scan


def test_stages_take_odd_rows(spark, tmp_path):
    for df in (odd(spark), empty(spark)):
        for _, stage in C.STAGES[:-1]:
            columns = df.columns
            df = stage(spark, df, "")
            assert df.columns == columns
        C.STAGES[-1][1](spark, df, "").collect()


def test_against_plain_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    named = C.language_stage(spark, docs, d)
    assert {r.doc_id for r in named.collect()} == {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    firsts = {r.doc_id for r in near_dup.near_duplicates(named).collect() if r.doc_id == r.component_id}
    kept = C.near_duplicate_stage(spark, named, d)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(firsts)
    clean = C.secret_stage(spark, kept, d)
    assert not any(secret_scan.base_spans(r.text) for r in clean.collect())
    out = C.run(spark, d).toPandas()
    mixed = C.mixing_stage(spark, clean, d).toPandas()
    want = sum(len(packing.cut(len(packing.tokenizer()(t)) // 4 + 1, 1024)) for t in mixed.text)
    assert len(out) == want and (out.groupby("sequence_id").length.sum() <= 1024).all()
