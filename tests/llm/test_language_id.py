import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import empty, odd
from tidelog.llm import language_id as L

EN = "the cat sat on the mat and the dog ran to the park with a ball. " * 3
FR = "le chat est sur la table et le chien court dans le jardin avec une balle. " * 3


def plain_bits(sample: bytes, text: bytes, order: int) -> list[float]:
    """PPM, method C, byte by byte from counted contexts."""
    seen = defaultdict(Counter)
    for k in range(order + 1):
        for i in range(k, len(sample)):
            seen[sample[i - k : i]][sample[i]] += 1
    out = []
    for i, x in enumerate(text):
        bits = 0.0
        for k in range(min(order, i), -1, -1):
            c = seen.get(text[i - k : i])
            if not c:
                continue
            total, kinds = sum(c.values()), len(c)
            if x in c:
                bits -= math.log2(c[x] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
        else:
            bits += 8.0  # no context has the byte: one of 256
        out.append(bits)
    return out


@pytest.mark.parametrize("most", [0, L.DENSE_CELLS])
def test_code_lengths_are_exact(monkeypatch, most):
    """Of every byte, those that one language or all of them lack included; with dense tables and with sorted keys."""
    monkeypatch.setattr(L.Children.of.__func__, "__defaults__", (most,))
    model = L.fit({"en": [EN.encode()], "fr": [FR.encode()]}, order=3)
    assert (model.children[3].table is None) == (most == 0)
    text = "the chat and la dog court Q\u00e9 x1 quiz".encode()
    got = model.bits(np.frombuffer(text, np.uint8), np.arange(len(text)))
    for j, sample in enumerate((EN, FR)):
        assert np.allclose(got[:, j], plain_bits(sample.encode(), text, 3), atol=1e-4)


def test_copies_are_one_in_the_sample(spark):
    rows = spark.createDataFrame([("the same text", "en")] * 300 + [(f"text {i}", "en") for i in range(40)] + [(None, "en"), ("x", None)], "text string, lang string")
    got = L.training_sample(rows, max_docs=1000)
    assert sorted(got) == ["en"] and len(got["en"]) == 41


def test_chunks_do_not_change_a_score():
    model = L.fit({"en": [EN.encode()], "fr": [FR.encode()]})
    long = EN * 8000
    _, _, (rate,) = L.predict_batch(model, [long])
    _, _, (part,) = L.predict_batch(model, [EN * 800])
    assert abs(rate - part) < 1e-3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = L.identify(docs, L.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter(L.held_out(F.col("doc_id"))).toPandas()
    assert len(got) > 20 and (got.lang_pred == got.lang).mean() >= 0.95


def test_odd_rows(spark):
    model = L.fit({"en": [EN.encode()], "fr": [FR.encode()]})
    got = L.identify(odd(spark), model).toPandas()
    assert len(got) == 11 and ((got.score >= 0) & (got.score <= 1)).all()
    assert set(got[got.doc_id.isin([1, 2, 6])].lang_pred) == {"und"}
    assert got[got.doc_id == 7].lang_pred.item() == "fr"
    assert L.identify(empty(spark), model).count() == 0
    assert L.learn(empty(spark)) is None
    assert set(L.identify(odd(spark), None).toPandas().lang_pred) == {"und"}
    kept = L.keep_identified(odd(spark), model)
    assert kept.columns == odd(spark).columns and kept.count() == 7
    assert L.keep_identified(odd(spark), None).count() == 7 and L.keep_identified(empty(spark), model).count() == 0
