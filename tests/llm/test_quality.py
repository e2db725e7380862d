import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import LONG, docs, empty, odd
from tidelog.llm import quality as Q


def halves(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    own = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return table, labels.filter(own), labels.filter(~own)


def test_held_out_accuracy_with_and_without_rounds(spark):
    """Fitted on one half of the labels, judged on the other."""
    table, mine, others = halves(spark)
    truth = {r.doc_id: r.quality for r in others.collect()}
    model = Q.learn(table, mine)
    got = {r.doc_id: r for r in Q.score(table, model).collect() if r.doc_id in truth}
    right = np.mean([(got[i].score >= 0.5) == (q == 1) for i, q in truth.items()])
    assert right >= 0.95 and np.mean([got[i].keep for i, q in truth.items() if q == 1]) >= 0.97
    rows = {r.doc_id: r for r in table.collect()}
    column = lambda ids: {k: [rows[i][k] for i in ids] for k in ("text", "source", "lang")}
    known = [(r.doc_id, r.quality) for r in mine.orderBy("doc_id").collect() if rows[r.doc_id].text and len(rows[r.doc_id].text) <= 20_000]
    alone = Q.co_train(column([i for i, _ in known]), np.array([float(q) for _, q in known]), {"text": [], "source": [], "lang": []})
    test = column(list(truth))
    z = (alone.text.odds(Q.text_view(test["text"])) + alone.meta.odds(Q.meta_view(test))) / 2
    assert right >= np.mean((z > 0) == np.array([q == 1 for q in truth.values()])) - 0.02  # the rounds do no harm


def plain_score(model, text, source, lang):
    """The score of one text, feature by feature."""
    b = text.encode()
    if not text:
        return 0.0
    counts = {}
    for i in range(len(b) - 2):
        g = ((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 20
        counts[g] = counts.get(g, 0) + 1
    zt = sum(math.sqrt(n / (len(b) - 2)) * model.text.w[g] for g, n in counts.items()) + model.text.b
    total, lines = max(1, len(b)), text.count("\n") + 1
    share = lambda f: sum(f(chr(x)) for x in b if x < 128) / total
    odd_ = lambda c: 33 <= ord(c) < 48 or 58 <= ord(c) < 65 or 91 <= ord(c) < 97 or 123 <= ord(c) < 127
    x = [1, math.log1p(len(b)) / 10, math.log1p(lines) / 5, math.log1p(total / lines) / 8, share(str.isupper), share(str.islower), share(str.isdigit) * 5, share(odd_) * 5, share(lambda c: c in " \t\n\v\f\r") * 3, sum(y >= 128 for y in b) / total, share(lambda c: c == "|") * 20, share(lambda c: c == "!") * 20]
    zm = sum(a * c for a, c in zip(x, model.meta.w)) + model.meta.b
    for name, base in ((source, 12), (lang, 28)):
        zm += 0.3 * model.meta.w[base + (zlib.crc32(name.encode()) % 15 if name else 15)]
    odds = [m.slope * z + m.shift for m, z in ((model.text, zt), (model.meta, zm))]
    return 1 / (1 + math.exp(-sum(odds) / 2))


def test_scores_against_brute_force(spark):
    table, mine, _ = halves(spark)
    model = Q.learn(table, mine)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((r.doc_id, r.score) for r in Q.score(rows, model).collect())
    want = sorted((r.doc_id, plain_score(model, r.text or "", r.source, r.lang)) for r in rows.collect())
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-3)
    # odd rows under a fitted model: nulls, empty and very long texts, repeats
    found = sorted((r.doc_id or -1, round(r.score, 3), r.keep) for r in Q.score(odd(spark), model).collect())
    plain = sorted((r.doc_id or -1, round(plain_score(model, r.text or "", r.source, r.lang), 3)) for r in odd(spark).collect())
    assert [f[:2] for f in found] == [p for p in plain] and not any(k for i, _, k in found if i in (1, 2)) and len(found) == 11
    assert Q.score(docs(spark, [(1, LONG * 3, "en", "b")]), model).count() == 1


def test_exchange_teaches_the_surest_rows_and_no_disagreement():
    text, meta = np.array([0.99, 0.97, 0.5, 0.01, 0.96, 0.02]), np.array([0.5, 0.98, 0.999, 0.99, 0.01, 0.03])
    (rows0, y0), (rows1, y1) = Q.exchange([text, meta], growth=1, confident=0.95)
    assert rows0.tolist() == [2, 5] and y0.tolist() == [1, 0]  # row 3 and row 4: the views disagree
    assert rows1.tolist() == [0, 5] and y1.tolist() == [1, 0]


def test_rows_are_taught_once(monkeypatch):
    """No row is handed to a view a second time."""
    seen = []
    real = Q.exchange
    monkeypatch.setattr(Q, "exchange", lambda p: seen.append(len(p[0])) or real(p, growth=5))
    words = [["alpha", "beta"], ["QUX!!", "BAZ##"]]
    texts = [" ".join(words[i % 2] * (10 + i % 7)) for i in range(80)]
    rows = lambda t: {"text": t, "source": ["s"] * len(t), "lang": ["en"] * len(t)}
    Q.co_train(rows(texts[:20]), np.array([1.0, 0.0] * 10), rows(texts[20:]))
    assert seen[0] == 60 and all(a > b for a, b in zip(seen, seen[1:]))


def test_pseudo_labels_help_the_weaker_view():
    """A word view with few labels learns from what the layout view is sure of."""
    import random

    rng = random.Random(1)
    good = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "kappa"], k=60)) for _ in range(120)]
    bad = ["\n".join(" ".join(rng.choices(["ZOO!!", "QUX!!", "BAZ##", "FOO$$"], k=2)) for _ in range(30)) for _ in range(120)]
    rows = lambda t: {"text": t, "source": ["s"] * len(t), "lang": ["en"] * len(t)}
    labelled = [x for pair in zip(good[:10], bad[:10]) for x in pair]
    model = Q.co_train(rows(labelled), np.array([1.0, 0.0] * 10), rows(good[10:60] + bad[10:60]))
    test = good[60:] + bad[60:]
    p = Q.sigmoid(model.text.odds(Q.text_view(test)))
    assert ((p > 0.5) == ([True] * 60 + [False] * 60)).mean() > 0.95


def test_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = Q.learn(odd(spark), labels)
    got = Q.score(odd(spark), model).toPandas()
    assert len(got) == 11 and got[got.doc_id.isin([1, 2])].keep.sum() == 0 and got[got.doc_id == 3].keep.all()
    assert Q.score(empty(spark), Q.learn(empty(spark), labels.limit(0))).count() == 0


def test_repeated_ids_give_one_row_each(spark):
    rows = docs(spark, [(i % 3, f"text {i} of a repeated id", "en", "a") for i in range(60)] + [(i, f"alone {i}", "en", "b") for i in range(10, 40)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in [0, 1, *range(10, 30)]], "doc_id long, quality int, toxic int")
    assert Q.one_each(rows).count() == 33
    assert Q.learn(rows, labels).text is not None
