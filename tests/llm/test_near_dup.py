import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import docs, empty, odd
from tidelog.llm import near_dup as N


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def roots(ids, fps):
    up = list(range(len(fps)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    best = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            best[top(i)] = min(best.get(top(i), ids[i]), ids[i])
    return [best.get(top(i)) for i in range(len(fps))]


def test_whole_table_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in table.collect())
    fps = [plain(t) for _, t in rows]
    want = list(zip([i for i, _ in rows], [f"{f:016x}" for f in fps], roots([i for i, _ in rows], fps)))
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in N.near_duplicates(table).collect())
    assert got == want


@pytest.mark.parametrize("dense", [8, 1024])
def test_links_keep_all_components_in_crowded_balls(spark, monkeypatch, dense):
    """Near groups that are too large for pairs, chains, and fingerprints at exactly 3 and 4 bits."""
    monkeypatch.setattr(N, "DENSE", dense)
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)}
    centre = rng.getrandbits(64)
    for _ in range(150):
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice((1, 1, 2)))))
    for r in (3, 4):
        for _ in range(15):
            a = rng.getrandbits(64)
            fps |= {a, a ^ sum(1 << b for b in rng.sample(range(64), r))}
    chain = rng.getrandbits(64)
    for _ in range(12):
        chain ^= sum(1 << b for b in rng.sample(range(64), 3))
        fps.add(chain)
    fps = sorted(N.signed(f) for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = N.links(df)
    assert edges.filter("bit_count(a ^ b) > 3").count() == 0
    got = {r.node: r.root for r in N.components(edges).collect()}
    index = {f: i for i, f in enumerate(fps)}
    want = roots(list(range(len(fps))), [f & (1 << 64) - 1 for f in fps])
    assert [index[got.get(f, f)] for f in fps] == want


def test_long_texts_are_hashed_whole(monkeypatch):
    text = " ".join(f"w{i % 4001}" for i in range(9000))
    whole = N.fingerprint(text)
    monkeypatch.setattr(N, "STEP", 1000)
    assert N.fingerprint(text) == whole == plain(text)


def test_odd_rows(spark):
    got = N.near_duplicates(odd(spark)).toPandas()
    assert len(got) == 11
    assert set(got[got.fingerprint == "0" * 16].component_id) == {1}
    kept = N.keep_first(odd(spark))
    assert kept.columns == odd(spark).columns
    ids = sorted(kept.toPandas().doc_id.fillna(-1).astype(int))
    assert ids == [-1, 1, 3, 5, 6, 7, 8, 9]
    again = docs(spark, [(4, "one text of its own here", None, None), (4, "quite another text stands in this row", None, None), (4, "one text of its own here", None, None), (9, "one text of its own here", None, None)])
    assert sorted((r.doc_id, r.text[:3]) for r in N.keep_first(again).collect()) == [(4, "one"), (4, "qui")]
    assert N.near_duplicates(empty(spark)).count() == 0 and N.keep_first(empty(spark)).count() == 0
    assert np.all(got.fingerprint.str.len() == 16)


def test_a_hot_fingerprint_is_joined_apart(spark, monkeypatch):
    from tidelog.llm import common

    rows = docs(spark, [(i, "the same text again", None, None) for i in range(40)] + [(100 + i, f"text number {i} alone {i * i}", None, None) for i in range(20)] + [(None, "the same text again", None, None)])
    want = sorted(map(str, N.near_duplicates(rows).collect()))
    kept = sorted(map(str, N.keep_first(rows).collect()))
    monkeypatch.setattr(common, "HOT_SHARE", 0.3)
    assert sorted(map(str, N.near_duplicates(rows).collect())) == want
    assert sorted(map(str, N.keep_first(rows).collect())) == kept and len(kept) == 21
