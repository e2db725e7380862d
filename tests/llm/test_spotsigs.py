import hashlib
import re
from itertools import combinations, islice

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import docs, empty, odd
from tidelog.llm import spotsigs as S


MASK = (1 << 64) - 1


def plain_signatures(text):
    """The set of signatures, word by word and with whole numbers."""
    words = re.findall(r"\w+", text.lower())
    digest = lambda t: xxhash.xxh32_intdigest(t.encode())
    out = set()
    for i, w in enumerate(words):
        after = list(islice((v for v in islice(words, i + 1, None) if v not in S.STOP), 3)) if w in S.ANCHORS else []
        if len(after) == 3:
            out.add(digest(" ".join([w, *after])))
    runs = set()
    width = min(4, len(words))
    for i in range(len(words) - width + 1 if words else 0):
        h = 0
        for w in words[i : i + width]:
            h = (((h ^ (h >> 31)) * 0x9E3779B97F4A7C15) + digest(w) + 1) & MASK
        runs.add((((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & MASK) >> 32)
    return out | set(sorted(runs)[:64])


def text_of(sigs):
    return "".join(f"{x:08x}" for x in sorted(sigs))


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def order(text):
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, order(r[1]), r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        a, b, c = map(plain_signatures, (text, edited, after))
        out.append((doc_id or -1, len(text), hashlib.sha256(edited.encode()).hexdigest(), text_of(a), text_of(b), likeness(a, b), likeness(a, c), len(a), likeness(a, b) >= 0.8, likeness(a, c) >= 0.8))
    return sorted(out)


@pytest.mark.parametrize("name", ["table", "odd", "one", "same", "hot"])
def test_against_brute_force(spark, name):
    df = {"table": lambda: spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "odd": lambda: odd(spark), "one": lambda: docs(spark, [(4, "one row alone in here", None, None)]), "hot": lambda: docs(spark, [(i if i % 3 else 7, f"text {i} of a hot id", None, None) for i in range(120)] + [(None, f"no id {i}", None, None) for i in range(60)]), "same": lambda: docs(spark, [(1, f"text {i} is the same id", None, None) for i in range(9)])}[name]()
    got = sorted((r.doc_id or -1, *tuple(r)[1:8], r.alike_edited, r.alike_next) for r in S.compare_edited(df).collect())
    assert got == plain([(r.doc_id, r.text) for r in df.collect()])


def test_empty_and_fingerprints(spark):
    assert S.compare_edited(empty(spark)).count() == 0
    assert S.signatures("").size == 0 and S.jaccard(S.signatures(""), S.signatures("")) == 1.0
    assert S.signatures("short").size == 1
    assert (S.read(S.written(S.signatures("the big dog is here and the cat is there"))) == S.signatures("the big dog is here and the cat is there")).all()
    got = {r.doc_id: r.fingerprint for r in S.fingerprints(odd(spark)).collect()}
    assert got[1] == "" and got[3] != ""


def test_pruned_pairs_are_all_pairs(spark):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[a : a + n]) for a, n in [(0, 60), (1, 60), (2, 62), (5, 60), (30, 60), (0, 60), (100, 20), (101, 19), (100, 20), (200, 5)]]
    sets = {S.written(S.signatures(t)) for t in texts}
    assert sets == {text_of(plain_signatures(t)) for t in texts}
    want = {tuple(sorted((a, b))) for a, b in combinations(sets, 2) if likeness(set(S.read(a).tolist()), set(S.read(b).tolist())) >= 0.8}
    got = [tuple(sorted((r.a, r.b))) for r in S.similar(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()]
    assert len(want) >= 3 and sorted(got) == sorted(want)


def test_likeness_does_not_jump_with_the_number_of_anchors():
    """A text whose last quarter, with most of its anchors, is replaced stays alike, whichever side has few anchors."""
    body = " ".join(f"w{i}" for i in range(120))
    for n in range(8):
        tail = " ".join(f"the v{i} x{i} y{i} z{i}" for i in range(n))
        whole, edited = S.signatures(f"{body} {tail}"), S.signatures(f"{body} " + " ".join(f"u{i}" for i in range(5 * n)))
        assert S.jaccard(whole, edited) > 0.3, n
    few, more = "the a1 b1 c1 is d1 e1 f1 le g1 h1 i1", "the a1 b1 c1 is d1 e1 f1 le g1 h1 i1 la j1 k1 l1"
    assert S.jaccard(S.signatures(few), S.signatures(more)) > 0.3


def test_pruned_comparison_is_the_exact_one():
    rng = np.random.default_rng(3)
    for _ in range(400):
        base = np.unique(rng.integers(0, 1 << 32, rng.integers(0, 300), dtype=np.uint32))
        other = np.unique(np.concatenate([base[rng.random(len(base)) < rng.choice([0.7, 0.9, 0.97])], rng.integers(0, 1 << 32, rng.integers(0, 20), dtype=np.uint32)]))
        assert S.alike(base, other) == S.alike(other, base) == (S.jaccard(base, other) >= 0.8 - 1e-12)


def test_pairs_of_odd_rows(spark):
    assert S.similar(empty(spark)).count() == 0 and S.similar(odd(spark)).count() == 0
    hot = [(i, " ".join(f"shared{j}" for j in range(30)) + f" own{i} own{i}x", None, None) for i in range(12)]
    assert S.similar(docs(spark, hot)).count() == 66


def test_a_hot_id_is_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "partitions", lambda _: 12)
    rows = docs(spark, [(i if i % 3 else 7, f"text {i} of a hot id", None, None) for i in range(1200)])
    got = S.with_next(rows).filter("mark = 0 and doc_id = 7").groupBy("part").count().collect()
    assert len(got) >= 3 and max(r["count"] for r in got) < 250
    assert S.with_next(rows).filter("mark = 1").count() == S.with_next(rows).select("part").distinct().count()
    assert sorted((r.doc_id or -1, *tuple(r)[1:8], r.alike_edited, r.alike_next) for r in S.compare_edited(rows).collect()) == plain([(r.doc_id, r.text) for r in rows.collect()])
