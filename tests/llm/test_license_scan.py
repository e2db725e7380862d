import re

from tests.llm.helpers import docs, empty, odd
from tidelog.llm import license_scan as S

BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def common(a, b, inside):
    """Longest common subsequence of two lists over the cells (i, j) that inside allows, by the full table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + 1 if a[i] == b[j] and inside(i, j) else 0)
    return best[-1][-1]


def occurrences(w, template):
    """(from, to, part) by definition: every band of diagonals, read in full."""
    t = template.text.split()
    k = 2 if len(t) < 24 else 4
    mine, theirs = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)], [" ".join(t[i : i + k]) for i in range(len(t) - k + 1)]
    kept, known = [], set(mine)
    if sum(g in known for g in theirs) < 0.75 * len(theirs):  # no band can hold so many
        return []
    for d in range(-len(theirs), len(mine) + 1):
        lo, hi = max(0, d), min(len(mine), d + 6 + len(theirs))
        cells = [i for i in range(lo, hi) for j in range(max(0, i - d - 6), min(len(theirs), i - d + 1)) if mine[i] == theirs[j]]
        if not any(i - j == d for i in range(lo, hi) for j in [i - d] if 0 <= j < len(theirs) and mine[i] == theirs[j]) or len(cells) < 0.75 * len(theirs):
            continue
        n = common(mine[lo:hi], theirs, lambda i, j, d=d, lo=lo: d <= i + lo - j <= d + 6)
        if n >= 0.75 * len(theirs):
            kept.append((-n, min(cells), max(cells) + k))
    out = []
    for n, a, b in sorted(kept):
        if all(b <= x or a >= y for x, y, _ in out):
            out.append((a, b, -n / len(theirs)))
    return out


def plain(text):
    w = words(text)
    hits = [(i, k) for k, p in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    notices = sorted((a, b, i, p, t.label) for i, t in enumerate(S.NOTICES) for a, b, p in occurrences(w, t))
    labels, group, reach = {k for _, k in hits}, [], -1
    for n in [*notices, None]:
        if group and (n is None or n[0] >= reach):
            labels |= {g[4] for g in group if g[3] == max(x[3] for x in group)}
            group, reach = [], -1
        if n:
            group.append(n)
            reach = max(reach, n[1])
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in hits})), ",".join(sorted(labels))


def check(df):
    want = sorted((r.doc_id or -1, *map(str, plain(r.text))) for r in df.collect())
    got = sorted((r.doc_id or -1, *map(str, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels))) for r in S.scan(df).collect())
    assert got == want


MIT = S.NOTICES[10].text
BSD = S.NOTICES[11].text


def changed(text, every, word="zzz"):
    return " ".join(word if i % every == every - 1 else w for i, w in enumerate(text.split()))


def test_against_brute_force(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_made_texts_against_brute_force(spark):
    w = MIT.split()
    rows = [
        "CC BY cc by, CC-BY! general public General Public License license all rights reserved all rights", "cc " * 50 + "by",
        "the mit license the mit license", "the apache license " * 3, "under the x under the x under the", "license mit the under released",
        "Licensed under the MIT license", "released under the mit license " * 3, "x " * 9 + MIT + " and then " + BSD, changed(MIT, 40), changed(MIT, 3), " ".join(w[:60]),
        " ".join(w[:40] + w[43:]), " ".join(w[:40] + ["a", "b"] + w[40:]), " ".join(w[80:] + w[:80]), MIT + " " + MIT, "of the " * 300 + MIT, "in the software " * 200,
        "Licensed under the GNU Affero General Public License version 3 and licensed under cc by sa 4.0",
    ]
    check(docs(spark, [(i, t, None, None) for i, t in enumerate(rows)]))
    check(odd(spark))
    assert S.scan(empty(spark)).count() == 0 and S.found_spans(empty(spark)).count() == 0
    assert S.found_spans(odd(spark)).count() == 0


def test_words_out_of_order_or_repeated_are_no_notice(spark):
    rows = [(1, "the mit license the mit license", None, None), (2, "the apache license the apache license the apache license", None, None), (3, "under the x under the x under the", None, None)]
    assert [(r.labels, r.score < 0.5) for r in S.scan(docs(spark, rows)).collect()] == [("", True)] * 3


def test_notices_and_versions(spark):
    rows = [
        (1, "x y Released under the MIT License. z", None, None), (2, "This is licensed under the GNU General Public License, version 3", None, None),
        (3, "Licensed under the Apache License, Version 2.0.", None, None), (4, "Licensed under a the Apache License Version 2.0", None, None), (5, "under the apache", None, None),
        (6, MIT, None, None), (7, changed(MIT, 40), None, None),
    ]
    got = {r.doc_id: (r.labels, r.score) for r in S.scan(docs(spark, rows)).collect()}
    assert got[1] == ("mit", 1.0) and got[2] == ("gpl,gpl-3.0", 1.0) and got[3] == ("apache-2.0", 1.0)
    assert got[4][0] == "apache-2.0" and 0.75 <= got[4][1] < 1  # a word put in moves the diagonal
    assert got[5][0] == "" and got[5][1] < 0.5
    assert got[6] == ("mit", 1.0) and got[7][0] == "mit" and got[7][1] < 1
    spans = {(r.label, r.start, r.end) for r in S.found_spans(docs(spark, rows[:1])).collect()}
    assert spans == {("mit", 2, 7)}
    assert S.found_spans(docs(spark, rows[:1] * 2)).count() == 2
