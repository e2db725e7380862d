import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelog.llm import common
from tidelog.llm import url_filter as U
from tidelog.llm.queries import URLS

URL = ["http://A.Example.com/en/1?q=/es/", "https://www.EXAMPLE.com/en/", "https://x.www.example.com/en/a#b", "http://example.com", "http://com/", "http://badexample.com/en/", "ftp://x.net/es/y", "//x.net/fr/", None, "", "http://x.net?/fr/", "no scheme http", "a://b://net/fr/", "http://net/fr/\nline", "http://../en/", "http://x.net/fr/"]


def test_against_sql(spark):
    rows = [(i, u) for i, u in enumerate(URL)] + [(3, "http://example.com"), (None, "http://x.net/fr/")]
    df = spark.createDataFrame([(i, u, "h", "x") for i, u in rows], "page_id long, url string, host string, rule string")
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", rows)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, U.judge(df).collect())) == sorted(map(key, con.sql(URLS).fetchall()))
    assert U.judge(df.limit(0)).count() == 0


def test_longest_rule_wins_and_paths_are_raw_prefixes(spark):
    df = spark.createDataFrame([(1, "http://a.b.c/xyz"), (2, "http://b.c/x"), (3, "http://c/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge(df, [("block", "c", ""), ("allow", "b.c", "/x"), ("block", "a.b.c", "/xy")], "allow").collect()}
    assert got == {1: ("a.b.c/xy", "block"), 2: ("b.c/x", "allow"), 3: ("c", "block")}


def plain(url, rules):
    """(host, path, rule, verdict) by trying every rule."""
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fit = [(-len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(min(fit)[1:] if fit else (None, "allow")))


@pytest.mark.parametrize("most", [2, 60, 100_000])
def test_more_rules_than_may_be_broadcast(spark, monkeypatch, most):
    """By the list as it is, by the rules that are met, and by a shuffle with hot expressions apart."""
    monkeypatch.setattr(common, "HOT_SHARE", 0.05)
    rules = [*U.RULES, *(("block" if i % 2 else "allow", f"h{i}.net", "/" if i % 3 else "/a") for i in range(150))]
    urls = [*URL, *(f"http://www.h{i % 40}.net/{'abc'[i % 3]}" for i in range(90)), "http://x.com/" + "y" * 50_000, "http://" + "a." * 3000 + "com/"]
    rows = list(enumerate(urls)) + [(3, URL[3])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("uid", "host", "short", "digest", "some", "n")})
    want = sorted(str((i, *plain(u, rules))) for i, u in rows)
    assert sorted(str(tuple(r)) for r in U.judge(df, rules, most=most).collect()) == want


def test_200_000_rules(spark):
    n = 200_000
    rules = spark.range(n).select(F.lit("block").alias("verdict"), F.concat(F.lit("h"), F.col("id"), F.lit(".org")).alias("host"), F.lit("/").alias("path"))
    df = spark.createDataFrame([(1, "http://a.h199999.org/x"), (2, "http://h7.org/"), (3, "http://h200000.org/"), (4, None)], "page_id long, url string")
    assert {r.page_id: r.verdict for r in U.judge(df, rules).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}
    assert U.judge(df, []).filter("verdict = 'allow'").count() == 4
