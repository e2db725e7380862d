import os

from pyspark.sql import functions as F

from tidelog.operators import compression as C

TEXTS = [b"", b"a", b"abc" * 100, os.urandom(3000), b"\0" * 100_000]


def test_blocks():
    for x in TEXTS:
        b = C.block(x)
        assert C.unblock(b, len(x)) == x and C.unblock(b, None) == x
    assert [C.unblock(b[:-1], 100_000), C.unblock(b, 50_000), C.unblock(b, 100_001), C.unblock(b, -1), C.unblock(b"\xff\xff", None), C.unblock(b, 100_000, 1000)] == [None] * 6


def test_packages(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*TEXTS, None])], "id int, data binary")
    for enabled in (True, False):
        sent = C.pack(rows, enabled=enabled)
        assert {r.flag for r in sent.collect()} == {int(enabled)} and [r.source_data_len for r in sent.orderBy("id").collect()] == [*map(len, TEXTS), None]
        assert [(r.data and bytes(r.data), r.fault) for r in C.unpack(sent).orderBy("id").collect()] == [(x, False) for x in TEXTS] + [(None, False)]
    sent = C.pack(rows)
    old = C.unpack(sent.withColumns({"flag": F.lit(None).cast("int"), "source_data_len": F.lit(None).cast("long")}), legacy=F.col("id") == 2).orderBy("id").collect()
    assert bytes(old[2].data) == TEXTS[2] and bytes(old[4].data) == C.block(TEXTS[4])
    bad = C.unpack(sent.withColumn("data", F.expr("substring(data, 2)"))).filter("id = 4").first()
    assert bad.data is None and bad.fault
    assert C.unpack(sent.limit(0)).count() == 0
