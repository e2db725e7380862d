"""Rules that SQL does not show: folds, quirks, binary files, options, text functions."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tidelog.functions import scalar as S
from tidelog.functions.sequence import with_previous, with_running_sum
from tidelog.operators import accept, continuity, decode, filters, inspect, metrics, package, schema_store, segment
from tidelog.sources import binlog, config, sinks, topic_log


def whole(rule, rows):
    return [g[0] for g in accept.fold(rows, rule)]


def test_recovery_rules():
    assert whole(accept.Recovery(), [(1, 5, 0, 0), (1, 6, 0, 0), (1, 6, 0, 0), (1, 8, 0, 0), (1, 7, 0, 0), (0, 8, 0, 0), (2, 8, 0, 0)]) == [True, True, False, False, True, False, True]
    split = [(1, 1, 0, 1), (1, 1, 1, 1), (1, 1, 1, 1), (1, 1, 2, 2), (1, 2, 0, 0)]
    assert whole(accept.Recovery(), split) == [True, True, False, True, True]


def test_resent_split_under_a_higher_epoch():
    """Recovery has moved on at the first part and rejects it; a consumer takes it."""
    rows = [(1, 1, 0, 0), (1, 2, 0, 1), (2, 2, 0, 1), (2, 2, 1, 2)]
    assert whole(accept.Recovery(), rows) == [True, True, False, False]
    assert whole(accept.ConsumerV1(), rows) == [True, True, True, True]


def test_recovery_closed_forms():
    rng = random.Random(2)
    for _ in range(200):
        seqs, at = [], 1
        while at <= 12:
            seqs.append(at)
            at = max(1, at - rng.randint(0, 3)) if rng.random() < 0.3 else at + 1
        got = whole(accept.Recovery(), [(1, s, 0, 0) for s in seqs])
        assert got == [s not in seqs[:i] for i, s in enumerate(seqs)]


def test_consumers():
    assert accept.fold([(1, 1, 0, 0), (1, 3, 0, 0), (1, 2, 0, 0), (1, 4, 0, 1)], accept.ConsumerV0()) == [(True, True), (True, True), (False, False), (False, False)]
    assert accept.fold([(1, 1, 0, 1)], accept.ConsumerV0(transactional=False)) == [(False, True)]
    assert accept.fold([(1, 1, 0, 0), (1, 3, 0, 0), (1, 4, 0, 0)], accept.ConsumerV1()) == [(True, True), (False, False), (False, False)]
    assert whole(accept.ConsumerV1(allow_merged_gaps=True), [(1, 1, 0, 0), (1, 3, 0, 0), (1, 4, 0, 0)]) == [True, True, True]
    assert accept.fold([(1, 9, 1, 1), (1, 9, 2, 2), (1, 10, 0, 0)], accept.ConsumerV1()) == [(True, False), (True, True), (True, True)]
    assert accept.fold([(1, 1, 0, 0), (1, 1, 0, 0)], accept.ConsumerV1(transactional=False)) == [(True, True)] * 2


def test_token_bucket():
    assert accept.token_bucket([(0, 100), (1000, 100), (1000, 100)], 100) == [1000, 1000, 2000]


def test_state_table():
    assert segment.step("NONE", "GTID") == ("GTID", False, False)
    assert segment.step("GTID", "STATEMENT") == ("NONE", False, True)
    assert segment.step("DML", "GTID") == ("GTID", True, False)
    assert segment.step("DML", "END_TRX") == ("NONE", False, False)
    assert segment.step("NONE", "END_TRX") == ("NONE", True, False)
    assert segment.step("GTID", "PRE_STATEMENT") == ("DDL", False, True)


def plain_groups(kinds):
    """The state table, event by event: (group, attempt, ends, error)."""
    state, group, attempt, out = "NONE", 1, 0, []
    for kind in kinds:
        state, error, _ = segment.step(state, kind)
        ends = state == "NONE" and not error
        out.append((group, attempt, ends, error))
        group, attempt, state = group + ends, attempt + error, "NONE" if error else state
    return out


@pytest.mark.parametrize("rows", [7, 1000])
def test_segments_of_any_log_in_many_ranges(spark, rows):
    """Errors, statements in statement format, heartbeats, switches of files within transactions, at every border."""
    rng = random.Random(rows)
    say = {"GTID": (33, ""), "BEGIN_TRX": (2, "BEGIN"), "END_TRX": (16, ""), "END_XA_TRX": (2, "XA ROLLBACK 'a'"), "STATEMENT": (2, "INSERT INTO t VALUES (1)"), "PRE_STATEMENT": (5, ""), "IGNORE": (27, ""), "ERROR": (99, "")}
    kinds = []
    while len(kinds) < 300:
        kinds += ["GTID", "BEGIN_TRX", "STATEMENT", "IGNORE", "END_TRX"] if rng.random() < 0.6 else [rng.choice(list(say))]
    df = spark.createDataFrame([(i * 3, *say[k], 10) for i, k in enumerate(kinds)], "order_key long, event_type long, statement string, size long")
    got = segment.segment(df, rows=rows).orderBy("order_key").collect()
    want = plain_groups(kinds)
    assert [(r.group_no, r.attempt, r.ends, r.error) for r in got] == want
    ended = {w[:2] for w in want if w[2]}
    assert segment.groups(segment.segment(df, rows=rows)).count() == len(ended)


def test_statement_after_begin_is_no_schema_change(spark):
    rows = [(33, ""), (2, "BEGIN"), (2, "INSERT INTO t VALUES (1)"), (16, ""), (27, ""), (26, ""), (33, ""), (2, "CREATE TABLE t (a INT)"), (33, ""), (2, "BEGIN"), (4, ""), (15, ""), (30, ""), (16, "")]
    df = spark.createDataFrame([(i, t, q, 1) for i, (t, q) in enumerate(rows)], "order_key long, event_type long, statement string, size long")
    got = sorted((r.first_key, r.n_events, r.is_ddl) for r in segment.groups(segment.segment(df)).collect())
    assert got == [(0, 4, 0), (4, 1, 0), (5, 1, 0), (6, 2, 1), (8, 6, 0)]


@pytest.mark.parametrize("most", [0, 1000])
def test_restarts_are_exempt(spark, monkeypatch, most):
    """Several rows without an id after a restart, and the next transaction continues the log: no break. With and without broadcasts."""
    monkeypatch.setattr(continuity, "MOST_EPOCHS", most)
    rows = [(1, "u:1", 1, 1, 4, 1, 100), (2, "", 2, 9, 0, 9, 4), (3, "", 2, 9, 4, 9, 120), (4, "u:2", 2, 1, 100, 1, 200), (5, "u:3", 2, 1, 201, 1, 300), (6, "", 3, 9, 4, 9, 50), (7, "", 4, 1, 300, 1, 310), (8, "", 4, 7, 4, 7, 9)]
    df = spark.createDataFrame(rows, "trans_seq_no long, gtid string, epoch long, file_no long, position long, next_file_no long, next_position long")
    assert [(r.trans_seq_no, r.prev_seq) for r in continuity.transaction_breaks(df, 2).orderBy("trans_seq_no").collect()] == [(5, 4), (8, 7)]


def test_boundary_classes(spark):
    rows = [(2, "BEGIN", "BEGIN_TRX"), (2, "B", "STATEMENT"), (2, "XA START 'a'", "BEGIN_TRX"), (2, "rollback", "END_TRX"), (2, "ROLLBACK TO a", "STATEMENT"), (2, "xa rollback 'a'", "END_XA_TRX"), (2, "COMMIT", "END_TRX"), (38, "", "END_TRX"), (5, "", "PRE_STATEMENT"), (27, "", "IGNORE"), (99, "", "ERROR"), (24, "", "STATEMENT")]
    df = spark.createDataFrame(rows, "t long, s string, want string")
    assert df.filter(segment.boundary_class(F.col("t"), F.col("s")) != F.col("want")).count() == 0


def test_streams_agree_with_batch(spark, tmp_path):
    from tidelog.streaming.stateful import accept_stream, run_to_end, segment_stream

    rows = [("t", p, i, 1, s, 0, 0) for p in (0, 1) for i, s in enumerate([1, 2, 2, 3, 5, 4, 5])]
    schema = "topic string, part_no long, offset long, epoch long, trans_seq_no long, seq_no long, split_flag long"
    df = spark.createDataFrame(rows, schema)
    for i in range(7):
        df.filter(F.col("offset") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = topic_log.read_stream(spark, str(tmp_path / "in"), schema, 100)
    got = run_to_end(accept_stream(stream), "accepted", str(tmp_path / "c1")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, accept.accept(df).collect()))
    ev = [("b", i, c) for i, c in enumerate(["GTID", "BEGIN_TRX", "STATEMENT", "END_TRX", "GTID", "STATEMENT", "IGNORE", "GTID", "GTID"])]
    spark.createDataFrame(ev, "source string, order_key long, boundary string").write.parquet(str(tmp_path / "ev"))
    s = topic_log.read_stream(spark, str(tmp_path / "ev"), "source string, order_key long, boundary string", 100)
    out = {r.order_key: (r.group_no, r.ends, r.error, r.is_ddl) for r in run_to_end(segment_stream(s), "segments", str(tmp_path / "c2")).collect()}
    assert out[3] == (1, True, False, False) and out[5] == (2, True, False, True) and out[6][0] == 3 and out[8][2]


def test_global_order_in_many_ranges(spark):
    df = spark.range(0, 1000, 7).withColumnRenamed("id", "k").withColumn("v", F.col("k") % 5)
    got = with_running_sum(with_previous(df, "k", {"p": F.col("v")}, 50), "k", F.col("v"), "s", 50).orderBy("k").collect()
    total, last = 0, None
    for r in got:
        total += r.v
        assert r.s == total and r.p == last
        last = r.v


def test_filter_rules(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "z"), ("mysql", "x"), ("MYSQL", "x")], "d string, t string")
    keep = lambda text, **k: [tuple(r) for r in df.filter(filters.table_included(F.col("d"), F.col("t"), filters.load_rules(text), **k)).collect()]
    assert keep("{}") == [("a", "x"), ("a", "y"), ("b", "x"), ("c", "z"), ("MYSQL", "x")]
    assert keep('{"a": {"x": []}, "": {"z": []}}') == [("a", "x"), ("c", "z")]
    assert keep('{"a": {}}') == [("a", "x"), ("a", "y")]
    assert keep('{"a": {"": []}}') == [] and len(keep('{"a": {"": []}}', table_wildcard=True)) == 2


def test_typed_values(spark):
    cases = [("-5", "int", -5), ("4294967295", "int unsigned", 4294967295), ("18446744073709551615", "bigint unsigned", 18446744073709551615), ("2018:01:01", "date", "2018-01-01"), ("1539689886000", "timestamp", "2018-10-16 11:38:06"), ("2018-10-16 19:38:06.5", "datetime", "2018-10-16 19:38:06.000005"), ("1901", "year", 1901), ("2", "enum('a','b')", "b"), ("3", "set('a','b','c')", "a,b"), ("15.845700000000000784", "double", 15.8457), ("x", "int", None), ("12.50", "decimal(10,2)", "12.50")]
    for text, kind, want in cases:
        got = spark.range(1).select(decode.typed(F.lit(text), kind)).first()[0]
        assert got == want or str(got) == str(want), (text, kind, got)


def test_apply_ddl():
    t = schema_store.apply_ddl(None, "CREATE TABLE t (a INT, b DECIMAL(10, 2))")
    assert t == [("a", "INT"), ("b", "DECIMAL(10, 2)")]
    t = schema_store.apply_ddl(t, "ALTER TABLE t ADD COLUMN c varchar(10)")
    t = schema_store.apply_ddl(schema_store.apply_ddl(t, "alter table t drop a"), "ALTER TABLE t MODIFY COLUMN b int unsigned")
    assert t == [("b", "int unsigned"), ("c", "varchar(10)")] and schema_store.apply_ddl(t, "DROP TABLE t") is None
    with pytest.raises(ValueError):
        schema_store.apply_ddl(t, "ALTER TABLE t ENGINE = x")


def test_binary_files(spark, tmp_path):
    gtid = b"\x00" + bytes(range(16)) + struct.pack("<q", 77)
    data = binlog.encode([(100, 33, 1, 0, gtid), (101, 4, 1, 0, struct.pack("<Q", 4) + b"log.000002")])
    (tmp_path / "log.000001").write_bytes(data + b"\x01\x02")
    rows = binlog.read(spark, str(tmp_path)).orderBy("log_pos").collect()
    assert [(r.timestamp, r.event_type, r.log_pos - r.event_size) for r in rows] == [(100, 33, 4), (101, 4, 48)]
    assert binlog.gtid_of(rows[0].payload) == "00010203-0405-0607-0809-0a0b0c0d0e0f:77" and binlog.rotate_of(rows[1].payload) == ("log.000002", 4)
    assert [binlog.length_encoded(b, 0)[0] for b in (b"\x05", b"\xfb", b"\xfc\x01\x02", b"\xfd\x01\x00\x01", b"\xfe" + struct.pack("<Q", 2**40))] == [5, None, 513, 65537, 2**40]
    assert binlog.strip_checksum(b"abcdEFGH", True) == b"abcd" and binlog.strip_checksum(b"abcd", True, True) == b"abcd"


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [len(one(S.split_string(F.lit(t), s))) for t, s in (("abcd", " "), ("a/b/d/", "/"), ("a/b/d", "/"), ("/a/b/d", "/"), ("a//b//d/", "/"), ("//a//b//d//", "//"))] == [1, 4, 3, 4, 6, 5]
    assert one(S.same_text(F.lit("AbC"), F.lit("ABc"))) and not one(S.same_text(F.lit("ABd"), F.lit("ABC")))
    assert one(S.decode_bits(F.lit(b"\x01\x02"))) == 258 and one(S.write_bits(F.lit(5).cast("long"), 4)) == "b'0101'"
    assert [one(S.length_encoded_int(F.lit(b))) for b in (b"\x05", b"\xfc\x01\x02", b"\xfe" + struct.pack("<Q", 2**40))] == [5, 513, 2**40] and one(S.length_encoded_int(F.lit(b"\xfb"))) is None
    for text in ("ab", "", "\u00e9\u4e2d x"):
        h = 5381
        for c in text.encode():
            h = (h * 33 + c) % 2**32
        assert one(S.djb_hash(F.lit(text))) == h
    assert one(S.is_ddl(F.lit(" create table x"))) and not one(S.is_ddl(F.lit("insert into x")))


def test_inspection(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(inspect.sql_value(F.lit("a'b\\c\nd"))) == "'a\\'b\\\\c\\nd'" and one(inspect.sql_value(F.lit(None))) == "NULL"
    assert one(inspect.without_definer(F.lit("CREATE DEFINER=`a`@`b` VIEW v"))) == "CREATE VIEW v"
    assert one(inspect.index_lines(F.lit("CREATE TABLE t (\n a INT,\n PRIMARY KEY (a),\n UNIQUE KEY u (a),\n KEY k (a)\n)"))) == ["UNIQUE KEY u (a),", "KEY k (a)"]
    assert one(inspect.row_estimate(F.lit("InnoDB"), F.lit(10))) == 15.0
    assert one(inspect.version_comment(F.lit("x"))) == "/*!50003 x */"
    assert one(metrics.alarm_text(F.lit("a:b" + "x" * 200))) == "a b" + "x" * 97


def test_sources_and_options(spark, tmp_path):
    assert config.parse("# x\nA = 1\n;y\nb=2\na=3") == {"a": "3", "b": "2"}
    with pytest.raises(ValueError):
        config.check_options(True, True, False)
    assert sinks.checkpoint_from_json(sinks.checkpoint_json({"flag": 1, "seq_no": 0, "gtid": "u:1"})) == {"flag": "1", "seq_no": "0", "gtid": "u:1"}
    df = spark.range(10).select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"))
    topic_log.write(df, str(tmp_path / "log"))
    assert topic_log.read(spark, str(tmp_path / "log"), 2, 5).count() == 3
    assert [r.offset for r in topic_log.scan(df, 6, 3).collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        topic_log.check_range(5, 2)


def test_split_of_single_rows_and_empty(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 7)], "trans_seq_no long, n_rows long")
    got = [tuple(r) for r in package.split_rows(df, 64, 50).orderBy("trans_seq_no", "seq_no").collect()]
    assert got[:2] == [(1, 0, 0, 0, 0), (2, 0, 0, 1, 0)] and [g[2:4] for g in got[2:]] == [(i, i + 1) for i in range(7)]
