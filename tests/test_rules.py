"""Rules of delivery, state, schema changes and sources that SQL does not show."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tidelog.functions import stored
from tidelog.functions.sequence import range_number, ranges_of, with_previous, with_running_sum
from tidelog.operators import accept, continuity, filters, gtid, inspect, metrics, package, schema_store, segment, wire
from tidelog.plans import catalog
from tidelog.sources import binlog, change_log, sinks, state

SF = "/root/testdata/sf0.001"


def test_ranges_are_even_whatever_the_keys(spark):
    keys = [*range(1000), *range(10**9, 10**9 + 1000), 10**15]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    borders = ranges_of(df, "k", rows=60)
    got = {r.n: r["count"] for r in df.groupBy(range_number(F.col("k"), borders).alias("n")).count().collect()}
    assert len(got) >= 18 and max(got.values()) <= 250
    want = {k: sum(b <= k for b in borders) for k in keys}
    assert {r.k: r.n for r in df.select("k", range_number(F.col("k"), borders).alias("n")).collect()} == want


def test_stored_tables_are_cleaned_up(spark, tmp_path):
    assert stored.stored(spark.range(5)).count() == 5
    assert stored.clean_up(spark) >= 1 and stored.clean_up(spark) == 0


def test_a_state_survives_a_write_that_fails(spark, tmp_path):
    path = str(tmp_path / "state")
    with pytest.raises(ValueError):
        sinks.load_state(spark, path)
    good = spark.createDataFrame([(1, 10)], "seq_no long, offset long")
    assert sinks.save_state(good, path) == 1
    with pytest.raises(Exception):
        sinks.save_state(good.withColumn("offset", F.raise_error(F.lit("x")).cast("long")), path)
    assert [tuple(r) for r in sinks.load_state(spark, path).collect()] == [(1, 10)]
    for i in range(2, 7):
        sinks.save_state(spark.createDataFrame([(i, i)], "seq_no long, offset long"), path)
    assert sinks.load_state(spark, path).first().seq_no == 6 and sinks.versions_of(spark, path) == [4, 5, 6]


def test_a_stream_goes_on_where_it_was_stopped(spark, tmp_path):
    """The state of the fold is in the checkpoint: a second run takes only what is new, by the state of the first."""
    from tidelog.streaming.stateful import ACCEPTED, accept_stream, run_to_files

    schema = "topic string, part_no long, offset long, epoch long, trans_seq_no long, seq_no long, split_flag long"
    rows = [("t", 0, i, 1, s, 0, 0) for i, s in enumerate([1, 2, 2, 3, 5, 4, 5])]
    source = str(tmp_path / "in")
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        got = [(r.offset, r.accepted) for r in run_to_files(accept_stream(stream), str(tmp_path / "out"), str(tmp_path / "c"), ACCEPTED).collect()]
    assert sorted(got) == sorted((r.offset, r.accepted) for r in accept.accept(spark.createDataFrame(rows, schema)).collect())


def test_bootstrap_and_switch():
    assert accept.bootstrap({"flag": "1", "seq_no": "7", "gtid": "u:1-5", "epoch": "3"}) == {"read_topic": False, "offset": None, "gtid": "u:1-5", "seq_no": 7, "epoch": 4}
    assert accept.bootstrap({"flag": "0", "seq_no": "7", "gtid": "u:1-5", "epoch": "3", "offset": "90"})["offset"] == 91
    v1 = accept.ConsumerV1()
    v1.accept(2, 5, 0, 0)
    v0 = accept.switched(v1, 0)
    assert (v0.epoch, v0.seq) == (2, 5) and accept.switched(v0, 0) is v0
    assert accept.switched(v0, 1) == accept.ConsumerV1() and not v0.accept(2, 5, 0, 0)[0]


def test_rate_limit_is_the_bucket(spark):
    rng = random.Random(3)
    rows = [(s, i, t, rng.randint(1, 400)) for s in (0, 1) for i, t in enumerate(sorted(rng.randint(0, 9000) for _ in range(60)))]
    got = {(r.source, r.event_id): r.wait_ms for r in accept.limited(spark.createDataFrame(rows, "source long, event_id long, at long, size long"), 500).collect()}
    for s in (0, 1):
        own = [r for r in rows if r[0] == s]
        assert [got[s, r[1]] for r in own] == accept.token_bucket([(r[2], r[3]) for r in own], 500)
    assert max(got.values()) > 0


def test_object_lists():
    assert filters.parse_objects("a.b, c") == [("a", "b"), ("%", "c")]
    assert filters.parse_objects('"x,y", \'a.b\'.c') == [("%", "x,y"), ("a.b", "c")]
    assert filters.parse_objects("root@localhost,app", users=True) == [("'root'", "'localhost'"), ("'app'", "%")]
    for bad in ("a.b.c", "a.", ",a"):
        with pytest.raises(ValueError):
            filters.parse_objects(bad)
    assert ("mysql", "user") in filters.with_default_exclusions([], []) and filters.with_default_exclusions([("a", "b")], []) == []


def test_illegal_events_fail(spark):
    df = spark.createDataFrame([(1,), (99,)], "event_type long")
    assert filters.illegal(df).count() == 1 and filters.legal(df.filter("event_type = 1")).count() == 1
    with pytest.raises(Exception, match="no such event type"):
        filters.legal(df).collect()


def test_lookup_needs_one_version(spark):
    e = spark.createDataFrame([("a", "x", 1)], "database_name string, table_name string, trans_seq_no long")
    s = spark.createDataFrame([("a", "x", 1, 1), ("a", "x", 2, 1)], "db_name string, table_name string, version long, status long")
    with pytest.raises(Exception, match="current versions of a.x"):
        schema_store.single(schema_store.lookup(e, s)).collect()


def test_schema_changes():
    one = lambda cols, s: schema_store.apply_ddl(cols, s)
    t = one(None, "CREATE TABLE IF NOT EXISTS `d`.`t` (`a b` INT NOT NULL DEFAULT '1,2', b DECIMAL(10, 2) COMMENT 'x)', PRIMARY KEY (`a b`), KEY k (b)) ENGINE=InnoDB DEFAULT CHARSET=utf8")
    assert t == [("a b", "INT"), ("b", "DECIMAL(10, 2)")]
    t = one(t, "ALTER TABLE t ADD c varchar(10) NOT NULL AFTER `a b`, ADD COLUMN z int FIRST, ADD UNIQUE INDEX i (c)")
    assert [c[0] for c in t] == ["z", "a b", "c", "b"]
    t = one(t, "ALTER TABLE t CHANGE z y bigint unsigned AFTER b, RENAME COLUMN c TO d, MODIFY b text FIRST")
    assert t == [("b", "text"), ("a b", "INT"), ("d", "varchar(10)"), ("y", "bigint unsigned")]
    assert one(t, "TRUNCATE TABLE t") == t and one(t, "CREATE UNIQUE INDEX i ON t (b)") == t and one(None, "DROP TABLE IF EXISTS t") is None
    for cols, bad in ((t, "ALTER TABLE t DROP q"), (t, "ALTER TABLE t ADD b int"), (t, "CREATE TABLE t (a int)"), (None, "DROP TABLE t"), (None, "ALTER TABLE t ADD a int"), (t, "SELECT 1"), (t, "ALTER TABLE t ADD q int AFTER nowhere")):
        with pytest.raises(ValueError):
            one(cols, bad)
    done = set()
    tables, failed = schema_store.applied({}, [("g1", "d", "CREATE TABLE x (a int)"), ("g1", "d", "DROP TABLE x"), ("g2", "d", "RENAME TABLE x TO e.y"), ("g3", "d", "ALTER TABLE x ADD b int"), ("g4", "e", "ALTER TABLE y RENAME TO z"), ("g5", "", "CREATE DATABASE q"), ("g6", "", "drop database d")], done)
    assert tables == {("e", "z"): [("a", "int")]} and [f[0] for f in failed] == ["g3"] and done == {"g1", "g2", "g4", "g5", "g6"}


def test_snapshot_is_read_again_while_the_schema_changes(spark):
    values = iter([1, 2, 2, 2])
    status = lambda: spark.createDataFrame([("Com_create_table", next(values)), ("Com_select", 9)], "name string, value long")
    cols = lambda: spark.createDataFrame([("d", "t", 1, "a", "int"), ("mysql", "u", 1, "a", "int")], "db_name string, table_name string, position long, name string, type string")
    assert schema_store.snapshot(cols, status).count() == 1
    always = iter(range(100))
    with pytest.raises(RuntimeError):
        schema_store.snapshot(cols, lambda: spark.createDataFrame([("Com_alter_table", next(always))], "name string, value long"))


def test_messages_on_the_wire(spark):
    rng = random.Random(1)
    for _ in range(200):
        v = [rng.choice([None, 0, 1, 127, 128, 2**40, -1]) if k == "long" else rng.choice([None, "", "xé" * rng.randint(1, 200)]) if k == "string" else rng.choice([None, b"", bytes(300)]) for _, _, k in wire.PACKAGE]
        data = wire.message(v, wire.PACKAGE)
        assert wire.parsed(data, wire.PACKAGE) == v and wire.parsed(data + wire.varint(99 << 3) + wire.varint(5), wire.PACKAGE) == v
    assert wire.message([1, 300], [(1, "a", "long"), (2, "b", "long")]) == b"\x08\x01\x10\xac\x02"
    assert wire.parsed(b"\x0a\x05ab", [(1, "a", "string")]) is None and wire.parsed(b"\x08", [(1, "a", "long")]) is None
    bad = wire.decode(spark.createDataFrame([(b"\x0a\x05ab",), (b"",)], "message binary"), wire.PACKAGE)
    assert [tuple(r) for r in bad.collect()] == [(None,) * 10] * 2


def test_state_tree(spark):
    t = spark.createDataFrame([("/a", 1, "x"), ("/a/b", 1, "y"), ("/a/b", 2, None), ("/a/c/d", 1, "z")], "path string, version long, value string")
    assert {r.path: r.value for r in state.latest(t).collect()} == {"/a": "x", "/a/c/d": "z"}
    assert {r.child for r in state.children(t, "/a/").collect()} == {"b", "c"}
    assert {r.path: r.version for r in state.latest(state.set_value(t, "/a", "w", expected=1)).collect()}["/a"] == 2
    with pytest.raises(ValueError):
        state.set_value(t, "/a", "w", expected=5)


def test_binary_files_as_a_stream_and_as_blobs(spark, tmp_path):
    from tidelog.streaming.stateful import run_to_end

    for i in (1, 2):
        (tmp_path / f"log.{i:06d}").write_bytes(binlog.encode([(i, 16, 1, 0, struct.pack("<q", i)), (i, 4, 1, 0, struct.pack("<Q", 4) + b"next")]))
    got = run_to_end(binlog.read_stream(spark, str(tmp_path)), "binary_stream", str(tmp_path.parent / "c")).collect()
    assert sorted((r.timestamp, r.event_type) for r in got) == [(1, 4), (1, 16), (2, 4), (2, 16)]
    b = {r.name: r.length for r in sinks.blobs(spark, str(tmp_path)).collect()}
    assert set(b) == {"log.000001", "log.000002"} and all(b.values())
    assert binlog.group_commit_of(bytes(25) + b"\x02" + struct.pack("<qq", 5, 6)) == (5, 6) and binlog.group_commit_of(bytes(25)) == (None, None)


def test_observed_metrics(spark):
    df, seen = metrics.observed(catalog.ev(spark, SF), "log")
    n = df.count()
    assert seen.get["event_count"] == n and seen.get["transaction_count"] > 0


def test_levels_of_a_circle(spark):
    with pytest.raises(RuntimeError):
        inspect.levels(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "task string, needs string"))


def test_parts_are_the_work_list():
    rng = random.Random(5)
    for _ in range(200):
        events = [(i, rng.randint(1, 120), [rng.randint(1, 300) for _ in range(rng.randint(0, 6))]) for i in range(rng.randint(0, 7))]
        got = package.split_parts(events, 260)
        rows = {i: [] for i, _, _ in events}
        for part, size, cleared in got:
            assert size <= 260 or len(part) == 1 and part[0][1] == part[0][2]
            for i, lo, hi in part:
                rows[i] += list(range(lo, hi))
        for i, base, sizes in events:
            lost = [j for j in range(len(sizes)) if j not in rows[i]]
            assert rows[i] == sorted(rows[i]) and all(64 + base + sizes[j] > 260 for j in lost)


def test_ids_of_a_merged_run(spark):
    u = change_log.SOURCE_UUID
    rows = [(1, f"{u}:1", 0, 1, 4, 1, 10), (2, f"{u}:2", 0, 1, 10, 1, 20), (3, "", 0, 1, 20, 2, 4), (4, f"{u}:5", 0, 2, 4, 2, 9), (5, f"{u}:6", 3, 2, 9, 2, 30)]
    df = spark.createDataFrame(rows, "trans_seq_no long, gtid string, n_events long, file_no long, position long, next_file_no long, next_position long")
    got = [(r.trans_seq_no, r.n_merged, r.next_file_no, r.next_position, r.gtid_text) for r in package.merge_empty(df).orderBy("trans_seq_no").collect()]
    assert got == [(1, 4, 2, 9, f"{u}:1-2:5"), (5, 1, 2, 30, f"{u}:6")]
    assert [r.n_merged for r in package.merge_empty(df, batch=2).orderBy("trans_seq_no").collect()] == [2, 2, 1]


def test_id_sets_over_many_spans(spark):
    rng = random.Random(9)
    rows = [(0, "u", lo, lo + rng.randint(0, 3 * gtid.SPAN if rng.random() < 0.1 else 40)) for lo in (rng.randint(0, 6 * gtid.SPAN) for _ in range(300))]
    df = spark.createDataFrame(rows, "set_id long, uuid string, lo long, hi long")
    want = []
    for _, _, lo, hi in sorted(rows, key=lambda r: r[2:]):
        if want and lo <= want[-1][1] + 1:
            want[-1][1] = max(want[-1][1], hi)
        else:
            want.append([lo, hi])
    assert sorted([r.lo, r.hi] for r in gtid.merge(df).collect()) == want
    inner = spark.createDataFrame([(1, "u", *want[0]), (2, "u", want[0][0], want[0][1] + 1), (3, "v", 1, 1)], "set_id long, uuid string, lo long, hi long")
    assert {r.set_id: r.contained for r in gtid.contains(df.drop("set_id"), inner).collect()} == {1: True, 2: False, 3: False}


def test_large_id_sets_are_merged_without_a_window_over_all(spark, monkeypatch):
    """Whatever the intervals are, and a window over a whole set sees two rows a range at most; the text is made of pieces in order."""
    rng, seen, islands = random.Random(11), [], gtid.islands
    monkeypatch.setattr(gtid, "islands", lambda df, *by: (seen.append((by, df.count())), islands(df, *by))[1])
    rows = [(s, u, lo, lo + (rng.randint(0, 90) if rng.random() < 0.05 else rng.randint(0, 3))) for s, u, step in ((0, "u", 6), (1, "u", 3), (1, "v", 2), (2, "w", 9)) for lo in range(0, 2000, step)] + [(0, "u", 700, 1190), (2, "w", 64, 64), (2, "w", 127, 127), (2, "w", -5, -1)]
    want = {}
    for s, u, lo, hi in sorted(rows):
        own = want.setdefault((s, u), [])
        if own and lo <= own[-1][1] + 1:
            own[-1][1] = max(own[-1][1], hi)
        else:
            own.append([lo, hi])
    df = spark.createDataFrame(rows, "set_id long, uuid string, lo long, hi long")
    merged = gtid.merge(df, rows=300, near=64)
    assert sorted((r.set_id, r.uuid, r.lo, r.hi) for r in merged.collect()) == sorted((*k, *x) for k, v in want.items() for x in v)
    assert len(rows) > 1000 and all(by or n <= 2 * 4 * (2000 // 64 + 2) for by, n in seen)
    monkeypatch.setattr(gtid, "NEAR", 64)
    texts = {(s, u): ":".join(str(lo) if lo == hi else f"{lo}-{hi}" for lo, hi in v) for (s, u), v in want.items()}
    assert {r.set_id: r.gtid_text for r in gtid.to_text(merged).collect()} == {s: ",".join(f"{u}:{x}" for (t, u), x in sorted(texts.items()) if t == s) for s in (0, 1, 2)}


def test_delivery_is_tried_again(spark, tmp_path, monkeypatch):
    from tidelog.sources import topic_log

    fails, real = [0, 0], topic_log.write
    monkeypatch.setattr(topic_log, "write", lambda df, path: (_ for _ in ()).throw(OSError("full")) if fails and fails.pop() == 0 else real(df, path))
    assert topic_log.deliver(spark.range(3), str(tmp_path / "t"), pause=0) == 3 and spark.read.parquet(str(tmp_path / "t")).count() == 3
    fails += [0] * 9
    with pytest.raises(OSError):
        topic_log.deliver(spark.range(3), str(tmp_path / "t"), tries=2, pause=0)
    fails.clear()
    spark.range(5).write.parquet(str(tmp_path / "in"))
    q = topic_log.write_stream(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_dump_options_and_compression(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    o = inspect.DumpOptions(create=False, lock=False, names=False, rows=1, verb="REPLACE INTO")
    assert [r.text for r in inspect.table_dump(df, "", "t", "k", {"k": "number", "v": "text"}, o).orderBy("place").collect()] == ['REPLACE INTO t VALUES (1,"a");', "REPLACE INTO t VALUES (2,NULL);"]
    o = inspect.DumpOptions(data=False, drop=True, defer_keys=False)
    assert [r.text for r in inspect.table_dump(df, "CREATE TABLE t (k INT, KEY (k))", "t", "k", {}, o).orderBy("step").collect()] == ["DROP TABLE IF EXISTS t;", "CREATE TABLE t (k INT, KEY (k));"]
    sinks.write_text(df, "v", str(tmp_path / "z"), "gzip")
    assert spark.read.text(str(tmp_path / "z")).count() == 2 and list((tmp_path / "z").glob("*.gz"))


PACKAGES = "topic string, part_no long, offset long, epoch long, trans_seq_no long, seq_no long, split_flag long"


def odd_packages(seed, n, versions=False):
    """Topic partitions with splits, parts sent again, gaps, older numbers and higher epochs."""
    rnd, rows = random.Random(seed), []
    for topic, many in (("a", n), ("b", 5), (None, 3)):
        epoch, seq, version = 1, 1, rnd.random() < 0.5
        sent = []
        while len(sent) < many:
            parts = rnd.choice([1, 1, 1, 3])
            one = [(epoch, seq, i, 0 if parts == 1 else 2 if i == parts - 1 else 1, int(version)) for i in range(parts)]
            sent += one if rnd.random() < 0.9 else one[: rnd.randint(1, parts)] + one
            if rnd.random() < 0.05:
                sent += rnd.sample(sent, min(3, len(sent)))
            seq += 2 if seed % 3 == 0 and rnd.random() < 0.01 else 1
            epoch += rnd.random() < 0.02
            version ^= versions and rnd.random() < 0.02
        rows += [(topic, 0, at * 3, *r) for at, r in enumerate(sent)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_acceptance_in_ranges_is_that_of_row_by_row(spark, seed):
    """Ranges of 60 rows: the states that are foretold for them meet, or are put right."""
    rows = odd_packages(seed, 250)
    df = spark.createDataFrame([r[:7] for r in rows], PACKAGES)
    for rule, options in (("recovery", {}), ("v0", {}), ("v0", {"transactional": False}), ("v1", {}), ("v1", {"allow_merged_gaps": True}), ("v1", {"transactional": False})):
        want = {}
        for topic in ("a", "b", None):
            own = sorted((r for r in rows if r[0] == topic), key=lambda r: r[2])
            want |= {(topic, r[2]): g for r, g in zip(own, accept.fold([r[3:7] for r in own], accept.RULES[rule](**options)))}
        got = {(r.topic, r.offset): (r.accepted, r.can_save_offset) for r in accept.accept(df, rule, rows=60, **options).collect()}
        assert got == want, (rule, options)


@pytest.mark.parametrize("seed", range(2))
def test_consumers_in_ranges_hand_on_what_row_by_row_does(spark, seed):
    rows = odd_packages(seed, 250, versions=True)
    events = lambda r: [(r[5], 30, r[4] % 3), (9, 30, 1), (7, 19, 0)] if r[4] % 5 else None
    df = spark.createDataFrame([(*r, events(r)) for r in rows], PACKAGES + ", version long, events array<struct<ev_idx:bigint,event_type:bigint,n_rows:bigint>>")
    for transactional in (True, False):
        want, state = [], None
        for topic in ("a", "b", None):
            state = None
            for r in sorted((r for r in rows if r[0] == topic), key=lambda r: r[2]):
                if state is None:
                    state = accept.ConsumerV1(transactional) if r[7] else accept.ConsumerV0(transactional)
                state = accept.switched(state, r[7])
                v1 = isinstance(state, accept.ConsumerV1)
                took, save = state.accept(*r[3:7], *([events(r)] if v1 else []))
                kept = [e for part in (state.merged if v1 else [events(r)]) for e in part or [] if e[1] == 30 and e[2] > 0] if took else []
                if kept:
                    want.append((topic, 0, r[2], r[3], r[4], len({e[0] for e in kept}), sum(e[2] for e in kept), save))
        got = [tuple(r) for r in accept.consume(df, transactional, rows=60).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_events_of_a_large_log_are_dealt_to_more_tasks(spark):
    """Each task has a bounded number of events whatever the log's size, and the log is the same."""
    few, many = change_log.events(spark, SF), change_log.events(spark, SF, task_events=200)
    assert "REPARTITION_BY_NUM" in many._jdf.queryExecution().toString() and "REPARTITION_BY_NUM" not in few._jdf.queryExecution().toString()
    assert many.exceptAll(few).isEmpty() and few.exceptAll(many).isEmpty()
    assert many.groupBy(F.spark_partition_id()).count().agg(F.count("*")).first()[0] > 1


def test_streams_of_large_batches_go_on_from_batch_to_batch(spark, tmp_path):
    """In ranges of 40 rows and in three batches, which end within transactions: as the stateful folds, row by row, and nothing anew in a second run."""
    from tidelog.operators.segment import CLASSES, step
    from tidelog.streaming.stateful import accept_to_files, segment_to_files

    rows = [r[:7] for r in odd_packages(2, 120)]
    rows.sort(key=lambda r: r[2])
    for n in range(3):
        spark.createDataFrame(rows[n * 45 : (n + 1) * 45 if n < 2 else None], PACKAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
        stream = spark.readStream.schema(PACKAGES).parquet(str(tmp_path / "p"))
        got = accept_to_files(stream, str(tmp_path / "po"), str(tmp_path / "pc"), rows=40)
    want = accept.accept(spark.createDataFrame(rows, PACKAGES)).collect()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want), key=repr)
    rnd, want, events = random.Random(5), [], []
    now, group, ddl = "NONE", 1, False
    for k in range(240):
        kind = rnd.choice(CLASSES[:-1] + ["GTID", "BEGIN_TRX", "STATEMENT", "END_TRX"] * 3) if k % 90 else "ERROR"
        now, error, mark = step(now, kind)
        ddl, ends = ddl or mark, now == "NONE" and not error
        want.append(("a", k, group, kind, now, error, ends, ddl))
        events.append(("a", k, kind))
        if error:
            now, ddl = "NONE", False
        elif ends:
            group, ddl = group + 1, False
    for n in range(3):
        spark.createDataFrame(events[n * 80 : (n + 1) * 80], "source string, order_key long, boundary string").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
        stream = spark.readStream.schema("source string, order_key long, boundary string").parquet(str(tmp_path / "s"))
        got = segment_to_files(stream, str(tmp_path / "so"), str(tmp_path / "sc"), rows=40)
    assert sorted(map(tuple, got.collect())) == want


def test_parts_of_transactions_dealt_to_many_tasks(spark):
    """Dealt or not, events without sizes and rows that are too large: the same parts, and the same events from them."""
    rows = [(t, i, 19, None if (t + i) % 5 == 0 else [20 + (t * i * j) % 400 for j in range((t * 7 + i) % 6)]) for t in range(60) for i in range(t % 4 + 1)]
    df = spark.createDataFrame(rows, "trans_seq_no long, ev_idx long, base_size long, row_sizes array<bigint>")
    few, many = package.split_transactions(df, 400), package.split_transactions(df, 400, tasks=16)
    assert "REPARTITION_BY_NUM" in many._jdf.queryExecution().toString()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    sizes = {r[:2]: r[3] or [] for r in rows}
    for r in few.collect():
        assert r.cleared == (r.lo == r.hi and len(sizes[r.trans_seq_no, r.ev_idx]) > 0)
    got = {(r.trans_seq_no, r.ev_idx): r.n_rows for r in package.merged_events(many, tasks=16).collect()}
    assert got == {k: sum(x + 64 + 19 <= 400 for x in v) for k, v in sizes.items()}


def test_files_of_a_large_log_are_dealt_to_many_tasks(spark):
    """The same files and details, whatever the number of tasks."""
    ev = spark.range(400).select(F.floor(F.col("id") / 20).alias("file"), F.col("id").alias("at"))
    body = lambda r: (1, 16, 0, struct.pack("<q", r["at"]))
    few, many = (binlog.write(ev, body, "file", ["at"], checksums=True, tasks=n) for n in (None, 8))
    assert "REPARTITION_BY_NUM" in many._jdf.queryExecution().toString()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    got = binlog.details(binlog.decoded(many, checksums=True)).collect()
    assert sorted((int(r.path), r.xid, r.decoder, r.gtid) for r in got) == [(k // 20, k, "xid", None) for k in range(400)]


def test_ranges_are_tasks_however_few_bytes_they_have(spark):
    df = stored.stored(spark.createDataFrame([(k, k % 7) for k in range(2000)], "k long, v long"))
    for got in (with_running_sum(df, "k", F.col("v"), "s", rows=100), with_previous(df, "k", {"p": F.col("v")}, rows=100)):
        tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert len(tasks) >= 15 and max(tasks) <= 200 and sum(tasks) == 2000


def test_a_log_is_segmented_in_as_many_tasks_as_ranges(spark):
    ev = stored.stored(spark.createDataFrame([(k, (33, 2, 16)[k % 3], "BEGIN" if k % 3 == 1 else "") for k in range(1500)], "order_key long, event_type long, statement string"))
    got = segment.segment(ev, rows=100)
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) >= 12 and max(tasks) <= 250
    assert {r.order_key: r.group_no for r in got.collect()} == {k: k // 3 + 1 for k in range(1500)}


def test_transactions_and_breaks_of_a_large_log_are_dealt_to_many_tasks(spark):
    ev = stored.stored(change_log.events(spark, SF))
    lossy = ev.filter("(trans_seq_no * 7 + ev_idx) % 13 <> 0")
    tasks = lambda df: df.groupBy(F.spark_partition_id()).count().count()
    for few, many in ((continuity.summaries(ev), continuity.summaries(ev, 40)), (continuity.event_breaks(lossy), continuity.event_breaks(lossy, 40))):
        assert many.exceptAll(few).isEmpty() and few.exceptAll(many).isEmpty() and not few.isEmpty()
        assert tasks(many) > 20 > tasks(few)
