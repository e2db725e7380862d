"""Queries of delivery, state, schema changes and metrics over the derived log, with SQL of the same meaning."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..functions.stored import shared_dir, stored
from ..operators import accept, continuity, gtid, metrics, package, schema_store
from ..sources import change_log, config, sinks, state
from .catalog import CONTINUITY, EV, EVENT_BREAKS, IDS, MERGED, PKG, TICKS, TRX, catalog, continuity_event, ev, ids, pkg, query, read, restarted, ticks, trx

# ---- consumers

#: Split every fifth transaction into three parts of its events; the version of messages changes on the way; some are sent twice.
PARTS = f"""{EV}, e AS (SELECT trans_seq_no, max(epoch) AS epoch, list({{'ev_idx': ev_idx, 'event_type': event_type, 'n_rows': n_rows}} ORDER BY ev_idx) AS events FROM ev GROUP BY trans_seq_no)"""


def parts(spark, d):
    e = ev(spark, d).groupBy("trans_seq_no").agg(F.max("epoch").alias("epoch"), F.sort_array(F.collect_list(F.struct("ev_idx", "event_type", "n_rows"))).alias("events"))
    seq = F.col("trans_seq_no")
    whole = e.withColumns({"seq_no": F.lit(0).cast("long"), "split_flag": F.lit(0).cast("long")})
    third = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.struct(i.cast("long").alias("seq_no"), F.when(i == 2, 2).otherwise(1).cast("long").alias("split_flag"), F.slice(F.col("events"), i * 3 + 1, F.lit(3)).alias("part")))
    split = e.filter(seq % 5 == 0).withColumn("p", F.explode(third)).select("trans_seq_no", "epoch", F.col("p.part").alias("events"), "p.seq_no", "p.split_flag")
    p = whole.filter(seq % 5 != 0).unionByName(split).withColumn("offset", seq * 10 + F.col("seq_no"))
    again = p.filter(seq % 7 == 0).withColumn("offset", F.col("offset") + 5)
    return p.unionByName(again).withColumns({"topic": F.lit("t"), "part_no": F.lit(0).cast("long"), "version": F.lit(1).cast("long")})


@query(f"WITH {PARTS}, k AS (SELECT trans_seq_no, epoch, list_filter(events, lambda x: x.event_type IN (23, 24, 25, 30, 31, 32) AND x.n_rows > 0) AS kept FROM e) SELECT trans_seq_no, epoch, trans_seq_no * 10 + CASE WHEN trans_seq_no % 5 = 0 THEN 2 ELSE 0 END AS \"offset\", len(kept)::BIGINT AS n_events, list_sum(list_transform(kept, lambda x: x.n_rows))::BIGINT AS n_rows, true AS can_save_offset FROM k WHERE len(kept) > 0")
def consume_v1(spark, d):
    return accept.consume(parts(spark, d)).drop("topic", "part_no")


@query(f"""WITH {PARTS}, k AS (SELECT trans_seq_no, epoch, list_filter(events, lambda x: x.event_type IN (23, 24, 25, 30, 31, 32) AND x.n_rows > 0) AS kept FROM e WHERE trans_seq_no % 5 <> 0)
SELECT trans_seq_no, epoch, trans_seq_no * 10 AS "offset", len(kept)::BIGINT AS n_events, list_sum(list_transform(kept, lambda x: x.n_rows))::BIGINT AS n_rows, true AS can_save_offset FROM k WHERE len(kept) > 0""")
def consume_v0(spark, d):
    return accept.consume(parts(spark, d).withColumn("version", F.lit(0).cast("long"))).drop("topic", "part_no")


@query(f"""WITH {PARTS}, k AS (SELECT trans_seq_no, epoch, list_filter(events, lambda x: x.event_type IN (23, 24, 25, 30, 31, 32) AND x.n_rows > 0) AS kept FROM e WHERE trans_seq_no % 5 <> 0 OR trans_seq_no <= 800)
SELECT trans_seq_no, epoch, trans_seq_no * 10 + CASE WHEN trans_seq_no % 5 = 0 THEN 2 ELSE 0 END AS "offset", len(kept)::BIGINT AS n_events, list_sum(list_transform(kept, lambda x: x.n_rows))::BIGINT AS n_rows, true AS can_save_offset FROM k WHERE len(kept) > 0""")
def consume_switch(spark, d):
    """Messages of version 1 up to 800, of version 0 from there on: splits are rejected then, and what was taken is not taken again."""
    return accept.consume(parts(spark, d).withColumn("version", F.when(F.col("trans_seq_no") <= 800, 1).otherwise(0).cast("long"))).drop("topic", "part_no")


@query(f'WITH {PKG} SELECT "offset", true AS accepted, true AS can_save_offset FROM pkg')
def consumer_nontransactional(spark, d):
    return accept.accept(pkg(spark, d), "v1", transactional=False).select("offset", "accepted", "can_save_offset")


# ---- streams


def streamed(df, to_files):
    """A table as a stream of few batches, into files that are read again."""
    folder = f"{shared_dir(df.sparkSession).rstrip('/')}/tidelog-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/in")
    stream = df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1000).parquet(f"{folder}/in")
    return to_files(stream, f"{folder}/out", f"{folder}/checkpoint")


@query(f'WITH {PKG} SELECT "offset", trans_seq_no, row_number() OVER (PARTITION BY trans_seq_no, seq_no ORDER BY "offset") = 1 AS accepted FROM pkg')
def stream_accept(spark, d):
    from ..streaming.stateful import accept_to_files

    return streamed(pkg(spark, d), accept_to_files).select("offset", "trans_seq_no", "accepted")


@query(f"WITH {EV}, s AS (SELECT *, dense_rank() OVER (ORDER BY truth) AS group_no FROM ({change_log.MESSY.format(ev='ev')})) SELECT order_key, group_no, row_number() OVER (PARTITION BY group_no ORDER BY order_key DESC) = 1 AS ends FROM s")
def stream_segment(spark, d):
    from ..operators.segment import boundary_class
    from ..streaming.stateful import segment_to_files
    from .catalog import messy

    e = messy(spark, d).select(F.lit("a").alias("source"), "order_key", boundary_class(F.col("event_type"), F.col("statement")).alias("boundary"))
    return streamed(e, segment_to_files).select("order_key", "group_no", "ends")


# ---- state and recovery


@query(f"WITH {PKG} SELECT 0::BIGINT AS set_id, concat('{change_log.SOURCE_UUID}:', string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE concat(lo, '-', hi) END, ':' ORDER BY lo)) AS gtid_text FROM (SELECT min(trans_seq_no) AS lo, max(trans_seq_no) AS hi FROM (SELECT trans_seq_no, trans_seq_no - row_number() OVER (ORDER BY trans_seq_no) AS g FROM (SELECT DISTINCT trans_seq_no FROM pkg WHERE trans_seq_no % 4 <> 0 AND gtid <> '' UNION SELECT unnest(range(4, 41)))) GROUP BY g)")
def checkpoint_set(spark, d):
    before = spark.createDataFrame([(0, change_log.SOURCE_UUID, 4, 40)], "set_id long, uuid string, lo long, hi long")
    return accept.checkpoint_set(pkg(spark, d).withColumn("split_flag", F.when(F.col("trans_seq_no") % 4 == 0, 1).otherwise(0)), before)


@query(f'WITH {PKG}, t AS (SELECT trans_seq_no * 137 AS at_ms, "offset" FROM pkg WHERE seq_no = 0 AND "offset" % 2 = 0 AND trans_seq_no % 300 < 100), l AS (SELECT at_ms // 1000 AS tick, max("offset") AS "offset" FROM t GROUP BY 1) SELECT (tick + 1) * 1000 AS saved_at, "offset" FROM l')
def checkpoint_ticks(spark, d):
    p = pkg(spark, d).filter("offset % 2 = 0 and trans_seq_no % 300 < 100").select((F.col("trans_seq_no") * 137).alias("at"), "offset")
    return accept.due(p, 1000).select("saved_at", "offset")


@query(f"WITH {EV} SELECT trans_seq_no, trans_seq_no - 1 AS waits_for, trans_seq_no - 1 < 1300 AS ready FROM ev WHERE event_type = 2 AND statement <> 'BEGIN'")
def ddl_waits(spark, d):
    """All transactions but number 1,300 are acknowledged."""
    ddl = ev(spark, d).filter("event_type = 2 and statement <> 'BEGIN'").select("trans_seq_no")
    return accept.may_run(ddl, trx(spark, d).filter("trans_seq_no <> 1300").select("trans_seq_no"))


@query(f"WITH {PKG} SELECT max(trans_seq_no) FILTER (trans_seq_no % 4 <> 0) AS seq_no, max(\"offset\") FILTER (trans_seq_no % 4 <> 0) AS \"offset\", max(epoch) AS epoch FROM pkg")
def checkpoint_saved(spark, d):
    """Saved as a new version twice, and read again."""
    path = f"{shared_dir(spark).rstrip('/')}/tidelog-{uuid.uuid4().hex}"
    s = accept.checkpoint(pkg(spark, d).withColumn("split_flag", F.when(F.col("trans_seq_no") % 4 == 0, 1).otherwise(0)))
    sinks.save_state(s.limit(0), path)
    sinks.save_state(s, path)
    return sinks.load_state(spark, path).select("seq_no", "offset", "epoch")


@query(f"""WITH {PKG} SELECT "offset", concat('{{"flag":"0","timestamp":"', ts, '","topic":"t","offset":"', "offset", '","gtid":"', gtid, '","epoch":"', epoch, '","seq_no":"', trans_seq_no, '"}}') AS state FROM pkg""")
def checkpoint_json(spark, d):
    return sinks.state_json(pkg(spark, d).withColumns({"flag": F.lit(0), "timestamp": F.col("ts")}).withColumn("key", F.col("offset"))).select(F.col("key").alias("offset"), "state")


@query("SELECT concat('/node/', o_custkey) AS path, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS value FROM orders GROUP BY o_custkey")
def state_latest(spark, d):
    o = read(spark, d, "orders").select(F.concat(F.lit("/node/"), F.col("o_custkey").cast("string")).alias("path"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("value"))
    return state.latest(o)


@query("SELECT DISTINCT o_custkey::VARCHAR AS child FROM orders WHERE o_custkey % 7 = 3")
def state_children(spark, d):
    o = read(spark, d, "orders").select(F.concat_ws("/", F.lit(""), (F.col("o_custkey") % 7).cast("string"), F.col("o_custkey").cast("string"), F.lit("x")).alias("path"))
    return state.children(o, "/3")


@query("SELECT concat('/n/', o_custkey) AS parent, concat('member', lpad((min(o_orderkey))::VARCHAR, 10, '0')) AS child FROM orders GROUP BY o_custkey")
def leader(spark, d):
    o = read(spark, d, "orders").select(F.concat(F.lit("/n/"), F.col("o_custkey").cast("string")).alias("parent"), F.concat(F.lit("member"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("child"))
    return metrics.leader(o)


@query(f"SELECT conv_id, turn, 'v' || turn AS value FROM conversations WHERE turn IS NOT NULL")
def options(spark, d):
    """Options from a text of lines, one text a row; remarks and blank lines are passed over, the last of a key wins."""
    c = read(spark, d, "conversations").filter("turn is not null").select("conv_id", "turn", F.concat(F.lit("# x\nKey = old\n\n;y\nkey="), F.lit("v"), F.col("turn").cast("string")).alias("text"))
    return config.options(c, "text").filter("key = 'key'").select("conv_id", "turn", "value")


# ---- id sets


@query(f"WITH {MERGED} SELECT set_id, uuid, lo, hi FROM merged UNION ALL SELECT 999, 'zz', 5, 7")
def gtid_add(spark, d):
    more = spark.createDataFrame([(999, "zz", 5, 5), (999, "zz", 6, 7), (999, "zz", 6, 6)], "set_id long, uuid string, lo long, hi long")
    return gtid.add(ids(spark, d), more)


@query(f"WITH {TRX} SELECT '{change_log.SOURCE_UUID}' AS uuid, min(trans_seq_no) AS lo, max(trans_seq_no) AS hi FROM (SELECT trans_seq_no, trans_seq_no - row_number() OVER (ORDER BY trans_seq_no) AS g FROM trx WHERE gtid <> '' AND trans_seq_no % 97 <> 0) GROUP BY g")
def gtid_boundary(spark, d):
    return gtid.at_boundary(trx(spark, d).filter("trans_seq_no % 97 <> 0")).select("uuid", "lo", "hi")


@query(f"WITH {TRX} SELECT trans_seq_no, CASE WHEN gtid = '' THEN '' WHEN trans_seq_no % 2 = 0 THEN '7' ELSE '{change_log.SOURCE_UUID}' END AS uuid, CASE WHEN gtid = '' THEN NULL ELSE trans_seq_no END AS number FROM trx")
def gtid_split(spark, d):
    text = F.when(F.col("gtid") == "", "").when(F.col("trans_seq_no") % 2 == 0, F.concat(F.lit("0-7-"), F.col("trans_seq_no").cast("string"))).otherwise(F.col("gtid"))
    u, n = gtid.split_id(text)
    return trx(spark, d).select("trans_seq_no", u.alias("uuid"), n.alias("number"))


LE = "array_to_string(list_transform(range(8), lambda i: lpad(lower(to_hex(({v} // (256 ** i)::HUGEINT) % 256)), 2, '0')), '')"
ONE_UUID = change_log.SOURCE_UUID.replace("-", "")


@query(f"WITH {IDS}, x AS (SELECT set_id, lo FROM ids WHERE uuid = 'aaaa-01' AND lo % 2 = 0), g AS (SELECT DISTINCT set_id, lo FROM x), t AS (SELECT set_id, count(*) AS n, string_agg({LE.format(v='lo')} || {LE.format(v='(lo + 1)')}, '' ORDER BY lo) AS b FROM g GROUP BY set_id) SELECT set_id, {LE.format(v='1')} || '{ONE_UUID}' || {LE.format(v='n')} || b AS data FROM t")
def gtid_binary(spark, d):
    i = ids(spark, d).filter("uuid = 'aaaa-01' and lo % 2 = 0").select("set_id", F.lit(change_log.SOURCE_UUID).alias("uuid"), "lo", F.col("lo").alias("hi"))
    return gtid.binary(gtid.merge(i)).select("set_id", F.lower(F.hex("data")).alias("data"))


# ---- the checker's report

JSON_PKG = "concat('{{\"GTID\":\"', {p}.gtid, '\",\"begin_offset\":\"', {p}.begin_offset, '\",\"end_offset\":\"', {p}.end_offset, '\",\"epoch\":\"', {p}.epoch, '\",\"trans_seqno\":\"', {p}.trans_seq_no, '\"}}')"


@query(f"""WITH {TRX}, log AS ({change_log.RESTARTED.format(trx='trx')}), p AS (SELECT trans_seq_no, gtid, epoch, trans_seq_no - 1 AS begin_offset, trans_seq_no + 2 AS end_offset FROM log), c AS ({CONTINUITY}), b AS (SELECT DISTINCT trans_seq_no * 10 AS trans_seq_no FROM ({EVENT_BREAKS})),
  t AS (SELECT string_agg(concat('{{"next":', {JSON_PKG.format(p='n')}, ',"pre":', {JSON_PKG.format(p='o')}, '}}'), ',' ORDER BY c.trans_seq_no) AS l, count(*) AS k FROM c JOIN p n ON n.trans_seq_no = c.trans_seq_no JOIN p o ON o.trans_seq_no = c.prev_seq), e AS (SELECT string_agg({JSON_PKG.format(p='p')}, ',' ORDER BY p.trans_seq_no) AS l, count(*) AS k FROM b JOIN p ON p.trans_seq_no = b.trans_seq_no)
SELECT concat('{{"broken_count":"', t.k + e.k, '","event_miss":[', e.l, '],"start_offset":"', (SELECT min(begin_offset) FROM p), '","stop_offset":"', (SELECT max(end_offset) FROM p), '","trans_miss":[', t.l, ']}}') AS report FROM t, e""")
def checker_report(spark, d):
    log = restarted(spark, d)
    packages = log.select("trans_seq_no", "gtid", "epoch", (F.col("trans_seq_no") - 1).alias("begin_offset"), (F.col("trans_seq_no") + 2).alias("end_offset"))
    broken = continuity_event(spark, d).withColumn("trans_seq_no", F.col("trans_seq_no") * 10)
    return continuity.full_report(continuity.transaction_breaks(log), broken, packages)


# ---- packages


@query(f"WITH {TRX} SELECT floor((place - 1) / 20)::BIGINT AS batch, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM (SELECT bytes, row_number() OVER (ORDER BY trans_seq_no) AS place FROM trx WHERE trans_seq_no % 3 <> 0) GROUP BY 1")
def pop_batches(spark, d):
    return metrics.batch_sizes(trx(spark, d).filter("trans_seq_no % 3 <> 0"), 20)


@query(f"""WITH {EV} SELECT trans_seq_no, concat('{{"gtid":"', max(gtid), '","events":[', string_agg(concat('{{"event_type":', event_type, ',"database_name":"', database_name, '","table_name":"', table_name, '","position":', position, ',"next_position":', next_position, '}}'), ',' ORDER BY ev_idx), ']}}') AS record FROM ev GROUP BY trans_seq_no""")
def transaction_records(spark, d):
    return package.records(ev(spark, d)).select("trans_seq_no", "record")


@query(f"""WITH {EV} SELECT trans_seq_no, max(gtid) AS gtid, count(*) AS n_events, 1000::BIGINT AS position, (max(next_position) - min(position) + 1000)::BIGINT AS next_position, concat('9.', trans_seq_no, '.0') AS message_id FROM ev WHERE event_type <> 4 GROUP BY trans_seq_no""")
def generate_packages(spark, d):
    """From JSON transactions: read, moved to a place, and put into packages of an epoch."""
    made = package.generated(package.records(ev(spark, d).filter("event_type <> 4")), epoch=9, start=1000)
    return made.select("trans_seq_no", "gtid", F.size("events").cast("long").alias("n_events"), "position", "next_position", "message_id")


@query(f"WITH {EV} SELECT trans_seq_no, ev_idx FROM ev WHERE (ev_idx < 1 OR ev_idx >= 3)")
def erase_ranges(spark, d):
    e = ev(spark, d).groupBy("trans_seq_no").agg(F.sort_array(F.collect_list("ev_idx")).alias("e"))
    from ..functions import scalar as S

    return e.select("trans_seq_no", F.explode(S.without_range(F.col("e"), 1, 3)).alias("ev_idx"))


# ---- schema changes

STATUS = "(SELECT concat(CASE o_orderkey % 6 WHEN 0 THEN 'Com_create_table' WHEN 1 THEN 'Com_alter_table' WHEN 2 THEN 'Com_drop_index' WHEN 3 THEN 'Com_rename_table' WHEN 4 THEN 'Com_insert' ELSE 'Comxcreate_x' END) AS name, o_custkey::BIGINT AS value FROM orders)"


@query(f"SELECT sum(value)::BIGINT AS total FROM {STATUS} WHERE name IN ('Com_create_table', 'Com_alter_table', 'Com_drop_index', 'Com_rename_table')")
def ddl_counters(spark, d):
    k = F.col("o_orderkey") % 6
    name = F.when(k == 0, "Com_create_table").when(k == 1, "Com_alter_table").when(k == 2, "Com_drop_index").when(k == 3, "Com_rename_table").when(k == 4, "Com_insert").otherwise("Comxcreate_x")
    return schema_store.ddl_counters(read(spark, d, "orders").select(name.alias("name"), F.col("o_custkey").alias("value")))


@query(f"WITH {EV} SELECT DISTINCT database_name AS db_name FROM ev WHERE lower(database_name) NOT IN ('sys', 'information_schema', 'mysql', 'performance_schema')")
def databases_to_drop(spark, d):
    return schema_store.to_drop(ev(spark, d).select(F.col("database_name").alias("db_name")))


@query("SELECT count(*) AS size, count(*) = 0 AS empty FROM part WHERE p_size > 10")
def store_size(spark, d):
    return schema_store.is_empty(read(spark, d, "part").filter("p_size > 10"))


@query("SELECT 'db1' AS db_name, concat('t', p_size) AS table_name, 1::BIGINT AS version, 1::BIGINT AS status, 5::BIGINT AS valid_from FROM part GROUP BY p_size")
def store_bootstrap(spark, d):
    empty = spark.createDataFrame([], "db_name string, table_name string, version long, status long, valid_from long")
    return schema_store.first_versions(empty, catalog(spark, d), 5)


@query("WITH s AS (SELECT p_brand AS db_name, p_size % 5 AS t, count(*) AS version FROM part GROUP BY ALL), n AS (SELECT db_name, t FROM s WHERE t IN (1, 2)) SELECT db_name, concat('t', t) AS table_name, version, CASE WHEN t IN (1, 2) THEN 0 ELSE 1 END::BIGINT AS status FROM s UNION ALL SELECT db_name, concat('t', t), version + 1, 1 FROM s WHERE t IN (1, 2) UNION ALL SELECT 'new', 'x', 1, 1")
def store_new_versions(spark, d):
    s = read(spark, d, "part").groupBy(F.col("p_brand").alias("db_name"), (F.col("p_size") % 5).alias("t")).agg(F.count(F.lit(1)).alias("version"))
    s = s.select("db_name", F.concat(F.lit("t"), F.col("t").cast("string")).alias("table_name"), F.lit("{}").alias("schema_value"), "version", F.lit(1).cast("long").alias("status"), F.lit(0).cast("long").alias("valid_from"))
    new = s.filter("table_name in ('t1', 't2')").select("db_name", "table_name", F.lit("{1}").alias("schema_value"), F.lit(9).cast("long").alias("valid_from"))
    new = new.unionByName(spark.createDataFrame([("new", "x", "{1}", 9)], "db_name string, table_name string, schema_value string, valid_from long"))
    return schema_store.close_old(s, new).select("db_name", "table_name", "version", "status")


@query(f"WITH {EV} SELECT trans_seq_no, CASE WHEN trans_seq_no % 3 = 0 THEN NULL ELSE concat('USE `', database_name, '`') END AS use_database FROM ev WHERE event_type = 2")
def ddl_database(spark, d):
    e = ev(spark, d).filter("event_type = 2").withColumn("ddl", F.when(F.col("trans_seq_no") % 3 == 0, " create database x").otherwise("ALTER TABLE t ADD a INT"))
    return e.select("trans_seq_no", schema_store.needs_database(F.col("ddl"), F.col("database_name")).alias("use_database"))


@query(f"WITH {EV} SELECT trans_seq_no FROM ev WHERE event_type = 2 AND statement <> 'BEGIN' AND trans_seq_no % 1001 <> 0 AND lower(database_name) NOT IN ('sys', 'mysql') AND NOT regexp_matches(statement, '^# note')")
def ddl_gate(spark, d):
    from ..functions import scalar as S

    e = ev(spark, d).filter("event_type = 2 and trans_seq_no % 1001 <> 0 and statement not like '# note%'").withColumn("ddl", S.normalise_ddl(F.col("statement")))
    return schema_store.applicable(e).select("trans_seq_no")


@query(f"WITH {EV} SELECT r.trans_seq_no, ev_idx, 1::BIGINT AS version FROM ev r WHERE event_type IN (30, 31, 32) AND database_name = 'shop'")
def schema_single(spark, d):
    s = spark.createDataFrame([("shop", "orders", 1, 1), ("shop", "lineitem", 1, 1), ("shop", "lineitem", 0, 0)], "db_name string, table_name string, version long, status long")
    rows = ev(spark, d).filter("event_type in (30, 31, 32) and database_name = 'shop'")
    return schema_store.single(schema_store.lookup(rows, s)).select("trans_seq_no", "ev_idx", "version")


@query(f"WITH {EV}, n AS (SELECT o_custkey % 50 AS t, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS i FROM orders) SELECT t, concat('id INT', CASE WHEN n >= 2 THEN concat(',', (SELECT string_agg(concat('c', x, ' BIGINT'), ',' ORDER BY x) FROM (SELECT unnest(range(2, n + 1)) AS x) WHERE x % 3 <> 0)) ELSE '' END) AS columns FROM (SELECT t, least(count(*), 8)::BIGINT AS n FROM n GROUP BY t)")
def ddl_applied(spark, d):
    """Statements of 50 tables in the order of orders: each adds a column, and every third is dropped again."""
    k, t = F.col("o_orderkey"), (F.col("o_custkey") % 50).alias("t")
    o = read(spark, d, "orders").select(t, k.alias("k"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = min(len(pdf), 8)
        changes = [("g1", "d", "CREATE TABLE t (id INT, PRIMARY KEY (id))")]
        for i in range(2, n + 1):
            changes.append((f"g{i}", "d", f"ALTER TABLE t ADD COLUMN c{i} BIGINT"))
            if i % 3 == 0:
                changes.append((f"h{i}", "d", f"ALTER TABLE t DROP COLUMN c{i}, ADD INDEX x (id)"))
        tables, failed = schema_store.applied({}, [*changes, changes[-1], ("bad", "d", "ALTER TABLE t DROP q")], set())
        assert failed and failed[0][0] == "bad"
        return pd.DataFrame({"t": [pdf.t.iloc[0]], "columns": [",".join(f"{n} {y}" for n, y in tables["d", "t"])]})

    return o.groupBy("t").applyInPandas(run, "t long, columns string")


# ---- metrics


@query(f"WITH {EV}, m AS (SELECT file_no AS tick, count(*) AS event_count, sum(n_rows)::BIGINT AS row_count, sum(size)::BIGINT AS byte_count, count(*) FILTER (event_type = 33) AS transaction_count, count(*) FILTER (event_type = 2 AND statement <> 'BEGIN') AS ddl_count, count(*) FILTER (event_type = 30) AS insert_count, count(*) FILTER (event_type = 31) AS update_count, count(*) FILTER (event_type = 32) AS delete_count, count(*) FILTER (event_type = 4) AS rotate_count FROM ev GROUP BY 1) UNPIVOT m ON COLUMNS(* EXCLUDE tick) INTO NAME metric_name VALUE value")
def metrics_report(spark, d):
    return metrics.report(ev(spark, d), F.col("file_no"))


@query(f"WITH {TICKS}, l AS (SELECT metric_name, list(sample ORDER BY sample) AS s FROM ticks GROUP BY 1) SELECT metric_name, unnest(list_reduce(list_transform(s, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[len(a)] >= 25 THEN list_append(a, x[1]) ELSE a END)) AS at FROM l")
def report_due(spark, d):
    return metrics.due(ticks(spark, d).select("metric_name", F.col("sample").alias("at")), 25)


@query(f"WITH {TICKS}, r AS (SELECT sample, length(metric_name) + 20 AS size, sum(length(metric_name) + 20) OVER (ORDER BY sample) AS bytes FROM ticks) SELECT sample, ((bytes - size) // 4096)::BIGINT AS file FROM r")
def metric_files(spark, d):
    lines = stored(ticks(spark, d).select("sample", (F.length("metric_name") + 20).alias("size")))
    return sinks.rolling(lines, "sample", F.col("size"), 4096).select("sample", "file")


@query("SELECT o_orderkey AS file, o_orderkey * 60 AS last_ts FROM orders WHERE o_orderkey * 60 < 900000 - 864000")
def expired_files(spark, d):
    return sinks.expired(read(spark, d, "orders").select(F.col("o_orderkey").alias("file"), (F.col("o_orderkey") * 60).alias("last_ts")), F.lit(900000), 864000)


@query(f"""WITH {EV}, f AS (SELECT trans_seq_no, arg_min(database_name, ev_idx) AS db, arg_min(table_name, ev_idx) AS t, count(DISTINCT concat(database_name, '.', table_name)) AS k FROM ev WHERE event_type IN (30, 31, 32) GROUP BY 1), p AS (SELECT trans_seq_no, max(gtid) AS gtid, arg_min(file_no, ev_idx) AS file_no, arg_min(position, ev_idx) AS a, arg_max(next_position, ev_idx) AS z FROM ev GROUP BY 1)
SELECT f.trans_seq_no, concat('GTID:', gtid, ' Binlog:', file_no, ':', a, '~', z, ' Len:', z - a, ' DB:', db, ' Table:', t, CASE WHEN k > 1 THEN ' ...' ELSE '' END) AS alarm FROM f JOIN p ON f.trans_seq_no = p.trans_seq_no""")
def truncation_alarm(spark, d):
    return metrics.truncation_alarm(ev(spark, d))


@query("SELECT s_suppkey AS topic_no, s_suppkey % 4 AS thread FROM supplier")
def topic_threads(spark, d):
    return metrics.assigned(read(spark, d, "supplier").select(F.col("s_suppkey").alias("topic_no")), 4)


@query("SELECT event_id, 0::BIGINT AS wait_ms FROM events")
def rate_limit(spark, d):
    """Events of a source in the order of time, far below the rate: none waits."""
    e = read(spark, d, "events").select((F.col("user_id") % 5).alias("source"), "event_id", (F.unix_millis(F.col("ts").cast("timestamp"))).alias("at"), F.lit(10).cast("long").alias("size"))
    return accept.limited(e, rate=10**9).select("event_id", F.col("wait_ms"))


@query("WITH l AS (SELECT user_id AS name, (SELECT max(event_id) FROM events) - max(event_id) AS silence FROM events GROUP BY 1) SELECT name, silence, CASE WHEN silence >= 50 THEN 'gone' WHEN silence >= 20 THEN 'safe' ELSE 'live' END AS mode FROM l")
def liveness(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("name"), F.col("event_id").alias("at"))
    return metrics.liveness(e, F.lit(e.agg(F.max("at")).first()[0]), 50)
