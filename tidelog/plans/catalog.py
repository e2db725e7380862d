"""A query for each operator over the derived change log, with SQL of the same meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.stored import stored
from ..operators import accept, continuity, decode, filters, gtid, inspect, metrics, package, schema_store, segment
from ..sources import change_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

EV = f"ev AS ({change_log.sql_text('ansi')})"
TRX = f"""{EV}, trx AS (
  SELECT trans_seq_no, max(gtid) AS gtid, max(epoch) AS epoch, arg_min(file_no, ev_idx) AS file_no, arg_min(position, ev_idx) AS position,
    coalesce(max(CASE WHEN event_type = 4 THEN file_no + 1 END), arg_max(file_no, ev_idx)) AS next_file_no,
    CASE WHEN max(CASE WHEN event_type = 4 THEN 1 ELSE 0 END) = 1 THEN 4::BIGINT ELSE arg_max(next_position, ev_idx) END AS next_position,
    count(*) AS n_events, sum(n_rows)::BIGINT AS n_rows, sum(size)::BIGINT AS bytes, max(ts) AS ts FROM ev GROUP BY trans_seq_no)"""
LOSSY = f"{TRX}, lossy AS (SELECT * FROM trx WHERE trans_seq_no % 997 <> 0)"
PKG = f"{TRX}, pkg AS (SELECT *, trans_seq_no * 2 AS \"offset\", 0::BIGINT AS seq_no, 0::BIGINT AS split_flag FROM trx UNION ALL SELECT *, trans_seq_no * 2 + 1, 0, 0 FROM trx WHERE trans_seq_no % 503 = 0)"
IDS = "ids AS (SELECT CAST(o_custkey % 20 AS BIGINT) AS set_id, CASE WHEN o_orderkey % 3 = 0 THEN 'aaaa-01' ELSE 'bbbb-02' END AS uuid, CAST(o_orderkey AS BIGINT) AS lo, CAST(o_orderkey + o_custkey % 4 AS BIGINT) AS hi FROM orders)"
POLLS = "polls AS (SELECT event_id AS poll_id, epoch(date_trunc('second', ts))::BIGINT AS poll_ts, user_id % 3 AS server_id, event_type <> 'error' AS healthy, event_id - user_id % 7 AS executed_to FROM events)"
TICKS = "ticks AS (SELECT event_type AS metric_name, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS tick, event_id AS sample, CAST(floor(value) AS BIGINT) AS value FROM events)"
DOCS = "payload AS (SELECT doc_id + 1 AS trans_seq_no, n_chars AS bytes, CAST(floor(n_chars * 3 / 4) AS BIGINT) AS row_bytes FROM documents)"


def query(sql: str | None = None):
    """Register a function by its name, and the SQL it must agree with."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ev = change_log.events


def trx(spark: SparkSession, d: str) -> DataFrame:
    return continuity.summaries(ev(spark, d), change_log.tasks_of(spark, d))


def pkg(spark: SparkSession, d: str) -> DataFrame:
    t = trx(spark, d).withColumns({"topic": F.lit("t"), "part_no": F.lit(0).cast("long"), "seq_no": F.lit(0).cast("long"), "split_flag": F.lit(0).cast("long")})
    again = t.filter("trans_seq_no % 503 = 0").withColumn("offset", F.col("trans_seq_no") * 2 + 1)
    return t.withColumn("offset", F.col("trans_seq_no") * 2).unionByName(again)


def ids(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    return o.select((F.col("o_custkey") % 20).alias("set_id"), F.when(F.col("o_orderkey") % 3 == 0, "aaaa-01").otherwise("bbbb-02").alias("uuid"), F.col("o_orderkey").alias("lo"), (F.col("o_orderkey") + F.col("o_custkey") % 4).alias("hi"))


def polls(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_id").alias("poll_id"), F.unix_timestamp("ts").alias("poll_ts"), (F.col("user_id") % 3).alias("server_id"), (F.col("event_type") != "error").alias("healthy"), (F.col("event_id") - F.col("user_id") % 7).alias("executed_to"))


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_type").alias("metric_name"), F.floor(F.unix_timestamp("ts") / 3600).alias("tick"), F.col("event_id").alias("sample"), F.floor("value").alias("value"))


def payload(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select((F.col("doc_id") + 1).alias("trans_seq_no"), F.col("n_chars").alias("bytes"), F.floor(F.col("n_chars") * 3 / 4).alias("row_bytes"))


# ---- places, summaries, continuity


@query(f"WITH {EV} SELECT trans_seq_no, ev_idx, event_type, file_no, position, next_position FROM ev")
def event_positions(spark, d):
    return ev(spark, d).select("trans_seq_no", "ev_idx", "event_type", "file_no", "position", "next_position")


@query(f"WITH {TRX} SELECT * FROM trx")
def trx_summary(spark, d):
    return trx(spark, d)


CONTINUITY = f"""WITH {TRX}, log AS ({change_log.RESTARTED.format(trx="trx")}), one AS (
  SELECT list({{'k': trans_seq_no, 'gtid': gtid, 'epoch': epoch, 'f': file_no, 'p': position, 'nf': next_file_no, 'np': next_position, 'breaks': []::STRUCT(trans_seq_no BIGINT, gtid VARCHAR, file_no BIGINT, "position" BIGINT, prev_seq BIGINT, prev_file_no BIGINT, prev_position BIGINT)[]}} ORDER BY trans_seq_no) AS l FROM log)
SELECT unnest(list_reduce(l, lambda a, x: CASE WHEN x.f = a.nf AND x.p = a.np THEN {{'k': x.k, 'gtid': x.gtid, 'epoch': x.epoch, 'f': x.f, 'p': x.p, 'nf': x.nf, 'np': x.np, 'breaks': a.breaks}} WHEN a.epoch < x.epoch AND x.gtid = '' THEN a
  ELSE {{'k': x.k, 'gtid': x.gtid, 'epoch': x.epoch, 'f': x.f, 'p': x.p, 'nf': x.nf, 'np': x.np, 'breaks': list_append(a.breaks, {{'trans_seq_no': x.k, 'gtid': x.gtid, 'file_no': x.f, 'position': x.p, 'prev_seq': a.k, 'prev_file_no': a.nf, 'prev_position': a.np}})}} END).breaks, recursive := true) FROM one"""


def restarted(spark, d):
    return stored(spark.sql(change_log.RESTARTED, trx=stored(trx(spark, d))))


@query(CONTINUITY)
def continuity_trx(spark, d):
    return continuity.transaction_breaks(restarted(spark, d))


EVENT_BREAKS = f"""WITH {EV}, l AS (SELECT *, lead(position) OVER w AS after, lead(file_no) OVER w AS after_file FROM ev WHERE (trans_seq_no * 7 + ev_idx) % 911 <> 0 WINDOW w AS (PARTITION BY trans_seq_no ORDER BY ev_idx))
SELECT trans_seq_no, ev_idx, next_position, after FROM l WHERE after_file = file_no AND after <> next_position"""


@query(EVENT_BREAKS)
def continuity_event(spark, d):
    lossy = ev(spark, d).select("trans_seq_no", "ev_idx", "file_no", "position", "next_position").filter("(trans_seq_no * 7 + ev_idx) % 911 <> 0")
    return continuity.event_breaks(lossy, change_log.tasks_of(spark, d))


@query(f"SELECT 'event' AS error, count(*) AS broken_count FROM ({EVENT_BREAKS}) UNION ALL SELECT 'transaction', count(*) FROM ({CONTINUITY})")
def broken_points_summary(spark, d):
    return continuity.broken_counts(continuity_event(spark, d), continuity_trx(spark, d))


@query(f"WITH {LOSSY} SELECT trans_seq_no, trans_seq_no * 3 AS end_offset, coalesce(lag(trans_seq_no * 3) OVER (ORDER BY trans_seq_no) + 1, trans_seq_no * 3) AS begin_offset FROM lossy")
def offset_ranges(spark, d):
    return continuity.offset_ranges(stored(trx(spark, d).filter("trans_seq_no % 997 <> 0").select("trans_seq_no", (F.col("trans_seq_no") * 3).alias("end_offset"))))


@query(f"WITH {TRX} SELECT trans_seq_no, file_no FROM trx WHERE position = 4")
def file_switches(spark, d):
    return continuity.file_switches(trx(spark, d))


@query(f"""SELECT trans_seq_no, concat('{{"gtid":"', gtid, '","position":"', position, '","prev_position":"', prev_position, '","trans_seqno":"', trans_seq_no, '"}}') AS report FROM ({CONTINUITY})""")
def checker_json(spark, d):
    return continuity.report(continuity_trx(spark, d))


@query(f"WITH {EV} SELECT trans_seq_no, concat(max(gtid), ',', string_agg(concat(event_type, ',', database_name, ',', table_name, ',', position), ',' ORDER BY ev_idx)) AS line FROM ev GROUP BY trans_seq_no")
def csv_rows(spark, d):
    return continuity.csv_lines(ev(spark, d))


# ---- boundaries

CLASS = """CASE WHEN event_type IN (33, 34) THEN 'GTID' WHEN event_type = 2 AND statement = 'BEGIN' THEN 'BEGIN_TRX' WHEN event_type = 2 AND statement = 'COMMIT' THEN 'END_TRX' WHEN event_type = 2 THEN 'STATEMENT'
  WHEN event_type IN (16, 38) THEN 'END_TRX' WHEN event_type IN (19, 30, 31, 32) THEN 'STATEMENT' WHEN event_type IN (4, 15, 27, 35) THEN 'IGNORE' ELSE 'ERROR' END"""


@query(f"WITH {EV} SELECT trans_seq_no, ev_idx, {CLASS} AS boundary FROM ev")
def boundary_classify(spark, d):
    return ev(spark, d).select("trans_seq_no", "ev_idx", segment.boundary_class(F.col("event_type"), F.col("statement")).alias("boundary"))


MESSY = f"WITH {EV}, s AS (SELECT *, dense_rank() OVER (ORDER BY truth) AS group_no FROM ({change_log.MESSY.format(ev='ev')}))"


def messy(spark, d):
    own = stored(ev(spark, d).select("trans_seq_no", "ev_idx", "event_type", "table_name", "statement", "size"))
    return stored(spark.sql(change_log.MESSY, ev=own))


@query(f"{MESSY} SELECT order_key, group_no FROM s")
def segment_events(spark, d):
    return segment.segment(messy(spark, d)).select("order_key", "group_no")


@query(f"{MESSY} SELECT group_no, min(order_key) AS first_key, count(*) AS n_events, sum(size)::BIGINT AS bytes, max(CASE WHEN event_type = 2 AND regexp_matches(statement, '(?i)alter|create|drop') THEN 1 ELSE 0 END)::BIGINT AS is_ddl FROM s GROUP BY group_no")
def segment_trx(spark, d):
    return segment.groups(segment.segment(messy(spark, d)))


@query(f"WITH {EV}, r AS (SELECT *, sum(size) OVER (PARTITION BY trans_seq_no ORDER BY ev_idx) > 600 AND event_type IN (30, 31, 32) AS truncated FROM ev) SELECT trans_seq_no, ev_idx, truncated, CASE WHEN truncated THEN 0 ELSE n_rows END AS n_rows FROM r")
def truncate_large(spark, d):
    return segment.truncate_large(ev(spark, d), 600).select("trans_seq_no", "ev_idx", "truncated", "n_rows")


# ---- filters

RULES = '{"shop": {"orders": [], "lineitem": ["l_quantity"]}, "crm": {}, "": {"orders": []}}'
INCLUDED = "(database_name NOT IN ('sys', 'information_schema', 'mysql', 'performance_schema') AND CASE WHEN database_name = 'crm' THEN true WHEN database_name = 'shop' THEN table_name IN ('orders', 'lineitem') ELSE table_name = 'orders' END)"


def included():
    return filters.table_included(F.col("database_name"), F.col("table_name"), filters.load_rules(RULES))


@query(f"WITH {EV} SELECT trans_seq_no, ev_idx, database_name, table_name FROM ev WHERE event_type IN (30, 31, 32) AND {INCLUDED}")
def filter_table(spark, d):
    return filters.data_events(ev(spark, d)).filter(included()).select("trans_seq_no", "ev_idx", "database_name", "table_name")


@query(f"WITH {EV} SELECT trans_seq_no, ev_idx, CASE WHEN event_type IN (30, 31, 32) AND NOT {INCLUDED} THEN 0 ELSE n_rows END AS n_rows FROM ev")
def filter_shell(spark, d):
    return filters.shell(ev(spark, d), included()).select("trans_seq_no", "ev_idx", "n_rows")


CELLS = """cells AS (SELECT o_orderkey AS k, 'shop' AS database_name, 'orders' AS table_name, c.column_name, c.column_type, coalesce(c.value, '') AS value, CASE WHEN c.value IS NULL THEN 1 ELSE 0 END::BIGINT AS is_null
  FROM orders, unnest([{'column_name': 'o_orderkey', 'column_type': 'bigint', 'value': CAST(o_orderkey AS VARCHAR)}, {'column_name': 'o_orderstatus', 'column_type': 'char(1)', 'value': o_orderstatus},
    {'column_name': 'o_note', 'column_type': 'text', 'value': CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END}]) t(c))"""


def cells(spark, d):
    o = read(spark, d, "orders").withColumn("o_note", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")))
    flat = decode.flatten(o, ["o_orderkey"], {"o_orderkey": (F.col("o_orderkey"), "bigint"), "o_orderstatus": (F.col("o_orderstatus"), "char(1)"), "o_note": (F.col("o_note"), "text")})
    return flat.withColumnRenamed("o_orderkey", "k").withColumns({"database_name": F.lit("shop"), "table_name": F.lit("orders")})


@query(f"WITH {CELLS} SELECT k, column_name, column_type, value, is_null FROM cells")
def flatten_changes(spark, d):
    return cells(spark, d).select("k", "column_name", "column_type", "value", "is_null")


@query(f"WITH {CELLS} SELECT k, column_name FROM cells WHERE column_name IN ('o_orderkey', 'o_note')")
def filter_column(spark, d):
    rules = {"shop": {"orders": ["o_orderkey", "o_note"]}}
    return cells(spark, d).filter(filters.column_included(F.col("database_name"), F.col("table_name"), F.col("column_name"), rules)).select("k", "column_name")


@query("SELECT p_partkey, p_brand, p_type FROM part WHERE NOT (p_brand LIKE 'Brand#1%' AND p_type LIKE '%') OR (p_brand LIKE 'Brand#1_' AND p_type LIKE 'E%')")
def filter_like(spark, d):
    keep = filters.dump_object_included(F.col("p_brand"), F.col("p_type"), [("Brand#1_", "E%")], [("Brand#1%", "%")])
    return read(spark, d, "part").filter(keep).select("p_partkey", "p_brand", "p_type")


@query(f"WITH {EV} SELECT event_type, count(*) AS n, sum(n_rows)::BIGINT AS n_rows FROM ev WHERE event_type IN (30, 31, 32) GROUP BY event_type")
def data_events(spark, d):
    return filters.data_events(ev(spark, d)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("n_rows"))


@query(f"WITH {EV} SELECT trans_seq_no, ev_idx FROM ev WHERE event_type IN (23, 24, 25, 30, 31, 32) AND n_rows > 0")
def consumer_invalid_filter(spark, d):
    return filters.valid_for_consumers(ev(spark, d)).select("trans_seq_no", "ev_idx")


@query(f"WITH {EV} SELECT trans_seq_no, ev_idx FROM ev WHERE event_type <> 27 AND size <> 0 AND next_position <> 0 AND ts <> 0 AND event_type BETWEEN 1 AND 38")
def forwardable_events(spark, d):
    return filters.forwardable(ev(spark, d)).select("trans_seq_no", "ev_idx")


@query(f"WITH {EV} SELECT trans_seq_no, ev_idx FROM ev WHERE database_name = 'shop' AND table_name = 'orders' AND event_type IN (30, 32)")
def tool_filter(spark, d):
    return filters.tool_filter(ev(spark, d), "shop", "orders", [30, 32]).select("trans_seq_no", "ev_idx")


@query(f"WITH {EV} SELECT trans_seq_no, ev_idx FROM ev WHERE NOT (database_name = 'shop' AND table_name IN ('orders', ''))")
def filter_rules_join(spark, d):
    rules = spark.createDataFrame([("shop", "orders"), ("shop", "")], "database_name string, table_name string")
    return filters.semi_join(ev(spark, d), rules, wanted=False).select("trans_seq_no", "ev_idx")


@query(f"WITH {EV} SELECT database_name, count(*) AS n FROM ev WHERE database_name <> '' AND lower(database_name) NOT IN ('sys', 'information_schema', 'mysql', 'performance_schema') GROUP BY database_name")
def filter_system_schemas(spark, d):
    return ev(spark, d).filter((F.col("database_name") != "") & ~S.is_system_schema(F.col("database_name"))).groupBy("database_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV} SELECT trans_seq_no, ev_idx FROM ev WHERE trans_seq_no > 500")
def start_at_executed(spark, d):
    return filters.not_seen(ev(spark, d), 500).select("trans_seq_no", "ev_idx")


# ---- decoding


@query("""SELECT o_orderkey, CAST(o_orderkey % 128 AS TINYINT)::BIGINT AS tiny, CAST(18446744073709551000 + o_orderkey % 615 AS DECIMAL(20, 0)) AS big, CAST(o_orderdate AS DATE) AS day,
  CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS label, concat_ws(',', CASE WHEN o_orderkey % 2 = 1 THEN 'x' END, CASE WHEN o_orderkey % 4 >= 2 THEN 'y' END) AS members FROM orders""")
def typed_decode(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    text = lambda c: c.cast("string")
    return o.select(
        "o_orderkey", decode.typed(text(k % 128), "tinyint").cast("long").alias("tiny"), decode.typed(text(F.lit("18446744073709551000").cast("decimal(20,0)") + k % 615), "bigint unsigned").alias("big"),
        decode.typed(F.date_format("o_orderdate", "yyyy:MM:dd"), "date").alias("day"), decode.typed(text(k % 3 + 1), "enum('a','b','c')").alias("label"), decode.typed(text(k % 4), "set('x','y')").alias("members"),
    )


@query("SELECT o_orderkey, (CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 6 = 0 THEN 4 ELSE 0 END)::BIGINT AS bitmap FROM orders")
def null_bitmap(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", decode.null_bitmap([F.when(k % 4 != 0, k), k, F.when(k % 6 != 0, k)]).alias("bitmap"))


@query(f"WITH {EV} SELECT trans_seq_no, ev_idx, table_id, database_name AS map_db, table_name AS map_table FROM ev WHERE event_type IN (30, 31, 32)")
def table_map_lookup(spark, d):
    return decode.table_map_lookup(ev(spark, d))


@query(f"WITH {EV}, r AS (SELECT trans_seq_no, ev_idx, CASE event_type WHEN 30 THEN 'insert' WHEN 31 THEN 'update' ELSE 'delete' END AS op, unnest(CASE event_type WHEN 30 THEN ['after'] WHEN 31 THEN ['before', 'after'] ELSE ['before'] END) AS image FROM ev WHERE event_type IN (30, 31, 32)) SELECT * FROM r")
def row_images(spark, d):
    return decode.changes(filters.data_events(ev(spark, d))).select("trans_seq_no", "ev_idx", "op", "image")


@query(f"WITH {EV} SELECT trans_seq_no, ev_idx, CASE event_type WHEN 33 THEN 'GTID' WHEN 2 THEN 'QUERY' WHEN 19 THEN 'TABLE_MAP' WHEN 30 THEN 'WRITE_ROWS' WHEN 31 THEN 'UPDATE_ROWS' WHEN 32 THEN 'DELETE_ROWS' WHEN 16 THEN 'XID' WHEN 4 THEN 'ROTATE' END AS name FROM ev")
def event_names(spark, d):
    return ev(spark, d).select("trans_seq_no", "ev_idx", S.event_name(F.col("event_type")).alias("name"))


# ---- schema store

CLEANED = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(statement, '--[^\\n]*', '', 'g'), '^\\s*#[^\\n]*\\n', ''), '/\\*.*?\\*/', ' ', 'gs'), '\\s+', ' ', 'g'))"


def statements(spark, d):
    return ev(spark, d).filter("event_type = 2")


@query(f"WITH {EV} SELECT trans_seq_no, {CLEANED} AS ddl FROM ev WHERE event_type = 2")
def ddl_normalise(spark, d):
    return statements(spark, d).select("trans_seq_no", S.normalise_ddl(F.col("statement")).alias("ddl"))


@query(f"WITH {EV} SELECT trans_seq_no, regexp_matches(upper({CLEANED}), '^(CREATE|ALTER|DROP|RENAME|TRUNCATE) (DATABASE|SCHEMA|TABLE|INDEX|UNIQUE INDEX)') AS is_ddl FROM ev WHERE event_type = 2")
def ddl_classify(spark, d):
    return statements(spark, d).select("trans_seq_no", S.is_ddl(S.normalise_ddl(F.col("statement"))).alias("is_ddl"))


CHANGES = """chg AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'shop' ELSE 'crm' END AS db_name, CASE WHEN o_orderkey % 3 = 0 THEN 'orders' ELSE 'lineitem' END AS table_name, CAST(o_orderkey + 1 AS BIGINT) AS valid_from, concat('v', o_orderkey) AS schema_value FROM orders),
  ver AS (SELECT *, row_number() OVER w AS version, lead(valid_from) OVER w AS valid_to FROM chg WINDOW w AS (PARTITION BY db_name, table_name ORDER BY valid_from))"""


def versions(spark, d):
    k = F.col("o_orderkey")
    c = read(spark, d, "orders").select(F.when(k % 2 == 0, "shop").otherwise("crm").alias("db_name"), F.when(k % 3 == 0, "orders").otherwise("lineitem").alias("table_name"), (k + 1).alias("valid_from"), F.concat(F.lit("v"), k.cast("string")).alias("schema_value"))
    return schema_store.versions(c)


@query(f"WITH {CHANGES} SELECT db_name, table_name, valid_from, schema_value, version, valid_to, CASE WHEN valid_to IS NULL THEN 1 ELSE 0 END::BIGINT AS status FROM ver")
def schema_scd2(spark, d):
    return versions(spark, d)


@query(f"WITH {EV}, {CHANGES} SELECT trans_seq_no, ev_idx, database_name, r.table_name, version FROM (SELECT * FROM ev WHERE event_type IN (30, 31, 32)) r ASOF JOIN ver ON database_name = db_name AND r.table_name = ver.table_name AND trans_seq_no >= valid_from")
def schema_asof(spark, d):
    return schema_store.as_of(filters.data_events(ev(spark, d)), versions(spark, d)).select("trans_seq_no", "ev_idx", "database_name", "table_name", "version")


@query(f"WITH {EV}, {CHANGES}, cur AS (SELECT db_name, table_name, count(*) AS found, max(version) AS version FROM ver WHERE valid_to IS NULL GROUP BY ALL) SELECT trans_seq_no, ev_idx, coalesce(found, 0) AS found, version FROM ev LEFT JOIN cur ON database_name = db_name AND ev.table_name = cur.table_name WHERE event_type IN (30, 31, 32)")
def schema_lookup(spark, d):
    return schema_store.lookup(filters.data_events(ev(spark, d)), versions(spark, d)).select("trans_seq_no", "ev_idx", "found", "version")


DIFF = """old AS (SELECT p_brand AS db_name, p_type AS table_name, CAST(sum(p_size) AS VARCHAR) AS schema_value FROM part WHERE p_partkey % 3 <> 0 GROUP BY ALL), new AS (SELECT p_brand AS db_name, p_type AS table_name, CAST(sum(p_size) AS VARCHAR) AS schema_value FROM part WHERE p_partkey % 5 <> 0 AND p_size % 2 = 0 GROUP BY ALL)"""


@query(f"WITH {DIFF} SELECT coalesce(new.db_name, old.db_name) AS db_name, coalesce(new.table_name, old.table_name) AS table_name, CASE WHEN new.db_name IS NULL THEN 'dropped' WHEN old.db_name IS NULL THEN 'created' ELSE 'altered' END AS change FROM new FULL JOIN old ON new.db_name = old.db_name AND new.table_name = old.table_name WHERE new.schema_value IS DISTINCT FROM old.schema_value")
def schema_diff(spark, d):
    side = lambda df: df.groupBy(F.col("p_brand").alias("db_name"), F.col("p_type").alias("table_name")).agg(F.sum("p_size").cast("string").alias("schema_value"))
    p = read(spark, d, "part")
    return schema_store.diff(side(p.filter("p_partkey % 3 <> 0")), side(p.filter("p_partkey % 5 <> 0 and p_size % 2 = 0")), drops=True)


CATALOG = "SELECT 'db1' AS db_name, concat('t', p_size) AS table_name, CAST(p_partkey AS BIGINT) AS position, concat('c', p_partkey) AS name, p_type AS type FROM part"


def catalog(spark, d):
    k = F.col("p_partkey")
    return read(spark, d, "part").select(F.lit("db1").alias("db_name"), F.concat(F.lit("t"), F.col("p_size").cast("string")).alias("table_name"), k.alias("position"), F.concat(F.lit("c"), k.cast("string")).alias("name"), F.col("p_type").alias("type"))


@query(f"""SELECT db_name, table_name, concat('{{"columns":[', string_agg(concat('{{"name":"', name, '","type":"', type, '","position":', position, '}}'), ',' ORDER BY position), ']}}') AS schema_value FROM ({CATALOG}) GROUP BY ALL""")
def schema_json(spark, d):
    return schema_store.from_catalog(catalog(spark, d))


@query(CATALOG)
def schema_parse(spark, d):
    return schema_store.parse(schema_store.from_catalog(catalog(spark, d)))


@query(f"WITH {EV} SELECT trans_seq_no, gtid FROM ev WHERE event_type = 2 AND statement <> 'BEGIN' AND trans_seq_no % 3 <> 0")
def ddl_idempotent(spark, d):
    ddl = ev(spark, d).filter("event_type = 2 and statement <> 'BEGIN'").select("trans_seq_no", "gtid")
    return schema_store.pending_ddl(ddl, ev(spark, d).filter("trans_seq_no % 3 = 0").select("gtid"))


# ---- id sets

MERGED = f"""{IDS}, m1 AS (SELECT *, max(hi) OVER (PARTITION BY set_id, uuid ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM ids),
  m2 AS (SELECT *, sum(CASE WHEN far IS NULL OR lo > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY set_id, uuid ORDER BY lo, hi) AS island FROM m1), merged AS (SELECT set_id, uuid, min(lo) AS lo, max(hi) AS hi FROM m2 GROUP BY set_id, uuid, island)"""


@query(f"WITH {MERGED} SELECT * FROM merged")
def gtid_merge(spark, d):
    return gtid.merge(ids(spark, d))


@query(f"WITH {MERGED}, u AS (SELECT set_id, uuid, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE concat(lo, '-', hi) END, ':' ORDER BY lo) AS s FROM merged GROUP BY ALL) SELECT set_id, string_agg(concat(uuid, ':', s), ',' ORDER BY concat(uuid, ':', s)) AS gtid_text FROM u GROUP BY set_id")
def gtid_text(spark, d):
    return gtid.to_text(gtid.merge(ids(spark, d)))


@query(f"WITH {MERGED} SELECT * FROM merged")
def gtid_parse(spark, d):
    return gtid.merge(gtid.parse(gtid_text(spark, d)))


@query(f"WITH {MERGED} SELECT set_id, bool_and(EXISTS (SELECT 1 FROM (SELECT 'aaaa-01' AS uuid, 0 AS lo, 200000000 AS hi UNION ALL SELECT 'bbbb-02', 10, 200000000) o WHERE o.uuid = m.uuid AND m.lo >= o.lo AND m.hi <= o.hi)) AS contained FROM merged m GROUP BY set_id")
def gtid_contains(spark, d):
    outer = spark.createDataFrame([("aaaa-01", 0, 200_000_000), ("bbbb-02", 10, 100_000), ("bbbb-02", 90_000, 200_000_000)], "uuid string, lo long, hi long")
    return gtid.contains(outer, ids(spark, d))


@query("WITH n AS (SELECT DISTINCT o_custkey % 20 AS set_id, 'u' AS uuid, o_orderkey AS v FROM orders WHERE NOT (o_orderkey BETWEEN 100 AND 399 OR o_orderkey BETWEEN 650 AND 5000)), g AS (SELECT *, v - row_number() OVER (PARTITION BY set_id ORDER BY v) AS island FROM n) SELECT set_id, uuid, min(v) AS lo, max(v) AS hi FROM g GROUP BY set_id, uuid, island")
def gtid_subtract(spark, d):
    left = read(spark, d, "orders").select((F.col("o_custkey") % 20).alias("set_id"), F.lit("u").alias("uuid"), F.col("o_orderkey").alias("lo"), F.col("o_orderkey").alias("hi"))
    return gtid.subtract(left, spark.createDataFrame([("u", 100, 250), ("u", 200, 399), ("u", 650, 5000)], "uuid string, lo long, hi long"))


# ---- packages


@query(f"WITH {EV}, u AS (SELECT trans_seq_no FROM ev GROUP BY trans_seq_no HAVING max(CASE WHEN event_type IN (30, 31, 32) AND n_rows > 1 OR (event_type = 2 AND statement <> 'BEGIN') THEN 1 ELSE 0 END) = 1) SELECT trans_seq_no, ev_idx FROM ev WHERE trans_seq_no IN (SELECT trans_seq_no FROM u)")
def clean_trx(spark, d):
    few = ev(spark, d).withColumn("n_rows", F.when(F.col("n_rows") > 1, F.col("n_rows")).otherwise(0))
    return package.clean(few).select("trans_seq_no", "ev_idx")


@query(f"WITH {TRX}, u AS (SELECT trans_seq_no, max(CASE WHEN event_type IN (30, 31, 32) AND n_rows > 1 OR (event_type = 2 AND statement <> 'BEGIN') THEN 1 ELSE 0 END) AS keep FROM ev GROUP BY trans_seq_no) SELECT trx.trans_seq_no, gtid, next_file_no, next_position, (n_events * keep)::BIGINT AS n_events, (bytes * keep)::BIGINT AS bytes FROM trx JOIN u ON trx.trans_seq_no = u.trans_seq_no")
def clean_shells(spark, d):
    few = ev(spark, d).withColumn("n_rows", F.when(F.col("n_rows") > 1, F.col("n_rows")).otherwise(0))
    return package.shells(trx(spark, d), few).select("trans_seq_no", "gtid", "next_file_no", "next_position", "n_events", "bytes")


@query(f"WITH {DOCS} SELECT trans_seq_no, CASE WHEN bytes + 64 <= 2000 THEN 'whole' WHEN bytes - row_bytes + 64 <= 2000 THEN 'no_rows' ELSE 'no_events' END AS sent_as, CASE WHEN bytes + 64 <= 2000 THEN bytes + 64 WHEN bytes - row_bytes + 64 <= 2000 THEN bytes - row_bytes + 64 ELSE 64 END AS sent_bytes FROM payload")
def shrink_ladder(spark, d):
    return package.shrink(payload(spark, d), 2000).select("trans_seq_no", "sent_as", "sent_bytes")


SPLIT = """WITH RECURSIVE items AS (SELECT doc_id + 1 AS trans_seq_no, CAST(floor(n_chars / 10) + 1 AS BIGINT) AS n_rows FROM documents), tree AS (
  SELECT trans_seq_no, 0::BIGINT AS lo, n_rows AS hi FROM items UNION ALL
  SELECT trans_seq_no, CASE WHEN h.half = 0 THEN lo ELSE lo + (hi - lo) // 2 END, CASE WHEN h.half = 0 THEN lo + (hi - lo) // 2 ELSE hi END FROM tree, (VALUES (0), (1)) h(half) WHERE hi - lo > 19)
, leaves AS (SELECT *, row_number() OVER (PARTITION BY trans_seq_no ORDER BY lo) - 1 AS seq_no, count(*) OVER (PARTITION BY trans_seq_no) AS n FROM tree WHERE hi - lo <= 19)
SELECT trans_seq_no, seq_no, lo, hi, CASE WHEN n = 1 THEN 0 WHEN seq_no = n - 1 THEN 2 ELSE 1 END::BIGINT AS split_flag FROM leaves"""


@query(SPLIT)
def split_rows(spark, d):
    items = read(spark, d, "documents").select((F.col("doc_id") + 1).alias("trans_seq_no"), (F.floor(F.col("n_chars") / 10) + 1).alias("n_rows"))
    return package.split_rows(items, 1024, 50)


@query(f"WITH parts AS ({SPLIT}) SELECT 1::BIGINT AS epoch, trans_seq_no, count(*) AS n_parts, sum(hi - lo)::BIGINT AS n_rows FROM parts WHERE trans_seq_no % 5 <> 0 GROUP BY trans_seq_no")
def reassemble(spark, d):
    p = split_rows(spark, d).filter("not (trans_seq_no % 5 = 0 and split_flag <> 1)").select(F.lit(1).cast("long").alias("epoch"), "trans_seq_no", "seq_no", "split_flag", (F.col("hi") - F.col("lo")).alias("n_rows"))
    return package.reassemble(p)


SIZED = f"""{EV}, sized AS (SELECT trans_seq_no, list({{'i': ev_idx, 'b': 19::BIGINT, 'r': list_transform(range(n_rows), lambda j: (20 + (trans_seq_no * 7 + j * 13) % 90)::BIGINT)}} ORDER BY ev_idx) AS e FROM ev GROUP BY trans_seq_no),
  flat AS (SELECT trans_seq_no, x.i AS ev_idx, x.b AS b, x.r AS r FROM sized, unnest(e) u(x))"""
#: A part is its first and last event by place, and rows lo to hi of a single event; the path orders parts.
HALVES = f"""WITH RECURSIVE {SIZED}, tree AS (
  SELECT trans_seq_no, '' AS path, 1::BIGINT AS a, len(e)::BIGINT AS z, 0::BIGINT AS lo, NULL::BIGINT AS hi, false AS cleared, e, 64 + list_sum(list_transform(e, lambda x: x.b + coalesce(list_sum(x.r), 0)))::BIGINT AS bytes FROM sized
  UNION ALL SELECT trans_seq_no, concat(path, h), a, z, lo, hi, cleared, e, CASE WHEN hi IS NULL THEN 64 + coalesce(list_sum(list_transform(e[a:z], lambda x: x.b + coalesce(list_sum(x.r), 0))), 0) ELSE 64 + e[a].b + coalesce(list_sum(e[a].r[lo + 1:hi]), 0) END::BIGINT FROM (
    SELECT trans_seq_no, path, h, e, CASE WHEN z > a AND h = 1 THEN a + (z - a + 1) // 2 ELSE a END AS a, CASE WHEN z > a AND h = 0 THEN a + (z - a + 1) // 2 - 1 ELSE z END AS z,
      CASE WHEN z > a THEN 0 WHEN h = 1 THEN lo + (n - lo) // 2 ELSE lo END AS lo, CASE WHEN z > a THEN NULL WHEN n - lo = 1 THEN lo WHEN h = 0 THEN lo + (n - lo) // 2 ELSE n END AS hi, z = a AND n - lo = 1 AS cleared
    FROM (SELECT *, coalesce(hi, len(e[a].r)) AS n FROM tree WHERE bytes > 400), (VALUES (0), (1)) v(h) WHERE z > a OR n - lo > 1 OR (n - lo = 1 AND h = 0))),
  leaves AS (SELECT *, row_number() OVER (PARTITION BY trans_seq_no ORDER BY path) - 1 AS seq_no, count(*) OVER (PARTITION BY trans_seq_no) AS n FROM tree WHERE bytes <= 400 OR (a = z AND coalesce(hi, len(e[a].r)) = lo))"""


def sized(spark, d):
    j = F.transform(F.when(F.col("n_rows") > 0, F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1)).otherwise(F.array().cast("array<bigint>")), lambda j: 20 + (F.col("trans_seq_no") * 7 + j * 13) % 90)
    return ev(spark, d).select("trans_seq_no", "ev_idx", F.lit(19).cast("long").alias("base_size"), j.alias("row_sizes"))


@query(f"""{HALVES} SELECT trans_seq_no, seq_no, CASE WHEN n = 1 THEN 0 WHEN seq_no = n - 1 THEN 2 ELSE 1 END::BIGINT AS split_flag, x.i AS ev_idx, CASE WHEN hi IS NULL THEN 0 ELSE lo END AS lo, coalesce(hi, len(x.r)) AS hi, bytes AS part_bytes, cleared FROM leaves, unnest(e[a:z]) u(x)""")
def split_transactions(spark, d):
    return package.split_transactions(sized(spark, d), 400, change_log.tasks_of(spark, d))


@query(f"WITH {SIZED}, c AS (SELECT trans_seq_no, ev_idx, len(list_filter(r, lambda x: x + 83 <= 400))::BIGINT AS n_rows FROM flat) SELECT * FROM c WHERE trans_seq_no % 6 <> 0")
def merge_parts(spark, d):
    tasks = change_log.tasks_of(spark, d)
    parts = stored(package.split_transactions(sized(spark, d), 400, tasks))
    got = package.merged_events(parts.filter("not (trans_seq_no % 6 = 0 and split_flag <> 1)"), tasks)
    return got.select("trans_seq_no", "ev_idx", "n_rows")


@query(f"WITH {PKG} SELECT DISTINCT concat(epoch, '.', trans_seq_no, '.', seq_no) AS message_id, concat(trans_seq_no, '-', seq_no) AS key FROM pkg")
def message_id(spark, d):
    return pkg(spark, d).select(package.message_id().alias("message_id"), package.package_key().alias("key")).distinct()


@query(f"""WITH {TRX} SELECT concat(epoch, '.', trans_seq_no, '.0') AS message_id, concat(trans_seq_no, '-0') AS key, concat('{{"epoch":', epoch, ',"trans_seq_no":', trans_seq_no, ',"gtid":"', gtid, '","split_flag":0,"seq_no":0,"flag":0,"source_data_len":', bytes, ',"version":1}}') AS payload FROM trx""")
def envelope(spark, d):
    return package.envelope(pkg(spark, d).filter("offset % 2 = 0"))


CRC = f"""WITH {PKG}, t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END)) AS tab),
  m AS (SELECT trans_seq_no, "offset", concat(gtid, '|', epoch, '|', bytes) AS s FROM pkg)
SELECT trans_seq_no, "offset", xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ord(substr(s, i, 1))::BIGINT)), lambda c, b: xor(tab[(xor(c, b) % 256 + 1)::INTEGER], c // 256))) AS checksum FROM m, t"""


@query(CRC)
def package_crc(spark, d):
    return pkg(spark, d).select("trans_seq_no", "offset", package.checksum(F.concat_ws("|", "gtid", "epoch", "bytes")).alias("checksum"))


@query("SELECT c_custkey, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(c_name, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 33 + c) % 4294967296) AS hash FROM customer")
def partition_djb(spark, d):
    return read(spark, d, "customer").select("c_custkey", S.djb_hash(F.col("c_name")).alias("hash"))


EMPTY = f"{TRX}, e AS (SELECT *, row_number() OVER (ORDER BY trans_seq_no) AS place FROM (SELECT trans_seq_no, gtid, file_no, position, next_file_no, next_position, CASE WHEN trans_seq_no % 9 < 7 THEN 0 ELSE n_events END AS n_events FROM trx WHERE trans_seq_no % 50 <> 0))"
RUNS = f"""{EMPTY}, b AS (SELECT *, CASE WHEN n_events = 0 AND (place - 1) % 20 <> 0 AND coalesce(lag(n_events) OVER w = 0 AND lag(next_file_no) OVER w = file_no AND lag(next_position) OVER w = position, false) THEN 0 ELSE 1 END AS brk FROM e WINDOW w AS (ORDER BY trans_seq_no)),
  r AS (SELECT *, sum(brk) OVER (ORDER BY trans_seq_no) AS run FROM b),
  i AS (SELECT run, gtid, trans_seq_no - row_number() OVER (PARTITION BY run ORDER BY trans_seq_no) AS island, trans_seq_no FROM r WHERE gtid <> ''),
  t AS (SELECT run, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE concat(lo, '-', hi) END, ':' ORDER BY lo) AS spans FROM (SELECT run, min(trans_seq_no) AS lo, max(trans_seq_no) AS hi FROM i GROUP BY run, island) GROUP BY run)"""


@query(f"""WITH {RUNS} SELECT min(trans_seq_no) AS trans_seq_no, max(trans_seq_no) AS last_seq_no, count(*) AS n_merged, arg_min(file_no, trans_seq_no) AS file_no, arg_min(position, trans_seq_no) AS position, arg_max(next_file_no, trans_seq_no) AS next_file_no,
  arg_max(next_position, trans_seq_no) AS next_position, CASE WHEN any_value(spans) IS NULL THEN '' ELSE concat('{change_log.SOURCE_UUID}:', any_value(spans)) END AS gtid_text FROM (SELECT r.*, spans FROM r LEFT JOIN t ON r.run = t.run) GROUP BY run""")
def merge_empty(spark, d):
    t = trx(spark, d).filter("trans_seq_no % 50 <> 0").withColumn("n_events", F.when(F.col("trans_seq_no") % 9 < 7, 0).otherwise(F.col("n_events")))
    return package.merge_empty(t, batch=20)


@query(f"WITH {LOSSY} SELECT trans_seq_no FROM lossy WHERE trans_seq_no BETWEEN 10 AND 996")
def contiguous_prefix(spark, d):
    return package.contiguous_prefix(trx(spark, d).filter("trans_seq_no % 997 <> 0"), 10).select("trans_seq_no")


# ---- acceptance


@query(f'WITH {PKG} SELECT "offset", trans_seq_no, row_number() OVER (PARTITION BY trans_seq_no, seq_no ORDER BY "offset") = 1 AS accepted FROM pkg')
def accept_packages(spark, d):
    return accept.accept(pkg(spark, d)).select("offset", "trans_seq_no", "accepted")


@query(f'WITH {PKG} SELECT "offset", trans_seq_no FROM pkg QUALIFY row_number() OVER (PARTITION BY trans_seq_no, seq_no ORDER BY "offset") = 1')
def accept_first(spark, d):
    return accept.first_occurrences(pkg(spark, d)).select("offset", "trans_seq_no")


@query(f'WITH {PKG} SELECT "offset", (trans_seq_no < 997 AND row_number() OVER (PARTITION BY trans_seq_no ORDER BY "offset") = 1) AS accepted FROM pkg WHERE trans_seq_no % 997 <> 0')
def accept_after_gap(spark, d):
    return accept.accept(pkg(spark, d).filter("trans_seq_no % 997 <> 0")).select("offset", "accepted")


@query(f'WITH {PKG} SELECT "offset", row_number() OVER (PARTITION BY trans_seq_no ORDER BY "offset") = 1 AS accepted, row_number() OVER (PARTITION BY trans_seq_no ORDER BY "offset") = 1 AS can_save_offset FROM pkg WHERE trans_seq_no % 997 <> 0')
def consumer_v0(spark, d):
    return accept.accept(pkg(spark, d).filter("trans_seq_no % 997 <> 0"), "v0").select("offset", "accepted", "can_save_offset")


@query(f'WITH {PKG} SELECT "offset", row_number() OVER (PARTITION BY trans_seq_no ORDER BY "offset") = 1 AS accepted FROM pkg')
def consumer_v1(spark, d):
    return accept.accept(pkg(spark, d), "v1").select("offset", "accepted")


@query(f'WITH {PKG} SELECT max(CASE WHEN trans_seq_no % 4 <> 0 THEN trans_seq_no END) AS seq_no, max(CASE WHEN trans_seq_no % 4 <> 0 THEN "offset" END) AS "offset", max(epoch) AS epoch FROM pkg')
def checkpoint_state(spark, d):
    p = pkg(spark, d).withColumn("split_flag", F.when(F.col("trans_seq_no") % 4 == 0, 1).otherwise(0))
    return accept.checkpoint(p).select("seq_no", "offset", "epoch")


@query(f'WITH {PKG} SELECT max("offset") + 1 AS start_offset, greatest(max("offset") - 100, 0) AS old_start_offset FROM pkg')
def recovery_start(spark, d):
    s = accept.checkpoint(pkg(spark, d))
    return accept.recovery_start(s).select("offset", "start_offset").join(accept.recovery_start(s, True, 100).select("offset", F.col("start_offset").alias("old_start_offset")), "offset").select("start_offset", "old_start_offset")


@query(f'WITH {PKG} SELECT min("offset") AS low, max("offset") + 1 AS high FROM pkg')
def topic_watermarks(spark, d):
    from ..sources.topic_log import watermarks

    return watermarks(pkg(spark, d).withColumn("partition", F.lit(0))).select("low", "high")


# ---- metrics and replicas

TOTALS = f"{TICKS}, totals AS (SELECT metric_name, tick, sum(value)::BIGINT AS added, sum(sum(value)) OVER (PARTITION BY metric_name ORDER BY tick)::BIGINT AS total FROM ticks GROUP BY metric_name, tick)"


@query(f"WITH {TOTALS} SELECT * FROM totals")
def metric_counter(spark, d):
    return metrics.counter(ticks(spark, d))


@query(f"WITH {TOTALS} SELECT metric_name, tick, added, total, coalesce(floor((total - lag(total) OVER w) / ((tick - lag(tick) OVER w) * 10)), 0)::BIGINT AS rate FROM totals WINDOW w AS (PARTITION BY metric_name ORDER BY tick)")
def metric_meter(spark, d):
    return metrics.meter(metrics.counter(ticks(spark, d)))


@query(f"WITH {TICKS} SELECT metric_name, sample, floor(sum(value) OVER w / count(value) OVER w)::BIGINT AS average FROM ticks WINDOW w AS (PARTITION BY metric_name ORDER BY sample ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def metric_avg(spark, d):
    return metrics.moving_average(ticks(spark, d)).select("metric_name", "sample", "average")


@query(f"""WITH {TOTALS} SELECT concat('{{"metricName":"', metric_name, '","timestamp":', tick, ',"longValue":', total, '}}') AS line FROM totals""")
def metric_lines(spark, d):
    return metrics.json_lines(metrics.counter(ticks(spark, d)))


@query(f"WITH {EV} SELECT trans_seq_no, ev_idx, greatest(0, 1500000000 + 2 * trans_seq_no - ts - 30)::BIGINT AS lag FROM ev")
def replication_lag(spark, d):
    return metrics.lag_seconds(ev(spark, d), F.lit(1500000000) + 2 * F.col("trans_seq_no"), F.col("ts"), 30).select("trans_seq_no", "ev_idx", "lag")


@query("SELECT event_id, user_id AS t2_ms, (event_id % 7)::BIGINT AS t3_ms FROM events")
def stage_latency(spark, d):
    t1 = F.unix_millis(F.col("ts").cast("timestamp"))
    p = read(spark, d, "events").withColumns({"t1": t1}).withColumn("t2", F.col("t1") + F.col("user_id")).withColumn("t3", F.col("t2") + F.col("event_id") % 7)
    return metrics.stage_latency(p, ["t1", "t2", "t3"]).select("event_id", "t2_ms", "t3_ms")


GATE = f"""WITH {TRX}, {POLLS}, t AS (SELECT trans_seq_no, 1704067200 + trans_seq_no * 60 AS ts FROM trx),
  p AS (SELECT *, min(CASE WHEN NOT healthy THEN poll_ts END) OVER (PARTITION BY server_id ORDER BY poll_ts, poll_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS unhealthy_at FROM polls),
  lastp AS (SELECT server_id, poll_ts, arg_max(healthy, poll_id) AS healthy, arg_max(unhealthy_at, poll_id) AS unhealthy_at, bool_or(arg_max(unhealthy_at, poll_id) IS NOT NULL) OVER () AS x FROM (SELECT server_id, poll_ts, poll_id, healthy, coalesce(unhealthy_at, 0) AS unhealthy_at FROM p) GROUP BY server_id, poll_ts),
  servers AS (SELECT DISTINCT server_id FROM polls), ts AS (SELECT trans_seq_no, ts, server_id FROM t, servers),
  w AS (SELECT ts.trans_seq_no, ts.ts, ts.server_id, nullif(unhealthy_at, 0) AS unhealthy_at FROM ts ASOF JOIN lastp ON ts.server_id = lastp.server_id AND ts.ts >= lastp.poll_ts WHERE healthy),
  cov AS (SELECT server_id, mx, min(poll_ts) AS seen_at FROM (SELECT server_id, poll_ts, max(executed_to) OVER (PARTITION BY server_id ORDER BY poll_ts, poll_id) AS mx FROM polls WHERE healthy) GROUP BY server_id, mx),
  j AS (SELECT w.*, seen_at FROM w ASOF LEFT JOIN cov ON w.server_id = cov.server_id AND w.trans_seq_no <= cov.mx),
  r AS (SELECT trans_seq_no, max(least(greatest(coalesce(least(seen_at, unhealthy_at), ts + 86400), ts), ts + 86400)) AS released_at FROM j GROUP BY trans_seq_no)
SELECT t.trans_seq_no, coalesce(released_at, ts) AS released_at FROM t LEFT JOIN r ON t.trans_seq_no = r.trans_seq_no"""


@query(GATE)
def replica_gate(spark, d):
    t = trx(spark, d).select("trans_seq_no", (F.lit(1704067200) + F.col("trans_seq_no") * 60).alias("ts"))
    return metrics.replica_gate(t, polls(spark, d), 86400)


@query("WITH o AS (SELECT DISTINCT c_nationkey::BIGINT AS server_id FROM customer WHERE c_acctbal > 9000), n AS (SELECT DISTINCT s_nationkey::BIGINT AS server_id FROM supplier) SELECT coalesce(o.server_id, n.server_id) AS server_id, CASE WHEN o.server_id IS NULL THEN 'added' WHEN n.server_id IS NULL THEN 'evicted' ELSE 'kept' END AS change FROM o FULL JOIN n ON o.server_id = n.server_id")
def replica_reconcile(spark, d):
    o = read(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").cast("long").alias("server_id")).distinct()
    return metrics.reconcile(o, read(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("server_id")).distinct())


@query(f"WITH {POLLS} SELECT server_id, poll_id, poll_ts, healthy FROM (SELECT *, lag(healthy) OVER (PARTITION BY server_id ORDER BY poll_ts, poll_id) AS was FROM polls) WHERE was <> healthy")
def replica_health(spark, d):
    return metrics.health_changes(polls(spark, d))


@query("SELECT doc_id, replace(substr(text, 1, 100), ':', ' ') AS alarm FROM documents")
def alarm_text(spark, d):
    return read(spark, d, "documents").select("doc_id", metrics.alarm_text(F.col("text")).alias("alarm"))


# ---- inspection and dumps


@query(f"WITH {EV} SELECT trans_seq_no, ev_idx, concat('#', ev_idx, ' ', CASE event_type WHEN 33 THEN 'GTID' WHEN 2 THEN 'QUERY' WHEN 19 THEN 'TABLE_MAP' WHEN 30 THEN 'WRITE_ROWS' WHEN 31 THEN 'UPDATE_ROWS' WHEN 32 THEN 'DELETE_ROWS' WHEN 16 THEN 'XID' WHEN 4 THEN 'ROTATE' END, ' ', database_name, '.', table_name, ' pos=', position, ' rows=', n_rows) AS line FROM ev")
def verbose_rows(spark, d):
    return inspect.verbose(ev(spark, d))


@query(f"WITH {EV}, r AS (SELECT trans_seq_no, CASE event_type WHEN 30 THEN 'insert' WHEN 31 THEN 'update' ELSE 'delete' END AS op, unnest(CASE event_type WHEN 30 THEN ['after'] WHEN 31 THEN ['before', 'after'] ELSE ['before'] END) AS image, table_name FROM ev WHERE event_type IN (30, 31, 32)) SELECT trans_seq_no, op, image, concat(CASE WHEN op = 'update' THEN concat(image, ':') ELSE '' END, op, ',', trans_seq_no, ',', table_name) AS line FROM r")
def concise_rows(spark, d):
    return inspect.concise(decode.changes(filters.data_events(ev(spark, d))), ["trans_seq_no", "table_name"])


@query(f"WITH {TRX} SELECT trans_seq_no, concat('seq=', trans_seq_no, ' epoch=', epoch, ' gtid=', gtid, ' events=', n_events, ' bytes=', bytes) AS header FROM trx")
def package_header(spark, d):
    return inspect.package_header(trx(spark, d))


@query(f"WITH {EV} SELECT trans_seq_no, ev_idx, position - min(position) OVER w + 4 AS position, next_position - min(position) OVER w + 4 AS next_position FROM ev WINDOW w AS (PARTITION BY trans_seq_no)")
def rebase_positions(spark, d):
    return inspect.rebase(ev(spark, d), 4).select("trans_seq_no", "ev_idx", "position", "next_position")


@query("SELECT CAST(floor(c_custkey / 100) AS BIGINT) AS group_no, concat('INSERT INTO customer (c_custkey,c_name,c_mktsegment) VALUES ', string_agg(concat('(', c_custkey, ',''', c_name, ''',', CASE WHEN c_custkey % 9 = 0 THEN 'NULL' ELSE concat('''', c_mktsegment, '''') END, ')'), ',' ORDER BY c_custkey)) AS statement FROM customer GROUP BY 1")
def dump_row_groups(spark, d):
    c = read(spark, d, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")))
    return inspect.dump_rows(c, "customer", "c_custkey", {"c_custkey": True, "c_name": False, "c_mktsegment": False}, 100)


@query("SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent, len(string_split(url, '/'))::BIGINT AS n_parts FROM pages")
def string_functions(spark, d):
    return read(spark, d, "pages").select("page_id", S.parent_path(F.col("url")).alias("parent"), F.size(S.split_string(F.col("url"), "/")).cast("long").alias("n_parts"))


@query("SELECT event_id, strftime(ts, '%Y%m%d-%H:%M:%S') AS stamp, concat('b''', lpad(to_base(event_id % 16, 2), 4, '0'), '''') AS bits, (event_id % 8) // 4 = 1 AS third FROM events")
def scalar_functions(spark, d):
    k = F.col("event_id")
    return read(spark, d, "events").select("event_id", S.stamp(F.col("ts")).alias("stamp"), S.write_bits(k % 16, 4).alias("bits"), S.bit_at((k % 8).cast("long"), F.lit(2)).alias("third"))


from . import delivery, dumps, receive  # noqa: E402, F401
