"""Queries of inspection and logical dumps, with SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import decode, filters, inspect
from .catalog import CELLS, EV, cells, ev, query, read

IMAGE = f"""{EV}, im AS (SELECT trans_seq_no, ev_idx, database_name, table_name, ts, CASE event_type WHEN 30 THEN 'insert' WHEN 31 THEN 'update' ELSE 'delete' END AS op, unnest(CASE event_type WHEN 30 THEN ['after'] WHEN 31 THEN ['before', 'after'] ELSE ['before'] END) AS image FROM ev WHERE event_type IN (30, 31, 32))"""


@query(f"WITH {CELLS}, o AS (SELECT k, CASE WHEN k % 3 = 0 THEN 'insert' WHEN k % 3 = 1 THEN 'delete' ELSE 'update' END AS op, CASE column_name WHEN 'o_orderkey' THEN 1 WHEN 'o_orderstatus' THEN 2 ELSE 3 END AS n, CASE WHEN is_null = 1 THEN 'NULL' ELSE concat('''', value, '''') END AS v FROM cells) SELECT k, concat(CASE op WHEN 'insert' THEN 'INSERT INTO `shop`.`orders` SET ' WHEN 'delete' THEN 'DELETE FROM `shop`.`orders` WHERE ' ELSE 'UPDATE `shop`.`orders` SET ' END, CASE WHEN op = 'delete' THEN string_agg(concat('@', n, '=', v), ' AND ' ORDER BY n) ELSE string_agg(concat('@', n, '=', v), ', ' ORDER BY n) END) AS line FROM o GROUP BY k, op")
def pseudo_sql(spark, d):
    c = cells(spark, d)
    n = F.when(F.col("column_name") == "o_orderkey", 1).when(F.col("column_name") == "o_orderstatus", 2).otherwise(3)
    op = F.when(F.col("k") % 3 == 0, "insert").when(F.col("k") % 3 == 1, "delete").otherwise("update")
    return inspect.pseudo_sql(c.withColumns({"ordinal": n, "op": op}))


@query(f"""WITH {EV} SELECT trans_seq_no, ev_idx, concat('{{"Catalog":"def","Type":', event_type, ',"Database":"', database_name, '","Table":"', table_name, '","Rows":', n_rows, '}}') AS line FROM ev""")
def debug_rows(spark, d):
    return inspect.debug_row(ev(spark, d))


@query(f"WITH {IMAGE} SELECT trans_seq_no, concat_ws('|', trans_seq_no * 2, ts + 1, ts, database_name, table_name, concat(CASE WHEN op = 'update' THEN CASE WHEN image = 'before' THEN 'befor:' ELSE 'after:' END ELSE '' END, op), trans_seq_no, table_name) AS line FROM im WHERE database_name = 'shop'")
def concise_lines(spark, d):
    rows = decode.changes(filters.tool_filter(filters.data_events(ev(spark, d)), "shop")).withColumns({"offset": F.col("trans_seq_no") * 2, "received": F.col("ts") + 1})
    return inspect.concise_lines(rows, F.concat_ws("|", "trans_seq_no", "table_name"))


@query(f"WITH {IMAGE}, f AS (SELECT trans_seq_no, min(ev_idx) AS e FROM im GROUP BY 1) SELECT f.trans_seq_no, concat('offset|receipt|timestamp|database|table|operation|', CASE WHEN any_value(table_name) = 'orders' THEN 'o_orderkey|o_note' ELSE 'l_orderkey' END) AS line FROM f JOIN im ON im.trans_seq_no = f.trans_seq_no AND im.ev_idx = f.e GROUP BY f.trans_seq_no")
def column_headers(spark, d):
    names = F.when(F.col("table_name") == "orders", F.array(F.lit("o_orderkey"), F.lit("o_status"), F.lit("o_note"))).otherwise(F.array(F.lit("l_orderkey"), F.lit("l_qty")))
    rows = decode.changes(filters.data_events(ev(spark, d))).select("trans_seq_no", "ev_idx", F.lit(0).alias("row"), "image", F.posexplode(names).alias("ordinal", "column_name"))
    return inspect.headers(rows, ["O_ORDERKEY", "o_note", "l_orderkey"])


@query(f"WITH {EV} SELECT trans_seq_no, ev_idx, CASE event_type WHEN 2 THEN 'Query' WHEN 4 THEN 'Rotate' WHEN 16 THEN 'Xid' WHEN 19 THEN 'Table_map' WHEN 30 THEN 'insert' WHEN 31 THEN 'update' WHEN 32 THEN 'delete' ELSE 'Unknown' END AS name FROM ev")
def viewer_names(spark, d):
    return ev(spark, d).select("trans_seq_no", "ev_idx", S.viewer_name(F.col("event_type")).alias("name"))


OBJECTS = """cat AS (SELECT DISTINCT p_brand AS db_name, 'database' AS kind, p_brand AS name FROM part UNION ALL SELECT DISTINCT p_brand, CASE p_size % 6 WHEN 0 THEN 'view' WHEN 1 THEN 'trigger' WHEN 2 THEN 'event' WHEN 3 THEN 'function' WHEN 4 THEN 'other' ELSE 'table' END, concat('x', p_size) FROM part)"""


def objects(spark, d):
    p, k = read(spark, d, "part"), F.col("p_size") % 6
    kind = F.when(k == 0, "view").when(k == 1, "trigger").when(k == 2, "event").when(k == 3, "function").when(k == 4, "other").otherwise("table")
    dbs = p.select(F.col("p_brand").alias("db_name"), F.lit("database").alias("kind"), F.col("p_brand").alias("name"))
    return dbs.unionAll(p.select("p_brand", kind, F.concat(F.lit("x"), F.col("p_size").cast("string")))).distinct()


@query(f"WITH {OBJECTS}, s AS (SELECT *, CASE kind WHEN 'database' THEN 0 WHEN 'table' THEN 1 WHEN 'view' THEN 3 WHEN 'function' THEN 4 WHEN 'event' THEN 6 WHEN 'trigger' THEN 8 END AS step FROM cat) SELECT step::BIGINT AS step, db_name, kind, name FROM s WHERE step IS NOT NULL UNION ALL SELECT 2, db_name, 'placeholder', name FROM s WHERE kind = 'view'")
def dump_objects(spark, d):
    return inspect.objects(objects(spark, d)).withColumn("step", F.col("step").cast("long"))


TABLES = "(SELECT DISTINCT p_brand AS db_name, concat('x', p_size % 7) AS name FROM part)"


@query(f"""SELECT 'start' AS task, 0::BIGINT AS level UNION ALL SELECT DISTINCT concat('db ', db_name), 1 FROM {TABLES} UNION ALL SELECT concat('ddl ', db_name, '.', name), 2 FROM {TABLES} UNION ALL SELECT concat('rows ', db_name, '.', name), 3 FROM {TABLES}
UNION ALL SELECT concat('keys ', db_name, '.', name), 4 FROM {TABLES} UNION ALL SELECT DISTINCT concat('end ', db_name), 5 FROM {TABLES} UNION ALL SELECT 'end', 6""")
def dump_levels(spark, d):
    t = read(spark, d, "part").select(F.col("p_brand").alias("db_name"), F.concat(F.lit("x"), (F.col("p_size") % 7).cast("string")).alias("name")).distinct()
    return inspect.levels(inspect.dump_tasks(t)).withColumn("level", F.col("level").cast("long"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_custkey * 1.5 ELSE c_custkey * 1.0 END::DOUBLE AS estimate FROM customer")
def row_estimates(spark, d):
    return read(spark, d, "customer").select("c_custkey", inspect.row_estimate(F.when(F.col("c_nationkey") % 2 == 0, "InnoDB").otherwise("MyISAM"), F.col("c_custkey")).alias("estimate"))


@query("SELECT c_custkey, concat('/*!', 50003 + c_nationkey, ' CREATE TRIGGER ', c_name, ' */') AS ddl FROM customer")
def version_comments(spark, d):
    c = F.concat(F.lit("CREATE TRIGGER "), F.col("c_name"))
    return read(spark, d, "customer").select("c_custkey", F.concat(F.lit("/*!"), (F.col("c_nationkey") + 50003).cast("string"), F.substring(inspect.version_comment(c), 9, 100000)).alias("ddl"))


@query("SELECT c_custkey, concat('CREATE SQL SECURITY DEFINER VIEW v', c_custkey, ' AS SELECT 1') AS ddl FROM customer")
def definers(spark, d):
    text = F.concat(F.lit("CREATE DEFINER=`"), F.col("c_name"), F.lit("`@`%` SQL SECURITY DEFINER VIEW v"), F.col("c_custkey").cast("string"), F.lit(" AS SELECT 1"))
    return read(spark, d, "customer").select("c_custkey", inspect.without_definer(F.regexp_replace(text, r"(?<=`)([^`@%]*) (?=[^`]*`@)", "$1_")).alias("ddl"))


@query("SELECT c_custkey, concat_ws(';', CASE WHEN c_nationkey % 2 = 0 THEN 'UNIQUE KEY u (id)' END, CASE WHEN c_nationkey % 3 = 0 THEN 'KEY k (id)' END) AS keys, 'CREATE TABLE t (\n  id INT,\n  PRIMARY KEY (id)\n)' AS without, CASE WHEN c_nationkey % 2 = 0 AND c_nationkey % 3 = 0 THEN 'ALTER TABLE t ADD UNIQUE KEY u (id), ADD KEY k (id);' WHEN c_nationkey % 2 = 0 THEN 'ALTER TABLE t ADD UNIQUE KEY u (id);' WHEN c_nationkey % 3 = 0 THEN 'ALTER TABLE t ADD KEY k (id);' END AS added FROM customer")
def deferred_keys(spark, d):
    n = F.col("c_nationkey")
    create = F.concat(F.lit("CREATE TABLE t (\n  id INT,\n  PRIMARY KEY (id)"), F.when(n % 2 == 0, ",\n  UNIQUE KEY u (id)").otherwise(""), F.when(n % 3 == 0, ",\n  KEY k (id)").otherwise(""), F.lit("\n)"))
    c = read(spark, d, "customer").select("c_custkey", create.alias("ddl")).withColumn("k", inspect.key_lines(F.col("ddl")))
    return c.select("c_custkey", F.array_join("k", ";").alias("keys"), inspect.create_without_keys(F.col("ddl")).alias("without"), inspect.add_keys(F.lit("t"), F.col("k")).alias("added"))


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY c_custkey) AS place, c_custkey, concat('(', c_custkey, ',''', c_acctbal, ''',', CASE WHEN c_custkey % 9 = 0 THEN 'NULL' WHEN c_custkey % 9 = 1 THEN '''''' ELSE concat('"', c_mktsegment, ' \\"x\\"\\n"') END, ',0x', hex(c_name), ')') AS r FROM customer WHERE c_custkey % 4 <> 1)
SELECT ((place - 1) // 70)::BIGINT AS group_no, concat('REPLACE INTO customer (id,bal,seg,raw) VALUES ', string_agg(r, ',' ORDER BY c_custkey), ';') AS statement FROM r GROUP BY 1""")
def dump_extended(spark, d):
    k = F.col("c_custkey")
    c = read(spark, d, "customer").filter(k % 4 != 1).select(k.alias("id"), F.col("c_acctbal").alias("bal"), F.when(k % 9 == 1, "").when(k % 9 != 0, F.concat("c_mktsegment", F.lit(' "x"\n'))).alias("seg"), F.col("c_name").cast("binary").alias("raw"))
    return inspect.dump_groups(c, "customer", "id", {"id": "number", "bal": "decimal", "seg": "text", "raw": "blob"}, 70, "REPLACE INTO")


@query("SELECT p_partkey, concat('LOCK TABLES ', p_name, ' WRITE;\nX\nUNLOCK TABLES;') AS text, CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#22' THEN 2 ELSE 0 END::BIGINT AS queue FROM part")
def dump_frames(spark, d):
    return read(spark, d, "part").select("p_partkey", inspect.framed(F.col("p_name"), F.lit("X")).alias("text"), inspect.queue_of(F.col("p_brand"), {"Brand#11": 1, "Brand#22": 2}).cast("long").alias("queue"))


@query("WITH t AS (SELECT p_brand AS name, count(*) AS rows, count(*) FILTER (p_size > 5 OR p_brand = 'Brand#11') AS done FROM part GROUP BY 1) SELECT count(*) FILTER (done >= rows) AS tables_done, count(*) AS tables_total, sum(done)::BIGINT AS rows_done, sum(rows)::BIGINT AS rows_total, floor(sum(done) * 100 / sum(rows))::BIGINT AS percent FROM t")
def dump_progress(spark, d):
    p = read(spark, d, "part")
    count = lambda df: df.groupBy(F.col("p_brand").alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    return inspect.progress(count(p.filter("p_size > 5 or p_brand = 'Brand#11'")), count(p))


@query("SELECT c_custkey, concat('''', c_name, '\\''''@''', c_mktsegment, '''') AS account FROM customer")
def accounts(spark, d):
    return read(spark, d, "customer").select("c_custkey", inspect.account(F.concat("c_name", F.lit("'")), F.col("c_mktsegment")).alias("account"))


@query("SELECT p_partkey, lower(hex(p_name)) AS hexed, to_base64(p_name::BLOB) AS coded, p_name AS back FROM part")
def text_codes(spark, d):
    b = F.col("p_name").cast("binary")
    return read(spark, d, "part").select("p_partkey", F.lower(F.hex(b)).alias("hexed"), F.base64(b).alias("coded"), F.unbase64(F.base64(F.unhex(F.hex(b)))).cast("string").alias("back"))


@query("SELECT event_id, concat(epoch_us(ts) // 1000000, '.', lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0')) AS stamp, (user_id * 1500)::BIGINT AS us, (user_id * 1500 // 1000)::BIGINT AS ms FROM events")
def time_functions(spark, d):
    t = F.col("ts").cast("timestamp")
    after = F.timestamp_micros(F.unix_micros(t) + F.col("user_id") * 1500)
    return read(spark, d, "events").select("event_id", S.stamp_us(F.col("ts")).alias("stamp"), S.elapsed_us(t, after).alias("us"), S.elapsed_ms(t, after).alias("ms"))


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS place, s_suppkey, concat('(', s_suppkey, ',"', s_name, '")') AS r FROM supplier) SELECT 1::BIGINT AS step, 0::BIGINT AS place, 'CREATE TABLE s (
  id INT
);' AS text UNION ALL SELECT 2, 0, 'LOCK TABLES s WRITE;' UNION ALL SELECT 3, place // 50, concat('INSERT IGNORE INTO s (s_suppkey,s_name) VALUES ', string_agg(r, ',' ORDER BY s_suppkey), ';') FROM r GROUP BY 2 UNION ALL SELECT 4, 0, 'UNLOCK TABLES;' UNION ALL SELECT 5, 0, 'ALTER TABLE s ADD KEY k (id);'""")
def table_dump(spark, d):
    o = inspect.DumpOptions(verb="INSERT IGNORE INTO", rows=50)
    got = inspect.table_dump(read(spark, d, "supplier"), "CREATE TABLE s (\n  id INT,\n  KEY k (id)\n)", "s", "s_suppkey", {"s_suppkey": "number", "s_name": "text"}, o)
    return got.withColumn("step", F.col("step").cast("long"))
