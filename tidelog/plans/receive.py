"""Queries of sources, decoding and filters over the derived log, with SQL of the same meaning."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.stored import shared_dir
from ..operators import compression, decode, filters
from ..sources import binlog, change_log, row_image, topic_log
from .catalog import CELLS, EV, PKG, TRX, cells, ev, pkg, query, read, trx

UUID = bytes.fromhex(change_log.SOURCE_UUID.replace("-", ""))


def body(r: dict) -> tuple[int, int, int, bytes]:
    """The binary form of an event of the derived log."""
    kind, seq = r["event_type"], r["trans_seq_no"]
    if kind == 33:
        data = b"\x00" + UUID + struct.pack("<qBqq", seq, 2, seq - 1, seq)
    elif kind == 2:
        db = r["database_name"].encode()
        data = struct.pack("<IIBHH", 1, 0, len(db), 0, 3) + b"\x00\x01\x02" + db + b"\x00" + r["statement"].encode()
    elif kind == 4:
        data = struct.pack("<Q", 4) + f"log.{r['file_no'] + 1:06d}".encode()
    elif kind == 16:
        data = struct.pack("<q", seq)
    else:
        data = b"\x00" * 8
    return r["ts"], kind, 0, data


def binary_files(spark, d):
    cols = ["file_no", "trans_seq_no", "ev_idx", "event_type", "database_name", "statement", "ts"]
    return binlog.write(ev(spark, d).select(*cols), body, "file_no", ["trans_seq_no", "ev_idx"], checksums=True, tasks=change_log.tasks_of(spark, d))


@query(f"""WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY file_no ORDER BY trans_seq_no, ev_idx) AS place FROM ev) SELECT file_no, place, ts, event_type, CASE WHEN event_type = 33 THEN gtid END AS gtid, CASE WHEN event_type = 33 THEN trans_seq_no - 1 END AS last_committed,
  CASE WHEN event_type = 33 THEN trans_seq_no END AS sequence_number, CASE WHEN event_type = 2 THEN database_name END AS database_name, CASE WHEN event_type = 2 THEN statement END AS statement, CASE WHEN event_type = 4 THEN concat('log.', lpad((file_no + 1)::VARCHAR, 6, '0')) END AS next_file,
  CASE WHEN event_type = 4 THEN 4 END::BIGINT AS next_file_pos, CASE WHEN event_type = 16 THEN trans_seq_no END AS xid, CASE event_type WHEN 33 THEN 'gtid' WHEN 2 THEN 'query' WHEN 4 THEN 'rotate' WHEN 16 THEN 'xid' WHEN 19 THEN 'table_map' ELSE 'rows' END AS decoder FROM n""")
def binary_log(spark, d):
    from pyspark.sql import Window

    e = binlog.details(binlog.decoded(binary_files(spark, d), checksums=True))
    place = F.row_number().over(Window.partitionBy("path").orderBy("log_pos")).cast("long")
    return e.select(F.col("path").cast("long").alias("file_no"), place.alias("place"), F.col("timestamp").alias("ts"), F.col("event_type").cast("long").alias("event_type"), *[c.split()[0] for c in binlog.DETAILS.split(", ")])


@query(f"WITH {EV}, n AS (SELECT file_no, row_number() OVER w AS place, 19 + 4 + CASE event_type WHEN 33 THEN 42 WHEN 2 THEN 13 + 3 + length(database_name) + 1 + length(statement) WHEN 4 THEN 8 + 10 WHEN 16 THEN 8 ELSE 8 END AS event_size FROM ev WINDOW w AS (PARTITION BY file_no ORDER BY trans_seq_no, ev_idx)) SELECT file_no, place, event_size::BIGINT AS event_size, (3 + sum(event_size) OVER w - event_size + 1)::BIGINT AS position, (4 + sum(event_size) OVER w)::BIGINT AS next_position FROM n WINDOW w AS (PARTITION BY file_no ORDER BY place)")
def binary_headers(spark, d):
    from pyspark.sql import Window

    e = binlog.decoded(binary_files(spark, d), checksums=True, with_payload=False)
    place = F.row_number().over(Window.partitionBy("path").orderBy("log_pos")).cast("long")
    return e.select(F.col("path").cast("long").alias("file_no"), place.alias("place"), "event_size", (F.col("log_pos") - F.col("event_size")).alias("position"), F.col("log_pos").alias("next_position"))


def row_body(r: dict) -> tuple[int, int, int, bytes]:
    """A table map of (bigint, varchar(40), varchar(40)), or the insert of one row."""
    if r["kind"] == 33:
        return 1, 33, 0, b"\x00" + UUID + struct.pack("<q", r["k"])
    head = (7).to_bytes(6, "little") + b"\x01\x00"
    if r["kind"] == 19:
        return 1, 19, 0, head + b"\x04shop\x00\x06orders\x00" + b"\x03" + bytes([8, 15, 15]) + b"\x04" + struct.pack("<HH", 40, 40) + b"\x06"
    texts = [r["status"], r["note"]]
    null = sum(1 << i + 1 for i, t in enumerate(texts) if t is None)
    cell = b"".join(bytes([len(t.encode())]) + t.encode() for t in texts if t is not None)
    return 1, 30, 0, head + b"\x02\x00" + b"\x03\x07" + bytes([null]) + struct.pack("<q", r["k"]) + cell


@query(f"WITH {CELLS}, o AS (SELECT *, CASE column_name WHEN 'o_orderkey' THEN 1 WHEN 'o_orderstatus' THEN 2 ELSE 3 END AS ordinal FROM cells) SELECT k, database_name, table_name, ordinal, column_name, value, is_null FROM o")
def binary_rows(spark, d):
    k = F.col("o_orderkey")
    o = read(spark, d, "orders").select(F.floor(k / 1000).alias("file"), k.alias("k"), F.col("o_orderstatus").alias("status"), F.when(k % 4 != 0, F.col("o_orderpriority")).alias("note"), F.explode(F.array(F.lit(33), F.lit(19), F.lit(30))).alias("kind"), F.lit(0).alias("at"))
    o = o.withColumn("at", F.when(F.col("kind") == 33, 0).when(F.col("kind") == 19, 1).otherwise(2))
    got = row_image.decoded(binlog.write(o, row_body, "file", ["k", "at"]))
    from pyspark.sql import Window

    key = F.first(F.when(F.col("ordinal") == 1, F.col("value").cast("string").cast("long")), ignorenulls=True).over(Window.partitionBy("path", "log_pos", "row", "image"))
    schema = spark.createDataFrame([("shop", "orders", 1, "o_orderkey", "bigint"), ("shop", "orders", 2, "o_orderstatus", "char(1)"), ("shop", "orders", 3, "o_note", "text")], "database_name string, table_name string, ordinal int, column_name string, column_type string")
    named = decode.named_columns(got.withColumn("k", key), schema)
    return named.select("k", "database_name", "table_name", F.col("ordinal").cast("long").alias("ordinal"), "column_name", F.col("value").cast("string").alias("value"), F.col("is_null").cast("long").alias("is_null"))


@query(f"WITH {EV} SELECT trans_seq_no, ev_idx, CASE event_type WHEN 33 THEN 'gtid' WHEN 2 THEN 'query' WHEN 4 THEN 'rotate' WHEN 16 THEN 'xid' WHEN 19 THEN 'table_map' ELSE 'rows' END AS decoder FROM ev")
def event_dispatch(spark, d):
    return ev(spark, d).select("trans_seq_no", "ev_idx", decode.decoder(F.col("event_type")).alias("decoder"))


@query("SELECT o_orderkey, o_orderkey % 70000 AS n, o_orderkey % 250 AS small, (o_orderkey * 7919) % 4294967296 AS bits FROM orders")
def coded_numbers(spark, d):
    n, h = F.col("o_orderkey") % 70000, lambda c, w: F.lpad(F.hex(c.cast("long")), w, "0")
    le = lambda c, w: F.concat(*[F.substring(h(c, 2 * w), i, 2) for i in range(2 * w - 1, 0, -2)])
    data = F.unhex(F.when(n < 251, h(n, 2)).when(n < 65536, F.concat(F.lit("FC"), le(n, 2))).otherwise(F.concat(F.lit("FD"), le(n, 3))))
    small = F.unhex(F.concat(h(F.col("o_orderkey") % 250, 2), F.lit("FFFF")))
    bits = F.unhex(h((F.col("o_orderkey") * 7919) % 4294967296, 8))
    return read(spark, d, "orders").select("o_orderkey", S.length_encoded_int(data).cast("long").alias("n"), S.length_encoded_int(small).cast("long").alias("small"), S.decode_bits(bits).cast("long").alias("bits"))


@query(f"WITH {EV} SELECT trans_seq_no, ev_idx FROM ev WHERE gtid = '' OR NOT (trans_seq_no BETWEEN 1 AND 400 OR trans_seq_no BETWEEN 600 AND 650 OR trans_seq_no = 700 OR trans_seq_no BETWEEN 1000 AND 1200)")
def start_at_set(spark, d):
    done = spark.createDataFrame([(change_log.SOURCE_UUID, 1, 300), (change_log.SOURCE_UUID, 250, 400), (change_log.SOURCE_UUID, 600, 650), (change_log.SOURCE_UUID, 700, 700), (change_log.SOURCE_UUID, 1000, 1200), ("other", 1, 10**9)], "uuid string, lo long, hi long")
    return filters.not_executed(ev(spark, d), done).select("trans_seq_no", "ev_idx")


#: Received twice in part: heartbeats, artificial events, and ignorable ones from before.
RECEIVED = f"""{EV}, got AS (SELECT trans_seq_no * 100 + ev_idx * 10 AS n, file_no, event_type, size, position, next_position, ts, 0::BIGINT AS flag FROM ev
  UNION ALL SELECT trans_seq_no * 100 + ev_idx * 10 + 1, file_no, CASE WHEN trans_seq_no % 4 = 0 THEN 27 ELSE event_type END, CASE WHEN trans_seq_no % 4 = 3 AND ev_idx = 0 THEN 0 ELSE size END, position, next_position - CASE WHEN trans_seq_no % 8 = 2 THEN 1 ELSE 0 END, ts, CASE trans_seq_no % 4 WHEN 1 THEN 32 WHEN 2 THEN 128 ELSE 0 END::BIGINT FROM ev WHERE ev_idx < 2)"""


def got(spark, d):
    e, q = ev(spark, d), F.col("trans_seq_no") % 4
    n = F.col("trans_seq_no") * 100 + F.col("ev_idx") * 10
    cols = ["file_no", "event_type", "size", "position", "next_position", "ts"]
    again = e.filter("ev_idx < 2").select((n + 1).alias("n"), "file_no", F.when(q == 0, 27).otherwise(F.col("event_type")).cast("long").alias("event_type"), F.when((q == 3) & (F.col("ev_idx") == 0), 0).otherwise(F.col("size")).cast("long").alias("size"), "position", (F.col("next_position") - F.when(F.col("trans_seq_no") % 8 == 2, 1).otherwise(0)).alias("next_position"), "ts", F.when(q == 1, 32).when(q == 2, 128).otherwise(0).cast("long").alias("flag"))
    return e.select(n.alias("n"), *cols, F.lit(0).cast("long").alias("flag")).unionByName(again)


@query(f"WITH {RECEIVED}, s AS (SELECT *, max(next_position) OVER (PARTITION BY file_no ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM got) SELECT n, event_type, flag FROM s WHERE event_type <> 27 AND flag & 32 = 0 AND NOT (flag & 128 <> 0 AND next_position < coalesce(seen, 0)) AND size > 0")
def receive_loop(spark, d):
    return filters.received(got(spark, d)).select("n", "event_type", "flag")


@query(f"WITH {EV} SELECT trans_seq_no, ev_idx, event_type + 30 AS event_type FROM ev WHERE event_type + 30 > 38")
def illegal_events(spark, d):
    return filters.illegal(ev(spark, d).withColumn("event_type", F.col("event_type") + 30)).select("trans_seq_no", "ev_idx", "event_type")


@query(f"WITH {EV} SELECT event_type, count(*) AS n FROM ev GROUP BY event_type")
def legal_events(spark, d):
    return filters.legal(ev(spark, d)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CELLS} SELECT k, column_name, value FROM cells WHERE column_name IN ('o_note', 'o_orderkey')")
def listed_columns(spark, d):
    return filters.listed_columns(cells(spark, d), ["O_NOTE", "o_OrderKey"]).select("k", "column_name", "value")


@query(f"WITH {EV} SELECT DISTINCT trans_seq_no FROM ev WHERE event_type IN (30, 31) AND database_name = 'crm' AND table_name = 'lineitem'")
def wanted_transactions(spark, d):
    return filters.wanted_transactions(ev(spark, d), "crm", "lineitem", [30, 31])


@query("SELECT event_id, user_id % 3 AS server_id FROM events WHERE user_id % 3 IN (0, 2)")
def included_replicas(spark, d):
    return filters.included_replicas(read(spark, d, "events").select("event_id", (F.col("user_id") % 3).alias("server_id")), "2, 0,7")


@query(f"WITH {EV} SELECT trans_seq_no, ev_idx FROM ev WHERE event_type IN (30, 31, 32) AND CASE database_name WHEN 'shop' THEN table_name = 'orders' WHEN 'crm' THEN true ELSE table_name = 'lineitem' END")
def filter_rules_wildcard(spark, d):
    rules = spark.createDataFrame([("shop", "orders"), ("crm", ""), ("", "lineitem")], "database_name string, table_name string")
    return filters.rule_join(filters.data_events(ev(spark, d)), rules).select("trans_seq_no", "ev_idx")


@query("SELECT p_partkey, p_brand, p_type FROM part WHERE NOT ((p_brand LIKE 'Brand#1%' AND p_type LIKE '%') OR p_type LIKE 'E%') OR (p_brand = 'Brand#11' AND p_type LIKE '%')")
def filter_object_lists(spark, d):
    include, exclude = filters.parse_objects("Brand#11.%"), filters.parse_objects('Brand#1%.%, "E%"')
    keep = filters.dump_object_included(F.col("p_brand"), F.col("p_type"), include, filters.with_default_exclusions(include, exclude))
    return read(spark, d, "part").filter(keep).select("p_partkey", "p_brand", "p_type")


@query("SELECT c_custkey, c_mktsegment AS db_name FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def filter_ignored_databases(spark, d):
    return filters.without_databases(read(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("db_name")), ["BUILDING", "MACHINERY"])


@query("SELECT p_partkey FROM part WHERE p_partkey % 5 NOT IN (1, 2)")
def filter_generated_columns(spark, d):
    k = F.col("p_partkey") % 5
    return filters.stored_columns(read(spark, d, "part").select("p_partkey", F.when(k == 1, "STORED GENERATED").when(k == 2, "virtual generated").when(k == 3, "auto_increment").alias("extra"))).select("p_partkey")


@query(f'WITH {PKG} SELECT "offset", trans_seq_no FROM pkg WHERE "offset" >= 100 AND "offset" < 2500')
def topic_range(spark, d):
    import uuid

    path = f"{shared_dir(spark).rstrip('/')}/tidelog-{uuid.uuid4().hex}"
    topic_log.write(pkg(spark, d).select("topic", "offset", "trans_seq_no"), path)
    return topic_log.read(spark, path, 100, 2500).select("offset", "trans_seq_no")


@query(f'WITH {PKG} SELECT "offset", trans_seq_no FROM pkg WHERE "offset" <= 2500 ORDER BY "offset" LIMIT 700')
def topic_scan(spark, d):
    return topic_log.scan(pkg(spark, d), 2500, 700).select("offset", "trans_seq_no")


@query(f'WITH {PKG} SELECT trans_seq_no % 3 AS topic_no, count(*) AS messages, min("offset") AS low, max("offset") + 1 AS high FROM pkg GROUP BY 1')
def topic_metadata(spark, d):
    p = pkg(spark, d).withColumns({"topic": (F.col("trans_seq_no") % 3).cast("string"), "partition": F.lit(0)})
    return topic_log.metadata(p).select(F.col("topic").cast("long").alias("topic_no"), "messages", "low", "high")


@query("SELECT doc_id, md5(text) AS digest, strlen(text)::BIGINT AS source_data_len, false AS fault FROM documents")
def lz4_round_trip(spark, d):
    p = compression.pack(read(spark, d, "documents").select("doc_id", F.col("text").alias("data")))
    return compression.unpack(p).select("doc_id", F.md5("data").alias("digest"), "source_data_len", "fault")


@query(f"WITH {TRX} SELECT trans_seq_no, gtid, n_events, bytes FROM trx")
def wire_round_trip(spark, d):
    """Messages in their form on the wire, packed, and read again."""
    from ..operators import wire

    t = trx(spark, d).withColumns({"seq_no": F.lit(0).cast("long"), "split_flag": F.lit(0).cast("long"), "data": F.concat_ws("|", "n_events", "bytes").cast("binary")})
    w = wire.encode(compression.pack(t).withColumns({"checksum": F.crc32("data"), "version": F.lit(1).cast("long")}), wire.PACKAGE)
    back = compression.unpack(wire.decode(w, wire.PACKAGE))
    parts = F.split(F.col("data").cast("string"), r"\|")
    return back.select("trans_seq_no", "gtid", parts[0].cast("long").alias("n_events"), parts[1].cast("long").alias("bytes"))


@query(f"WITH {TRX} SELECT trans_seq_no, row_number() OVER (ORDER BY trans_seq_no) + 499 AS \"offset\" FROM trx WHERE trans_seq_no % 7 <> 0")
def topic_offsets(spark, d):
    return topic_log.with_offsets(trx(spark, d).filter("trans_seq_no % 7 <> 0").select("trans_seq_no"), "trans_seq_no", 500)


@query(f'WITH {PKG} SELECT trans_seq_no, max("offset") AS "offset" FROM pkg WHERE trans_seq_no < 1200 GROUP BY trans_seq_no')
def topic_acknowledged(spark, d):
    p = pkg(spark, d).select("trans_seq_no", "seq_no", "offset")
    return topic_log.acknowledged(p.drop("offset").distinct(), p.filter("trans_seq_no not in (1200, 1300)")).select("trans_seq_no", "offset")
