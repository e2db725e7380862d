"""A deterministic change log derived from orders and line items, as one SQL text for any engine.

A transaction is an order. Events: gtid (33), begin (2), table map (19) and row event of orders, table map and
row event of lineitem, commit (16); every 500th order is a schema change (33 and a statement) instead, and
a rotate event (4) ends each file of 1,000 orders. Only arithmetic on keys: no clock, no chance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCE_UUID = "3e11fa47-71ca-11e1-9e33-c80aa9429562"

EVENTS = """
WITH counted AS (
  SELECT l_orderkey, COUNT(*) AS n FROM {lineitem} GROUP BY l_orderkey
), numbered AS (
  SELECT o_orderkey + 1 AS k, o_orderkey + 1 + CAST(FLOOR(o_orderkey / 1000) AS BIGINT) AS trans_seq_no, CAST(FLOOR(o_orderkey / 1000) AS BIGINT) + 1 AS file_no,
    COALESCE(n, 0) AS n, (o_orderkey + 1) % 500 = 0 AS is_ddl,
    CASE WHEN (o_orderkey + 1) % 10 = 0 THEN 32 WHEN (o_orderkey + 1) % 10 IN (1, 2) THEN 31 ELSE 30 END AS kind,
    CASE WHEN (o_orderkey + 1) % 11 = 0 THEN 'mysql' WHEN (o_orderkey + 1) % 13 = 0 THEN 'Sys' WHEN (o_orderkey + 1) % 7 = 0 THEN 'crm' ELSE 'shop' END AS db
  FROM {orders} LEFT JOIN counted ON l_orderkey = o_orderkey
), parts AS (
  SELECT trans_seq_no, 0 AS ev_idx, 33 AS event_type, '' AS database_name, '' AS table_name, 0 AS table_id, 0 AS n_rows, 65 AS size, file_no, k, '' AS statement FROM numbered
  UNION ALL SELECT trans_seq_no, 1, 2, db, '', 0, 0, 72, file_no, k, 'BEGIN' FROM numbered WHERE NOT is_ddl
  UNION ALL SELECT trans_seq_no, 1, 2, db, '', 0, 0, 150, file_no, k,
    CASE WHEN k % 1500 = 0 THEN 'drop  table   old_orders' WHEN k % 1000 = 0 THEN '# note\nCREATE TABLE t1 (a INT) -- end\n' ELSE '  ALTER TABLE orders /* x */ ADD COLUMN c1 INT' END FROM numbered WHERE is_ddl
  UNION ALL SELECT trans_seq_no, 2, 19, db, 'orders', 101, 0, 84, file_no, k, '' FROM numbered WHERE NOT is_ddl
  UNION ALL SELECT trans_seq_no, 3, kind, db, 'orders', 101, 1, 95, file_no, k, '' FROM numbered WHERE NOT is_ddl
  UNION ALL SELECT trans_seq_no, 4, 19, db, 'lineitem', 102, 0, 84, file_no, k, '' FROM numbered WHERE NOT is_ddl
  UNION ALL SELECT trans_seq_no, 5, kind, db, 'lineitem', 102, n, 40 + 50 * n, file_no, k, '' FROM numbered WHERE NOT is_ddl
  UNION ALL SELECT trans_seq_no, 6, 16, '', '', 0, 0, 31, file_no, k, '' FROM numbered WHERE NOT is_ddl
  UNION ALL SELECT trans_seq_no + 1, 0, 4, '', '', 0, 0, 47, file_no, k, '' FROM numbered WHERE k % 1000 = 0
)
SELECT CAST(trans_seq_no AS BIGINT) AS trans_seq_no, CAST(ev_idx AS BIGINT) AS ev_idx, CAST(event_type AS BIGINT) AS event_type, database_name, table_name, CAST(table_id AS BIGINT) AS table_id,
  CAST(n_rows AS BIGINT) AS n_rows, CAST(size AS BIGINT) AS size, CAST(file_no AS BIGINT) AS file_no, statement, CAST(FLOOR((trans_seq_no - 1) / 4000) AS BIGINT) + 1 AS epoch,
  CASE WHEN event_type = 4 THEN '' ELSE CONCAT('{uuid}:', CAST(trans_seq_no AS {text})) END AS gtid,
  CAST(4 + (SUM(size) OVER w) - size AS BIGINT) AS position, CAST(4 + (SUM(size) OVER w) AS BIGINT) AS next_position, CAST(1500000000 + k AS BIGINT) AS ts
FROM parts WINDOW w AS (PARTITION BY file_no ORDER BY trans_seq_no, ev_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

#: The log with what real ones have besides, from {ev}; truth tells the group each event belongs to, and rises with order_key.
#: A heartbeat and an incident after a commit, a file's end within a transaction, statements as data, savepoints, commits by statement.
MESSY = """
SELECT trans_seq_no * 100 + ev_idx * 10 AS order_key, trans_seq_no * 10 AS truth, event_type, statement, size FROM {ev} WHERE NOT (event_type = 16 AND trans_seq_no % 45 = 0)
UNION ALL SELECT trans_seq_no * 100 + 60, trans_seq_no * 10, CAST(2 AS BIGINT), 'COMMIT', size FROM {ev} WHERE event_type = 16 AND trans_seq_no % 45 = 0
UNION ALL SELECT trans_seq_no * 100 + 70, trans_seq_no * 10 + 1, CAST(27 AS BIGINT), '', CAST(39 AS BIGINT) FROM {ev} WHERE event_type = 16 AND trans_seq_no % 40 = 0
UNION ALL SELECT trans_seq_no * 100 + 71, trans_seq_no * 10 + 2, CAST(26 AS BIGINT), '', CAST(27 AS BIGINT) FROM {ev} WHERE event_type = 16 AND trans_seq_no % 60 = 0
UNION ALL SELECT trans_seq_no * 100 + 31, trans_seq_no * 10, CAST(4 AS BIGINT), '', CAST(47 AS BIGINT) FROM {ev} WHERE event_type = 19 AND table_name = 'orders' AND trans_seq_no % 70 = 0
UNION ALL SELECT trans_seq_no * 100 + 32, trans_seq_no * 10, CAST(15 AS BIGINT), '', CAST(119 AS BIGINT) FROM {ev} WHERE event_type = 19 AND table_name = 'orders' AND trans_seq_no % 70 = 0
UNION ALL SELECT trans_seq_no * 100 + 11, trans_seq_no * 10, CAST(5 AS BIGINT), '', CAST(32 AS BIGINT) FROM {ev} WHERE statement = 'BEGIN' AND trans_seq_no % 35 = 0
UNION ALL SELECT trans_seq_no * 100 + 12, trans_seq_no * 10, CAST(2 AS BIGINT), 'INSERT INTO t VALUES (1)', CAST(96 AS BIGINT) FROM {ev} WHERE statement = 'BEGIN' AND trans_seq_no % 35 = 0
UNION ALL SELECT trans_seq_no * 100 + 25, trans_seq_no * 10, CAST(2 AS BIGINT), 'ROLLBACK TO a', CAST(80 AS BIGINT) FROM {ev} WHERE event_type = 19 AND table_name = 'orders' AND trans_seq_no % 55 = 0
UNION ALL SELECT trans_seq_no * 100 + 5, trans_seq_no * 10, CAST(13 AS BIGINT), '', CAST(35 AS BIGINT) FROM {ev} WHERE event_type = 2 AND statement <> 'BEGIN' AND trans_seq_no % 2 = 0
"""

#: Transactions with restarts, from {trx}: an epoch of every 200, whose first rows have no id. By epoch, these are exempt, or one of them continues the
#: log and the next is broken, or the first transaction is moved, or it is lost; some restarts have an epoch of their own without any id.
RESTARTED = """
WITH dealt AS (SELECT *, CAST(FLOOR((trans_seq_no - 1) / 200) AS BIGINT) AS g FROM {trx}), heads AS (
  SELECT * FROM dealt WHERE trans_seq_no % 200 = 1 AND g > 0 AND g % 4 <> 2
), added AS (
  SELECT trans_seq_no, g, j, CASE WHEN g % 4 = 1 AND j > 0 THEN file_no ELSE 900 + j END AS file_no, CASE WHEN g % 4 = 1 AND j = 1 THEN position WHEN g % 4 = 1 AND j = 2 THEN position + 50 ELSE 4 + j END AS position
  FROM heads CROSS JOIN (SELECT CAST(0 AS BIGINT) AS j UNION ALL SELECT CAST(1 AS BIGINT) UNION ALL SELECT CAST(2 AS BIGINT)) three
)
SELECT trans_seq_no * 10 AS trans_seq_no, gtid, 2 * g AS epoch, file_no, position + CASE WHEN g % 4 = 2 AND trans_seq_no % 200 = 1 THEN 7 ELSE 0 END AS position, next_file_no, next_position
FROM dealt WHERE NOT (g % 4 = 3 AND trans_seq_no % 200 = 1) AND trans_seq_no % 997 <> 0
UNION ALL SELECT trans_seq_no * 10 - 5 + j, '', 2 * g - CASE WHEN g % 5 = 0 THEN 1 ELSE 0 END, file_no, position, file_no, position + 50 FROM added
"""


#: Events that a task puts in order, about; and events of an order, about.
TASK_EVENTS, ORDER_EVENTS = 500_000, 7


def sql_text(dialect: str) -> str:
    """EVENTS for 'spark' (tables as parameters) or 'ansi' (tables by name)."""
    tables = {"lineitem": "{lineitem}", "orders": "{orders}"} if dialect == "spark" else {"lineitem": "lineitem", "orders": "orders"}
    text = EVENTS.format(uuid=SOURCE_UUID, text="STRING" if dialect == "spark" else "VARCHAR", **tables)
    return text if dialect == "spark" else text.replace("\\n", "\n")


def tasks_of(spark: SparkSession, sf_dir: str, task_events: int = TASK_EVENTS) -> int | None:
    """How many tasks the log's events ask for; None for a log so small that Spark's choice is as good."""
    tasks = -(-spark.read.parquet(f"{sf_dir}/orders.parquet").count() * ORDER_EVENTS // task_events)
    return tasks if tasks > spark.sparkContext.defaultParallelism else None


def events(spark: SparkSession, sf_dir: str, task_events: int = TASK_EVENTS) -> DataFrame:
    """The log. Files are dealt to as many tasks as its events ask for, not to as few as their shuffled bytes, which are small: numbers that go up
    compress well, and tasks would hold more and more of them as the log grows."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    text, tasks = sql_text("spark"), tasks_of(spark, sf_dir, task_events)
    if tasks:
        text = text.replace("FROM parts WINDOW", f"FROM (SELECT /*+ REPARTITION({tasks}, file_no) */ * FROM parts) WINDOW")
    return spark.sql(text, orders=read("orders").select("o_orderkey"), lineitem=read("lineitem").select("l_orderkey"))
