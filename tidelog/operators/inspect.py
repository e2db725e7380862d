"""Rendering of logs for people, and logical dumps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import event_name


def verbose(ev: DataFrame) -> DataFrame:
    """One line an event."""
    line = F.concat(F.lit("#"), F.col("ev_idx").cast("string"), F.lit(" "), event_name(F.col("event_type")), F.lit(" "), F.col("database_name"), F.lit("."), F.col("table_name"), F.lit(" pos="), F.col("position").cast("string"), F.lit(" rows="), F.col("n_rows").cast("string"))
    return ev.select("trans_seq_no", "ev_idx", line.alias("line"))


def concise(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One line an image; images of updates carry a prefix."""
    values = F.concat_ws(",", *[F.col(c).cast("string") for c in columns])
    prefix = F.when((F.col("op") == "update") & (F.col("image") == "before"), "before:").when((F.col("op") == "update") & (F.col("image") == "after"), "after:").otherwise("")
    return rows.select("trans_seq_no", "op", "image", F.concat(prefix, F.col("op"), F.lit(","), values).alias("line"))


def package_header(pkg: DataFrame) -> DataFrame:
    return pkg.select("trans_seq_no", F.format_string("seq=%d epoch=%d gtid=%s events=%d bytes=%d", "trans_seq_no", "epoch", "gtid", "n_events", "bytes").alias("header"))


def rebase(ev: DataFrame, start: int) -> DataFrame:
    """Places of each transaction moved so that its first event is at start."""
    first = F.min("position").over(Window.partitionBy("trans_seq_no"))
    return ev.withColumn("_shift", start - first).withColumns({"position": F.col("position") + F.col("_shift"), "next_position": F.col("next_position") + F.col("_shift")}).drop("_shift")


def sql_value(c: Column, numeric: bool = False) -> Column:
    """NULL, a bare number, or a quoted text with quotes, backslashes and line ends escaped."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(c.cast("string"), r"\\", r"\\\\"), "'", r"\\'"), "\n", r"\\n")
    return F.coalesce(c.cast("string") if numeric else F.concat(F.lit("'"), text, F.lit("'")), F.lit("NULL"))


def dump_rows(df: DataFrame, table: str, key: str, columns: dict[str, bool], group: int, verb: str = "INSERT INTO") -> DataFrame:
    """group_no, statement: extended inserts of the rows whose keys fall in the same range of `group` numbers."""
    row = F.concat(F.lit("("), F.concat_ws(",", *[sql_value(F.col(c), n) for c, n in columns.items()]), F.lit(")"))
    g = df.select(F.floor(F.col(key) / group).cast("long").alias("group_no"), F.col(key).alias("k"), row.alias("r")).groupBy("group_no")
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "r"))), lambda x: x["r"]), ",")
    return g.agg(F.concat(F.lit(f"{verb} {table} ({','.join(columns)}) VALUES "), rows).alias("statement"))


def without_definer(ddl: Column) -> Column:
    return F.regexp_replace(ddl, r"(?i)\s+DEFINER\s*=\s*\S+", "")


def version_comment(ddl: Column, version: int = 50003) -> Column:
    return F.concat(F.lit(f"/*!{version} "), ddl, F.lit(" */"))


def row_estimate(engine: Column, rows: Column) -> Column:
    return F.when(engine == "InnoDB", rows * 1.5).otherwise(rows * 1.0)


def index_lines(create: Column) -> Column:
    """Lines of a create statement that declare an index, without the primary key."""
    return F.filter(F.transform(F.split(create, "\n"), lambda x: F.trim(x)), lambda x: x.rlike("^(UNIQUE |FULLTEXT |SPATIAL )?KEY "))


def pseudo_sql(cells: DataFrame) -> DataFrame:
    """k, line: a row image as a statement, for people: cells (k, op, database_name, table_name, ordinal, value, is_null)."""
    v = F.when(F.col("is_null") == 1, "NULL").otherwise(F.concat(F.lit("'"), F.col("value"), F.lit("'")))
    each = F.concat(F.lit("@"), F.col("ordinal").cast("string"), F.lit("="), v)
    g = cells.groupBy("k", "op", "database_name", "table_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", each.alias("e")))), lambda x: x["e"]).alias("e"))
    name = F.concat(F.lit("`"), F.col("database_name"), F.lit("`.`"), F.col("table_name"), F.lit("`"))
    head = F.when(F.col("op") == "insert", F.concat(F.lit("INSERT INTO "), name, F.lit(" SET "))).when(F.col("op") == "delete", F.concat(F.lit("DELETE FROM "), name, F.lit(" WHERE "))).otherwise(F.concat(F.lit("UPDATE "), name, F.lit(" SET ")))
    return g.select("k", F.concat(head, F.when(F.col("op") == "delete", F.array_join("e", " AND ")).otherwise(F.array_join("e", ", "))).alias("line"))


def debug_row(ev: DataFrame) -> DataFrame:
    """trans_seq_no, ev_idx, line: an event's own fields as JSON."""
    return ev.select("trans_seq_no", "ev_idx", F.to_json(F.struct(F.lit("def").alias("Catalog"), F.col("event_type").alias("Type"), F.col("database_name").alias("Database"), F.col("table_name").alias("Table"), F.col("n_rows").alias("Rows"))).alias("line"))


def column_header(columns: list[str], wanted: list[str] | None = None) -> str:
    """The first line of concise output: fixed fields and the columns of the first row image that are wanted."""
    keep = [c for c in columns if not wanted or c.lower() in {w.lower() for w in wanted}]
    return "|".join(["offset", "receipt", "timestamp", "database", "table", "operation", *keep])


def headers(cells: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """trans_seq_no, line: the header of each transaction, from its first row image: cells (trans_seq_no, ev_idx, row, image, ordinal, column_name)."""
    first = F.struct("ev_idx", "row", F.when(F.col("image") == "before", 0).otherwise(1).alias("i"))
    named = F.col("column_name") if not wanted else F.when(F.lower("column_name").isin([w.lower() for w in wanted]), F.col("column_name"))
    g = cells.groupBy("trans_seq_no", first.alias("f")).agg(F.array_sort(F.collect_list(F.when(named.isNotNull(), F.struct("ordinal", named.alias("n"))))).alias("c"))
    one = g.groupBy("trans_seq_no").agg(F.min_by("c", "f").alias("c"))
    return one.select("trans_seq_no", F.array_join(F.concat(F.array(*map(F.lit, column_header([]).split("|"))), F.transform("c", lambda x: x["n"])), "|").alias("line"))


def concise_lines(images: DataFrame, values: Column) -> DataFrame:
    """trans_seq_no, line of row images (offset, received, ts, database_name, table_name, op, image): fields between bars; the two
    images of an update are marked."""
    mark = F.when(F.col("op") == "update", F.when(F.col("image") == "before", "befor:").otherwise("after:")).otherwise("")
    fields = [F.col("offset"), F.col("received"), F.col("ts"), F.col("database_name"), F.col("table_name"), F.concat(mark, F.col("op"))]
    return images.select("trans_seq_no", F.concat_ws("|", *[f.cast("string") for f in fields], values).alias("line"))


def objects(catalog: DataFrame) -> DataFrame:
    """What a dump holds, in its order: step, db_name, kind, name from a catalog (db_name, kind, name). A view stands twice: first as a
    placeholder with its columns, so that what needs it can be made, and last as itself."""
    steps = {"database": 0, "table": 1, "placeholder": 2, "view": 3, "function": 4, "procedure": 5, "event": 6, "user": 7, "trigger": 8}
    rows = catalog.unionByName(catalog.filter("kind = 'view'").withColumn("kind", F.lit("placeholder")))
    return rows.withColumn("step", F.element_at(F.create_map(*[F.lit(x) for kv in steps.items() for x in kv]), F.col("kind"))).filter("step is not null").select("step", "db_name", "kind", "name")


def levels(needs: DataFrame, most: int = 1000) -> DataFrame:
    """task, level of a graph (task, needs; null for none): 0 for what needs nothing, else one above the highest it needs. A level is one join, and a table is
    written for each; RuntimeError for a circle."""
    from ..functions.stored import stored

    needs = stored(needs.select("task", "needs"))
    done = stored(needs.groupBy("task").agg(F.count("needs").alias("n")).filter("n = 0").select("task", F.lit(0).alias("level")))
    total = needs.select("task").distinct().count()
    for level in range(1, most):
        if done.count() == total:
            return done
        ready = needs.join(done.select(F.col("task").alias("needs"), F.lit(1).alias("ok")), "needs", "left").groupBy("task").agg(F.min(F.coalesce("ok", F.lit(0))).alias("ok")).filter("ok = 1").join(done, "task", "left_anti")
        new = stored(ready.select("task", F.lit(level).alias("level")))
        if new.isEmpty():
            break
        done = done.unionByName(new)
    raise RuntimeError("tasks need each other in a circle")


def dump_tasks(tables: DataFrame) -> DataFrame:
    """task, needs of a dump of tables (db_name, name): start, each database, its tables' definitions, rows and keys in turn, the end of the database, the end."""
    db, t = F.col("db_name"), F.concat_ws(".", "db_name", "name")
    dbs = tables.select("db_name").distinct()
    pair = lambda df, task, needs: df.select(task.alias("task"), needs.alias("needs"))
    return (
        dbs.limit(1).select(F.lit("start").alias("task"), F.lit(None).cast("string").alias("needs"))
        .unionAll(pair(dbs, F.concat(F.lit("db "), db), F.lit("start"))).unionAll(pair(tables, F.concat(F.lit("ddl "), t), F.concat(F.lit("db "), db)))
        .unionAll(pair(tables, F.concat(F.lit("rows "), t), F.concat(F.lit("ddl "), t))).unionAll(pair(tables, F.concat(F.lit("keys "), t), F.concat(F.lit("rows "), t)))
        .unionAll(pair(tables, F.concat(F.lit("end "), db), F.concat(F.lit("keys "), t))).unionAll(pair(dbs, F.lit("end"), F.concat(F.lit("end "), db)))
    )


def dump_statement(table: str, verb: str = "INSERT INTO", columns: list[str] | None = None) -> str:
    return f"{verb} {table}" + (f" ({','.join(columns)})" if columns else "") + " VALUES "


def dump_groups(df: DataFrame, table: str, key: str, columns: dict[str, str], group: int, verb: str = "INSERT INTO", names: bool = True) -> DataFrame:
    """group_no, statement: extended inserts of `group` rows each, in the order of key. columns: their kinds, number, text, decimal or blob;
    a number is bare, a decimal quoted, a blob hexadecimal, an empty text two quotes, a null NULL."""
    from ..functions.sequence import with_running_sum
    from ..functions.stored import stored

    def cell(c: str, kind: str) -> Column:
        v = F.col(c)
        if kind == "number":
            out = v.cast("string")
        elif kind == "decimal":
            out = F.concat(F.lit("'"), v.cast("string"), F.lit("'"))
        elif kind == "blob":
            out = F.when(F.length(v) == 0, "''").otherwise(F.concat(F.lit("0x"), F.hex(v)))
        else:
            out = F.when(v == "", "''").otherwise(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), F.lit('"')))
        return F.coalesce(out, F.lit("NULL"))

    row = F.concat(F.lit("("), F.concat_ws(",", *[cell(c, k) for c, k in columns.items()]), F.lit(")"))
    placed = with_running_sum(stored(df.select(F.col(key).alias("_k"), row.alias("_r"))), "_k", F.lit(1).cast("long"), "_place").withColumn("group_no", F.floor((F.col("_place") - 1) / group))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_r"))), lambda x: x["_r"]), ",")
    return placed.groupBy("group_no").agg(F.concat(F.lit(dump_statement(table, verb, list(columns) if names else None)), rows, F.lit(";")).alias("statement"))


def key_lines(create: Column) -> Column:
    """Lines of a create statement that declare a key or a constraint, to be added after the rows; the primary key stays in the table."""
    trimmed = F.transform(F.split(create, "\n"), lambda x: F.regexp_replace(F.trim(x), r"^,+|,+$", ""))
    return F.filter(trimmed, lambda x: x.rlike("^((UNIQUE |FULLTEXT |SPATIAL )?(KEY|INDEX)|CONSTRAINT) "))


def create_without_keys(create: Column) -> Column:
    """The create statement without the lines of key_lines()."""
    lines = F.filter(F.split(create, "\n"), lambda x: ~F.trim(x).rlike("^((UNIQUE |FULLTEXT |SPATIAL )?(KEY|INDEX)|CONSTRAINT) "))
    return F.regexp_replace(F.array_join(lines, "\n"), r",(\s*\n\))", "$1")


def add_keys(table: Column, keys: Column) -> Column:
    """One statement that adds deferred keys; null if there are none."""
    return F.when(F.size(keys) > 0, F.concat(F.lit("ALTER TABLE "), table, F.lit(" "), F.array_join(F.transform(keys, lambda k: F.concat(F.lit("ADD "), k)), ", "), F.lit(";")))


def framed(table: Column, body: Column, lock: bool = True) -> Column:
    """A table's part of a dump, with its rows between locks."""
    return F.concat(F.lit("LOCK TABLES "), table, F.lit(" WRITE;\n"), body, F.lit("\nUNLOCK TABLES;")) if lock else body


def queue_of(db: Column, queues: dict[str, int], default: int = 0) -> Column:
    """The queue that dumps a database: its own, or the one for all others."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in queues.items() for x in kv]), db), F.lit(default)) if queues else F.lit(default)


def progress(done: DataFrame, totals: DataFrame) -> DataFrame:
    """tables_done, tables_total, rows_done, rows_total, percent: of tables (name, rows) and what was written (name, rows)."""
    d = done.groupBy("name").agg(F.sum("rows").alias("rows_done"))
    j = totals.join(d, "name", "left").withColumn("rows_done", F.coalesce("rows_done", F.lit(0)))
    out = j.agg(F.sum((F.col("rows_done") >= F.col("rows")).cast("long")).alias("tables_done"), F.count(F.lit(1)).alias("tables_total"), F.sum("rows_done").alias("rows_done"), F.sum("rows").alias("rows_total"))
    return out.withColumn("percent", F.floor(F.col("rows_done") * 100 / F.col("rows_total")))


def account(user: Column, host: Column) -> Column:
    """'user'@'host', with quotes and backslashes escaped."""
    q = lambda c: F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), "'", r"\\'"), F.lit("'"))
    return F.concat(q(user), F.lit("@"), q(host))


@dataclass
class DumpOptions:
    """verb: INSERT INTO, REPLACE INTO or INSERT IGNORE INTO; rows of a statement; column names; keys after the rows; locks; what is left out."""

    verb: str = "INSERT INTO"
    rows: int = 250
    names: bool = True
    defer_keys: bool = True
    lock: bool = True
    create: bool = True
    drop: bool = False
    data: bool = True


def table_dump(df: DataFrame, create: str, table: str, key: str, columns: dict[str, str], options: DumpOptions | None = None) -> DataFrame:
    """step, place, text of a table's dump in order: drop, create, lock, rows, unlock, keys, as the options ask for."""
    o = options or DumpOptions()
    spark = df.sparkSession
    one = spark.createDataFrame([(create,)], "ddl string").withColumn("k", key_lines(F.col("ddl")))
    text = lambda step, c: one.select(F.lit(step).alias("step"), F.lit(0).cast("long").alias("place"), c.alias("text"))
    made = create_without_keys(F.col("ddl")) if o.defer_keys else F.col("ddl")
    parts = []
    if o.drop:
        parts.append(text(0, F.lit(f"DROP TABLE IF EXISTS {table};")))
    if o.create:
        parts.append(text(1, F.concat(made, F.lit(";"))))
    if o.data:
        if o.lock:
            parts += [text(2, F.lit(f"LOCK TABLES {table} WRITE;")), text(4, F.lit("UNLOCK TABLES;"))]
        parts.append(dump_groups(df, table, key, columns, o.rows, o.verb, o.names).select(F.lit(3).alias("step"), F.col("group_no").alias("place"), F.col("statement").alias("text")))
    if o.create and o.defer_keys:
        parts.append(text(5, add_keys(F.lit(table), F.col("k"))).filter("text is not null"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
