"""Filters by database, table, column and event type."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ROW_EVENTS, ROW_EVENTS_ALL, SYSTEM_SCHEMAS
from .gtid import SPAN, merge, split_id

Rules = dict[str, dict[str, list[str]]]


def load_rules(text: str) -> Rules:
    """{database: {table: [columns]}}; an empty database is any other one."""
    return {db: {t: list(c) for t, c in tables.items()} for db, tables in json.loads(text or "{}").items()}


def table_included(db: Column, table: Column, rules: Rules, table_wildcard: bool = False) -> Column:
    """System schemas never (as written, lower case); without rules all; the database's own rules or else those of ``;
    a database without tables keeps all its tables. table_wildcard: an empty table name stands for all."""
    ok = F.lit(False)
    if not rules:
        ok = F.lit(True)
    elif "" in rules:
        ok = _tables(table, rules[""], table_wildcard)
    for name, tables in rules.items():
        if name:
            ok = F.when(db == name, _tables(table, tables, table_wildcard)).otherwise(ok)
    return ~db.isin(SYSTEM_SCHEMAS) & ok


def _tables(table: Column, tables: dict[str, list[str]], wildcard: bool) -> Column:
    return F.lit(True) if not tables or wildcard and "" in tables else table.isin(list(tables))


def column_included(db: Column, table: Column, column: Column, rules: Rules) -> Column:
    """As table_included, and then an empty list of columns keeps all."""
    listed = F.lit(False)
    for name, tables in rules.items():
        for t, columns in tables.items():
            own_db = (db == name) if name else ~db.isin([d for d in rules if d])
            listed = listed | (own_db & (table == t) & (F.lit(True) if not columns else column.isin(columns)))
        if not tables:
            listed = listed | ((db == name) if name else ~db.isin([d for d in rules if d]))
    return table_included(db, table, rules) & (listed if rules else F.lit(True))


def shell(ev: DataFrame, included: Column) -> DataFrame:
    """Row events of tables left out keep their place in the log but lose their rows."""
    return ev.withColumn("n_rows", F.when(F.col("event_type").isin(ROW_EVENTS_ALL) & ~included, 0).otherwise(F.col("n_rows")).cast("long"))


def semi_join(ev: DataFrame, rules: DataFrame, wanted: bool = True) -> DataFrame:
    """Events whose (database, table) is in a table of rules, or is not."""
    return ev.join(rules, ["database_name", "table_name"], "left_semi" if wanted else "left_anti")


def data_events(ev: DataFrame, old: bool = False) -> DataFrame:
    return ev.filter(F.col("event_type").isin(ROW_EVENTS_ALL if old else ROW_EVENTS))


def forwardable(ev: DataFrame) -> DataFrame:
    """Not a heartbeat, with a size, an end and a time, and of a known type."""
    return ev.filter("event_type <> 27 and size <> 0 and next_position <> 0 and ts <> 0 and event_type between 1 and 38")


def valid_for_consumers(ev: DataFrame) -> DataFrame:
    """Data events with rows; transactions without any vanish."""
    return ev.filter(F.col("event_type").isin(ROW_EVENTS_ALL) & (F.col("n_rows") > 0))


def dump_object_included(schema: Column, name: Column, include: list[tuple[str, str]], exclude: list[tuple[str, str]]) -> Column:
    """LIKE patterns on (schema, object). With exclusions: not excluded, or included as well; else included; no lists keep all."""
    hit = lambda pairs: _any([schema.like(s) & name.like(o) for s, o in pairs])
    if exclude:
        return ~hit(exclude) | (hit(include) if include else F.lit(False))
    return hit(include) if include else F.lit(True)


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def tool_filter(ev: DataFrame, database: str | None = None, table: str | None = None, types: list[int] | None = None) -> DataFrame:
    """Exact database, and table if the database is given; event types if listed."""
    out = ev.filter(F.col("database_name") == database) if database else ev
    out = out.filter(F.col("table_name") == table) if database and table else out
    return out.filter(F.col("event_type").isin(types)) if types else out


def not_executed(ev: DataFrame, executed: DataFrame) -> DataFrame:
    """Events of ids outside of the executed set, intervals (uuid, lo, hi): where reading starts. Events without an id stay. Each id meets the one
    merged interval of its uuid that starts last at or before it, by a sweep; the set is small next to the log, and is broadcast by Spark if its size allows."""
    uuid, n = split_id(F.col("gtid"))
    done = merge(executed.withColumn("set_id", F.lit(0))).select(F.col("uuid").alias("_uuid"), F.explode(F.sequence(F.floor(F.col("lo") / SPAN), F.floor(F.col("hi") / SPAN))).alias("_span"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    e = ev.withColumns({"_u": uuid, "_n": n}).withColumn("_s", F.floor(F.col("_n") / SPAN))
    return e.join(done, (F.col("_u") == F.col("_uuid")) & (F.col("_s") == F.col("_span")) & (F.col("_n") >= F.col("_lo")) & (F.col("_n") <= F.col("_hi")), "left_anti").drop("_u", "_n", "_s")


#: Bits of an event's flag.
ARTIFICIAL, IGNORABLE = 0x20, 0x80


def received(ev: DataFrame) -> DataFrame:
    """What the receive loop hands on of events (file_no, event_type, size, position, next_position, ts, flag) in the order of each file as received,
    column n: no heartbeats, no artificial events, no ignorable ones that end before what was read of the file already, none without size, end or time."""
    seen = F.max("next_position").over(Window.partitionBy("file_no").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    known = ev.withColumn("_seen", seen)
    again = (F.col("next_position") < F.coalesce("_seen", F.lit(0))) & (F.col("flag").bitwiseAND(IGNORABLE) != 0)
    return known.filter((F.col("event_type") != 27) & (F.col("flag").bitwiseAND(ARTIFICIAL) == 0) & ~again & (F.col("size") != 0) & (F.col("next_position") != 0) & (F.col("ts") != 0)).drop("_seen")


def illegal(ev: DataFrame) -> DataFrame:
    """Events of types that there are not, to be set aside."""
    return ev.filter(~F.col("event_type").between(1, 38) | F.col("event_type").isNull())


def legal(ev: DataFrame) -> DataFrame:
    """ev, which fails where an event has a type that there is not."""
    ok = F.coalesce(F.col("event_type").between(1, 38), F.lit(False))
    return ev.withColumn("event_type", F.when(ok, F.col("event_type")).otherwise(F.raise_error(F.concat(F.lit("no such event type: "), F.coalesce(F.col("event_type").cast("string"), F.lit("null")))).cast("long")))


def listed_columns(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of a list, in any case; an empty list keeps all."""
    return cells.filter(F.lower("column_name").isin([c.lower() for c in columns])) if columns else cells


def wanted_transactions(ev: DataFrame, database: str | None = None, table: str | None = None, types: list[int] | None = None) -> DataFrame:
    """trans_seq_no of transactions with a row event that tool_filter() keeps."""
    return tool_filter(ev.filter(F.col("event_type").isin(ROW_EVENTS_ALL)), database, table, types).select("trans_seq_no").distinct()


def included_replicas(polls: DataFrame, ids: str) -> DataFrame:
    """Replicas whose server_id, as text, is in a comma list; an empty list keeps all."""
    listed = [x.strip() for x in ids.split(",") if x.strip()]
    return polls.filter(F.col("server_id").cast("string").isin(listed)) if listed else polls


def rule_join(ev: DataFrame, rules: DataFrame, wanted: bool = True) -> DataFrame:
    """Events that a table of rules (database_name, table_name) names: pairs, an empty table name for all tables of a database, an
    empty database name for a table in any database that has no rules of its own. With wanted false, all others."""
    r = rules.select(F.col("database_name").alias("_db"), F.col("table_name").alias("_table")).distinct()
    own = r.filter("_db <> ''").select(F.col("_db").alias("_own")).distinct()
    e = ev.join(own, F.col("database_name") == F.col("_own"), "left").withColumn("_key", F.coalesce("_own", F.lit("")))
    pairs = r.withColumn("_any", F.col("_table") == "")
    hit = (F.col("_key") == F.col("_db")) & (F.col("table_name") == F.col("_table"))
    exact = pairs.filter("not _any")
    whole = pairs.filter("_any").select(F.col("_db").alias("_whole")).distinct()
    e = e.join(whole, F.col("_key") == F.col("_whole"), "left")
    found = e.join(exact, hit, "left").withColumn("_in", F.col("_whole").isNotNull() | F.col("_db").isNotNull())
    return found.filter(F.col("_in") if wanted else ~F.col("_in")).select(*ev.columns)


def parse_objects(text: str, users: bool = False) -> list[tuple[str, str]]:
    """(schema, object) patterns of a comma list: names may be quoted, `schema.object` has a schema, a lone one any (%). For users
    (`user@host`) the parts are quoted and a lone user has any host. ValueError for an empty part or one too many."""
    out = []
    for item in _parts(text, ",", '"'):
        parts = [p.strip() for p in _parts(item.strip(), "@" if users else ".", '"' if users else "'")]
        if not all(parts):
            raise ValueError(f"empty part: {item!r}")
        if len(parts) > 2:
            raise ValueError(f"too many parts: {item!r}")
        parts = [f"'{p}'" for p in parts] if users else parts
        out.append((parts[0], parts[1]) if len(parts) == 2 else (parts[0], "%") if users else ("%", parts[0]))
    return out


def _parts(text: str, separator: str, quote: str) -> list[str]:
    """Parts between separators that are not quoted; a backslash takes the next character as it is."""
    out, own, inside, at = [], "", False, 0
    while at < len(text):
        c = text[at]
        if c == "\\" and at + 1 < len(text):
            own, at = own + text[at + 1], at + 1
        elif c == quote:
            inside = not inside
        elif c == separator and not inside:
            out.append(own)
            own = ""
        else:
            own += c
        at += 1
    return [*out, own]


#: Tables of accounts, logs and engines, which a dump of everything leaves out.
BUILT_IN = [("mysql", t) for t in ("apply_status", "schema", "general_log", "slow_log", "user", "db", "tables_priv", "columns_priv", "procs_priv", "proxies_priv", "event", "proc")]


def with_default_exclusions(include: list[tuple[str, str]], exclude: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The exclusions of a dump: built-in tables as well, unless tables are only included by name."""
    return [*exclude, *BUILT_IN] if exclude or not include else list(exclude)


def without_databases(objects: DataFrame, ignored: list[str]) -> DataFrame:
    return objects.filter(~F.col("db_name").isin(ignored)) if ignored else objects


def stored_columns(columns: DataFrame) -> DataFrame:
    """Columns whose values are part of a row: those with an `extra` of STORED GENERATED or VIRTUAL GENERATED are worked out, not dumped."""
    return columns.filter(~F.coalesce(F.upper("extra").contains("STORED GENERATED") | F.upper("extra").contains("VIRTUAL GENERATED"), F.lit(False)))


def not_seen(ev: DataFrame, start_seq: int) -> DataFrame:
    """Events past an executed position."""
    return ev.filter(F.col("trans_seq_no") > start_seq)
