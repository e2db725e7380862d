"""Scalar functions as column expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of event types, by code.
EVENT_NAMES = {
    0: "UNKNOWN", 1: "START_V3", 2: "QUERY", 3: "STOP", 4: "ROTATE", 5: "INTVAR", 6: "LOAD", 7: "SLAVE", 8: "CREATE_FILE", 9: "APPEND_BLOCK", 10: "EXEC_LOAD", 11: "DELETE_FILE",
    12: "NEW_LOAD", 13: "RAND", 14: "USER_VAR", 15: "FORMAT_DESCRIPTION", 16: "XID", 17: "BEGIN_LOAD_QUERY", 18: "EXECUTE_LOAD_QUERY", 19: "TABLE_MAP",
    23: "WRITE_ROWS_V1", 24: "UPDATE_ROWS_V1", 25: "DELETE_ROWS_V1", 26: "INCIDENT", 27: "HEARTBEAT", 28: "IGNORABLE", 29: "ROWS_QUERY", 30: "WRITE_ROWS", 31: "UPDATE_ROWS", 32: "DELETE_ROWS", 33: "GTID", 34: "ANONYMOUS_GTID", 35: "PREVIOUS_GTIDS",
}
#: Names of event types as the topic viewer says them; all other codes are Unknown.
VIEWER_NAMES = {
    1: "Start_v3", 2: "Query", 3: "Stop", 4: "Rotate", 5: "Intvar", 6: "Load", 7: "Slave", 8: "Create_file", 9: "Append_block", 10: "Exec_load", 11: "Delete_file", 12: "New_load", 13: "RAND", 14: "User var", 15: "Format_desc", 16: "Xid",
    17: "Begin_load_query", 18: "Execute_load_query", 19: "Table_map", 20: "Write_rows_event_old", 21: "Update_rows_event_old", 22: "Delete_rows_event_old", 23: "insert", 24: "update", 25: "delete", 26: "Incident", 30: "insert", 31: "update", 32: "delete",
}
#: Schemas that hold no user data; statements that change a schema.
SYSTEM_SCHEMAS = ["sys", "information_schema", "mysql", "performance_schema"]
DDL_PREFIXES = ["CREATE DATABASE", "CREATE SCHEMA", "CREATE TABLE", "CREATE INDEX", "CREATE UNIQUE INDEX", "ALTER DATABASE", "ALTER SCHEMA", "ALTER TABLE", "DROP DATABASE", "DROP SCHEMA", "DROP TABLE", "DROP INDEX", "RENAME TABLE", "TRUNCATE TABLE"]
ROW_EVENTS, ROW_EVENTS_ALL = [30, 31, 32], [23, 24, 25, 30, 31, 32]


def event_name(code: Column) -> Column:
    """Name of an event type, UNKNOWN for codes beyond the table."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_NAMES.items() for x in kv]), code.cast("int")), F.lit("UNKNOWN"))


def viewer_name(code: Column) -> Column:
    """Name of an event type in the topic viewer."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in VIEWER_NAMES.items() for x in kv]), code.cast("int")), F.lit("Unknown"))


def operation(code: Column) -> Column:
    """insert, update or delete for row events of both versions; Unknown otherwise."""
    return F.when(code.isin(23, 30), "insert").when(code.isin(24, 31), "update").when(code.isin(25, 32), "delete").otherwise("Unknown")


def is_system_schema(db: Column) -> Column:
    return F.lower(db).isin(SYSTEM_SCHEMAS)


def is_ddl(statement: Column) -> Column:
    return F.upper(F.ltrim(statement)).rlike("^(" + "|".join(DDL_PREFIXES) + ")")


def normalise_ddl(statement: Column) -> Column:
    """Comments out, white space single: dash comments, a leading hash comment, block comments, line ends, runs of spaces."""
    s = F.regexp_replace(statement, r"--[^\n]*", "")
    s = F.regexp_replace(s, r"^\s*#[^\n]*\n", "")
    s = F.regexp_replace(s, r"(?s)/\*.*?\*/", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def djb_hash(text: Column) -> Column:
    """h * 33 + c from 5381, 32 bits, over the UTF-8 bytes of a text."""
    data = text.cast("binary")
    places = F.when(F.length(data) > 0, F.sequence(F.lit(1), F.length(data))).otherwise(F.array().cast("array<int>"))
    octets = F.transform(places, lambda i: F.conv(F.hex(F.call_function("substring", data, i, F.lit(1))), 16, 10).cast("long"))
    return F.when(text.isNotNull(), F.aggregate(octets, F.lit(5381).cast("long"), lambda h, c: (h * 33 + c) % 4294967296))


def decode_bits(data: Column) -> Column:
    """Big-endian bytes, up to 8, as an unsigned number."""
    return F.conv(F.hex(data), 16, 10).cast("decimal(20,0)")


def write_bits(n: Column, width: int) -> Column:
    """b'0101' of the low bits of n."""
    return F.concat(F.lit("b'"), F.lpad(F.bin(n), width, "0"), F.lit("'"))


def length_encoded_int(data: Column) -> Column:
    """The integer at the start of data: one byte up to 250, null for 251, else 2, 3 or 8 little-endian bytes."""
    at = lambda i: F.conv(F.hex(F.substring(data, i, 1)), 16, 10).cast("decimal(20,0)")

    def little(n: int) -> Column:
        return F.conv(F.concat(*[F.hex(F.substring(data, i, 1)) for i in range(n + 1, 1, -1)]), 16, 10).cast("decimal(20,0)")

    return F.when(at(1) <= 250, at(1)).when(at(1) == 252, little(2)).when(at(1) == 253, little(3)).when(at(1) == 254, little(8))


def parent_path(path: Column) -> Column:
    """All before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def split_string(text: Column, separator: str) -> Column:
    """Parts between separators, empty ones included."""
    import re

    return F.split(text, re.escape(separator), -1)


def same_text(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HH:mm:ss")


def bit_at(mask: Column, i: Column) -> Column:
    """Whether bit i, counted from the lowest, is set."""
    return F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1


def without_range(items: Column, lo: int, hi: int) -> Column:
    """An array without its places from lo to below hi, counted from 0."""
    return F.concat(F.slice(items, 1, lo), F.slice(items, F.lit(hi + 1), F.greatest(F.size(items) - hi, F.lit(0))))


def elapsed_ms(a: Column, b: Column) -> Column:
    return F.floor(elapsed_us(a, b) / 1000).cast("long")


def elapsed_us(a: Column, b: Column) -> Column:
    return F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))


def stamp_us(ts: Column) -> Column:
    """Seconds and six digits of their fraction."""
    us = F.unix_micros(ts.cast("timestamp"))
    return F.concat(F.floor(us / 1000000).cast("string"), F.lit("."), F.lpad((us % 1000000).cast("string"), 6, "0"))
