"""Versioned table schemas: build, compare, look up as of a transaction."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS_JSON = "array<struct<name string, type string, position bigint>>"


def from_catalog(columns: DataFrame) -> DataFrame:
    """schema_value, a JSON text, of each (db_name, table_name) from a row for each column; system schemas are left out."""
    from ..functions.scalar import is_system_schema

    own = columns.filter(~is_system_schema(F.col("db_name")))
    cells = F.transform(F.sort_array(F.collect_list(F.struct("position", "name", "type"))), lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type"), c["position"].alias("position")))
    return own.groupBy("db_name", "table_name").agg(F.to_json(F.struct(cells.alias("columns"))).alias("schema_value"))


def parse(schemas: DataFrame) -> DataFrame:
    """A row for each column of each schema_value."""
    got = F.from_json("schema_value", f"columns {COLUMNS_JSON}")
    return schemas.withColumn("c", F.explode(got["columns"])).select("db_name", "table_name", "c.name", "c.type", "c.position")


def versions(changes: DataFrame) -> DataFrame:
    """Slowly changing dimension: version, status (1 is current), valid_from, valid_to of (db_name, table_name, valid_from, schema_value)."""
    w = Window.partitionBy("db_name", "table_name").orderBy("valid_from")
    v = changes.withColumn("version", F.row_number().over(w).cast("long")).withColumn("valid_to", F.lead("valid_from").over(w))
    return v.withColumn("status", F.when(F.col("valid_to").isNull(), 1).otherwise(0).cast("long"))


def as_of(ev: DataFrame, versions_: DataFrame, spans: int | None = None) -> DataFrame:
    """Events with the version in force at their transaction.

    Numbers are cut into spans, and a version is dealt to each span that it is in force in; an event meets the versions of its table in
    its own span only. So rows of one table are many keys, and the pairs that meet stay few however many versions a table has."""
    lo, hi = ev.agg(F.min("trans_seq_no"), F.max("trans_seq_no")).first()
    if lo is None:
        lo = hi = 0
    spans = spans or 16 * int(ev.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = max(1, -(-(hi - lo + 1) // spans))
    v = versions_.select(F.col("db_name").alias("database_name"), "table_name", "version", "valid_from", F.coalesce("valid_to", F.lit(hi + 1)).alias("valid_to")).filter(F.col("valid_to") > F.greatest("valid_from", F.lit(lo)))
    first, last = F.floor((F.greatest("valid_from", F.lit(lo)) - lo) / width), F.floor((F.least("valid_to", F.lit(hi + 1)) - 1 - lo) / width)
    v = v.filter(F.col("valid_from") <= hi).withColumn("_span", F.explode(F.sequence(first, last)))
    e = ev.withColumn("_span", F.floor((F.col("trans_seq_no") - lo) / width))
    return e.join(v, ["database_name", "table_name", "_span"]).filter("trans_seq_no >= valid_from and trans_seq_no < valid_to").drop("valid_from", "valid_to", "_span")


def diff(old: DataFrame, new: DataFrame, drops: bool = False) -> DataFrame:
    """db_name, table_name, change: created or altered; with drops also dropped, which is not seen otherwise."""
    o = old.select("db_name", "table_name", F.col("schema_value").alias("old_value"), F.lit(1).alias("had"))
    n = new.select("db_name", "table_name", "schema_value", F.lit(1).alias("has"))
    j = n.join(o, ["db_name", "table_name"], "full_outer" if drops else "left")
    change = F.when(F.col("has").isNull(), "dropped").when(F.col("had").isNull(), "created").when(~F.col("schema_value").eqNullSafe(F.col("old_value")), "altered")
    return j.withColumn("change", change).filter("change is not null").select("db_name", "table_name", "change")


def lookup(ev: DataFrame, current: DataFrame) -> DataFrame:
    """Events with the single current schema of their table; found is how many there are, and only 1 is right."""
    c = current.filter("status = 1").groupBy("db_name", "table_name").agg(F.count(F.lit(1)).alias("found"), F.max("version").alias("version"))
    return ev.join(c, (ev["database_name"] == c["db_name"]) & (ev["table_name"] == c["table_name"]), "left").select(*[ev[x] for x in ev.columns], F.coalesce("found", F.lit(0)).alias("found"), "version")


def pending_ddl(ddl: DataFrame, executed: DataFrame) -> DataFrame:
    """Statements whose gtid was not executed before."""
    return ddl.join(executed, "gtid", "left_anti")


def single(found: DataFrame) -> DataFrame:
    """The rows of lookup(), which fails where a table has no current version or more than one."""
    ok = F.col("found") == 1
    said = F.concat(F.lit("current versions of "), F.col("database_name"), F.lit("."), F.col("table_name"), F.lit(": "), F.col("found").cast("string"))
    return found.withColumn("version", F.when(ok, F.col("version")).otherwise(F.raise_error(said).cast("long"))).drop("found")


def is_empty(store: DataFrame) -> DataFrame:
    """One row: size, and whether the store has to be filled from a catalog first."""
    return store.agg(F.count(F.lit(1)).alias("size")).withColumn("empty", F.col("size") == 0)


def first_versions(store: DataFrame, catalog: DataFrame, seq: int = 0) -> DataFrame:
    """The store, or if it has no rows the tables of a catalog (a row for each column) as versions 1 from seq on."""
    if not store.isEmpty():
        return store
    return versions(from_catalog(catalog).withColumn("valid_from", F.lit(seq).cast("long"))).select(*store.columns)


def to_drop(catalog: DataFrame) -> DataFrame:
    """db_name of each database that a restore of a snapshot drops first: all but system schemas."""
    from ..functions.scalar import is_system_schema

    return catalog.select("db_name").distinct().filter(~is_system_schema(F.col("db_name")))


def ddl_counters(status: DataFrame) -> DataFrame:
    """total of the counters of schema changes in a status table (name, value)."""
    name = F.col("name")
    own = name.like("Com\\_create\\_%") | name.like("Com\\_alter\\_%") | name.like("Com\\_drop\\_%") | name.like("Com\\_rename\\_%")
    return status.filter(own).agg(F.coalesce(F.sum("value"), F.lit(0)).alias("total"))


def snapshot(catalog, counters, tries: int = 5) -> DataFrame:
    """A catalog read while no schema changed: read again, tries times at most, as long as the counters before and after differ. catalog and
    counters are functions that read them."""
    for _ in range(tries):
        before = ddl_counters(counters()).first()[0]
        found = catalog().persist()
        found.count()
        if ddl_counters(counters()).first()[0] == before:
            return from_catalog(found)
        found.unpersist()
    raise RuntimeError(f"the schema changed in each of {tries} reads")


def needs_database(ddl: Column, database: Column) -> Column:
    """USE of the database that a statement runs in; null for statements about databases, and without a database."""
    about = F.upper(F.ltrim(ddl)).rlike("^(CREATE|DROP) (DATABASE|SCHEMA)")
    return F.when((database != "") & ~about, F.concat(F.lit("USE `"), database, F.lit("`")))


def applicable(statements: DataFrame, enabled: bool = True) -> DataFrame:
    """Schema changes that reach the store: none if it is switched off, and none of system schemas."""
    from ..functions.scalar import is_ddl, is_system_schema

    return statements.filter(is_ddl(F.col("ddl")) & ~is_system_schema(F.col("database_name"))) if enabled else statements.limit(0)


def close_old(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with new schemas (db_name, table_name, schema_value, valid_from) as the versions that follow; older ones lose their status."""
    cols = ["db_name", "table_name", "schema_value", "version", "status", "valid_from"]
    last = store.groupBy("db_name", "table_name").agg(F.max("version").alias("last"))
    fresh = new.join(last, ["db_name", "table_name"], "left").withColumns({"version": F.coalesce("last", F.lit(0)) + 1, "status": F.lit(1).cast("long")})
    closed = store.join(new.select("db_name", "table_name", F.lit(1).alias("_new")).distinct(), ["db_name", "table_name"], "left").withColumn("status", F.when(F.col("_new") == 1, 0).otherwise(F.col("status")).cast("long"))
    return closed.select(*cols).unionByName(fresh.select(*cols))


TYPE = r"[A-Za-z]+(?:\s*\([^)]*\))?(?:\s+unsigned)?"
OPTIONS = r"(?: (?:NOT NULL|NULL|AUTO_INCREMENT|UNIQUE|PRIMARY KEY|DEFAULT (?:'[^']*'|\S+)|COMMENT '[^']*'|CHARACTER SET \S+|COLLATE \S+))*"
PLACE = r"(?: (?P<place>FIRST|AFTER (?P<after>`[^`]+`|\S+)))?"
Columns = list[tuple[str, str]]


def clauses(text: str) -> list[str]:
    """Parts between commas that stand in no brackets and no quotes."""
    return [c.strip() for c in re.findall(r"(?:[^,('\"`]|\((?:[^()']|'[^']*'|\([^()]*\))*\)|'[^']*'|\"[^\"]*\"|`[^`]*`)+", text)]


def plain_name(name: str) -> str:
    return name.split(".")[-1].strip("`\"")


def apply_ddl(columns: Columns | None, statement: str) -> Columns | None:
    """Columns (name, type) of a table after a statement: create, drop, truncate, and alter with one or several of add, drop, modify, change,
    rename column, with FIRST and AFTER; clauses on keys, engines and comments leave columns as they are. None: no such table.
    ValueError for statements of other forms, for a table or column that is not there, and for one that is there already."""
    s = re.sub(r"\s+", " ", statement).strip().rstrip(";").strip()
    if m := re.fullmatch(r"(?is)CREATE (?:TEMPORARY )?TABLE (IF NOT EXISTS )?\S+ ?\((.*)\)[^()]*", s):
        if columns is not None:
            if m[1]:
                return columns
            raise ValueError(f"the table is there: {s}")
        out = []
        for c in clauses(m[2]):
            if not re.match(r"(?i)(PRIMARY|UNIQUE|KEY|INDEX|FULLTEXT|SPATIAL|CONSTRAINT|FOREIGN|CHECK)\b", c):
                d = re.match(rf"(?is)(`[^`]+`|\S+) ({TYPE})", c)
                if not d:
                    raise ValueError(f"not a column: {c}")
                out.append((plain_name(d[1]), d[2]))
        return out
    if re.fullmatch(r"(?i)DROP TABLE (IF EXISTS )?\S+( CASCADE| RESTRICT)?", s):
        if columns is None and not re.search(r"(?i)IF EXISTS", s):
            raise ValueError(f"no table for: {s}")
        return None
    if columns is None:
        raise ValueError(f"no table for: {s}")
    if re.match(r"(?i)(TRUNCATE( TABLE)?|CREATE (UNIQUE |FULLTEXT |SPATIAL )?INDEX|DROP INDEX) ", s):
        return columns
    m = re.fullmatch(r"(?is)ALTER TABLE (\S+) (.*)", s)
    if not m:
        raise ValueError(f"not supported: {s}")
    for clause in clauses(m[2]):
        columns = altered(columns, clause)
    return columns


#: Clauses of an alter statement that leave columns as they are.
NO_COLUMN = r"(?i)(ADD|DROP) (PRIMARY KEY|UNIQUE|KEY|INDEX|FULLTEXT|SPATIAL|CONSTRAINT|FOREIGN)\b.*|RENAME (INDEX|KEY|TO|AS) .*|(AUTO_INCREMENT|COMMENT|DEFAULT CHARSET|CHARSET|ROW_FORMAT|DISABLE KEYS|ENABLE KEYS|CONVERT TO)\b.*"


def altered(columns: Columns, clause: str) -> Columns:
    names = [c[0] for c in columns]

    def at(name: str) -> int:
        if name not in names:
            raise ValueError(f"no column {name}: {clause}")
        return names.index(name)

    def put(rest: Columns, column: tuple[str, str], m: re.Match, else_at: int) -> Columns:
        if not m["place"]:
            i = else_at
        elif m["after"]:
            i = 1 + [c[0] for c in rest].index(plain_name(m["after"])) if plain_name(m["after"]) in [c[0] for c in rest] else at(plain_name(m["after"]))
        else:
            i = 0
        return [*rest[:i], column, *rest[i:]]

    if re.fullmatch(NO_COLUMN, clause):
        return columns
    if m := re.fullmatch(rf"(?i)ADD (?:COLUMN )?(?P<name>`[^`]+`|\S+) (?P<type>{TYPE}){OPTIONS}{PLACE}", clause):
        if plain_name(m["name"]) in names:
            raise ValueError(f"the column is there: {clause}")
        return put(columns, (plain_name(m["name"]), m["type"]), m, len(columns))
    if m := re.fullmatch(r"(?i)DROP (?:COLUMN )?(`[^`]+`|\S+)", clause):
        i = at(plain_name(m[1]))
        return columns[:i] + columns[i + 1 :]
    if m := re.fullmatch(rf"(?i)MODIFY (?:COLUMN )?(?P<name>`[^`]+`|\S+) (?P<type>{TYPE}){OPTIONS}{PLACE}", clause):
        i = at(plain_name(m["name"]))
        return put(columns[:i] + columns[i + 1 :], (names[i], m["type"]), m, i)
    if m := re.fullmatch(rf"(?i)CHANGE (?:COLUMN )?(?P<old>`[^`]+`|\S+) (?P<name>`[^`]+`|\S+) (?P<type>{TYPE}){OPTIONS}{PLACE}", clause):
        i = at(plain_name(m["old"]))
        return put(columns[:i] + columns[i + 1 :], (plain_name(m["name"]), m["type"]), m, i)
    if m := re.fullmatch(r"(?i)RENAME COLUMN (`[^`]+`|\S+) TO (`[^`]+`|\S+)", clause):
        i = at(plain_name(m[1]))
        return [*columns[:i], (plain_name(m[2]), columns[i][1]), *columns[i + 1 :]]
    raise ValueError(f"not supported: {clause}")


def applied(tables: dict[tuple[str, str], Columns], changes: list[tuple[str, str, str]], executed: set[str], tries: int = 3) -> tuple[dict[tuple[str, str], Columns], list[tuple[str, str]]]:
    """Tables after changes (gtid, database, statement), in order, and what could not be applied (gtid, why). A change whose gtid was
    executed is passed over; one that fails leaves the tables as they were. executed takes in what was applied.

    A statement that fails is tried again, tries times in all: a store that is out of reach may be back."""
    failed = []
    for gtid_, db, statement in changes:
        if gtid_ in executed:
            continue
        for attempt in range(tries):
            try:
                tables = one_applied(tables, db, statement)
                executed.add(gtid_)
                break
            except ValueError as fault:
                if attempt == tries - 1:
                    failed.append((gtid_, str(fault)))
    return tables, failed


def one_applied(tables: dict[tuple[str, str], Columns], db: str, statement: str) -> dict[tuple[str, str], Columns]:
    s = re.sub(r"\s+", " ", statement).strip().rstrip(";").strip()
    out = dict(tables)
    if m := re.fullmatch(r"(?i)DROP (?:DATABASE|SCHEMA) (?:IF EXISTS )?(\S+)", s):
        return {k: v for k, v in out.items() if k[0] != plain_name(m[1])}
    if re.match(r"(?i)(CREATE|ALTER) (DATABASE|SCHEMA) ", s):
        return out
    if m := re.fullmatch(r"(?i)RENAME TABLE (.*)", s):
        for pair in clauses(m[1]):
            old, new = (key_of(db, n) for n in re.split(r"(?i) TO ", pair))
            if old not in out or new in out:
                raise ValueError(f"cannot rename: {pair}")
            out[new] = out.pop(old)
        return out
    m = re.match(r"(?i)(?:CREATE (?:TEMPORARY )?TABLE (?:IF NOT EXISTS )?|DROP TABLE (?:IF EXISTS )?|ALTER TABLE |TRUNCATE (?:TABLE )?|(?:CREATE (?:UNIQUE |FULLTEXT |SPATIAL )?|DROP )INDEX \S+ ON )([^\s(]+)", s)
    if not m:
        raise ValueError(f"not supported: {s}")
    key = key_of(db, m[1])
    after = apply_ddl(out.get(key), s)
    moved = re.search(r"(?i)^ALTER TABLE \S+ (?:.*, ?)?RENAME (?:TO |AS )(\S+)$", s)
    out.pop(key, None)
    if after is not None:
        out[key_of(db, moved[1]) if moved else key] = after
    return out


def key_of(db: str, name: str) -> tuple[str, str]:
    parts = [p.strip("`\"") for p in name.split(".")]
    return (parts[0], parts[1]) if len(parts) > 1 else (db, parts[0])
