"""Row images: from events to changes, a row for each column, and typed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import operation


def images(kind: Column) -> Column:
    """Inserts have an image after, deletes one before, updates both."""
    return F.when(kind.isin(30, 23), F.array(F.lit("after"))).when(kind.isin(32, 25), F.array(F.lit("before"))).when(kind.isin(31, 24), F.array(F.lit("before"), F.lit("after"))).otherwise(F.array().cast("array<string>"))


def decoder(kind: Column) -> Column:
    """Which reader an event's body goes to, by its type; `header` for types without one."""
    from ..sources.binlog import DECODERS

    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DECODERS.items() for x in kv]), kind.cast("int")), F.lit("header"))


def changes(rows: DataFrame) -> DataFrame:
    """rows (row keys, event_type) with op and image, a row for each image."""
    return rows.withColumn("op", operation(F.col("event_type"))).withColumn("image", F.explode(images(F.col("event_type"))))


def flatten(rows: DataFrame, keys: list[str], columns: dict[str, tuple[Column, str]]) -> DataFrame:
    """keys, column_name, column_type, value, is_null: a row for each column. Null values are empty texts marked as null."""
    cells = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(t).alias("column_type"), v.cast("string").alias("v")) for n, (v, t) in columns.items()])
    out = rows.select(*keys, F.explode(cells).alias("c"))
    return out.select(*keys, "c.column_name", "c.column_type", F.coalesce("c.v", F.lit("")).alias("value"), F.col("c.v").isNull().cast("long").alias("is_null"))


def null_bitmap(columns: list[Column]) -> Column:
    """Bit i is set if column i is null."""
    return sum((F.when(c.isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(columns)), F.lit(0).cast("long"))


def typed(value: Column, mysql_type: str) -> Column:
    """A text value as its type; null where it cannot be read. unsigned 64-bit numbers are decimal(20,0)."""
    name, unsigned = mysql_type.split("(")[0].split()[0].lower(), "unsigned" in mysql_type.lower()
    whole = {"tinyint": ("tinyint", "smallint"), "smallint": ("smallint", "int"), "mediumint": ("int", "int"), "int": ("int", "bigint"), "bigint": ("bigint", "decimal(20,0)")}
    if name in whole:
        return value.try_cast(whole[name][unsigned])
    if name in ("float", "double"):
        return value.try_cast(name)
    if name == "decimal":
        return value.try_cast(mysql_type.split()[0])
    if name == "date":
        return F.try_to_date(F.translate(value, ":", "-"), "yyyy-MM-dd")
    if name == "timestamp":
        return F.timestamp_millis(value.try_cast("bigint"))
    if name == "datetime":
        whole_s, frac = F.substring_index(value, ".", 1), F.regexp_extract(value, r"\.(\d+)$", 1)
        return F.concat(whole_s, F.lit("."), F.lpad(F.when(frac == "", "0").otherwise(frac), 6, "0")).try_cast("timestamp_ntz")
    if name == "year":
        return value.try_cast("int")
    if name == "enum":
        return F.element_at(F.array(*[F.lit(x.strip("' ")) for x in mysql_type[mysql_type.index("(") + 1 : -1].split(",")]), value.try_cast("int"))
    if name == "set":
        labels = [x.strip("' ") for x in mysql_type[mysql_type.index("(") + 1 : -1].split(",")]
        return F.concat_ws(",", *[F.when(value.try_cast("bigint").bitwiseAND(1 << i) != 0, x) for i, x in enumerate(labels)])
    if name == "bit":
        return value.try_cast("decimal(20,0)")
    return value


def named_columns(ordinals: DataFrame, schema: DataFrame) -> DataFrame:
    """Values by place (database_name, table_name, ordinal) with the names and types of a schema table."""
    return ordinals.join(schema, ["database_name", "table_name", "ordinal"])


def table_map_lookup(ev: DataFrame) -> DataFrame:
    """Row events with the table that the latest map of their table_id in the same transaction names."""
    from pyspark.sql import Window

    w = Window.partitionBy("trans_seq_no", "table_id").orderBy("ev_idx").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("event_type") == 19, F.struct("database_name", "table_name")), ignorenulls=True).over(w)
    return ev.withColumn("map", seen).filter(F.col("event_type").isin(30, 31, 32)).select("trans_seq_no", "ev_idx", "table_id", F.col("map.database_name").alias("map_db"), F.col("map.table_name").alias("map_table"))
