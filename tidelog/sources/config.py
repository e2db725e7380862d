"""Options from `key=value` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse(text: str) -> dict[str, str]:
    """Lines that start with # or ; are remarks; keys are lower-cased; the last of a key wins."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#;" and "=" in line:
            key, value = line.split("=", 1)
            out[key.strip().lower()] = value.strip()
    return out


def check_options(split: bool, clean: bool, merge: bool) -> None:
    """Splitting excludes cleaning and merging."""
    if split and (clean or merge):
        raise ValueError("splitting can't be combined with cleaning or merging")


def options(texts: DataFrame, column: str) -> DataFrame:
    """texts with key, value: a row for each option of each text, by the rules of parse()."""
    line = F.trim(F.col("_line"))
    rows = texts.select("*", F.posexplode(F.split(column, "\n")).alias("_n", "_line")).filter(~line.rlike("^[#;]") & line.contains("="))
    keyed = rows.withColumns({"key": F.lower(F.trim(F.substring_index(line, "=", 1))), "value": F.trim(F.regexp_replace(line, "^[^=]*=", ""))})
    return keyed.groupBy(*texts.columns, "key").agg(F.max_by("value", "_n").alias("value"))


def below(found: dict[str, str], prefix: str) -> dict[str, str]:
    """Options whose keys start with a prefix, without it."""
    return {k[len(prefix) :]: v for k, v in found.items() if k.startswith(prefix)}
