"""Rows that every operator must take: nulls, empty and long texts, repeated rows, columns whose names clash."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t) if t is not None else None) for i, t, lang, src in rows], SCHEMA)


LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(60_000))
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "the quick brown fox jumps over the lazy dog", "en", "a"), (3, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (None, "a text without an id is here too", "en", None), (None, None, None, None), (5, LONG, "en", "b"), (6, "!!! 123 \n\n ???", None, "b"),
    (7, "Le chat noir dort sur la table de la cuisine", "fr", "b"), (8, "  two  spaces \t and a tab\n", "en", "c"), (9, "\u00e9t\u00e9 \U0001f600 \u4e2d\u6587 text", "fr", "c"),
]


def odd(spark):
    """ODD, with columns that operators might use themselves."""
    return docs(spark, ODD).withColumns({c: F.lit("x") for c in ("fp", "key", "at", "h", "uid", "part", "mark", "size", "rate", "near_dup_keep", "mix_rate", "w", "n", "copies", "target", "length")})


def empty(spark):
    return odd(spark).limit(0)
