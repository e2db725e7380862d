"""A corpus pipeline of five operators: each stage works on what the one before has kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet in the shared folder and reads again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import language_id, mixing, near_dup, packing, secret_scan
from tidelog.llm.common import store, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined go: null or empty texts and those without a letter, no others. Repeated rows go or stay alike."""
    return language_id.keep_identified(docs, language_id.learn(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest doc_id, null last; equal rows are one."""
    return near_dup.keep_first(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay. A null text stays null."""
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or more. A null source is a source of its own; null and empty
    texts have size 0 and are drawn like others; rows of one doc_id are drawn alike."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, and their places in sequences. A null or empty text is the end id alone; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [("language_id", language_stage), ("near_duplicates", near_duplicate_stage), ("secrets", secret_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL has no PPM, SimHash or byte-pair encoding; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages leave of the documents in sf_dir, each stage written and read again. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
