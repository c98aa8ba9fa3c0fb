"""The corpus pipeline: language ID, near-dedup, decontamination, secrets, packing.

Each stage is a function of (spark, docs, sf_dir); its DataFrame is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, language_id, near_dedup, packing, secret_scan
from millrace.llm.common import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can't be told go: null or letterless texts, and those that are likely of no learned language.

    Repeated rows and null ids are judged like any other row; an empty table stays empty.
    """
    return language_id.keep_identified(docs, language_id.train(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, told by doc_id and text: of the least doc_id, null last.

    Null texts count as empty, and those are copies of each other; an empty table stays empty.
    """
    return near_dedup.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts, repeated rows and null ids stay like any other, an empty table stays empty."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; every row stays, null texts stay null, an empty table stays empty."""
    return secret_scan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' token pieces, packed into sequences; a null or empty text is its end id alone, repeated rows each have pieces, an empty table has none."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", deduplicate),
    ("decontamination", decontaminate_benchmark),
    ("secret_scan", scan_secrets),
    ("packing", pack),
]

#: SQL cannot express the stages; tests hold each against a brute-force version, and run() against the stages in turn.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
