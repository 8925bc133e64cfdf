"""The corpus pipeline: language ID, near-copy removal, passage removal, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontam, langid, packing, simhash, substrings
from ledgerloom.llm.common import fold, ship_package, stored, table
from ledgerloom.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose main language is a learned one with at least half of their letters; null and letterless texts go."""
    ship_package(spark)
    return langid.in_known_language(docs, langid.fit(docs.where(~fold("doc_id", 1, 3))))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal or share 0.8 of their five-word shingles: the smallest id."""
    ship_package(spark)
    return simhash.drop_near_duplicates(docs, k=5, similarity=0.8)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words and more that a document of smaller id has; rows left empty go."""
    ship_package(spark)
    return substrings.documents_without_repeats(docs, window=50)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark window of ten words occurs."""
    ship_package(spark)
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, packed into sequences of at most 4096 tokens."""
    ship_package(spark)
    return packing.pack(docs, tokenizer_path(), capacity=4096, end_id=2)


STAGES = [("language_id", language), ("simhash_near_dedup", near_copies), ("substring_dedup", passages), ("decontamination", decontaminate), ("packing", pack)]

#: Learned language decisions and tokenization are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
