"""The corpus pipeline: documents to token ids, each stage over all that the stage before it kept.

An empty table passes through every stage; other columns of any name are kept
by all stages but the last, which returns what it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lociforge.llm import jaccard, mixing, pieces, quality
from lociforge.llm.common import table, written


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts are scored as texts without words; equal texts have
    equal scores; repeated rows stay or go together; without labels all stay.
    """
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest id: five-word shingles, similarity 0.8 or more.

    Rows without words (null, empty) and rows without an id stay; of rows that
    repeat an id and a text one stays.
    """
    return jaccard.distinct_documents(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks.

    Null and empty texts count no words; a null source is a source, the last;
    repeated rows are rows of their own.
    """
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and piece ids of every row; null and empty texts have no pieces, repeated rows and null ids stay."""
    return pieces.encode(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality", drop_poor), ("near_copies", drop_copies), ("mix", mix_sources), ("pieces", tokenize)]

#: SQL cannot express the fitted classifier or the piece encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
