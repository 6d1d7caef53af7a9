"""A training corpus from raw documents: quality, near duplicates, secrets, mix, packing.

Every stage takes (spark, docs, sf_dir) and returns what it keeps of docs; what it returns is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlight.llm import jaccard, mixing, packing, quality, secrets
from gridlight.llm.common import durable, release, scratch, table
from gridlight.operators.ranking import unused


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose ranking score reaches the cut; the ranking is learned from the labels outside the held-out fold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score, kept = unused(docs, "score", "kept")
    return quality.classify(docs, model, score, kept).where(F.col(kept) == 1).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id, and of its repeated rows one.

    A group without any id keeps one row for each text.
    """
    del spark, sf_dir
    groups = jaccard.join(docs)
    unit, mark = unused(docs, "unit", "mark")
    own = F.struct("doc_id").alias(unit)  # a struct can be joined where its part is null
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(own).distinct()
    kept = docs.withColumn(unit, own).join(stay, unit, "left_semi")
    return kept.withColumn(mark, F.xxhash64("text")).dropDuplicates([unit, mark]).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    del spark, sf_dir
    return secrets.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target shares: documents are repeated, cut or left out."""
    del spark, sf_dir
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 1024 tokens."""
    del spark, sf_dir
    return packing.pack(docs)


STAGES = [
    ("quality ranking", good_documents),
    ("near duplicates", one_of_each),
    ("secrets", without_secrets),
    ("source mix", mixed_sources),
    ("packing", packed_sequences),
]

#: SQL can't express the ranking, the tokenizer or the packing; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):  # a stage's own tables go once its rows are written, and so do the rows of the stage before
            made = durable(stage(spark, docs, sf_dir), f"stage{k}", keep=True)
        release(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
