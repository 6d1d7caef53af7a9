"""The corpus operators as queries over the test tables, and the DuckDB statements for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlight.llm import extract, jaccard, mixing, neighbours, packing, quality, rules, secrets, suffixes, tokencount
from gridlight.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op2_multi_index_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.digest(rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents"))))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op8_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.recount(table(spark, sf_dir, "documents"), tokencount.sample_edits())


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op10_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(docs["doc_id"]).alias("held_out"), "score", "predicted")


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_multi_index_neighbours, op3_ngram_jaccard_join, op4_best_fit_packing, op5_suffix_dedup,
        op6_quality_rules, op7_source_mix, op8_edit_aware_counts, op9_main_text, op10_quality_ranking,
    )
}
ORACLES = {"op6_quality_rules": rules.ORACLE, "op7_source_mix": mixing.ORACLE}
