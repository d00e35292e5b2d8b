"""Corpus pipeline: STAGES applied in order to ``documents``, each written as Parquet and read again.

1. quality_rules: documents that the quality rules reject go.
2. line_dedup: repeated runs of three lines, or of fewer that weigh 20 words, are deleted from the texts; a document that loses its last word goes.
3. ngram_join: one document of each group of near-duplicates stays, that with the smallest id.
4. decontamination: documents that hold a benchmark item go.
5. packing: the texts are tokenized, cut and packed; a row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitrine.llm import decontamination, line_dedup, ngram_join, packing, quality_rules
from vitrine.llm.runtime import materialize, prepare

#: Byte-pair tokens can't be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_rules.keep(docs, quality_rules.trusted(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return line_dedup.clean(docs, least=line_dedup.LEAST, emptied=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ngram_join.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_join", near_duplicates), ("decontamination", leaks), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
