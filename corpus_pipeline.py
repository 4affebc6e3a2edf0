"""A training-corpus pipeline over ``documents``: five stages, each over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.deploy import ship
from corpusloom.llm import bpe, decontaminate, langid, ngram_join, quality
from corpusloom.llm.common import ROW_GROUP, intermediates, release, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from ``labels``, rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go."""
    ship(spark)
    return langid.keep_known(docs)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id."""
    ship(spark)
    return ngram_join.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by ``benchmark`` go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    ship(spark)
    return bpe.encode_decode(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256"), most=100_000)  # stages share a worker's memory


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near-duplicates", duplicate_stage),
    ("decontamination", benchmark_stage),
    ("tokens", token_stage),
]

#: Learned models and BPE cannot be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written and reread; what a stage made on its way, and the stage before it, go when it is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        with intermediates(spark):
            stage(spark, docs, sf_dir).write.options(**ROW_GROUP).parquet(path)
        docs = spark.read.parquet(path)
        if before:
            release(spark, before)
        before = path
    return docs
