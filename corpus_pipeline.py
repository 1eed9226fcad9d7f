"""From raw documents to token ids: quality rules, near duplicates, benchmark passages, mixing, token store.

Every stage works on what the one before it kept; ``run`` writes each as Parquet
in the shared folder and reads it again.  SQL can't express the hashing stages,
so there is no oracle; the tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossweave.llm import covering_simhash, line_quality, suffix_decontamination, temperature_mixing, token_store
from glossweave.llm.staging import Staging, scope


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines common to their source."""
    return line_quality.apply_line_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return covering_simhash.apply_near_duplicates(docs, shingle=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return suffix_decontamination.apply_decontamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, those of small sources up to twice; the order is the store's, which goes by id."""
    return temperature_mixing.apply_mixing(docs, max_repeats=2.0)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per stored document, read back from the store."""
    return token_store.store_documents(docs, token_store.vocabulary(), end_id=0).verified()


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    staging = Staging(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        # what a stage's operators staged goes when its result is written, and then its input
        with scope():
            docs = staging.write(stage(spark, docs, sf_dir), name)
        staging.keep(name)
    return STAGES[-1][1](spark, docs, sf_dir)
