"""One query per operator: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, covering_simhash, html_extract, line_quality, line_templates, maxent_lm, oracles, substring_dedup, suffix_decontamination, temperature_mixing, token_store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.store_documents(table(spark, sf_dir, "documents"), token_store.vocabulary(), end_id=0)
    return store.verified()


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), keep_text=False, window=35)
    return found.drop("kept_text")


def op3_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score_documents(table(spark, sf_dir, "documents"), folds=10)


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temperature_mixing.mix(table(spark, sf_dir, "documents"), max_repeats=2.0)


def op5_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = covering_simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_templates.line_templates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    read = chat_format.read_back(chat_format.format_chats(turns.unionByName(extra)))
    listing = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listing, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_quality.line_quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.size("gone_lines").alias("n_common_lines"), "words_left")


def op10_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_maxent_lm": op3_maxent_lm,
    "op4_temperature_mixing": op4_temperature_mixing,
    "op5_covering_simhash": op5_covering_simhash,
    "op6_line_templates": op6_line_templates,
    "op7_chat_format": op7_chat_format,
    "op8_html_extract": op8_html_extract,
    "op9_line_quality": op9_line_quality,
    "op10_suffix_decontamination": op10_suffix_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op4_temperature_mixing": oracles.TEMPERATURE_MIXING,
    "op7_chat_format": oracles.CHAT_FORMAT,
    "op9_line_quality": oracles.LINE_QUALITY,
    "op10_suffix_decontamination": oracles.DECONTAMINATION,
}
