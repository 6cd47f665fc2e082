"""The corpus operators bound to the test tables, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnokit.llm.decontam import find_contamination
from limnokit.llm.html_text import extract_text
from limnokit.llm.kneser_ney import score_documents
from limnokit.llm.near_dedup import near_duplicates
from limnokit.llm.oracle import CONTAMINATION, KNESER_NEY, KNESER_NEY_TRIPLES, NEAR_DUPLICATES, PREFIX_TRIE, REPEATS, TURN_REPAIR
from limnokit.llm.packing import pack_documents
from limnokit.llm.pii import find_personal_data
from limnokit.llm.prefix_trie import prefix_trie, regrouped, turn_rows
from limnokit.llm.quality import measure_quality
from limnokit.llm.repeats import remove_repeats
from limnokit.llm.secrets import dictionary_from_ranks, scan_secrets
from limnokit.llm.subwords import tokenizer_path
from limnokit.llm.token_counts import count_tokens
from limnokit.llm.token_store import store_tokens
from limnokit.llm.turn_repair import damaged, repair_conversations


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_documents(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), shingle=3, percent=85)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_text(pages).withColumn("text_sha256", F.sha2("text", 256))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir)).drop("kept_text")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = dictionary_from_ranks(spark, "file://" + tokenizer_path("byte_bpe_50k.tiktoken"))
    found = scan_secrets(_documents(spark, sf_dir), dictionary)
    return found.select(
        "doc_id", "ordinal", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("n_chars"), F.round("probability", 6).alias("probability"), "is_secret"
    )


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_tokens(_documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_quality(_documents(spark, sf_dir))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(regrouped(turn_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op13_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(_documents(spark, sf_dir)).drop("perplexity", "triple_score")
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op13_kneser_ney_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the score by triples of words."""
    scored = score_documents(_documents(spark, sf_dir)).drop("perplexity", "score").withColumnRenamed("triple_score", "score")
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_personal_data, op2_decontamination, op3_near_dedup, op4_token_counts, op5_html_text, op6_repeats, op7_secrets, op8_token_store, op9_packing, op10_quality, op11_turn_repair, op12_prefix_trie, op13_kneser_ney, op13_kneser_ney_triples)
} | {"pipeline": corpus_pipeline.run}
LLM_ORACLE: dict[str, str] = {
    "op2_decontamination": CONTAMINATION,
    "op3_near_dedup": NEAR_DUPLICATES,
    "op6_repeats": REPEATS,
    "op11_turn_repair": TURN_REPAIR,
    "op12_prefix_trie": PREFIX_TRIE,
    "op13_kneser_ney": KNESER_NEY,
    "op13_kneser_ney_triples": KNESER_NEY_TRIPLES,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
