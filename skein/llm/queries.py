"""The registered queries of the training-data operators, and their oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import ann, bpe, decontaminate, html_text, language_id, maxent_lm, simhash, token_counts, tool_calls, url_filter
from skein.llm.common import table

def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts = language_id.training_sample(docs, language_id.held_out(3) != 1)
    out = language_id.identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), texts)
    return out.select("doc_id", (language_id.held_out(3) == 1).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op2_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return bpe.encode_decode(docs, path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(table(spark, sf_dir, "documents"), language_id.held_out(10) == 0)


def op4_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return token_counts.count_tokens(docs, path or public_tokenizers.path("word_bpe_49k.json"), 2048)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link(table(spark, sf_dir, "conversations"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_byte_bpe, op3_maxent_lm, op4_token_counts, op5_ann, op6_simhash, op7_html_text, op8_tool_calls, op9_url_filter, op10_decontaminate)}


def oracle_sql() -> dict[str, str]:
    """What SQL can express; the others are held against brute force, libraries or held-out texts in the tests."""
    return {"op9_url_filter": url_filter.judge_sql()}
