"""Corpus pipeline: language ID, near-duplicates, decontamination, tokenisation."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, decontaminate, language_id, simhash
from skein.llm.common import checkpoint, table

#: A row's key: two hashes of all its columns, so that rows without doc_id, or with one that repeats, are told apart.
KEY = ("_key_a", "_key_b")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({KEY[0]: F.xxhash64(F.lit(1), *docs.columns), KEY[1]: F.xxhash64(F.lit(2), *docs.columns)})


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; ``und`` (null text or no letters) goes. Learns as op1 does."""
    texts = language_id.training_sample(docs, language_id.held_out(3) != 1)
    judged = language_id.identify(docs, texts)
    return judged.where(F.col("lang_pred") != "und").select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one of the smallest doc_id.

    A document without doc_id stays if its component has none with one. Equal doc_ids are told apart by the
    rows' contents, and of rows that repeat in all columns one stays.
    """
    rows = keyed(docs)
    judged = simhash.components(rows, KEY)
    kept = judged.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)).alias("m")).select(*[F.col(f"m.{k}").alias(k) for k in KEY])
    return rows.join(kept, [*KEY], "left_semi").dropDuplicates([*KEY]).select(*docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole or nearly. Documents without doc_id are judged like others; repeated rows stay."""
    rows = keyed(docs)
    leaks = decontaminate.find_leaks(rows, table(spark, sf_dir, "benchmark"), KEY).select(*KEY).distinct()
    return rows.join(leaks, [*KEY], "left_anti").select(*docs.columns)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars with n_tokens, ids_sha256 and decoded_sha256 of each whole text, a row for each row."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source", "n_chars"])


STAGES = [("language_id", known_language), ("simhash", without_near_duplicates), ("decontaminate", without_leaks), ("byte_bpe", tokenized)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order. What a stage keeps is checkpointed, so that the next one's jobs don't compute it again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, checkpoint(docs) if i else docs, sf_dir)
    return docs
