"""The registered query of each operator, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, html_mincut, jaccard, lm, merkle, negatives, oracle, pii, quality, secrets, token_counts, urls
from .common import table

PUBLIC = public_tokenizers.path


#: (verdict, host, path)
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: A deployment passes its own secret; the query needs one that stays.
PII_KEY = b"documents, first release"


def op1_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extract(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), size=4, percent=85)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_texts(table(spark, sf_dir, "documents"), PUBLIC("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), PUBLIC("word_bpe_49k.json"), limit=2048)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = F.lit("\\### Assistant: </turn> ok")
    own = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), hard.alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digest_conversations(chat.format_windows(turns))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), PUBLIC("byte_bpe_multi_50k.tiktoken"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_mincut,
        op2_quality_rules,
        op3_url_filters,
        op4_jaccard_join,
        op5_byte_bpe,
        op6_token_counts,
        op7_decontamination,
        op8_pii,
        op9_chat_format,
        op10_lm_scoring,
        op11_merkle_manifest,
        op12_secret_scans,
        op13_hard_negatives,
    )
}

ORACLE_SQL = {
    "op2_quality_rules": oracle.quality_rules(),
    "op3_url_filters": oracle.url_filters(URL_RULES),
    "op4_jaccard_join": oracle.jaccard_join(4, 85),
    "op7_decontamination": oracle.decontamination(),
    "op9_chat_format": oracle.chat_format(512, 256),
    "op11_merkle_manifest": oracle.merkle_manifest(),
    "op13_hard_negatives": oracle.hard_negatives(),
}
