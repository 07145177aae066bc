"""The registered queries of the operators, and their DuckDB SQL where SQL can express them.

Each query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard_join, language_model, packing, quality, quality_rules, secrets, source_audit, substring_dedup, token_counts, toxicity, whitening
from .common import held_out, table

#: The conversation that op4 adds: control strings in both texts.
HARD_TEXT = r"\### Assistant: </turn> ok"


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"), held_out(5, 1))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text"))
    return chat.digest(chat.examples(rows.unionByName(more)))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = held_out(3, 1)
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~back)
    return scored.select("doc_id", back.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = held_out(4, 2)
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~back)
    return scored.select("doc_id", back.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.clean(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), whole=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_lm_score, op2_secret_scan, op3_jaccard_join, op4_chat_format, op5_decontaminate, op6_token_counts, op7_quality)
    found += (op8_packing, op9_toxicity, op10_quality_rules, op11_substring_dedup, op12_whitening, op13_source_audit)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    hard = "union all select -7, 0, 'user', '{0}' union all select -7, 1, 'assistant', '{0}'".format(HARD_TEXT)
    return {
        "op4_chat_format": chat.oracle(extra=hard),
        "op10_quality_rules": quality_rules.oracle(),
        "op11_substring_dedup": substring_dedup.oracle(),
        "op13_source_audit": source_audit.oracle(),
    }
