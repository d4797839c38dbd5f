"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import chat, decontam, dedup, langid, licenses, packing, quality, secret_scan, sharding, tokencount
from strandline.llm.common import native_table, table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    docs = lambda op: lambda spark, d: op(table(spark, d, "documents"))
    native = lambda op: lambda spark, d: op(native_table(spark, d, "documents"))
    return {
        "op1_template_decontamination": lambda spark, d: decontam.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("row_key"),
        "op2_setsketch_near_duplicates": lambda spark, d: dedup.near_duplicates(table(spark, d, "documents")).drop("row_key"),
        "op3_variable_best_fit": docs(packing.best_fit_bins),
        "op4_byte_prefix_shards": native(sharding.shards),
        "op5_adaptive_quality": native(quality.quality_report),
        "op6_license_set_join": docs(licenses.license_scan),
        "op7_viterbi_language": docs(langid.identify),
        "op8_resynchronised_token_counts": docs(tokencount.token_counts),
        "op9_trigram_secret_scan": docs(secret_scan.secret_digest),
        "op10_reply_tree_chat": lambda spark, d: chat.chat_digest(table(spark, d, "conversations")),
    }


def oracle_sql() -> dict[str, str]:
    """Of those that SQL can express; the others have brute-force tests."""
    return {
        "op2_setsketch_near_duplicates": dedup.dedup_sql(),
        "op4_byte_prefix_shards": sharding.shards_sql(),
        "op5_adaptive_quality": quality.quality_sql(),
        "op6_license_set_join": licenses.license_sql(),
        "op10_reply_tree_chat": chat.chat_sql(),
    }
