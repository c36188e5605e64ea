"""One query per operator of this subpackage, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from . import chat_format, decontaminate, fingerprint, html_extract, mixing, quality, simhash, substring_dedup, suffix_dedup, token_codes
from .common import table


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedupe(table(spark, sf_dir, "documents")).drop("kept")


def op3_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op4_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return token_codes.read_codes(token_codes.write_codes(table(spark, sf_dir, "documents"), vocabulary, end_id=1))


def op6_prefix_filter_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_seed_extend_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedupe(table(spark, sf_dir, "documents")).drop("kept")


def op8_template_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, shingle=3)


def op10_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.with_control(spark, table(spark, sf_dir, "conversations"))
    return chat_format.digest(chat_format.format_chat(turns))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pareto_mix, op2_suffix_array_dedup, op3_multiset_fingerprint, op4_nb_svm_quality, op5_token_codes, op6_prefix_filter_decontamination, op7_seed_extend_dedup, op8_template_extract, op9_simhash_ball, op10_prefix_target_chat)}


def oracle_sql() -> dict[str, str]:
    return {"op1_pareto_mix": mixing.ORACLE, "op6_prefix_filter_decontamination": decontaminate.ORACLE, "op7_seed_extend_dedup": substring_dedup.ORACLE, "op10_prefix_target_chat": chat_format.ORACLE}
