"""The corpus pipeline: documents in, addressable token ids out.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's docs.  ORACLE_SQL is None because the first stage fits a model.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontaminate, mixing, quality, simhash, token_codes
from pagemill.llm.common import staged, table

VOCABULARY = "word_bpe_49k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, as they came.

    Null and empty texts are scored like any other; repeated rows stay or go together; very long texts are read
    whole; other columns may have any name; no documents give none.
    """
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model = quality.train(slim, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is 0.8 or more alike in five-word shingles: the one with the least doc_id.

    A null doc_id is less than any other; repeated rows are one document; null and empty texts are one group; very
    long texts are read whole; other columns may have any name; no documents give none.
    """
    return simhash.drop_similar(docs, shingle=5, similarity=0.8).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    Null and empty texts hold none and stay; repeated rows stay or go together; very long texts are read whole;
    other columns may have any name; without items or documents nothing goes.
    """
    found = staged(decontaminate.hits(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "text_key"), "leaks")
    return decontaminate.without(docs, found).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Null and empty texts have no words and are not taken; a null source is one of its own; rows that repeat a doc_id
    are taken alike; other columns may have any name; no documents give none.
    """
    return mixing.mixed(docs).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ascending doc_id order, read back from the written codes.

    Null and empty texts have the end id alone; rows that repeat a doc_id follow one another; very long texts are
    encoded whole; other columns are ignored; no documents give none.
    """
    return token_codes.read_codes(token_codes.write_codes(docs, public_tokenizers.path(VOCABULARY)))


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("benchmark_leaks", drop_leaks),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
