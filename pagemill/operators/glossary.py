"""Glossaries across batches, scopes and documents, and the keys under which their results are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .batching import merge_terms

# How many automatic terms a glossary takes, and the separator of a term's fields.
MAX_TERMS, FIELD = 50, "\u0001"


def union_scopes(terms: DataFrame) -> DataFrame:
    """Terms (key, ord, source, abbreviation) of a document's scopes as one list: all automatic, the first of a name stays."""
    return merge_terms(terms.withColumn("origin", F.lit("auto"))).drop("origin")


def batch_glossary(relevant: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, source, target, abbreviation): of a batch's relevant terms the last of every name.

    ``relevant`` has ``block`` and ``place``, the order of units in the batch and of terms in a unit.
    """
    last = F.max_by(F.struct("source", "target", "abbreviation"), F.struct("block", "place")).alias("t")
    return relevant.groupBy(*keys, F.lower("source").alias("name")).agg(last).select(*keys, "name", "t.*")


def rendering(target: Column, abbreviation: Column) -> Column:
    """A term's rendering, its abbreviation appended in full-width brackets unless it holds it."""
    return F.when(abbreviation.isNull() | F.contains(target, abbreviation), target).otherwise(F.concat(target, F.lit("（"), abbreviation, F.lit("）")))


def valid_terms(terms: DataFrame, generic: list[str], most: int = MAX_TERMS) -> DataFrame:
    """Replies (key, ord, source, target, abbreviation) that are terms: well formed, the first of a name, ``most`` a key."""
    source, target = text.collapse(F.col("source")), text.collapse(F.col("target"))
    cleaned = terms.withColumn("source", source).withColumn("target", target).withColumn("v_name", F.lower("source"))
    formed = F.length("source").between(2, 80) & F.regexp_like("source", F.lit("[A-Za-z]")) & F.length("target").between(1, 60) & F.regexp_like("target", F.lit("[一-鿿]"))
    kept = cleaned.where(formed & ~F.col("v_name").isin(generic)).withColumn("v_n", F.row_number().over(Window.partitionBy("key", "v_name").orderBy("ord"))).where("v_n = 1")
    own = F.when(F.lower("abbreviation") != F.col("v_name"), F.col("abbreviation"))
    ranked = kept.withColumn("v_n", F.row_number().over(Window.partitionBy("key").orderBy("ord"))).where(F.col("v_n") <= most)
    return ranked.withColumn("abbreviation", own).drop("v_name", "v_n")


def list_hash(terms: DataFrame, key: str) -> DataFrame:
    """(key, term_hash): a hash of a list of terms that does not depend on their order."""
    line = F.concat(F.lower("source"), F.lit(FIELD), F.col("target"), F.lit(FIELD), F.coalesce("abbreviation", F.lit("")))
    return terms.groupBy(key).agg(text.fnv1a(F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("term_hash"))


def fingerprints(blocks: DataFrame, key: str, order: str) -> DataFrame:
    """(key, fingerprint): ``count:characters:hash`` of a document's texts in order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: s["text"])
    per = blocks.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), texts.alias("texts"))
    return per.select(key, F.concat_ws(":", F.col("n").cast("string"), F.col("chars").cast("string"), text.fnv1a(F.array_join("texts", "\n"))).alias("fingerprint"))


def keep_newest(memory: DataFrame, fresh: DataFrame) -> DataFrame:
    """Terms by (document, scope): a scope's newest list replaces what was kept, other scopes stay."""
    renewed = fresh.select("document", "scope").distinct()
    return memory.join(renewed, ["document", "scope"], "left_anti").unionByName(fresh)
