"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Every source gets a target in words by weighted water filling under a cap of ``max_copies`` times its
size.  A document's expected copies e are its source's target over the source's size (scaled by an
optional appetite column).  floor(e) copies are certain; for the rest the document has inclusion
probability lambda = e - floor(e), and documents are ranked by u/(1-u) over lambda/(1-lambda), where
u is a uniform number hashed from the seed and doc_id.  The sample is fixed in size (in words): ranks
are taken until the source's remaining target is met, the crossing document only if at least half of
it fits.

The cut rank of each source is found by a radix search over the 48-bit rank, 12 bits at a time, each
step one partially aggregated sum per (source, digit): no source is ever sorted or gathered, however
much of the corpus it holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, staged

RANK_BITS = 48
STEP_BITS = 12


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WS}]+"), lambda w: w != "")).cast("long")


def source_targets(sizes: DataFrame, share: float, weights: tuple[int, ...], max_copies: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources are in code point order, null last, and take the weights in turn.  The water level is
    solved in closed form over the sources in order of cap to weight: one row per source, so the
    unpartitioned window reads as many rows as there are sources.
    """
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(by_name) - 1
    weight = reduce(lambda c, i: c.when(turn % len(weights) == i, F.lit(weights[i])), range(1, len(weights)), F.when(turn % len(weights) == 0, F.lit(weights[0])))
    by_fill = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = (
        sizes.withColumn("weight", weight.cast("long"))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("full", F.coalesce(F.sum(F.col("source_size") * max_copies).over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(rest))
        # full sources come first in this order; the first that is not full sets the level
        .withColumn("is_full", F.col("source_size") * max_copies * F.col("open") <= F.col("weight") * (F.col("budget") - F.col("full")))
        .withColumn("level_full", F.min(F.when(~F.col("is_full"), F.col("full"))).over(everything))
        .withColumn("level_open", F.max(F.when(~F.col("is_full"), F.col("open"))).over(everything))
    )
    level = F.col("weight") * (F.col("budget") - F.col("level_full")) / F.col("level_open")
    return filled.select("source", "source_size", F.when(F.col("is_full"), (F.col("source_size") * max_copies).cast("double")).otherwise(level).alias("target"))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) with 48 bits, the same in every run."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 12), 16, 10)
    return (digits.cast("double") + 0.5) / float(1 << RANK_BITS)


def pareto_rank(u: Column, inclusion: Column) -> Column:
    """Random odds over inclusion odds, folded into [0, 2^48); null where nothing can be included."""
    q = (u * (F.lit(1.0) - inclusion)) / ((F.lit(1.0) - u) * inclusion)
    return F.when(inclusion > 0, F.floor(q / (F.lit(1.0) + q) * float(1 << RANK_BITS)).cast("long"))


def plan_mix(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), max_copies: int = 2, seed: int = 20, appetite: str | None = None) -> DataFrame:
    """One row per source: m_source, source_size, target, pull, cut_rank, cut_taken."""
    measure = F.col(appetite).cast("double") if appetite else F.lit(1.0)
    slim = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), measure.alias("appetite")), "mix")
    per_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("appetite")).alias("pull"))
    goal = source_targets(per_source.select("source", "source_size"), share, weights, max_copies)
    goal = goal.join(per_source.select(F.col("source").alias("s_"), "pull"), F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    goal = staged(goal.withColumnRenamed("source", "m_source"), "goal")
    whole, rank = _whole_and_rank(F.col("doc_id"), F.col("appetite"), max_copies, seed)
    ranked = slim.join(goal, F.col("source").eqNullSafe(F.col("m_source"))).select("source", "size", "target", whole.alias("whole"), rank.alias("rank"))
    cut = cut_ranks(staged(ranked, "ranked")).withColumnRenamed("source", "c_source")
    return staged(goal.join(cut, F.col("m_source").eqNullSafe(F.col("c_source")), "left").drop("c_source"), "plan")


def _whole_and_rank(doc_id: Column, appetite: Column, max_copies: int, seed: int) -> tuple[Column, Column]:
    """Certain copies, and the Pareto rank for one more, from a row joined to its source's plan."""
    expected = F.least(F.when(F.col("pull") > 0, F.col("target") * appetite / F.col("pull")).otherwise(F.lit(0.0)), F.lit(float(max_copies)))
    whole = F.floor(expected).cast("long")
    return whole, pareto_rank(uniform(doc_id, seed), expected - whole)


def with_copies(docs: DataFrame, plan: DataFrame, max_copies: int = 2, seed: int = 20, appetite: str | None = None) -> DataFrame:
    """``docs`` and how many copies the mix takes; a source's plan is one small row, so texts stay where they are."""
    whole, rank = _whole_and_rank(F.col("doc_id"), F.col(appetite).cast("double") if appetite else F.lit(1.0), max_copies, seed)
    extra = (rank < F.col("cut_rank")) | ((rank == F.col("cut_rank")) & F.col("cut_taken"))
    copies = (whole + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0)).cast("int")
    return docs.join(plan, F.col("source").eqNullSafe(F.col("m_source")), "left").withColumn("copies", F.coalesce(copies, F.lit(0)))


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), max_copies: int = 2, seed: int = 20, appetite: str | None = None) -> DataFrame:
    """``docs`` (doc_id, source, text, ...) -> doc_id, source, size, source_size, target, taken, copies.

    One row per input row.  Null text has size 0 and takes nothing; a null source is a source of its
    own, last in order; rows that repeat a doc_id share its random number and are taken or left
    together; an empty table gives an empty result; other columns are ignored.
    """
    plan = plan_mix(docs, share, weights, max_copies, seed, appetite)
    extra = [F.col(appetite).alias("m_appetite")] if appetite else []
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *extra)
    taken = with_copies(slim, plan, max_copies, seed, "m_appetite" if appetite else None)
    return taken.select("doc_id", "source", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, whatever their names, each as often as it is taken.

    Null and empty texts have size 0 and are never taken; rows that repeat a doc_id are taken or left together; texts of
    any length are counted whole; an empty table gives an empty result.
    """
    plan = plan_mix(docs, **options)
    kept = {k: v for k, v in options.items() if k in ("max_copies", "seed", "appetite")}
    taken = with_copies(docs.select("doc_id", "source", F.struct("*").alias("m_row"), *([options["appetite"]] if options.get("appetite") else [])), plan, **kept)
    return taken.where("copies > 0").select("m_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("m_copy")).select("m_row.*")


def cut_ranks(ranked: DataFrame) -> DataFrame:
    """(source, cut_rank, cut_taken): ranks below the cut are taken, the cut itself if cut_taken."""
    remaining = (F.first("target") - F.sum(F.col("size") * F.col("whole"))).alias("remaining")
    cut = ranked.groupBy("source").agg(remaining).select(F.col("source").alias("c_source"), "remaining", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    rows = ranked.where(F.col("rank").isNotNull()).select("source", "rank", "size")
    for shift in range(RANK_BITS - STEP_BITS, -1, -STEP_BITS):
        inside = rows.join(cut, F.col("source").eqNullSafe(F.col("c_source")) & (F.shiftright("rank", shift + STEP_BITS) == F.col("prefix")))
        digits = inside.groupBy("source", "remaining", "before", F.shiftright("rank", shift).alias("prefix")).agg(F.sum("size").alias("size"))
        order = Window.partitionBy("source").orderBy("prefix")
        upto = digits.withColumn("upto", F.col("before") + F.sum("size").over(order))
        last = Window.partitionBy("source").orderBy(F.col("prefix").desc())
        crossing = upto.withColumn("crosses", (F.col("upto") >= F.col("remaining")) | (F.row_number().over(last) == 1))
        first = F.min_by(F.struct("prefix", "upto", "size"), "prefix").alias("c")
        found = crossing.where("crosses").groupBy("source", "remaining").agg(first)
        cut = found.select(F.col("source").alias("c_source"), "remaining", F.col("c.prefix").alias("prefix"), (F.col("c.upto") - F.col("c.size")).alias("before"), F.col("c.upto").alias("upto"), F.col("c.size").alias("last_size"))
        if shift:
            cut = cut.drop("upto", "last_size")
    return cut.select(F.col("c_source").alias("source"), F.col("prefix").alias("cut_rank"), (2 * F.col("upto") - F.col("last_size") <= 2 * F.col("remaining")).alias("cut_taken"))


ORACLE = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
    coalesce(sum(source_size * 2) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_words,
    sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open_weight
  FROM s),
g AS (SELECT *, source_size * 2 * open_weight <= weight * (budget - full_words) AS is_full FROM f),
t AS (
  SELECT source, source_size,
    CASE WHEN is_full THEN (source_size * 2)::DOUBLE
    ELSE weight * (budget - min(CASE WHEN NOT is_full THEN full_words END) OVER ()) / max(CASE WHEN NOT is_full THEN open_weight END) OVER () END AS target
  FROM g),
e AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(t.target * 1.0::DOUBLE / t.source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS expected,
    (('0x' || substr(md5('20:' || d.doc_id), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, floor(expected)::BIGINT AS whole, (expected - floor(expected))::DOUBLE AS lam FROM e),
q AS (
  SELECT *, CASE WHEN lam > 0 THEN (u * (1.0::DOUBLE - lam)) / ((1.0::DOUBLE - u) * lam) END AS odds FROM p),
r AS (
  SELECT *, floor(odds / (1.0::DOUBLE + odds) * 281474976710656.0::DOUBLE)::BIGINT AS rank,
    target - sum(size * whole) OVER (PARTITION BY source) AS remaining FROM q),
c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY source, rank) AS tied FROM r)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN rank IS NOT NULL AND 2 * upto - tied <= 2 * remaining THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
