"""Request planning: blocks from documents, greedy batches, context, glossary terms, review selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import risk, text
from ..functions.text import B0, B1
from .folds import fold

# Limits of a request and estimates of its overhead.
MAX_BLOCKS, MAX_CHARS = 25, 10_000
PROMPT_TOKENS, UNIT_TOKENS = 650, 12


def line_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, text): the non-blank lines of every document, white space normalised."""
    lines = F.transform(F.split("text", r"\n"), text.normalize_cache_text)
    return docs.select("doc_id", F.posexplode(lines).alias("ord", "text")).where("text <> ''")


def assign_batches(sized: DataFrame, key: str, order: str, size: str, max_blocks: int, max_chars: int) -> DataFrame:
    """``sized`` with ``batch``: a batch closes when the next block would break a limit."""
    n = sized.columns.index(size)

    def step(state: tuple[int, int, int], row: tuple) -> tuple[tuple[int, int, int], tuple[int]]:
        batch, count, chars = state
        if count and (count >= max_blocks or chars + row[n] > max_chars):
            batch, count, chars = batch + 1, 0, 0
        return (batch, count + 1, chars + row[n]), (batch,)

    return fold(sized, [key], [order], lambda: (0, 0, 0), step, "batch int")


def greedy_batches(blocks: DataFrame, key: str = "doc_id", max_blocks: int = MAX_BLOCKS, max_chars: int = MAX_CHARS, size: Column | None = None) -> DataFrame:
    """``blocks`` (key, ord, ...) with ``batch``; only (key, ord, size) goes through the fold."""
    chars = size if size is not None else F.length("text")
    sized = blocks.select(key, "ord", F.coalesce(chars, F.lit(0)).cast("long").alias("n"))
    return blocks.join(assign_batches(sized, key, "ord", "n", max_blocks, max_chars).drop("n"), [key, "ord"])


def batch_plan(docs: DataFrame) -> DataFrame:
    """(doc_id, batch, units, chars, tokens): how each document is packed into requests, and their size."""
    from ..functions.predicates import skip_kind

    kept = line_blocks(docs).where(skip_kind(F.col("text")).isNull())
    sized = kept.select("doc_id", "ord", F.length("text").cast("long").alias("chars"), text.estimate_tokens(F.col("text")).alias("tokens"))
    planned = assign_batches(sized, "doc_id", "ord", "chars", MAX_BLOCKS, MAX_CHARS)
    return planned.groupBy("doc_id", "batch").agg(F.count("*").alias("units"), F.sum("chars").cast("long").alias("chars"), (F.lit(PROMPT_TOKENS) + F.sum(F.col("tokens") + UNIT_TOKENS)).cast("long").alias("tokens"))


def neighbour_context(units: DataFrame, key: str = "conv_id", order: str = "turn", chars: int = 120) -> DataFrame:
    """``units`` (key, order, text) with previous_context and next_context where a sentence runs over a break.

    An incomplete unit gets both sides; the one after an incomplete unit, or one that starts in lower
    case, gets what comes before it.
    """
    w = Window.partitionBy(key).orderBy(order)
    cut = ~text.completeness(F.col("text"))["complete"]
    marked = units.withColumn("cut", cut).withColumn("before", F.lag("text").over(w)).withColumn("after", F.lead("text").over(w)).withColumn("before_cut", F.coalesce(F.lag("cut").over(w), F.lit(False)))
    starts_inside = F.regexp_like(text.trim(F.col("text")), F.lit("^[a-z]"))
    want = F.col("cut") | F.col("before_cut") | starts_inside
    return marked.select(
        key, order, "text",
        F.when(want, text.tail_context(F.col("before"), chars)).alias("previous_context"),
        F.when(F.col("cut"), text.head_context(F.col("after"), chars)).alias("next_context"),
    )


def prune_context(units: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """Context is dropped where its unit travels in the same batch; ``units`` has batch and both contexts."""
    w = Window.partitionBy(key).orderBy(order)
    return units.withColumn("previous_context", F.when(~F.col("batch").eqNullSafe(F.lag("batch").over(w)), F.col("previous_context"))).withColumn("next_context", F.when(~F.col("batch").eqNullSafe(F.lead("batch").over(w)), F.col("next_context")))


def cache_probe(units: DataFrame, cache: DataFrame, lang: str, term_hash: str) -> DataFrame:
    """``units`` (text, ...) with the cached translation, null where the provider must be asked."""
    known = cache.where((F.col("lang") == lang) & (F.col("term_hash") == term_hash)).select("norm_text", "translation")
    return units.withColumn("norm_text", text.normalize_cache_text(F.col("text"))).join(known, "norm_text", "left")


def cache_upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The newest row of every key; both have lang, term_hash, norm_text, translation, at."""
    keys = ["lang", "term_hash", "norm_text"]
    return cache.unionByName(fresh).groupBy(*keys).agg(F.max_by("translation", "at").alias("translation"), F.max("at").alias("at"))


def accept_reply(sent: DataFrame, reply: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, missing): invented ids go, the first of repeated ids counts, blank replies are missing."""
    first = reply.where(text.trim(F.col("translation")) != "").withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("seq"))).where("n = 1").drop("n", "seq")
    return sent.join(first, "id"), sent.join(first, "id", "left_anti")


def select_review(ranked: DataFrame, translated: int, share: float) -> DataFrame:
    """``ranked`` (id, ord, score, triggers) with ``selected``.

    Critical blocks are always reviewed; what the budget leaves is filled by trigger, score and order.
    """
    budget = max(1, -(-round(translated * share * 1_000_000) // 1_000_000))
    order = [risk.trigger_rank(F.col("triggers")), F.col("score").desc(), F.col("ord")]
    critical = risk.is_critical(F.col("triggers"))
    # the budget bounds how many can be chosen, so only that many rows are ever sorted together
    count = ranked.where(critical).count()
    fill = ranked.where(~critical).orderBy(*order).limit(max(0, budget - count)).select("id")
    chosen = fill.withColumn("filled", F.lit(True))
    return ranked.join(chosen, "id", "left").withColumn("selected", critical | F.coalesce("filled", F.lit(False))).drop("filled")


def term_density(c: Column) -> Column:
    """Abbreviations count twice, hyphenated words and capitalised compounds once."""
    count = lambda p: F.regexp_count(c, F.lit(B0 + p + B1))
    return count("[A-Z][A-Z0-9]{1,8}") * 2 + count("[a-z]+-[a-z]+(?:-[a-z]+)?") + count(r"[A-Z][a-z]+(?:[\s]+[A-Z][a-z]+)+")


def merge_terms(terms: DataFrame) -> DataFrame:
    """``terms`` (key, ord, source, abbreviation, origin) that survive a merge, user terms first.

    A term goes when an earlier kept one has its source, or (automatic ones) when either of its names is
    taken.  What is taken depends on what was kept, so this is a fold over one key's terms; its state is the
    set of names taken.
    """
    named = terms.select("*", (F.col("origin") != "user").alias("m_auto"), F.lower("source").alias("m_source"), F.lower("abbreviation").alias("m_abbreviation"))
    auto, source, short = (named.columns.index(c) for c in ("m_auto", "m_source", "m_abbreviation"))

    def step(taken: set[str], row: tuple) -> tuple[set[str], tuple[bool]]:
        names = {n for n in (row[source], row[short]) if n is not None}
        clash = bool(taken & names) if row[auto] else row[source] in taken
        return (taken if clash else taken.union(names)), (not clash,)

    kept = fold(named, ["key"], ["m_auto", "ord", "source", "abbreviation"], set, step, "m_kept boolean")
    return kept.where("m_kept").select(*terms.columns)


def relevant_terms(texts: DataFrame, terms: DataFrame, limit: int = 100_000) -> DataFrame:
    """(id, source): the terms whose stem, or whose abbreviation as a whole word, stands in a text.

    The glossary is small by contract: its size is checked against ``limit`` before it is sent to every
    task as one array, and beyond that the call fails instead of dropping terms.
    """
    fold = lambda c: text.fold_for_match(c)
    stem = F.when((F.length("folded") > 3) & F.endswith("folded", F.lit("s")), F.expr("substring(folded, 1, length(folded) - 1)")).otherwise(F.col("folded"))
    known = terms.withColumn("folded", fold(F.col("source"))).withColumn("stem", stem)
    if known.count() > limit:
        raise ValueError(f"a glossary of more than {limit} terms must be filtered before it is sent")
    one = known.agg(F.collect_list(F.struct("source", "stem", "abbreviation")).alias("all"))  # bounded by ``limit``
    whole = lambda t, c: t["abbreviation"].isNotNull() & F.regexp_like(c, F.concat(F.lit("(?<![A-Za-z0-9])"), F.regexp_replace(t["abbreviation"], r"([.*+?^${}()|\[\]\\/])", r"\\$1"), F.lit("(?![A-Za-z0-9])")))
    hay = texts.withColumn("hay", fold(F.col("text"))).join(F.broadcast(one))
    found = hay.select("id", F.explode(F.filter("all", lambda t: F.contains(F.col("hay"), t["stem"]) | whole(t, F.col("text")))).alias("t"))
    return found.select("id", "t.source")


def usage_rollup(events: DataFrame) -> DataFrame:
    """``events`` (stage, input, output, cached) -> totals per stage and overall; cached is part of input."""
    out = events.rollup("stage").agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("cached").alias("cached"), F.count("*").alias("requests"), F.grouping("stage").alias("total"))
    return out.select(F.when(F.col("total") == 1, F.lit("TOTAL")).otherwise(F.col("stage")).alias("stage"), "requests", "input", "output", "cached", (F.col("input") + F.col("output")).alias("processed"))
