"""Chapters, scopes and the pages that an export holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold

PAGE_HEIGHT = 792.0


def page_runs(pages: DataFrame, key: str) -> DataFrame:
    """(key, start, end): consecutive distinct pages as runs."""
    w = Window.partitionBy(key).orderBy("page")
    marked = pages.select(key, "page").distinct().withColumn("run", F.col("page") - F.row_number().over(w))
    return marked.groupBy(key, "run").agg(F.min("page").alias("start"), F.max("page").alias("end")).drop("run")


def run_suffix(runs: DataFrame, key: str) -> DataFrame:
    """(key, suffix): "_p2-5_9-11"."""
    one = F.when(F.col("start") == F.col("end"), F.col("start").cast("string")).otherwise(F.concat(F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))
    return runs.groupBy(key).agg(F.concat(F.lit("_p"), F.concat_ws("_", F.transform(F.array_sort(F.collect_list(F.struct("start", one.alias("s")))), lambda r: r["s"]))).alias("suffix"))


def ruler(page: Column, y: Column, height: float = PAGE_HEIGHT) -> Column:
    """A place as one number that grows down the document; null y is the top of its page."""
    return (page - 1) * height + (F.lit(height) - F.coalesce(y, F.lit(height)))


def units_in_pages(units: DataFrame, start: int, end: int) -> DataFrame:
    """Units whose span touches the pages."""
    return units.where((F.col("end_page") >= start) & (F.col("start_page") <= end))


def units_in_chapters(units: DataFrame, chapters: DataFrame) -> DataFrame:
    """Units (doc_id, unit_id, lo, hi) that lie half, or 24 points, in a picked chapter (doc_id, c_lo, c_hi)."""
    length = F.greatest(F.col("hi") - F.col("lo"), F.lit(1.0))
    shared = F.least("hi", "c_hi") - F.greatest("lo", "c_lo")
    inside = units.join(chapters, "doc_id").where((F.col("lo") < F.col("c_hi")) & (F.col("hi") > F.col("c_lo")) & ((shared >= length * 0.5) | (shared >= 24)))
    whole = F.max(shared >= length - 1)
    return inside.groupBy("doc_id", "unit_id").agg(whole.alias("whole"))


def chapter_tree(headings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Headings (key, ord, level) with ``parent`` (the nearest earlier one above) and ``until`` (the next at or above).

    Both are folds with a stack of open headings, forwards and backwards, so levels may be of any depth.
    """
    kind = headings.schema["ord"].dataType.simpleString()
    level, at = headings.columns.index("level"), headings.columns.index("ord")

    def forwards(stack: list, row: tuple) -> tuple[list, tuple]:
        while stack and stack[-1][0] >= row[level]:
            stack.pop()
        parent = stack[-1][1] if stack else None
        return [*stack, (row[level], row[at])], (parent,)

    def backwards(stack: list, row: tuple) -> tuple[list, tuple]:
        while stack and stack[-1][0] > row[level]:
            stack.pop()
        until = stack[-1][1] if stack else None
        return [*stack, (row[level], row[at])], (until,)

    down = fold(headings, [key], ["ord"], list, forwards, f"parent {kind}")
    return fold(down, [key], [F.col("ord").desc()], list, backwards, f"until {kind}")


def end_of_chapter(tree: DataFrame, height: float = 792.0, share: float = 0.06) -> DataFrame:
    """Chapters (doc_id, ord, page, top, until, ...) with ``end_page``: where the next one at or above starts.

    A chapter that begins in the top ``share`` of its page leaves that page to itself: the one before ends
    on the page before, but never before its own start.
    """
    after = tree.select("doc_id", F.col("ord").alias("until"), F.col("page").alias("n_page"), F.col("top").alias("n_top"))
    high = F.coalesce(F.col("n_top") >= height * (1 - share), F.lit(False))
    end = F.greatest(F.col("page"), F.when(high, F.col("n_page") - 1).otherwise(F.col("n_page")))
    return tree.join(after, ["doc_id", "until"], "left").withColumn("end_page", F.when(F.col("n_page").isNotNull(), end)).drop("n_page", "n_top")


def settle_levels(headings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Levels that start at 1 and never jump down by more than one from the heading before."""
    least = headings.groupBy(key).agg(F.min("level").cast("int").alias("least"))
    rows = headings.join(least, key).select(key, F.col("ord").cast("long").alias("ord"), F.col("level").cast("int").alias("was"), "least")

    def step(last: int, row: tuple) -> tuple[int, tuple[int]]:
        level = min(row[2] - row[3] + 1, last + 1)
        return level, (level,)

    return fold(rows, [key], ["ord"], int, step, "level int").select(key, "ord", "level")


def validation(units: DataFrame, max_blocks: int = 50, block_chars: int = 6000, total_chars: int = 40_000) -> DataFrame:
    """(request, code, n): the limits that requests (request, id, text) break."""
    per = units.groupBy("request").agg(
        F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"), F.count_if(F.length("text") > block_chars).alias("long"),
        (F.count("*") - F.count_distinct("id")).alias("repeated"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("blank"),
    )
    broken = lambda test, code, n: F.when(test, F.struct(F.lit(code).alias("code"), n.cast("long").alias("n")))
    codes = F.array_compact(F.array(
        broken(F.col("blocks") > max_blocks, "too_many_blocks", F.col("blocks")), broken(F.col("chars") > total_chars, "request_too_long", F.col("chars")),
        broken(F.col("long") > 0, "block_too_long", F.col("long")), broken(F.col("repeated") > 0, "repeated_id", F.col("repeated")), broken(F.col("blank") > 0, "blank_block", F.col("blank")),
    ))
    return per.select("request", F.explode(codes).alias("c")).select("request", "c.code", "c.n")
