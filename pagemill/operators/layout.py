"""Layout reconstruction on positioned items: everything is keyed by document and page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold
from .regions import region_extents


def js_round(c: Column, digits: int = 0) -> Column:
    """Half up, also below zero."""
    scale = 10**digits
    return F.floor(c * scale + 0.5) / scale


def body_font_size(items: DataFrame) -> DataFrame:
    """(doc_id, body_size): the half-point size with most characters; the first one seen wins ties."""
    sized = items.withColumn("size", js_round(F.col("font_size") * 2) / 2).where("size > 0")
    per = sized.groupBy("doc_id", "size").agg(F.sum(F.length(F.trim("text"))).alias("weight"), F.min("item_id").alias("first"))
    return per.groupBy("doc_id").agg(F.max_by("size", F.struct("weight", -F.col("first"))).alias("body_size"))


def floor_percentile(df: DataFrame, key: str, value: str, p: float) -> DataFrame:
    """(key, value at floor(p (n - 1)) in sorted order), by ranks so that no group is collected."""
    w = Window.partitionBy(key)
    ranked = df.select(key, value).withColumn("rank", F.row_number().over(w.orderBy(value))).withColumn("n", F.count("*").over(w))
    return ranked.where(F.col("rank") == F.floor(F.lit(p) * (F.col("n") - 1)) + 1).select(key, F.col(value).alias("percentile"))


def gap_lines(items: DataFrame, keys: tuple[str, ...] = ("doc_id", "page", "y")) -> DataFrame:
    """Items on one baseline with ``line``: a new line where the gap to what came before exceeds 0.8 em."""
    w = Window.partitionBy(*keys).orderBy("x", "item_id")
    reach = F.max(F.col("x") + F.col("width")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    em = F.greatest("font_size", F.lag("font_size").over(w))
    opens = F.when(reach.isNotNull() & (F.col("x") - reach > em * 0.8), 1).otherwise(0)
    return items.withColumn("opens", opens).withColumn("line", F.sum("opens").over(w)).drop("opens")


def line_text(items: DataFrame, keys: tuple[str, ...] = ("doc_id", "page", "y")) -> DataFrame:
    """One row a line: its text, with a space where items are more than 0.12 em apart."""
    lined = gap_lines(items, keys)
    w = Window.partitionBy(*keys, "line").orderBy("x", "item_id")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)
    spaced = lined.withColumn("piece", F.when(gap > F.col("font_size") * 0.12, F.concat(F.lit(" "), "text")).otherwise(F.col("text")))
    text = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("x", "item_id", "piece"))), lambda s: s["piece"]))
    return spaced.groupBy(*keys, "line").agg(F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"), F.min("x").alias("x"), F.max(F.col("x") + F.col("width")).alias("right"), F.max("font_size").alias("font_size"), F.count("*").alias("items"))


def page_columns(lines: DataFrame, body: DataFrame, middle: float = 306.0) -> DataFrame:
    """(doc_id, page, n_left, n_right, n_crossing, two_columns) from body-sized lines around the middle."""
    sized = lines.join(body, "doc_id").where((F.col("font_size") >= F.col("body_size") * 0.75) & (F.col("font_size") <= F.col("body_size") * 1.3) & (F.length("text") >= 3))
    right = F.col("x") + F.col("width")
    of = lambda test: F.count_if(test)
    per = sized.groupBy("doc_id", "page").agg(of(right <= middle).alias("n_left"), of(F.col("x") >= middle).alias("n_right"), of((F.col("x") < middle) & (right > middle)).alias("n_crossing"))
    two = (F.col("n_left") >= 5) & (F.col("n_right") >= 5) & (F.col("n_crossing") <= F.col("n_left") + F.col("n_right"))
    return per.withColumn("two_columns", two)


def paragraphs(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page, region, line_id, x, right, y, font_size, font) with ``reason`` of a break before them
    (null inside a paragraph) and ``paragraph``, counted in their region.

    Every line is compared with the one before it in its region, downwards, in ems of that line.  The reasons in order:
    start, side-by-side up to 0.3, font-size beyond 15 %, font-change, line-gap beyond 1.8 (1.45 after a line that
    ends 20 % of the width early), indent beyond 0.6 unless both lines are centred.  A missing font equals a missing
    one; a line without size or place breaks by no distance.
    """
    keys = ["doc_id", "page", "region"]
    w = Window.partitionBy(*keys).orderBy(F.col("y").desc(), "x", "line_id")
    before = lambda c: F.lag(c).over(w)
    extents = region_extents(lines, keys)
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    placed = lines.alias("l").join(extents.alias("e"), same, "left").select("l.*", "e.left", "e.right_edge")
    width = F.col("right_edge") - F.col("left")
    middle = F.abs((F.col("x") + F.col("right")) / 2 - (F.col("left") + F.col("right_edge")) / 2)
    centred = (middle < width * 0.08) & (F.col("right") - F.col("x") < width * 0.85)
    stated = placed.withColumn("centred", centred).withColumn("short", F.col("right_edge") - F.col("right") > width * 0.2)
    em, pitch = before("font_size"), before("y") - F.col("y")
    ratio = F.col("font_size") / em
    reason = (
        F.when(before("line_id").isNull(), "start")
        .when(pitch <= em * 0.3, "side-by-side")
        .when((ratio < 0.85) | (ratio > 1.15), "font-size")
        .when(~F.col("font").eqNullSafe(before("font")), "font-change")
        .when(pitch > F.when(before("short"), 1.45).otherwise(1.8) * em, "line-gap")
        .when(~(F.col("centred") & before("centred")) & (F.col("x") - before("x") > em * 0.6), "indent")
    )
    marked = stated.withColumn("reason", reason)
    return marked.withColumn("paragraph", F.sum(F.when(F.col("reason").isNotNull(), 1).otherwise(0)).over(w)).drop("left", "right_edge", "centred", "short")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, page, block_id, column, top, x) with ``rank`` on their page.

    Spanning blocks cut a two-column page into bands; inside a band left comes before right, and the
    spanning block that closes it comes last.
    """
    page = Window.partitionBy("doc_id", "page")
    spanning = F.when(F.col("column") == "SPANNING", 1).otherwise(0)
    above = F.sum(spanning).over(page.orderBy(F.col("top").desc(), F.col("block_id")).rowsBetween(Window.unboundedPreceding, -1))
    side = F.when(F.col("column") == "RIGHT", 1).when(F.col("column") == "SPANNING", 2).otherwise(0)
    keyed = blocks.withColumn("band", F.coalesce(above, F.lit(0))).withColumn("side", side)
    return keyed.withColumn("rank", F.row_number().over(page.orderBy("band", "side", F.col("top").desc(), "x", "block_id"))).drop("band", "side")


def running_headers(blocks: DataFrame) -> DataFrame:
    """(doc_id, key, pages): texts with digits folded that stand on two pages or more."""
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"\d+", "#"), r"\s+", " "))
    keyed = blocks.withColumn("key", key).where((F.length("key") >= 2) & (F.length("text") <= 160))
    return keyed.select("doc_id", "key", "page").distinct().groupBy("doc_id", "key").agg(F.count("*").alias("pages")).where("pages >= 2")


def bands(intervals: DataFrame, key: str, gap: Column) -> DataFrame:
    """(key, band, start, end, n): intervals (lo, hi) merged where less than ``gap`` lies between them."""
    w = Window.partitionBy(key).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("lo") - reach >= gap), 1).otherwise(0)
    marked = intervals.withColumn("opens", opens).withColumn("band", F.sum("opens").over(w))
    return marked.groupBy(key, "band").agg(F.min("lo").alias("start"), F.max("hi").alias("end"), F.count("*").alias("n"))


def baseline_groups(items: DataFrame) -> DataFrame:
    """Items with ``row``: the fold over y downwards in which each item is compared with its row's anchor.

    An anchor moves only to the first real text (over two characters) or a strictly larger size; a chain
    of small steps therefore does not join two baselines.
    """
    slim = items.select("doc_id", "page", "item_id", "x", "y", "font_size", (F.length(F.trim("text")) > 2).alias("real"))

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple[int]]:
        _, _, _, _, y, size, real = row
        if state is None or abs(y - state[1]) > max(size, state[2]) * 0.25:
            return (0 if state is None else state[0] + 1, y, size, real), (0 if state is None else state[0] + 1,)
        number, at, most, had = state
        at, most = (y, size) if (real and not had) or size > most else (at, most)
        return (number, at, most, had or real), (number,)

    placed = fold(slim, ["doc_id", "page"], [F.col("y").desc(), "x", "item_id"], lambda: None, step, "row int")
    return items.join(placed.select("doc_id", "page", "item_id", "row"), ["doc_id", "page", "item_id"])


def ownership(claims: DataFrame) -> DataFrame:
    """(doc_id, owner, blocks): of the claims (doc_id, block_id, detector, priority) the first by priority holds."""
    first = claims.groupBy("doc_id", "block_id").agg(F.min_by("detector", F.struct("priority", "detector")).alias("owner"), F.count("*").alias("claims"))
    return first.groupBy("doc_id", "owner").agg(F.count("*").alias("blocks"), F.sum(F.col("claims") - 1).alias("turned_down"))
