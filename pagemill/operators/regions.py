"""Where lines and cells stand: regions, merged baselines, rules and bands around them, cells in place of blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import predicates as P
from .folds import fold
from .sweep import by_page, next_overlapping, numbers, ranks, said

# Tolerances in em or points.
BASELINE, GAP_LOW, GAP_HIGH = 0.5, -0.5, 2.0
RULE_ABOVE, RULE_BELOW = 0.55, 0.2
FURNITURE_WIDTH, FURNITURE_MARGIN = 0.8, 0.12
CAPTION_REACH = 4.0


def region(x: Column, right: Column, gutter_left: Column, gutter_right: Column, in_band: Column) -> Column:
    """FULL on a page of one column; SPANNING in a table band or across the gutter; else the side of the centre."""
    crosses = (x < gutter_left - 1) & (right > gutter_right + 1)
    return (
        F.when(gutter_left.isNull() | gutter_right.isNull(), "FULL")
        .when(F.coalesce(in_band, F.lit(False)) | crosses, "SPANNING")
        .when((x + right) / 2 <= (gutter_left + gutter_right) / 2, "LEFT")
        .otherwise("RIGHT")
    )


def merge_baselines(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page, region, line_id, x, right, y, font_size) with ``merged``: the first line of their merged line.

    A line joins the open one of its page when both stand in one region and on one baseline and the gap between them
    is that of justified text.  The merged line is what the next one is compared with: its right edge is the
    farthest so far, its size the largest, its baseline that of its largest line, the first of equals.
    """
    names = ["region", "x", "right", "y", "font_size", "line_id"]

    def step(open_: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        region_, x, right, y, size, own = (row[i] for i in at)
        if open_ is not None:
            o_region, o_right, o_y, o_size, first = open_
            em = max(o_size, size)
            if o_region == region_ and abs(o_y - y) <= BASELINE * em and GAP_LOW * em <= x - o_right <= GAP_HIGH * em:
                return (region_, max(o_right, right), y if size > o_size else o_y, em, first), (first,)
        return (region_, right, y, size, own), (own,)

    at = [lines.columns.index(n) for n in names]
    return fold(lines, ["doc_id", "page"], [F.col("y").desc(), "x", "line_id"], lambda: None, step, "merged long")


def region_extents(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, left, right_edge): the tenth percentile of left edges and the ninetieth of right ones, by floor rank."""
    w = lambda c: Window.partitionBy(*keys).orderBy(c, "line_id")
    n = F.count("*").over(Window.partitionBy(*keys))
    ranked = lines.select(*keys, "x", "right", F.row_number().over(w("x")).alias("rx"), F.row_number().over(w("right")).alias("rr"), n.alias("n"))
    pick = lambda c, r, q: F.max(F.when(F.col(r) == F.floor(F.lit(q) * (F.col("n") - 1)) + 1, F.col(c)))
    return ranked.groupBy(*keys).agg(pick("x", "rx", 0.1).alias("left"), pick("right", "rr", 0.9).alias("right_edge"))


def dominant(items: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, value) of the item with the strictly longest text, the first of equals."""
    return items.groupBy(*keys).agg(F.max_by(value, F.struct(F.length("text").alias("n"), (-F.col(order)).alias("place"))).alias(value))


def table_headers(cells: DataFrame) -> DataFrame:
    """Cells (table_id, page, block_type, top, y) with labels at or above the first numeric row marked as headers."""
    first = cells.where("block_type = 'TABLE_CELL'").groupBy("table_id", "page").agg(F.max("top").alias("h_top"))
    head = (F.col("block_type") == "TABLE_TEXT_LABEL") & (F.col("y") >= F.col("h_top") - 0.5)
    return cells.join(first, ["table_id", "page"], "left").withColumn("block_type", F.when(head, "TABLE_HEADER").otherwise(F.col("block_type"))).drop("h_top")


def cell_skip(value: Column, numeric: Column, figure: Column, maskable: Column) -> Column:
    """Why a cell is not translated, the first that holds; null when it is."""
    plain = F.when(figure, P.is_figure_notation(value)).otherwise(P.is_untranslatable(value))
    return (
        F.when(numeric, "NUMERIC_ONLY")
        .when(P.is_abbreviation_only(value), "ABBREVIATION_ONLY")
        .when(plain, "UNTRANSLATABLE")
        .when(~maskable, F.when(figure, "FIGURE_NOT_MASKABLE").otherwise("CELL_NOT_MASKABLE"))
    )


def suppress_in_bands(blocks: DataFrame, bands: DataFrame) -> DataFrame:
    """Blocks (doc_id, page, block_id, type, text, y, height, translate, skip_reason) with rows of values in a table band skipped.

    ``bands`` (doc_id, page, bottom, top) are few a page.
    """
    middle = F.col("y") + F.col("height") / 2
    rows = blocks.where(F.col("translate") & ~F.col("type").isin("TABLE", "FIGURE", "CAPTION") & P.is_numeric_row(F.col("text")))
    hit = rows.select("doc_id", "page", "block_id", middle.alias("m")).join(bands.select("doc_id", "page", "bottom", F.col("top").alias("b_top")), ["doc_id", "page"])
    hit = hit.where((F.col("m") >= F.col("bottom")) & (F.col("m") <= F.col("b_top"))).select("doc_id", "page", "block_id").distinct().withColumn("s_hit", F.lit(True))
    found = blocks.join(hit, ["doc_id", "page", "block_id"], "left")
    held = F.coalesce("s_hit", F.lit(False))
    return found.withColumn("translate", F.col("translate") & ~held).withColumn("skip_reason", F.when(held, "TABLE_BAND_UNRESOLVED").otherwise(F.col("skip_reason"))).drop("s_hit")


def is_page_furniture(x0: Column, x1: Column, y: Column, horizontal: Column, page: tuple[float, float, float, float]) -> Column:
    """A horizontal rule nearly as wide as the page in its top or bottom margin."""
    px0, py0, px1, py1 = page
    margin = FURNITURE_MARGIN * max(1.0, py1 - py0)
    return horizontal & (F.abs(x1 - x0) >= FURNITURE_WIDTH * max(1.0, px1 - px0)) & ((y <= py0 + margin) | (y >= py1 - margin))


def ruled_apart(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs (doc_id, page, pair_id, left, right, upper_y, lower_y, font_size) with ``ruled``: a rule lies between their baselines."""
    lo, hi = F.col("lower_y") + RULE_ABOVE * F.col("font_size"), F.col("upper_y") - RULE_BELOW * F.col("font_size")
    keys = ["doc_id", "page", "pair_id"]
    p = said(pairs.select(*keys, "left", "right", lo.alias("lo"), hi.alias("hi")), ["left", "right", "lo", "hi"])

    def run(p: pa.Table, r: pa.Table) -> pa.Table:
        (r0, r1, left, right), (y, low, high) = ranks(*numbers(r, "r0", "r1"), *numbers(p, "left", "right")), ranks(*numbers(r, "ry"), *numbers(p, "lo", "hi"))
        by = np.argsort(y, kind="stable")
        at = next_overlapping(r0[by], r1[by], np.searchsorted(y[by], low, "right"), left, right)
        return p.take(np.flatnonzero((at >= 0) & (y[by][at] < high)))

    hit = by_page(p, _edges(rules), run, p.select(*keys).schema).distinct().withColumn("ruled", F.lit(True))
    return pairs.join(hit, keys, "left").withColumn("ruled", F.coalesce("ruled", F.lit(False)))


def _edges(rules: DataFrame) -> DataFrame:
    return said(rules.select("doc_id", "page", F.col("x0").alias("r0"), F.col("x1").alias("r1"), F.col("y").alias("ry")), ["r0", "r1", "ry"])


def nearest_rules(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """Cells (doc_id, page, cell_id, left, right, min_top, max_bottom) with the rules next above and below over their columns.

    Cells without a document or page have none.
    """
    keys, r = ["doc_id", "page", "cell_id"], _edges(rules)
    c = said(cells.select(*keys, "left", "right", "min_top", "max_bottom"), ["left", "right"])
    schema = StructType([*c.schema.fields[:3], *(StructField(n, r.schema["ry"].dataType) for n in ("rule_above", "rule_below"))])

    def run(c: pa.Table, r: pa.Table) -> pa.Table:
        by = np.argsort(*numbers(r, "ry"), kind="stable")
        r = r.take(by)
        r0, r1, left, right = ranks(*numbers(r, "r0", "r1"), *numbers(c, "left", "right"))
        y, top, bottom = ranks(*numbers(r, "ry"), *numbers(c, "min_top", "max_bottom"))
        above = next_overlapping(r0, r1, np.searchsorted(y, top, "left"), left, right)
        below = next_overlapping(r0[::-1], r1[::-1], len(y) - np.searchsorted(y, bottom, "right"), left, right)
        some = [(at >= 0) & c.column(n).is_valid().to_numpy() for at, n in ((above, "min_top"), (below, "max_bottom"))]
        at = [pa.array(place, mask=~good) for place, good in zip((above, len(y) - 1 - below), some)]
        return pa.table([*(c.column(k) for k in keys), *(r.column("ry").take(i) for i in at)], schema.names)

    found = by_page(c, r, run, schema).groupBy(*keys).agg(F.min("rule_above").alias("rule_above"), F.max("rule_below").alias("rule_below"))
    return cells.join(found, keys, "left")


def replace_by_cells(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """Blocks (doc_id, ord, block_id, group) with each group replaced by its cells (doc_id, group, cell_ord, block_id).

    The cells stand where the group's first block stood; a group without cells keeps its first block; ``ord``
    is numbered anew from 0.
    """
    first = blocks.where("group IS NOT NULL").groupBy("doc_id", "group").agg(F.min("ord").alias("at"), F.min_by("block_id", "ord").alias("first_id"))
    filled = first.join(cells.withColumnRenamed("block_id", "cell_id"), ["doc_id", "group"], "left")
    placed = filled.select("doc_id", F.col("at").alias("a"), F.coalesce("cell_ord", F.lit(0)).alias("b"), F.coalesce("cell_id", "first_id").alias("block_id"))
    every = blocks.where("group IS NULL").select("doc_id", F.col("ord").alias("a"), F.lit(0).alias("b"), "block_id").unionByName(placed)
    return every.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("a", "b", "block_id")) - 1).alias("ord"), "block_id")


def insert_before(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Blocks (doc_id, ord, block_id) with labels (doc_id, before, block_id) put before the block they are named for."""
    at = blocks.select("doc_id", F.col("block_id").alias("before"), F.col("ord").alias("a"))
    placed = labels.join(at, ["doc_id", "before"]).select("doc_id", "a", F.lit(0).alias("b"), "block_id")
    every = blocks.select("doc_id", F.col("ord").alias("a"), F.lit(1).alias("b"), "block_id").unionByName(placed)
    return every.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("a", "b", "block_id")) - 1).alias("ord"), "block_id")


def first_data_row(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, data_row): the first row of two cells or more with a value among them, 0 where there is none."""
    rows = cells.groupBy(*keys, "row").agg(F.count("*").alias("n"), F.max(P.is_numeric_cell(F.col("text"))).alias("value"))
    return rows.groupBy(*keys).agg(F.coalesce(F.min(F.when((F.col("n") >= 2) & F.col("value"), F.col("row"))), F.lit(0)).alias("data_row"))


def introduced_by_table(bands: DataFrame, lines: DataFrame) -> DataFrame:
    """Bands (doc_id, page, band, bottom, top, body_size) whose nearest caption within reach is a table's."""
    captions = lines.select("doc_id", "page", "line_id", "y", P.caption_kind(F.col("text")).alias("kind")).where("kind IS NOT NULL")
    away = F.greatest(F.col("y") - F.col("top"), F.col("bottom") - F.col("y"), F.lit(0.0))
    near = bands.join(captions, ["doc_id", "page"]).where(away <= CAPTION_REACH * F.col("body_size"))
    kind = near.groupBy("doc_id", "page", "band").agg(F.min_by("kind", F.struct(away.alias("away"), "line_id")).alias("nearest"))
    return bands.join(kind, ["doc_id", "page", "band"], "left").withColumn("table", F.coalesce(F.col("nearest") == "TABLE", F.lit(False))).drop("nearest")


def shaded_columns(fills: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_id, left, right) of the columns that shading draws: horizontal extents, to half a point, of fills on two rows or more.

    ``fills`` are (table_id, fill_id, x0, y0, x1, y1), ``tables`` (table_id, left, right, top, bottom) of the text.  An extent that
    holds a narrower one is left out.  A table has none if fewer than three are left, two overlap by more than a point,
    or they cover less than 70 % of the text.
    """
    half = lambda c: F.floor(F.col(c) * 2 + 0.5)
    t = tables.select("table_id", F.col("left").alias("t_left"), F.col("right").alias("t_right"), "top", "bottom")
    near = fills.join(t, "table_id").where((F.col("y0") <= F.col("top")) & (F.col("y1") >= F.col("bottom")) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    first = lambda c: F.min_by(c, "fill_id")
    by = near.groupBy("table_id", "t_left", "t_right", half("x0").alias("k0"), half("x1").alias("k1"))
    drawn = by.agg(first("x0").alias("left"), first("x1").alias("right"), F.count_distinct(half("y0")).alias("rows")).where("rows >= 2")
    inner = drawn.select("table_id", F.col("left").alias("i_left"), F.col("right").alias("i_right"))
    holds = (F.col("i_left") >= F.col("left") - 0.5) & (F.col("i_right") <= F.col("right") + 0.5) & (F.col("i_right") - F.col("i_left") < F.col("right") - F.col("left") - 0.5)
    d, i = drawn.alias("d"), inner.alias("i")
    finest = d.join(i, (F.col("d.table_id") == F.col("i.table_id")) & holds, "left_anti")
    w = Window.partitionBy("table_id")
    clash = F.col("left") < F.lag("right").over(w.orderBy("left", F.col("right").desc())) - 1
    part = F.greatest(F.lit(0.0), F.least("right", "t_right") - F.greatest("left", "t_left"))
    judged = finest.withColumn("clash", F.coalesce(clash, F.lit(False))).withColumn("part", part)
    whole = judged.withColumn("n", F.count("*").over(w)).withColumn("clashes", F.max("clash").over(w)).withColumn("covered", F.sum("part").over(w))
    return whole.where((F.col("n") >= 3) & ~F.col("clashes") & (F.col("covered") >= (F.col("t_right") - F.col("t_left")) * 0.7)).select("table_id", "left", "right")
