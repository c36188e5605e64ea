"""What a translated page is drawn from: which units can be laid over, on what ground, in what room, in what order.

Blocks, images and fills meet on (doc_id, page), so every join is a hash join with a residual test, and each
block keeps one row through partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import text_color

PAGE = ["doc_id", "page"]

# Types that are laid over, and the tolerances of the tests.
OVERLAY_TYPES = ["BODY", "TITLE", "HEADING", "CAPTION", "FOOTNOTE", "TABLE", "FIGURE"]
IMAGE_SHARE, BACKGROUND_SHARE, ROTATION, SLACK, GAP, COVER = 0.1, 0.9, 0.02, 2.0, 0.75, 0.75


def overlap(a: str, b: str) -> Column:
    """Area that two rectangles a_x0 .. a_y1 and b_x0 .. b_y1 share."""
    c = lambda p, n: F.col(f"{p}{n}")
    wide = F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0"))
    high = F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0"))
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*PAGE, *[F.col(c).alias(p + c) for c in df.columns if c not in PAGE])


def overlay_reason(blocks: DataFrame, pages: DataFrame, images: DataFrame) -> DataFrame:
    """``blocks`` (doc_id, page, block_id, type, x0 .. y1, skew) with ``reason``: the first test that fails, else null.

    ``pages`` has rotation and px0 .. py1, ``images`` x0 .. y1; ``skew`` is the largest |b| or |c| of the
    block's items over their scale.  Images that fill a page are its background and hide nothing.
    """
    page_area = (F.col("px1") - F.col("px0")) * (F.col("py1") - F.col("py0"))
    front = prefixed(images, "i_").join(pages, PAGE).where((F.col("i_x1") - F.col("i_x0")) * (F.col("i_y1") - F.col("i_y0")) < page_area * BACKGROUND_SHARE).drop("rotation", "px0", "py0", "px1", "py1")
    hidden = prefixed(blocks.select(*PAGE, "block_id", "x0", "y0", "x1", "y1"), "b_").join(front, PAGE).groupBy(*PAGE, F.col("b_block_id").alias("block_id")).agg(F.sum(overlap("b_", "i_")).alias("hidden"))
    met = blocks.join(pages, PAGE, "left").join(hidden, [*PAGE, "block_id"], "left")
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    sound = F.coalesce((wide > 0) & (high > 0) & (wide < float("inf")) & (high < float("inf")), F.lit(False))
    inside = (F.col("x0") >= F.col("px0") - SLACK) & (F.col("y0") >= F.col("py0") - SLACK) & (F.col("x1") <= F.col("px1") + SLACK) & (F.col("y1") <= F.col("py1") + SLACK)
    reason = (
        F.when(~F.col("type").isin(OVERLAY_TYPES), F.concat(F.lit("TYPE_"), F.col("type")))
        .when(F.col("rotation").isNull(), "PAGE_MISSING")
        .when(F.col("rotation") % 360 != 0, "PAGE_ROTATED")
        .when(~sound, "INVALID_COORDINATES")
        .when(~inside, "OUT_OF_PAGE")
        .when(F.coalesce("skew", F.lit(0.0)) > ROTATION, "ROTATED_TEXT")
        .when(F.coalesce("hidden", F.lit(0.0)) / (wide * high) > IMAGE_SHARE, "IMAGE_OVERLAP")
    )
    return met.withColumn("reason", reason).select(*blocks.columns, "reason")


def background(blocks: DataFrame, fills: DataFrame, pages: DataFrame) -> DataFrame:
    """``blocks`` (.., container_fill) with ``ground``, ``source`` and ``ink``.

    The container's colour comes first, then the smallest fill around the block, then a fill of nine
    tenths of the page, then paper; white is paper too.
    """
    area = (F.col("f_x1") - F.col("f_x0")) * (F.col("f_y1") - F.col("f_y0"))
    page_area = (F.col("px1") - F.col("px0")) * (F.col("py1") - F.col("py0"))
    f = prefixed(fills, "f_").join(pages, PAGE).withColumn("area", area).withColumn("whole", area >= page_area * BACKGROUND_SHARE)
    f = f.withColumn("color", F.when(F.lower("f_color") != "#ffffff", F.lower("f_color"))).select(*PAGE, "f_seq", "f_x0", "f_y0", "f_x1", "f_y1", "area", "whole", "color")
    covers = (F.col("f_x0") - COVER <= F.col("x0")) & (F.col("f_y0") - COVER <= F.col("y0")) & (F.col("f_x1") + COVER >= F.col("x1")) & (F.col("f_y1") + COVER >= F.col("y1"))
    around = blocks.join(f.where(~F.col("whole")), PAGE).where(covers).groupBy(*PAGE, "block_id").agg(F.min_by(F.struct("color"), F.struct("area", "f_seq")).alias("fill"))
    sheet = f.where(F.col("whole") & F.col("color").isNotNull()).groupBy(*PAGE).agg(F.min_by("color", "f_seq").alias("sheet"))
    met = blocks.join(around, [*PAGE, "block_id"], "left").join(sheet, PAGE, "left")
    source = F.when(F.col("container_fill").isNotNull(), "container").when(F.col("fill").isNotNull(), "fill").when(F.col("sheet").isNotNull(), "page").otherwise("white")
    ground = F.when(F.col("source") == "container", F.when(F.lower("container_fill") != "#ffffff", F.lower("container_fill"))).when(F.col("source") == "fill", F.col("fill.color")).when(F.col("source") == "page", F.col("sheet"))
    return met.withColumn("source", source).withColumn("ground", ground).withColumn("ink", text_color(F.col("ground"))).drop("fill", "sheet")


def room_around(blocks: DataFrame, obstacles: DataFrame, pages: DataFrame, gap: float = GAP) -> DataFrame:
    """``blocks`` with room_x0 .. room_y1: as far as no obstacle reaches, never less than the text itself."""
    o = prefixed(obstacles.select(*PAGE, "x0", "y0", "x1", "y1"), "o_")
    level, above = (F.col("o_y0") < F.col("y1")) & (F.col("o_y1") > F.col("y0")), (F.col("o_x0") < F.col("x1")) & (F.col("o_x1") > F.col("x0"))
    near = blocks.join(o, PAGE).groupBy(*PAGE, "block_id").agg(
        F.max(F.when(level & (F.col("o_x1") <= F.col("x0")), F.col("o_x1"))).alias("left"), F.min(F.when(level & (F.col("o_x0") >= F.col("x1")), F.col("o_x0"))).alias("right"),
        F.max(F.when(above & (F.col("o_y1") <= F.col("y0")), F.col("o_y1"))).alias("below"), F.min(F.when(above & (F.col("o_y0") >= F.col("y1")), F.col("o_y0"))).alias("over"),
    )
    met = blocks.join(pages.select(*PAGE, "px0", "py0", "px1", "py1"), PAGE).join(near, [*PAGE, "block_id"], "left")
    low = lambda limit, edge, own: F.least(F.greatest(F.col(limit), F.coalesce(F.col(edge) + gap, F.col(limit))), F.col(own))
    high = lambda limit, edge, own: F.greatest(F.least(F.col(limit), F.coalesce(F.col(edge) - gap, F.col(limit))), F.col(own))
    return met.withColumns({"room_x0": low("px0", "left", "x0"), "room_x1": high("px1", "right", "x1"), "room_y0": low("py0", "below", "y0"), "room_y1": high("py1", "over", "y1")}).drop("left", "right", "below", "over", "px0", "py0", "px1", "py1")


def placement(rotation: Column, width: Column, height: Column, offset: Column) -> Column:
    """struct<x, y, rotate, width, height>: where an embedded page stands on a spread, turned as its page says."""
    turn = F.pmod(rotation, F.lit(360))
    sideways = turn.isin(90, 270)
    x = F.when(turn.isin(180, 270), F.when(turn == 180, width).otherwise(height)).otherwise(F.lit(0.0))
    y = F.when(turn.isin(90, 180), F.when(turn == 90, width).otherwise(height)).otherwise(F.lit(0.0))
    return F.struct((offset + x).alias("x"), y.alias("y"), (-turn).alias("rotate"), F.when(sideways, height).otherwise(width).alias("width"), F.when(sideways, width).otherwise(height).alias("height"))


def render_plan(blocks: DataFrame) -> DataFrame:
    """Placed blocks (.., ground, ink, translation, reason) -> the drawing steps of each page in order.

    All masks come before all texts, so no mask hides a neighbour's text; blocks that cannot be laid over
    or have no translation or no readable ink keep the page as it is.
    """
    drawn = blocks.where(F.col("reason").isNull() & F.col("translation").isNotNull() & (F.trim("translation") != "") & F.col("ink").isNotNull())
    mask = drawn.select(*PAGE, "block_id", F.lit("mask").alias("op"), "x0", "y0", "x1", "y1", F.coalesce("ground", F.lit("#ffffff")).alias("color"), F.lit(None).cast("string").alias("text"))
    words = drawn.select(*PAGE, "block_id", F.lit("text").alias("op"), "x0", "y0", "x1", "y1", F.when(F.col("ink") == "light", "#ffffff").otherwise("#000000").alias("color"), F.col("translation").alias("text"))
    order = Window.partitionBy(*PAGE).orderBy(F.when(F.col("op") == "mask", 0).otherwise(1), F.col("y1").desc(), "x0", "block_id")
    return mask.unionByName(words).withColumn("seq", F.row_number().over(order))


def render_report(blocks: DataFrame) -> DataFrame:
    """(reason, blocks): how many blocks were left out and why; null reasons were drawn."""
    return blocks.groupBy("reason").agg(F.count("*").alias("blocks"))
