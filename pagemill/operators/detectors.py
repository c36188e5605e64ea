"""Detectors of layout roles: labels, regions of labelled sections, panels beside the text.

Evidence is a table of groups.  Of each group the first signal that holds counts, with its points in hundredths; the
sum, held between 0 and 100, is the confidence.  A missing value holds no signal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold

Groups = list[list[tuple[str, int, Column]]]

# Least confidences in hundredths, sizes in points, shares.
MIN_LABEL, MIN_REGION, MIN_PANEL = 50, 60, 60
PANEL_WIDTH, PANEL_HEIGHT, PANEL_AREA, PAGE_SHARE = 40.0, 30.0, 2400.0, 0.6
INSIDE, STRADDLES, TWIN, SIDEBAR_SHARE = 0.85, 0.2, 0.9, 0.65
STYLE_SIZE, ALIGNED = 0.1, 3.0
SECTION_LINES, SECTION_BLOCKS = 16, 3
# Block types that no panel holds.
NEVER_INSIDE = ["HEADER", "FOOTER", "TITLE", "AUTHOR", "REFERENCE"]


def evidence(groups: Groups) -> Column:
    """struct<points, signals> of the groups' signals that hold."""
    none = F.lit(None).cast("struct<signal:string,points:int>")
    chosen = []
    for group in groups:
        first = none
        for signal, points, holds in reversed(group):
            first = F.when(holds, F.struct(F.lit(signal).alias("signal"), F.lit(points).alias("points"))).otherwise(first)
        chosen.append(first)
    held = F.filter(F.array(*chosen), lambda s: s.isNotNull())
    total = F.aggregate(held, F.lit(0), lambda sum_, s: sum_ + s["points"])
    return F.struct(F.greatest(F.lit(0), F.least(F.lit(100), total)).alias("points"), F.transform(held, lambda s: s["signal"]).alias("signals"))


def label_evidence() -> Column:
    """Evidence of a label candidate with the columns placement (run-in, own-line, standalone), text, words, bold, medium,
    caps, title_case, hint, follows, rule_above, ratio (of its size to the text's) and width_share (of its line)."""
    c = F.col
    at = lambda p: c("placement") == p
    digits = F.length(F.regexp_replace("text", "[^0-9]", ""))
    return evidence(
        [
            [("placement:run-in", 45, at("run-in")), ("placement:own-line", 35, at("own-line")), ("placement:standalone", 25, F.lit(True))],
            [("bold-font", 15, c("bold")), ("medium-font", 8, c("medium"))],
            [("all-caps", 15, c("caps")), ("title-case", 5, c("title_case"))],
            [("hint-words", 15, c("hint") >= 0.5), ("hint-word", 8, c("hint") > 0)],
            [("short", 5, c("words") <= 4)],
            [("colon", 5, F.endswith(c("text"), F.lit(":")))],
            [
                ("text-follows", 15, at("run-in") & c("follows")),
                ("nothing-follows", -20, at("run-in")),
                ("paragraph-follows", 10, at("own-line")),
                ("body-follows", 15, c("follows")),
                ("no-body-follows", -30, F.lit(True)),
            ],
            [("rule-above", 10, c("rule_above"))],
            [("smaller-than-body", -20, c("ratio") < 0.85), ("much-larger-than-body", -15, c("ratio") > 1.6)],
            [("too-long", -50, c("words") > 8)],
            [("digits", -25, digits >= 3)],
            [("lowercase-start", -40, F.regexp_like("text", F.lit("^[a-z]")))],
            [("label-too-wide", -30, at("run-in") & (c("width_share") > 0.6))],
        ]
    )


def label_runs(labels: DataFrame) -> DataFrame:
    """Labels (doc_id, page, column, block_id, ord, x, font, font_size, blockers, points) with ``run``, counted on their page.

    Labels of less than 50 points are left out.
    ``blockers`` counts the blocks before a label in its column that no section may hold.  A label goes on with the run
    of the one before it on the page when style, left edge and column are the same and no blocker lies between.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("ord", "block_id")
    before = lambda c: F.lag(c).over(w)
    sure = labels.where(F.col("points") >= MIN_LABEL)
    alike = F.abs(F.col("font_size") - before("font_size")) <= F.greatest("font_size", before("font_size")) * STYLE_SIZE
    goes_on = F.col("font").eqNullSafe(before("font")) & alike & F.col("column").eqNullSafe(before("column")) & (F.abs(F.col("x") - before("x")) <= ALIGNED) & (F.col("blockers") == before("blockers"))
    opens = F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)
    return sure.withColumn("opens", opens).withColumn("run", F.sum("opens").over(w)).drop("opens")


def label_regions(labels: DataFrame) -> DataFrame:
    """Regions (doc_id, page, run) of two labels or more with points and signals, those of 60 points or more.

    ``labels`` are those of ``label_runs`` with points, inline, lines and blocks of their sections, and ``above``: the kind of
    heading right above them (abstract, other or null; the first label's counts).
    """
    long = (F.col("lines") > SECTION_LINES) | (F.col("blocks") > SECTION_BLOCKS)
    runs = labels.groupBy("doc_id", "page", "run").agg(
        F.count("*").alias("n"), F.sum("points").alias("sum"), F.count_if("inline").alias("inline"), (F.max("x") - F.min("x")).alias("spread"),
        F.count_if(long).alias("long"), F.min_by("above", F.struct("ord", "block_id")).alias("above"),
    )
    more = evidence(
        [
            [("four-or-more", 15, F.col("n") >= 4), ("three-or-more", 10, F.col("n") >= 3)],
            [("run-in-majority", 10, F.col("inline") * 2 >= F.col("n"))],
            [("aligned", 5, F.col("spread") <= ALIGNED)],
            [("abstract-heading-above", 15, F.col("above") == "abstract"), ("heading-above", 5, F.col("above").isNotNull())],
        ]
    )
    scored = runs.where("n >= 2").withColumn("more", more)
    total = F.floor(F.col("sum") / F.col("n") + F.col("more.points") - F.col("long") * 15 + 0.5).cast("int")
    held = F.greatest(F.lit(0), F.least(F.lit(100), total))
    return scored.select("doc_id", "page", "run", "n", held.alias("points"), F.col("more.signals").alias("signals"), "long").where(F.col("points") >= MIN_REGION)


def candidate_panels(boxes: DataFrame, pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Panels (doc_id, page, box_id, x0, y0, x1, y1, fill, border) of fills and frames that can hold text.

    ``boxes`` has kind (fill or frame) and colour.  A frame that overlaps an earlier panel by 0.9 of the larger one is its
    border; other panels are bordered by ``rules`` (doc_id, page, horizontal, x0, y0, x1, y1) along two opposite sides.  A
    white fill without a border is no panel.  Pages (doc_id, page, px0, py0, px1, py1) bound the size.
    """
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    page_area = F.greatest(F.lit(1.0), (F.col("px1") - F.col("px0")) * (F.col("py1") - F.col("py0")))
    fits = (width >= PANEL_WIDTH) & (height >= PANEL_HEIGHT) & (width * height >= PANEL_AREA) & (width * height <= page_area * PAGE_SHARE)
    sized = boxes.join(pages, ["doc_id", "page"]).where(fits).select("doc_id", "page", "box_id", "x0", "y0", "x1", "y1", "kind", "colour")

    def step(kept: list[tuple], row: tuple) -> tuple[list[tuple], tuple]:
        own, box, frame = row[2], row[3:7], row[7] == "frame"
        twin = next((i for i, other in kept if _shared(other, box) >= TWIN), None) if frame else None
        if twin is None:
            kept.append((own, box))
        return kept, (own if twin is None else twin,)

    joined = fold(sized, ["doc_id", "page"], [F.when(F.col("kind") == "fill", 0).otherwise(1), "box_id"], list, step, "panel long")
    own = F.col("box_id") == F.col("panel")
    first = lambda c: F.max(F.when(own, F.col(c))).alias(c)
    fill = F.max(F.when((F.col("kind") == "fill") & (F.col("colour") != "#ffffff"), F.col("colour")))
    border = F.max(F.when(F.col("kind") == "frame", F.lit("frame")))
    panels = joined.groupBy("doc_id", "page", F.col("panel").alias("box_id")).agg(*[first(c) for c in ("x0", "y0", "x1", "y1")], fill.alias("fill"), border.alias("border"))
    bordered = _boxed(panels, rules)
    return bordered.where(F.col("fill").isNotNull() | F.col("border").isNotNull())


def _boxed(panels: DataFrame, rules: DataFrame) -> DataFrame:
    """Panels with the border ``rules`` where they have none and two opposite sides follow a rule within three points."""
    c, near = F.col, 3.0
    r = rules.select("doc_id", "page", "horizontal", *[c(k).alias(f"r_{k}") for k in ("x0", "y0", "x1", "y1")])
    along = lambda lo, hi: (c("r_" + lo) <= c(lo) + near + (c(hi) - c(lo)) * 0.1) & (c("r_" + hi) >= c(hi) - near - (c(hi) - c(lo)) * 0.1)
    lying, standing = c("horizontal") & along("x0", "x1"), ~c("horizontal") & along("y0", "y1")
    sides = {"bottom": ("y0", "y0", lying), "top": ("y0", "y1", lying), "left": ("x0", "x0", standing), "right": ("x0", "x1", standing)}
    met = panels.where(c("border").isNull()).join(r, ["doc_id", "page"])
    seen = met.groupBy("doc_id", "page", "box_id").agg(*[F.max(F.coalesce(test & (F.abs(c("r_" + at) - c(side)) <= near), F.lit(False))).alias(name) for name, (at, side, test) in sides.items()])
    ruled = seen.where((c("top") & c("bottom")) | (c("left") & c("right"))).select("doc_id", "page", "box_id", F.lit("rules").alias("ruled"))
    return panels.join(ruled, ["doc_id", "page", "box_id"], "left").withColumn("border", F.coalesce("border", "ruled")).drop("ruled")


def _shared(a: tuple, b: tuple) -> float:
    """The area that two boxes share, as a part of the larger one's."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return w * h / max(area(a), area(b), 1e-6) if w > 0 and h > 0 else 0.0


def _inside(panels: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs of a panel and a block of its page with ``share``: how much of the block lies inside."""
    b = blocks.select("doc_id", "page", *[F.col(c).alias(f"b_{c}") for c in blocks.columns if c not in ("doc_id", "page")])
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(hi, "b_" + hi) - F.greatest(lo, "b_" + lo))
    area = (F.col("b_x1") - F.col("b_x0")) * (F.col("b_y1") - F.col("b_y0"))
    share = F.when(area > 0, side("x0", "x1") * side("y0", "y1") / area).otherwise(0.0)
    return panels.join(b, ["doc_id", "page"]).withColumn("share", share).where(F.col("share") >= STRADDLES)


def score_panels(panels: DataFrame, blocks: DataFrame) -> DataFrame:
    """Panels with children, points and signals; panels with too little text inside are left out.

    Panels also have text_width (of the page's column) and striped.  Blocks (doc_id, page, block_id, ord, x0, y0, x1, y1, type,
    column, lines, words, owned, numeric, heading_like, label) may be null in a flag, which then is false.
    """
    pairs = _inside(panels, blocks)
    owned = F.coalesce("b_owned", F.lit(False))
    open_ = ~owned & ~F.coalesce(F.col("b_type").isin(NEVER_INSIDE), F.lit(False))
    child = open_ & (F.col("share") >= INSIDE)
    area = (F.col("b_x1") - F.col("b_x0")) * (F.col("b_y1") - F.col("b_y0"))
    ifs = lambda test: F.count_if(child & test)
    found = pairs.groupBy(*[F.col(c) for c in panels.columns]).agg(
        F.count_if(child).alias("children"), F.count_if(open_ & (F.col("share") < INSIDE)).alias("straddlers"), F.count_if(owned & (F.col("share") >= 0.5)).alias("foreign"),
        F.sum(F.when(child, F.col("b_lines"))).alias("lines"), F.sum(F.when(child, F.col("b_words"))).alias("words"), F.sum(F.when(child, area)).alias("covered"),
        F.min_by("b_heading_like", F.when(child, F.struct("b_ord", "b_block_id"))).alias("heading_first"), ifs(F.col("b_label")).alias("labels"),
        ifs((F.col("b_lines") >= 2) & (F.col("b_type") == "BODY")).alias("bodies"), ifs(F.col("b_type") == "CAPTION").alias("captions"),
        ifs(F.col("b_numeric")).alias("numbers"), ifs(F.col("b_column") == "LEFT").alias("lefts"), ifs(F.col("b_column") == "RIGHT").alias("rights"),
    )
    c = F.col
    wide = (c("x1") - c("x0")) / F.greatest(F.lit(1.0), "text_width")
    density = c("covered") / F.greatest(F.lit(1.0), (c("x1") - c("x0")) * (c("y1") - c("y0")))
    enough = found.where((c("children") >= 2) | ((c("children") == 1) & (c("lines") >= 3) & (c("words") >= 6)))
    score = evidence(
        [
            [("background-fill", 30, c("fill").isNotNull())],
            [("border:frame", 30, c("border") == "frame"), ("border:rules", 20, c("border") == "rules")],
            [("narrower-than-column", 15, wide <= SIDEBAR_SHARE), ("narrow", 5, wide <= 0.85)],
            [("text-density", 10, (density >= 0.12) & (density <= 0.9)), ("mostly-empty", -20, density < 0.06)],
            [("heading-first", 15, c("heading_first"))],
            [("label-body-pattern", 10, c("labels") >= 1)],
            [("body-paragraph", 5, c("bodies") >= 1)],
            [("contains-caption", -50, c("captions") >= 1)],
            [("numeric-cells", -40, c("numbers") * 10 >= c("children") * 3)],
            [("row-shading", -30, c("striped"))],
            [("straddling-blocks", -30, c("straddlers") > c("children"))],
            [("table-or-figure-inside", -40, c("foreign") > 0)],
            [("two-column-text", -40, (c("lefts") > 0) & (c("rights") > 0))],
            [("page-wide-many-blocks", -20, (wide >= 0.95) & (c("children") >= 10))],
        ]
    )
    kind = F.when(wide <= SIDEBAR_SHARE, "SIDEBAR").otherwise("CALLOUT_BOX")
    return enough.withColumn("score", score).select(*panels.columns, "children", kind.alias("container"), c("score.points").alias("points"), c("score.signals").alias("signals"))


def claim_children(scored: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page, block_id, box_id): each block goes to the surest accepted panel that holds it, then the smallest, then the first."""
    accepted = scored.where(F.col("points") >= MIN_PANEL).select("doc_id", "page", "box_id", "x0", "y0", "x1", "y1", "points")
    pairs = _inside(accepted, blocks.select("doc_id", "page", "block_id", "x0", "y0", "x1", "y1", "type", "owned"))
    free = pairs.where((F.col("share") >= INSIDE) & ~F.coalesce("b_owned", F.lit(False)) & ~F.coalesce(F.col("b_type").isin(NEVER_INSIDE), F.lit(False)))
    rank = F.struct((-F.col("points")).alias("p"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("a"), F.col("box_id").alias("i"))
    return free.groupBy("doc_id", "page", F.col("b_block_id").alias("block_id")).agg(F.min_by("box_id", rank).alias("box_id"))
