"""Outlines, trees and pages that are larger or odder than those of the tables."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text
from pagemill.operators import outputs, regions, spatial


def test_subtree_of_any_depth(spark):
    # a chain beyond the hundred levels of a recursive query, a node under two roots, a root that no edge names
    edges = spark.createDataFrame([(1, n, n - 1 if n else None) for n in range(300)] + [(2, 5, 4), (2, 4, None)], "doc_id long, node long, parent long")
    roots = spark.createDataFrame([(1, 0), (1, 290), (2, 4), (3, 7)], "doc_id long, root long")
    want = [(1, 0, n) for n in range(300)] + [(1, 290, n) for n in range(290, 300)] + [(2, 4, 4), (2, 4, 5), (3, 7, 7)]
    assert sorted(map(tuple, outputs.subtree(edges, roots).collect())) == sorted(want)


def test_subtree_of_a_cycle_ends(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, None)], "doc_id long, node long, parent long")
    with pytest.raises(ValueError):
        outputs.subtree(edges, spark.createDataFrame([(1, 1)], "doc_id long, root long"))


def coordinates(rng, n, most=12):
    odd = [float("nan"), -0.0, float("inf"), None]
    return [rng.choice(odd) if rng.random() < 0.03 else float(rng.randrange(most)) for _ in range(n)]


def pages(rng, n):
    return [(rng.choice([1, 1, 1, 2, None]), rng.choice([0, 0, 1, None])) for _ in range(n)]


def test_points_and_boxes_as_their_join(spark):
    # dense pages with ties, inverted boxes, NaN, infinities, nulls, repeated points and pages of one side alone
    rng = random.Random(11)
    for n, most in ((1, 3), (60, 12), (300, 40)):
        points = spark.createDataFrame([(*k, rng.randrange(n), x, y) for k, x, y in zip(pages(rng, n), coordinates(rng, n, most), coordinates(rng, n, most))] + [(9, 9, 1, 1.0, 1.0)], "doc_id long, page int, item_id long, px double, py double")
        sides = [coordinates(rng, n, most) for _ in range(4)]
        rows = [(*k, i % 50 if i % 7 else None, a, b, c if c is None or a is None or rng.random() < 0.1 else a + c, d) for i, (k, a, b, c, d) in enumerate(zip(pages(rng, n), *sides))]
        boxes = spark.createDataFrame(rows + [(8, 8, 1, 0.0, 0.0, 9.0, 9.0)], "doc_id long, page int, box_id long, x0 double, y0 double, x1 double, y1 double")
        inside = points.join(boxes, ["doc_id", "page"]).where("px between x0 and x1 and py between y0 and y1")
        least = inside.selectExpr("*", "(x1 - x0) * (y1 - y0) AS area").groupBy("doc_id", "page", "item_id").agg(F.min_by("box_id", F.struct("area", "box_id")).alias("box_id"))
        want = points.join(least, ["doc_id", "page", "item_id"], "left")
        got = spatial.smallest_container(points, boxes)
        assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
        fills = boxes.withColumn("seq", F.col("box_id")).withColumn("color", F.when(F.col("x0") > 5, "#FFFFFF").otherwise(F.concat(F.lit("#"), F.col("y0").cast("string"))))
        inside = points.join(fills, ["doc_id", "page"]).where("px between x0 and x1 and py between y0 and y1 AND seq IS NOT NULL")
        last = inside.groupBy("doc_id", "page", "item_id").agg(F.max_by("color", F.struct("seq", "color")).alias("color")).withColumn("color", F.when(F.col("color") != "#FFFFFF", F.col("color")))
        want = points.join(last, ["doc_id", "page", "item_id"], "left")
        assert sorted(map(repr, spatial.topmost_fill(points, fills).select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_cells_and_rules_as_their_join(spark):
    rng = random.Random(12)
    for n, most in ((1, 3), (60, 12), (300, 40)):
        columns = [coordinates(rng, n, most) for _ in range(4)]
        cells = spark.createDataFrame([(*k, i, *v) for i, (k, *v) in enumerate(zip(pages(rng, n), *columns))] + [(9, 9, n, 1.0, 2.0, 3.0, 4.0)], "doc_id long, page int, cell_id long, left double, right double, min_top double, max_bottom double")
        rules = spark.createDataFrame([(*k, *v) for k, *v in zip(pages(rng, n), *[coordinates(rng, n, most) for _ in range(3)])], "doc_id long, page int, x0 double, x1 double, y double")
        met = cells.join(rules, ["doc_id", "page"]).where("x1 > left and x0 < right")
        near = met.groupBy("cell_id").agg(F.expr("min(CASE WHEN y >= min_top THEN y END) AS rule_above"), F.expr("max(CASE WHEN y <= max_bottom THEN y END) AS rule_below"))
        want = cells.select("cell_id").join(near, "cell_id", "left")
        got = regions.nearest_rules(cells, rules).select("cell_id", "rule_above", "rule_below")
        same = lambda df: sorted(repr(tuple(v + 0.0 if isinstance(v, float) else v for v in r)) for r in df.collect())
        assert same(got) == same(want)
        pairs = cells.selectExpr("doc_id", "page", "cell_id AS pair_id", "left", "right", "min_top AS upper_y", "max_bottom AS lower_y", "1.0D AS font_size")
        hit = pairs.join(rules, ["doc_id", "page"]).where("x1 > left and x0 < right and y > lower_y + 0.55D * font_size and y < upper_y - 0.2D * font_size").select("pair_id").distinct().withColumn("ruled", F.lit(True))
        want = pairs.select("pair_id").join(hit, "pair_id", "left").select("pair_id", F.coalesce("ruled", F.lit(False)))
        assert sorted(map(tuple, regions.ruled_apart(pairs, rules).select("pair_id", "ruled").collect())) == sorted(map(tuple, want.collect()))


def crowded(spark):
    """One page of 300,000 rows as points, boxes, cells and rules: 90 billion pairs."""
    rows = spark.range(300_000).selectExpr("1L AS doc_id", "1 AS page", "id", "double(id * 7919 % 300007) AS x", "double(id * 104729 % 300017) AS y")
    points = rows.selectExpr("doc_id", "page", "id AS item_id", "x AS px", "y AS py")
    boxes = rows.selectExpr("doc_id", "page", "id AS box_id", "id AS seq", "'#000001' AS color", "x AS x0", "y AS y0", "x + id % 900 AS x1", "y + id % 700 AS y1")
    cells = rows.selectExpr("doc_id", "page", "id AS cell_id", "id AS pair_id", "x AS left", "x + 40 AS right", "y + 12 AS min_top", "y AS max_bottom", "y + 32 AS upper_y", "y AS lower_y", "8.0D AS font_size")
    return points, boxes, cells, rows.selectExpr("doc_id", "page", "x AS x0", "x + 300 AS x1", "y")


@pytest.mark.parametrize(
    "search",
    [
        lambda points, boxes, cells, rules: regions.nearest_rules(cells, rules),
        lambda points, boxes, cells, rules: spatial.smallest_container(points, boxes),
        lambda points, boxes, cells, rules: regions.ruled_apart(cells, rules),
        lambda points, boxes, cells, rules: spatial.topmost_fill(points, boxes),
    ],
)
def test_a_crowded_page_takes_no_pairs(spark, search):
    began = time.time()
    assert search(*crowded(spark)).count() == 300_000
    assert time.time() - began < 40


def test_outline_headings_as_their_join(spark):
    rng = random.Random(13)
    titles = ["Method", "Methods", "Methods and data", "METHODS, and", "Res", "Re", "Resu", "", "--", None, "Methodology", "Results of all", "Results"]
    name = lambda: rng.choice(titles)
    entries = [(rng.choice([1, 2, None]), i % 90, name(), rng.choice([1, 2, 3, 4, None])) for i in range(100)]
    blocks = [(rng.choice([1, 2, None]), i, rng.choice([1, 2, 3, 4, None]), rng.choice([1.0, 2.0, None, float("nan")]), rng.choice(["HEADING", "TITLE", "BODY", "BODY", "HEADER", None]), rng.choice([1, 2, 3]), rng.random() < 0.2, name()) for i in range(60)]
    outline = spark.createDataFrame(entries, "doc_id long, entry long, title string, page int")
    found = spark.createDataFrame(blocks, "doc_id long, block_id long, page int, top double, type string, line_count int, cell boolean, text string")
    b = found.select("doc_id", "block_id", F.col("page").alias("b_page"), "top", "type", "line_count", "cell", F.col("text").alias("b_text"))
    heading = F.col("type").isin("HEADING", "TITLE")
    loose = (F.col("b_page") == F.col("page")) & (F.col("line_count") <= 2) & ~F.col("type").isin("HEADER", "FOOTER") & ~F.col("cell")
    met = outline.join(b, "doc_id").where((heading & (F.col("b_page") >= F.col("page"))) | loose).where(text.title_matches(F.col("b_text"), F.col("title")))
    best = met.groupBy("doc_id", "entry").agg(F.min_by("block_id", F.struct(F.when(heading, 0).otherwise(1), "b_page", -F.col("top"), "block_id")).alias("block_id"))
    want = outline.join(best, ["doc_id", "entry"], "left").select("doc_id", "entry", "block_id")
    assert sorted(map(repr, outputs.snap_outline(outline, found).collect())) == sorted(map(repr, want.collect()))


def test_outline_of_equal_titles_takes_no_pairs(spark):
    rows = spark.range(200_000).selectExpr("1L AS doc_id", "id AS entry", "id AS block_id", "'Methods' AS title", "'Methods and' AS text", "int(id % 5) AS page", "double(id) AS top", "'HEADING' AS type", "1 AS line_count", "false AS cell")
    began = time.time()
    got = outputs.snap_outline(rows.select("doc_id", "entry", "title", "page"), rows.drop("entry", "title")).groupBy("block_id").count().collect()
    assert sorted(map(tuple, got)) == [(199_995 + p, 40_000) for p in range(5)]
    assert time.time() - began < 40
