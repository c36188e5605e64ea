"""Detectors, fonts, paragraphs and outlines on small cases with known results."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import fonts, reporting
from pagemill.operators import detectors, layout, outputs, regions


def test_symbol_fonts(spark):
    rows = [("\uf061 \uf0a3 \uf0d2x", "ABCDEF+Symbol"), ("\uf061", "Wingdings"), ("", "SymbolMT"), (None, "Symbol"), ("\uf061", None), ("\uf0e1\uf0f1", "symbolps-Italic")]
    df = spark.createDataFrame(rows, "text string, font string").select(fonts.normalize_symbol_font(F.col("text"), F.col("font")).alias("s")).select("s.*")
    got = [tuple(r) for r in df.collect()]
    assert got == [("α ≤ \uf0d2x", 2), ("\uf061", 0), ("", 0), (None, None), ("\uf061", 0), ("〈〉", 2)]


def test_symbol_codes():
    codes = dict(zip(fonts.SYMBOL_FROM, fonts.SYMBOL_TO))
    assert len(codes) == len(fonts.SYMBOL_FROM) == len(fonts.SYMBOL_TO) == 159
    assert [codes[chr(0xF000 + c)] for c in (0x21, 0x5F, 0x7E, 0xBC, 0xD1, 0xE5, 0xF2, 0xF5)] == ["!", "_", "∼", "…", "∇", "∑", "∫", "⌡"]
    assert not {chr(0xF060), chr(0xF0D2), chr(0xF0F0), chr(0xF0F4)} & set(codes)


def test_stand_ins(spark):
    rows = [("ﬁve − ★𝒳",), ("plain",), ("",), (None,)]
    df = spark.createDataFrame(rows, "text string")
    got = [tuple(r) for r in df.select(fonts.sanitize_for_font(F.col("text"), [(0x21, 0x7E)]).alias("s")).select("s.*").collect()]
    assert got == [("five - □□", 2), ("plain", 0), ("", 0), (None, None)]
    # Without an f no stand-in of a ligature can be drawn; what the font has stays.
    own = df.select(fonts.sanitize_for_font(F.col("text"), [(0x21, 0x65), (0x67, 0x7E), (0x2212, 0x2212)]).alias("s")).first()["s"]
    assert tuple(own) == ("□ve − □□", 3)


LINES = "doc_id long, page int, region string, line_id long, x double, right double, y double, font_size double, font string"


def _reasons(spark, rows):
    df = layout.paragraphs(spark.createDataFrame([(1, 1, "LEFT", i, *r) for i, r in enumerate(rows)], LINES))
    return [r["reason"] for r in df.orderBy("line_id").collect()]


@pytest.mark.parametrize(
    ("second", "reason"),
    [
        ((50.0, 250.0, 688.0, 10.0, "R"), None),
        ((50.0, 250.0, 698.0, 10.0, "R"), "side-by-side"),
        ((50.0, 250.0, 688.0, 12.0, "R"), "font-size"),
        ((50.0, 250.0, 688.0, 10.0, "B"), "font-change"),
        ((50.0, 250.0, 688.0, 10.0, None), "font-change"),
        ((50.0, 250.0, 681.0, 10.0, "R"), "line-gap"),
        ((57.0, 250.0, 688.0, 10.0, "R"), "indent"),
        ((56.0, 250.0, 688.0, 10.0, "R"), None),
    ],
)
def test_paragraph_reasons(spark, second, reason):
    assert _reasons(spark, [(50.0, 250.0, 700.0, 10.0, "R"), second]) == ["start", reason]


def test_gap_after_a_short_line(spark):
    full = [(50.0, 250.0, 700.0 - 12 * i, 10.0, "R") for i in range(10)]
    assert _reasons(spark, [*full, (50.0, 100.0, 580.0, 10.0, "R"), (50.0, 250.0, 565.0, 10.0, "R")])[-2:] == [None, "line-gap"]
    assert _reasons(spark, [*full, (50.0, 240.0, 580.0, 10.0, "R"), (50.0, 250.0, 565.0, 10.0, "R")])[-2:] == [None, None]


def test_regions_of_a_page_are_apart_and_empty_input(spark):
    rows = [(1, 1, "LEFT", 0, 50.0, 250.0, 700.0, 10.0, "R"), (1, 1, "RIGHT", 1, 320.0, 520.0, 700.0, 10.0, "R"), (None, 1, None, 2, None, None, None, None, None)]
    assert [r["reason"] for r in layout.paragraphs(spark.createDataFrame(rows, LINES)).collect()] == ["start"] * 3
    assert layout.paragraphs(spark.createDataFrame([], LINES)).count() == 0


def test_shaded_columns(spark):
    fill = lambda t, i, x, w, y: (t, i, float(x), float(x + w), float(y), float(y + 10))
    grid = [fill(1, 10 * r + c, 100 * c, 95, 20 * r) for r in range(3) for c in range(4)]
    wide = [fill(1, 100 + r, 0, 195, 20 * r) for r in range(2)]
    few = [fill(2, 10 * r + c, 100 * c, 95, 20 * r) for r in range(3) for c in range(2)]
    over = [fill(3, 10 * r + c, 90 * c, 95, 20 * r) for r in range(3) for c in range(4)]
    fills = spark.createDataFrame(grid + wide + few + over, "table_id long, fill_id long, x0 double, x1 double, y0 double, y1 double")
    tables = spark.createDataFrame([(i, 0.0, 400.0, 100.0, 0.0) for i in (1, 2, 3, 4)], "table_id long, left double, right double, top double, bottom double")
    got = sorted(tuple(r) for r in regions.shaded_columns(fills, tables).collect())
    assert got == [(1, 100.0 * c, 100.0 * c + 95) for c in range(4)]


LABEL = "placement string, text string, words int, bold boolean, medium boolean, caps boolean, title_case boolean, hint double, follows boolean, rule_above boolean, ratio double, width_share double"


def test_label_evidence(spark):
    rows = [
        ("run-in", "METHODS:", 1, True, False, True, False, 1.0, True, False, 1.0, 0.2),
        ("standalone", "a label of 123", 4, False, False, False, False, 0.0, False, False, 1.0, 0.2),
        ("own-line", "Aims", 1, None, None, None, None, None, None, None, None, None),
    ]
    got = [tuple(r["e"]) for r in spark.createDataFrame(rows, LABEL).select(detectors.label_evidence().alias("e")).collect()]
    assert got[0] == (100, ["placement:run-in", "bold-font", "all-caps", "hint-words", "short", "colon", "text-follows"])
    assert got[1] == (0, ["placement:standalone", "short", "no-body-follows", "digits", "lowercase-start"])
    assert got[2] == (50, ["placement:own-line", "short", "paragraph-follows"])


def _panels(spark, boxes, rules=()):
    made = spark.createDataFrame(boxes, "doc_id long, page int, box_id long, x0 double, y0 double, x1 double, y1 double, kind string, colour string")
    pages = spark.createDataFrame([(1, 1, 0.0, 0.0, 612.0, 792.0)], "doc_id long, page int, px0 double, py0 double, px1 double, py1 double")
    lines = spark.createDataFrame(list(rules), "doc_id long, page int, horizontal boolean, x0 double, y0 double, x1 double, y1 double")
    return detectors.candidate_panels(made, pages, lines)


def test_candidate_panels(spark):
    box = (100.0, 100.0, 300.0, 300.0)
    boxes = [
        (1, 1, 1, *box, "fill", "#eeeeee"),
        (1, 1, 2, 101.0, 101.0, 300.0, 300.0, "frame", None),
        (1, 1, 3, 400.0, 100.0, 500.0, 200.0, "fill", "#ffffff"),
        (1, 1, 4, 400.0, 300.0, 500.0, 400.0, "fill", "#ffffff"),
        (1, 1, 5, 10.0, 10.0, 20.0, 20.0, "frame", None),
        (1, 1, 6, 0.0, 0.0, 612.0, 792.0, "fill", "#cccccc"),
    ]
    rules = [(1, 1, True, 398.0, 301.0, 502.0, 301.0), (1, 1, True, 398.0, 399.0, 502.0, 399.0), (1, 1, True, 400.0, 100.0, 500.0, 100.0), (1, 1, False, 400.0, 100.0, 400.0, 200.0)]
    got = sorted((r["box_id"], r["fill"], r["border"]) for r in _panels(spark, boxes, rules).collect())
    assert got == [(1, "#eeeeee", "frame"), (4, None, "rules")]


def test_panels_claim_blocks(spark):
    panels = _panels(spark, [(1, 1, 1, 100.0, 100.0, 300.0, 300.0, "fill", "#eeeeee"), (1, 1, 2, 110.0, 150.0, 280.0, 290.0, "frame", None)])
    schema = "doc_id long, page int, block_id long, ord int, x0 double, y0 double, x1 double, y1 double, type string, column string, lines int, words int, owned boolean, numeric boolean, heading_like boolean, label boolean"
    rows = [
        (1, 1, 1, 1, 120.0, 270.0, 270.0, 285.0, "HEADING", "FULL", 1, 3, False, False, True, None),
        (1, 1, 2, 2, 120.0, 160.0, 270.0, 260.0, "BODY", "FULL", 6, 60, None, None, None, None),
        (1, 1, 3, 3, 120.0, 105.0, 270.0, 140.0, "BODY", "FULL", 2, 20, None, None, None, None),
        (1, 1, 4, 4, 120.0, 110.0, 270.0, 130.0, "FOOTER", "FULL", 1, 2, None, None, None, None),
        (1, 1, 5, 5, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    blocks = spark.createDataFrame(rows, schema)
    scored = detectors.score_panels(panels.withColumn("text_width", F.lit(400.0)).withColumn("striped", F.lit(None).cast("boolean")), blocks)
    got = {r["box_id"]: (r["children"], r["container"], r["points"]) for r in scored.collect()}
    assert got == {1: (3, "SIDEBAR", 75), 2: (2, "SIDEBAR", 75)}
    claimed = {r["block_id"]: r["box_id"] for r in detectors.claim_children(scored, blocks).collect()}
    assert claimed == {1: 2, 2: 2, 3: 1}


def test_label_runs_and_regions(spark):
    schema = "doc_id long, page int, column string, block_id long, ord int, x double, font string, font_size double, blockers int, points int, inline boolean, lines int, blocks int, above string"
    row = lambda d, i, x=50.0, font="B", blockers=0, points=70, lines=5, above=None: (d, 1, "LEFT", i, i, x, font, 10.0, blockers, points, True, lines, 1, above)
    rows = [row(1, 1, above="abstract"), row(1, 2), row(1, 3, points=40), row(1, 4, x=52.0), row(1, 5, blockers=1), row(2, 1), row(2, 2, font="R"), row(3, 1, lines=20), row(3, 2, lines=20)]
    runs = detectors.label_runs(spark.createDataFrame(rows, schema))
    assert {(r["doc_id"], r["block_id"]): r["run"] for r in runs.collect()} == {(1, 1): 1, (1, 2): 1, (1, 4): 1, (1, 5): 2, (2, 1): 1, (2, 2): 2, (3, 1): 1, (3, 2): 1}
    got = [(r["doc_id"], r["n"], r["points"], r["signals"]) for r in detectors.label_regions(runs).collect()]
    assert got == [(1, 3, 100, ["three-or-more", "run-in-majority", "aligned", "abstract-heading-above"])]


def test_outline_order(spark):
    rows = [(1, 1, None, 2), (1, 2, None, 1), (1, 3, 1, 1), (1, 4, 3, 1), (1, 5, 9, 1), (2, 1, 1, 1)]
    items = spark.createDataFrame(rows, "doc_id long, item_id long, parent_id long, ord int")
    assert sorted((r["rank"], r["item_id"], r["depth"]) for r in outputs.outline_order(items).collect()) == [(1, 2, 0), (2, 1, 0), (3, 3, 1), (4, 4, 2)]
    kinds = spark.createDataFrame([("XYZ", [1.0, 2.0, 0.0]), ("FitH", [7.0]), ("FitR", [1.0, 2.0, 3.0, 4.0]), ("Fit", []), ("XYZ", [1.0]), ("XYZ", [1.0, float("nan")]), (None, None)], "kind string, args array<double>")
    assert [r[0] for r in kinds.select(outputs.destination_top(F.col("kind"), F.col("args"))).collect()] == [2.0, 7.0, 4.0, None, None, None, None]


def test_roles_and_reports(spark):
    kinds = spark.createDataFrame([("TITLE", None), ("BODY", "SIDEBAR_LABEL"), (None, None), ("REFERENCE", None)], "kind string, role string")
    assert [r[0] for r in kinds.select(reporting.role_of(F.col("kind"), F.col("role"))).collect()] == ["HEADING", "SIDEBAR_LABEL", "BODY", "REFERENCE"]
    line = spark.range(1).select(reporting.report_line("input tokens", F.lit("1,234")), reporting.report_line("time", F.lit("1234567890123"))).first()
    assert tuple(line) == ("  input tokens                     1,234", "  time                      1234567890123")
