"""Block classes and sections of a small paper, and raised and lowered runs."""

from pyspark.sql import functions as F

from pagemill.functions import scripts
from pagemill.operators import sections

PROSE = "This paragraph holds more than a dozen ordinary words, so that it reads as running prose on its page."


def paper(spark, rows):
    """rows: (page, text, size, lines, y, font)"""
    data = [(1, i, f"b{i}", page, words, size, font, lines, "FULL", float(y), float(y + 12 * lines), 400.0) for i, (page, words, size, lines, y, font) in enumerate(rows)]
    blocks = spark.createDataFrame(data, sections.BLOCKS)
    body = spark.createDataFrame([(1, 10.0)], "doc_id long, body_size double")
    return [(r["type"], r["block_type"], r["section"], r["skip_reason"]) for r in sections.classify(blocks, body).orderBy("ord").collect()]


def test_a_small_paper(spark):
    got = paper(spark, [
        (1, "A Study of Many Interesting Things", 18.0, 1, 640, None), (1, "1. Introduction", 12.0, 1, 600, None), (1, PROSE, 10.0, 5, 520, None),
        (2, "Table 1. Results of the trial", 9.5, 1, 640, None), (2, "67.6 ± 5.2", 9.5, 1, 600, None), (2, "COPD", 9.5, 1, 590, None), (2, "Note: values are means", 9.5, 1, 560, None),
        (2, PROSE, 10.0, 4, 480, None), (3, "References", 12.0, 1, 640, None), (3, "[1] Smith, J. A title. 2019;3(2):1-9.", 10.0, 2, 600, None), (3, "and the rest of it", 10.0, 1, 580, None),
        (4, "Figure 1. A flow chart", 9.5, 1, 640, None), (4, "Supplementary Methods", 12.0, 1, 600, None), (4, "How often do you go out?", 10.0, 1, 560, None), (4, "12", 8.0, 1, 20, None),
    ])
    assert [g[0] for g in got] == ["TITLE", "HEADING", "BODY", "CAPTION", "TABLE", "TABLE", "CAPTION", "BODY", "HEADING", "REFERENCE", "REFERENCE", "CAPTION", "HEADING", "BODY", "FOOTER"]
    assert got[4][1:] == ("TABLE_CELL", "MAIN", "NUMERIC_ONLY") and got[5][1] == "TABLE_TEXT_LABEL" and got[6][1] == "TABLE_NOTE"
    assert got[10][3] == "REFERENCE_CONTINUATION" and got[11][2] == "FIGURES" and got[12][1:3] == ("SUPPLEMENTAL_HEADING", "SUPPLEMENTAL") and got[13][1] == "QUESTIONNAIRE"


def test_repeated_furniture_and_wrapped_lines(spark):
    got = paper(spark, [(1, "Journal of Tests 12", 9.0, 1, 760, None), (1, "The trial ran for a total of", 10.0, 3, 600, None), (1, "15 Sessions between groups whereas power output was kept as a ratings of", 10.0, 1, 580, None), (2, "Journal of Tests 13", 9.0, 1, 760, None), (2, "3. Results", 10.0, 1, 600, None)])
    assert [g[0] for g in got] == ["HEADER", "BODY", "BODY", "HEADER", "HEADING"]


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first()["v"]


def test_markers(spark):
    assert one(spark, scripts.glued_markers(F.lit("caregivers.62 and p=0.05, word,16,27-29 then 3.5"))) == ["62", "16,27-29"]
    assert one(spark, scripts.trailing_marker(F.lit("the word.12"))) == "12" and one(spark, scripts.trailing_marker(F.lit("Table 1"))) is None
    assert one(spark, F.array(*[scripts.is_marker(F.lit(t)) for t in ("68", "16,27-29", "a1", "1234")])) == [True, True, False, False]


def test_line_scripts(spark):
    items = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(y).alias("y"), F.lit(s).alias("font_size")) for t, y, s in (("CO", 100.0, 10.0), ("2", 98.0, 6.0), (" rose", 100.0, 10.0), ("12", 104.0, 6.0), (" ", 100.0, 10.0), ("x", 97.0, 6.0))])
    got = one(spark, scripts.line_scripts(items, F.lit(100.0), F.lit(10.0)))
    assert [(g["text"], g["anchor"], g["raised"]) for g in got] == [("2", "CO", False), ("12", "rose", True)]
    assert one(spark, scripts.block_markers(F.array(F.lit("62")), F.lit("end.62 more.7"))) == ["62", "7"]
