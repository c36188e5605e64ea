"""Literal vectors of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import citations, numeric, predicates, risk, text


def many(spark, fn, rows):
    """fn over rows of strings, in one job."""
    width = len(rows[0])
    data = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "i int, " + ", ".join(f"c{j} string" for j in range(width)))
    got = df.select("i", fn(*[F.col(f"c{j}") for j in range(width)]).alias("v")).orderBy("i").collect()
    return [r["v"] for r in got]


def test_join_fragments(spark):
    rows = [("set-", "tings"), ("well-", "known"), ("5-", "year"), ("non-", "Gaussian"), ("a", "b"), ("", "b"), ("out-of-the-", "box"), ("X-", "ray")]
    assert many(spark, text.join_fragments, rows) == ["settings", "well-known", "5-year", "non-Gaussian", "a b", "b", "out-of-the-box", "X-ray"]


def test_completeness(spark):
    rows = [("a basic word",), ("and with the",), ("by Smith et al.",), ("as shown [12].",), ("",), ("first,",), ("that is:",), ("word (Smith, 2020)",)]
    got = [(v["complete"], v["reason"], v["strong"]) for v in many(spark, text.completeness, rows)]
    assert [g[0] for g in got] == [False, False, False, True, True, False, True, False]
    assert [g[2] for g in got] == [False, True, True, False, False, True, False, False]
    assert got[1][1] == "ends-with-function-word:the" and got[2][1] == "abbreviation"


def test_contexts(spark):
    long = "One two three. Four five six seven. Eight nine"
    assert many(spark, lambda c: text.tail_context(c, 30), [("short",)]) == ["short"]
    tail, head = many(spark, lambda c: text.tail_context(c, 20), [(long,)])[0], many(spark, lambda c: text.head_context(c, 20), [(long,)])[0]
    assert tail == "Eight nine" and head == "One two three."
    assert many(spark, lambda c: text.head_context(c, 10), [("abcdefghijklmnop",)]) == ["abcdefghij…"]


def test_hash_tokens_cache(spark):
    assert many(spark, text.fnv1a, [("hello",), ("foobar",), ("",)]) == ["4f9f2cab", "bf9cf968", "811c9dc5"]
    assert many(spark, text.estimate_tokens, [("abcd",), ("中文",), ("ab中",), ("",)]) == [1, 3, 2, 0]
    assert many(spark, text.normalize_cache_text, [(" A　b\n c​ ",)]) == ["A b c"]


def test_titles(spark):
    assert many(spark, text.sanitize_title, [("3. Results",), ("!!",)]) == ["3-Results", "chapter"]
    assert many(spark, text.title_matches, [("2. Methods", "2 METHODS"), ("Intro", "Introduction"), ("Results", "Results and discussion")]) == [True, False, True]
    assert many(spark, text.numbered_level, [("2.1 Participants",), ("IV. End",), ("Plain",)]) == [2, 1, None]


@pytest.mark.parametrize(
    ("value", "numeric_cell", "notation"),
    [("67.6 ± 5.2", True, False), ("p<0.001", True, True), ("n=12", True, True), ("—", True, False), ("NA", True, True), ("12.3a", True, False), ("85.9 y", True, False), ("OR (95% CI)", False, True), ("SD", False, True), ("n (%)", False, True), ("No", False, False), ("mean (SD)", False, False), ("", False, False)],
)
def test_cells(spark, value, numeric_cell, notation):
    assert many(spark, predicates.is_numeric_cell, [(value,)]) == [numeric_cell]
    assert many(spark, predicates.is_stat_notation, [(value,)]) == [notation]


def test_predicates(spark):
    assert many(spark, predicates.skip_kind, [("x",), ("10.1000/abc",), ("https://a.b/c",), ("a@b.co",), ("[12, 13]",), ("page 3 of 9",), ("12.5",), ("ab",), ("A real sentence",)]) == ["empty", "doi", "url", "email", "citation-marker", "page-number", "NUMERIC_ONLY", "no-letters", None]
    assert many(spark, predicates.caption_kind, [("Table 3. Results",), ("Figure 2: Flow",), ("Table of contents",), ("Appendix Figure S1 | x",)]) == ["TABLE", "FIGURE", None, "FIGURE"]
    assert many(spark, predicates.is_reference_entry, [("[1] Smith",), ("Smith, J., and Lee",), ("In 2019 et al said",), ("Plain prose",)]) == [True, True, True, False]
    assert many(spark, predicates.is_numeric_row, [("72.69 ± 3.7 95.54 ± 4.1 Post 137.03",), ("one two 3",)]) == [True, False]
    assert many(spark, predicates.is_abbreviation_only, [("COPD",), ("LABA + ICS",), ("Copd",)]) == [True, True, False]
    assert many(spark, predicates.looks_suspicious, [("(cid:12)",), ("a",), ("fine",)]) == [True, True, False]


def test_numeric_signature(spark):
    got = many(spark, numeric.signature, [("p<0.05, n=30, 12.4%, 10–15, −2.5, 1,000, .05",)])[0]
    assert got["numbers"] == sorted(["-2.5", "0.05", "0.05", "10", "1000", "12.4%", "15", "30"])
    assert got["stats"] == ["n=30", "p<0.05"]


def test_numeric_compare(spark):
    rows = [("p = 0.03", "p = 0.3"), ("410 million people", "4.10 億人"), ("three groups", "3 組"), ("2 groups", "兩組"), ("phase II", "第 2 期")]
    got = many(spark, numeric.compare, rows)
    assert [g["ok"] for g in got] == [False, True, True, True, True]
    assert got[0]["missing"] == ["0.03", "p=0.03"] and got[0]["added"] == ["0.3", "p=0.3"]
    assert many(spark, numeric.missing_symbols, [("ΔFEV1 ≥ 5%", "FEV1 5%"), ("∆x", "Δx")]) == [["Δ", "≥"], []]


def test_citations(spark):
    rows = [("as in [12-15]", "見 [12–15]"), ("see [12]", "見 [13]"), ("(Smith et al., 2024) and Figure 2", "(Smith et al., 2024) Figure 2")]
    got = many(spark, citations.compare, rows)
    assert [g["ok"] for g in got] == [True, False, True] and got[1]["missing"] == ["[12]"] and got[1]["added"] == ["[13]"]


def test_protect_and_restore(spark):
    source = "Smith et al. (2024) said [3] see a@b.org (Lee, 2020)"
    df = spark.createDataFrame([(source,), (None,), ("__CITE_1__ kept",)], "t string").select("t", citations.protect("t").alias("p"))
    rows = df.select("t", "p.*").collect()
    assert rows[0]["text"] == "__CITE_3__ said __CITE_1__ see __EMAIL_1__ __CITE_2__" and rows[2]["placeholders"] == []
    spelled = rows[0]["text"].replace("__CITE_3__", "_CITE_ 03 __").replace(" __CITE_2__", " __CITE_9__")
    back = spark.createDataFrame([(spelled, rows[0]["placeholders"])], "t string, p array<struct<token:string,kind:string,value:string>>").select(citations.restore("t", "p").alias("r")).first()["r"]
    assert back["text"].startswith("Smith et al. (2024) said [3] see a@b.org") and back["missing"] == ["__CITE_2__"] and back["leftover"] == ["__CITE_9__"]


def test_risk(spark):
    f, t = F.lit(False), F.lit(True)
    case = lambda s, d, merged=f, cross=f, inc=f, num=t, cit=t, lost=0: (s, d, merged, cross, inc, num, cit, lost)
    cases = [
        (case("Plain words here", "文"), "none", []),
        (case("There was no significant difference in mortality.", "文"), "hard", ["NEGATION_WITH_OUTCOME"]),
        (case("This may reduce mortality by 15%.", "文"), "hard", ["UNCERTAINTY_WITH_OUTCOME"]),
        (case("This may reflect a habit.", "文"), "soft", []),
        (case("Plain", "文", num=f), "hard", ["NUMERIC_MISMATCH"]),
        (case("Plain", "文", cross=t, inc=t), "hard", ["CROSS_PAGE_INCOMPLETE"]),
        (case("not only this", "文"), "none", []),
    ]
    one = spark.range(1)
    for (s, d, *rest, lost), level, triggers in cases:
        got = one.select(risk.assess(F.lit(s), F.lit(d), *rest, F.lit(lost)).alias("r")).first()["r"]
        assert (got["level"], got["triggers"]) == (level, triggers), s
