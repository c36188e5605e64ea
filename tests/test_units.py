"""Units, requests, reviews and fitting."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions import fitting, text
from pagemill.operators import translate, units

NAMES = [c.split()[0] for c in units.BLOCKS.split(", ")]


def block(i, words, **other):
    base = dict(doc_id=1, ord=i, block_id=f"b{i}", page=1, type="BODY", text=words, translate=True, font_size=10.0, column="FULL", role="BODY", container_id=None, top=700.0 - 50 * i, y=660.0 - 50 * i, x=50.0, width=400.0, line_count=3, cell=False)
    return tuple((base | other)[n] for n in NAMES)


def built(spark, blocks):
    return [(r["unit_id"], r["text"]) for r in units.build_units(spark.createDataFrame(blocks, units.BLOCKS)).orderBy("ord").collect()]


def test_open_paragraphs_merge(spark):
    got = built(spark, [block(0, "The first half of"), block(1, "Page header", type="HEADER", translate=False), block(2, "a sentence ends here."), block(3, "Another one.")])
    assert got == [("merged-b0-b2", "The first half of a sentence ends here."), ("b3", "Another one.")]


def test_headings_and_the_cap_end_a_merge(spark):
    assert built(spark, [block(0, "It stops at"), block(1, "Heading", type="HEADING"), block(2, "the rest.")])[0] == ("b0", "It stops at")
    assert [u for u, _ in built(spark, [block(i, f"part {i} of") for i in range(5)])] == ["merged-b0-b1-b2", "merged-b3-b4"]


def test_tails_go_home(spark):
    got = built(spark, [block(0, "A paragraph that is cut in the"), block(1, "middle.62", line_count=1), block(2, "Next paragraph.")])
    assert got == [("merged-b0-b1", "A paragraph that is cut in the middle.62"), ("b2", "Next paragraph.")]
    got = built(spark, [block(0, "A sentence."), block(1, "Heading", type="HEADING"), block(2, "tail.", line_count=1)])
    assert [u for u, _ in got] == ["b0", "b1", "b2"]


def test_plain_twins_agree(spark):
    rnd = random.Random(1)
    ends = ["the", "word.", "word", "et al.", "[12].", "(see 3)", "x-", "well-", "a,", "b:", "(", "", "Fig.", "non-", "1-"]
    rows = [(f"{rnd.choice(['Some', 'This 5', ''])} {rnd.choice(ends)}", rnd.choice(["tings", "Known", "x", "", "(a)"])) for _ in range(150)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", text.completeness(F.col("a")).alias("c"), text.join_fragments(F.col("a"), F.col("b")).alias("j"))
    for r in df.collect():
        e = units.ending(r["a"])
        assert (e.complete, e.reason, e.strong) == (r["c"]["complete"], r["c"]["reason"], r["c"]["strong"]), r["a"]
        assert units.joined(r["a"], r["b"]) == r["j"]


def test_requests_retry_and_ask_again(spark):
    class Flaky:
        """Fails once, drops every fourth id at first, invents one."""

        def __init__(self):
            self.calls = 0

        def translate(self, rows):
            self.calls += 1
            if self.calls == 1:
                raise translate.ProviderError("rate_limit", 0.0)
            out = [(i, "文 " + t) for i, t in rows if len(rows) <= 5 or int(i) % 4]
            return [*out, ("999", "invented")]

    rows = [(1, i, str(i), f"text {i}") for i in range(40)] + [(2, 0, "0", " ")]
    df = spark.createDataFrame(rows, "doc_id long, ord int, id string, text string")
    got = translate.translate(df, Flaky(), 2, wait=lambda s: None).collect()
    assert len(got) == 41 and all(r["status"] == "done" for r in got if r["doc_id"] == 1)
    ok = translate.translate(df.where("doc_id = 1")).collect()
    assert {r["translation"] for r in ok if r["id"] == "7"} == {"文 7"}


def test_errors_are_rows(spark):
    class Down:
        def translate(self, rows):
            raise translate.ProviderError("auth")

    df = spark.createDataFrame([(1, 0, "a", "x")], "doc_id long, ord int, id string, text string")
    assert translate.translate(df, Down(), wait=lambda s: None).first()["status"] == "failed"
    waits = []
    assert translate.call(lambda u: (_ for _ in ()).throw(translate.ProviderError("timeout")), [1], wait=waits.append) == ([], 3, "timeout") and waits == [1.5, 3.0]


def test_reviews(spark):
    entries = spark.createDataFrame([("a", "5 cases", "6 例"), ("b", "plain", "文"), ("c", "plain", "文"), ("d", "3 cases", "3 例")], "id string, source string, translation string")
    verdicts = spark.createDataFrame([("a", 0, False, "5 例"), ("a", 1, True, None), ("b", 0, True, None), ("d", 0, False, "4 例")], "id string, seq int, ok boolean, correction string")
    got = {r["id"]: (r["translation"], r["qa"], r["rejected"]) for r in translate.apply_review(entries, verdicts).collect()}
    assert got == {"a": ("5 例", "corrected", False), "b": ("文", "ok", False), "c": ("文", "failed", False), "d": ("3 例", "ok", True)}


def test_wrapping():
    assert fitting.wrap("aaaa bbbb cccc", 10, 45) == ["aaaa bbbb", "cccc"]
    assert fitting.wrap("abcdefghij", 10, 25) == ["abcde", "fghij"]
    assert fitting.wrap("中文字，好", 10, 30) == ["中文", "字，好"]
    assert fitting.wrap("中文（好", 10, 30) == ["中文", "（好"] and fitting.wrap("", 10, 30) == []


@pytest.mark.parametrize(("height", "overflow"), [(100.0, False), (18.0, False), (5.0, True)])
def test_fitting(height, overflow):
    found = fitting.fit("some words that wrap", 60.0, height, 10.0)
    assert found.overflow == overflow and 7.0 <= found.size <= 10.0
    assert "".join(found.lines).replace(" ", "") == "somewordsthatwrap"


def test_a_word_goes_back_to_the_line_it_stands_on(spark):
    frame = spark.createDataFrame([block(0, "It is done.", y=650.0), block(1, "diving", line_count=1, y=650.5, top=660.0, x=300.0)], units.BLOCKS)
    with_ends = frame.withColumn("line_end", F.when(F.col("ord") == 0, 290.0))
    got = [(r["unit_id"], r["merge_reason"]) for r in units.build_units(with_ends).collect()]
    assert got == [("merged-b0-b1", "b0→b1 (tail: continues-the-same-line)")]
    assert units.build_units(frame.withColumn("line_end", F.lit(400.0))).count() == 2


def test_a_provider_is_asked_once(spark, tmp_path):
    class Counting:
        """Writes a file for every request, and leaves out every fourth id at first."""

        def __init__(self, folder):
            self.folder = folder

        def translate(self, rows):
            import uuid

            (self.folder / uuid.uuid4().hex).write_text(",".join(i for i, _ in rows))
            return [(i, "文 " + t) for i, t in rows if len(rows) <= 5 or int(i) % 4]

    rows = [(d, i, str(i), f"text {d} {i}") for d in range(3) for i in range(30)]
    got = translate.translate(spark.createDataFrame(rows, "doc_id long, ord int, id string, text string"), Counting(tmp_path), 2, wait=lambda s: None)
    assert got.count() == 90 and got.where("status = 'done'").count() == 90 and got.count() == 90
    asked = [p.read_text().split(",") for p in tmp_path.iterdir()]
    # two requests of at most 25 a document at first, then its missing ids five at a time, whatever was read since
    assert len(asked) == 3 * 2 + 3 * 2 and sum(map(len, asked)) == 90 + 3 * 7 or sum(map(len, asked)) == 90 + 3 * 8
