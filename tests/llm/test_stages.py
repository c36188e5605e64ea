"""Every stage of the pipeline on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
EXTRA = ["score", "held_out", "found", "w", "window", "copies", "rank", "target", "node", "root", "text_key", "shingles", "g_doc", "m_row", "h", "start", "n_tokens"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def rows():
    texts = [None, "", " \n\t", "a", "the same short text of a few words", "the same short text of a few words", "long " * 50_000, "é中😀 plain words here to be read"]
    made = [(i if i != 3 else None, t, "en", None if i % 4 == 3 else f"s{i % 2}", 0, *["x"] * len(EXTRA)) for i, t in enumerate(texts)]
    return [*made, made[4]]  # a repeated row


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, name, stage):
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = stage(spark, docs, SF)
    if name != "tokens":
        assert out.columns == docs.columns
        given = {tuple(r) for r in docs.collect()}
        assert {tuple(r) for r in out.collect()} <= given
    else:
        assert out.count() == len(rows())
    nothing = stage(spark, docs.limit(0), SF)
    assert nothing.count() == 0


def test_one_of_each_group_stays(spark):
    near = dict(corpus_pipeline.STAGES)["near_copies"](spark, spark.createDataFrame(rows(), SCHEMA), SF).collect()
    assert sum(r["text"] == "the same short text of a few words" for r in near) == 1
    assert sum(not (r["text"] or "").strip() for r in near) == 1
