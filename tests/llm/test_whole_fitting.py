"""Fitting over whole texts."""

from pagemill.llm import quality


def test_fitting_reads_whole_texts(spark):
    # the classes differ only in a passage that stands between evenly spread pieces of 4,096 characters
    body = ("plain words of a body " * 8_000)[:160_000]
    texts = [body[:6_000] + (" zqzqzq" if i % 2 else " jxjxjx") * 40 + body[6_000:] for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    scored = quality.classify(docs, labels).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in scored)
