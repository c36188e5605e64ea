"""Very long and very repetitive texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import fingerprint


def test_likeness_equals_the_unwrapped_cosine(spark):
    rng = random.Random(8)
    repetitive = "again once " * 40_000
    long = " ".join(rng.choices(["w%d" % i for i in range(60)], [1 / (i + 1) for i in range(60)], k=400_000))
    texts = [repetitive, long, " ".join("x%d" % rng.randrange(10**6) for _ in range(100_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["near_edited"] for r in fingerprint.fingerprints(docs).select("doc_id", "near_edited").collect()}

    def projection(text):
        pairs = spark.createDataFrame([(text,)], "text string").select(F.explode(fingerprint.word_pairs(F.col("text"))).alias("a")).groupBy("a").count().collect()
        h, n = np.array([r["a"] for r in pairs]), np.array([r["count"] for r in pairs])
        return np.array([(n * (2 * (h >> j & 1) - 1)).sum() for j in range(fingerprint.LIKENESS)], float)

    for i in (0, 1):
        k = len(texts[i]) // 4
        x, y = projection(texts[i]), projection(texts[i][: len(texts[i]) - k] + texts[i + 1][:k])
        assert got[i] == pytest.approx(x @ y / np.sqrt((x @ x) * (y @ y)), abs=1e-9) and got[i] > 0.9
