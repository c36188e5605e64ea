"""Fingerprints against brute force: likeness of texts of any length, sums of whole texts; SimHash by another program."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import fingerprint, simhash

SCHEMA = "doc_id long, text string"


def pairs(text):
    """Words with the next one of their paragraph, counted."""
    out = Counter()
    for line in text.split("\n"):
        words = line.split()
        out.update(zip(words, [*words[1:], None]))
    return out


def cosine(a, b):
    dot = sum(n * b[k] for k, n in a.items())
    size = (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5
    return dot / size if size else 0.0


def zipf(rng, n, names=5000):
    return [f"w{int(names * rng.random() ** 4)}" for _ in range(n)]


def edited(text, after):
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def test_likeness_follows_the_exact_cosine(spark):
    rng = random.Random(2)
    base = zipf(rng, 4000)
    texts = [" ".join(base)]
    for share in (0.02, 0.1, 0.3, 0.6, 1.0):
        texts.append(" ".join(w if rng.random() > share else zipf(rng, 1)[0] for w in base))
    texts += [" ".join(zipf(rng, 200_000)), "same pair " * 40_000, " ".join(zipf(rng, 300))]
    got = fingerprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).orderBy("doc_id").collect()
    for i, r in enumerate(got):
        after = texts[(i + 1) % len(texts)]
        # 63 random projections: a standard deviation of about an eighth at most, less where texts are alike
        for near, other in ((r["near_edited"], edited(texts[i], after)), (r["near_next"], after)):
            exact = cosine(pairs(texts[i]), pairs(other))
            assert abs(near - exact) <= 4 * (1 - exact * exact) / 63**0.5 + 0.02, (i, near, exact)


@pytest.mark.parametrize("words", [100, 40_000, 200_000])
def test_sums_equal_the_whole(spark, words):
    rng = random.Random(words)
    one, two = "\n".join(" ".join(zipf(rng, words // 4)) for _ in range(4)), " ".join(zipf(rng, words))
    rows = [(0, one), (1, two), (2, one + "\n" + two)]
    f = [r["fingerprint"] for r in fingerprint.fingerprints(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()]
    row = spark.range(1).select(fingerprint.add(F.lit(f[0]), F.lit(f[1])).alias("s"), fingerprint.subtract(F.lit(f[2]), F.lit(f[0])).alias("d")).first()
    assert row["s"] == f[2] and row["d"] == f[1]


def test_next_texts_and_order_at_any_partitioning(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(zipf(rng, rng.randrange(0, 40)))) for i in range(120)]
    want = None
    for parts in (1, 7):
        frame = spark.createDataFrame(rows, SCHEMA + "").withColumn("run", F.lit(1)).withColumn("lent", F.lit("x")).repartition(parts)
        got = sorted(map(tuple, fingerprint.fingerprints(frame).collect()))
        want = want or got
        assert got == want


def plain_simhash(text, size=3):
    """The contract, bit by bit."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    grams = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_the_contract(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs] + [(10**6, "Aé Bß"), (10**6 + 1, "ONE two Three"), (10**6 + 2, ""), (10**6 + 3, "x " * 70_000)]
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA + "").withColumn("fp", F.lit(1)).withColumn("root", F.lit(2))).collect()}
    assert got == {k: f"{plain_simhash(t):016x}" for k, t in rows}
    assert np.uint64(int(got[10**6 + 2], 16)) == 0
