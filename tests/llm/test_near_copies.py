"""Near copies against the exact Jaccard similarity of five-word shingles."""

import random

import numpy as np

from pagemill.llm import simhash


def words(rng, n):
    return ["w%06d" % rng.randrange(10**6) for _ in range(n)]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def groups(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["keeper"]["doc_id"] for r in simhash.similar_groups(docs).collect()}


def test_texts_below_the_similarity_stay(spark):
    rng, texts = random.Random(3), []
    for _ in range(60):
        w = words(rng, 204)
        texts += [" ".join(w), " ".join(w[:178] + words(rng, 26))]  # 174 of 226 shingles, 0.77
    assert all(0.76 < alike(a, b) < 0.78 for a, b in zip(texts[::2], texts[1::2]))
    assert all(keeper == doc for doc, keeper in groups(spark, texts).items())


def test_pairs_of_the_similarity_meet(spark):
    rng, texts = random.Random(4), []
    for _ in range(150):
        w = words(rng, 204)
        texts += [" ".join(w), " ".join(w[:182] + words(rng, 22))]  # 178 of 222 shingles, 0.802
    assert all(0.8 <= alike(a, b) < 0.805 for a, b in zip(texts[::2], texts[1::2]))
    got = groups(spark, texts)
    assert all(got[i] == got[i + 1] for i in range(0, len(texts), 2))


def test_short_pairs_of_the_similarity_meet(spark):
    rng, texts = random.Random(5), []
    for _ in range(100):
        w = words(rng, 9)
        texts += [" ".join(w), " ".join(w[:8])]  # 5 and 4 shingles
    got = groups(spark, texts)
    assert all(got[i] == got[i + 1] for i in range(0, len(texts), 2))


def test_crowded_meeting_of_strangers_loses_no_pair(spark):
    # texts around one passage meet in many bands, their partners are seldom first or next to them
    rng = random.Random(6)
    passage, texts = words(rng, 150), []
    for _ in range(150):
        own = words(rng, 50)
        texts += [" ".join(passage + own), " ".join(passage[8:] + own + words(rng, 28))]
    close = {(i, j) for i in range(len(texts)) for j in range(i) if alike(texts[i], texts[j]) >= 0.8}
    assert close == {(i + 1, i) for i in range(0, len(texts), 2)}
    got = groups(spark, texts)
    assert got == {i: i - i % 2 for i in range(len(texts))}


def exact_groups(texts):
    root = list(range(len(texts)))
    sets = [shingles(t) for t in texts]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


def family(seed, n):
    """Edits of one text, near and far, and texts around a common passage."""
    rng = random.Random(seed)
    base, texts = words(rng, 150), []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = words(rng, 1)[0]
        texts.append(" ".join(w if i % 3 else w[:110] + words(rng, 40)))
    return texts


def test_a_crowded_family_equals_brute_force(spark):
    texts = family(7, 160)
    assert groups(spark, texts) == exact_groups(texts)


def test_tiles_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 20)
    monkeypatch.setattr(simhash, "PART_BYTES", 4000)
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", -1)
    texts = family(8, 120)
    assert groups(spark, texts) == exact_groups(texts)


def test_recall_against_exact_similarity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect()
    texts = [r["text"] or "" for r in docs]
    got, sets, found, total = groups(spark, texts), [shingles(t) for t in texts], 0, 0
    by: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(i, j) for ids in by.values() if len(ids) < 200 for i in ids for j in ids if i < j}
    for i, j in pairs:
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            total, found = total + 1, found + (got[i] == got[j])
    assert total > 20 and found >= 0.99 * total


def test_balls_of_simhash_link_before_the_bands(spark, monkeypatch):
    # without a meeting in a band, what is within two bits of SimHash is grouped all the same, and nothing unlike is
    def none(similarity):
        def run(batches):
            for batch in batches:
                yield batch.select([1, 1]).slice(0, 0).rename_columns(["a", "b"])

        return run

    monkeypatch.setattr(simhash, "meeting_pairs", none)
    monkeypatch.setattr(simhash, "SMALL", 10**9)  # no tiles either
    rng, texts = random.Random(8), ["", "one two three"]
    for _ in range(40):
        w = words(rng, 1500)
        at = rng.randrange(1500)
        texts += [" ".join(w), " ".join([*w[:at], "other", *w[at + 1 :]])]
    prints = [simhash.majority(np.unique(simhash.shingle_hashes(t))) for t in texts]
    near = [i for i in range(2, len(texts), 2) if bin(prints[i] ^ prints[i + 1]).count("1") <= 2]
    assert len(near) >= 10
    got = groups(spark, texts)
    assert [i for i in range(2, len(texts), 2) if got[i + 1] == i] == near
    assert sum(keeper != doc for doc, keeper in got.items()) == len(near)
