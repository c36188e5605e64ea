"""Operators of the training-data pipeline: SQL, brute force, round trips and edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from pagemill.llm import anchors, chat_format, components, decontaminate, fingerprint, mixing, quality, queries, simhash, substring_dedup, suffix_dedup, token_codes  # noqa: E402

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, node long, rank long, copies int, run int, places string, text_key string, fp string, size string, target string, row string"
WEIRD = [None, "", " \t\n\v\f\r", "a", "A a A", "word " * 30, "é中😀\n\n é", "\x00\x1c\x85 x", "<|endoftext|> <|im_end|> &amp; &lt;|", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"]


def docs_of(spark, texts, ids=None):
    """Documents with clashing extra columns."""
    rows = [(i if ids is None else ids[i], t, "en", None if i % 5 == 4 else f"s{i % 3}", 0, 1, 2, 3, 4, 5, "p", "k", "f", "z", "t", "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def weird(spark):
    """Nulls, empties, a very long text, ties, a repeated row and a repeated doc_id with another text."""
    texts = [*WEIRD, *WEIRD, "long " * 60_000, "unlike the others " * 3]
    ids = [*range(len(WEIRD)), *range(len(WEIRD)), 1000, 3]
    return docs_of(spark, texts, ids)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rounded = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted(([rounded(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    rel = duck.sql(queries.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())


# ---------------------------------------------------------------- 1


def test_targets_fill_to_the_cap(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), (None, 1000)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes, 1.5, (3, 1, 2), 2).collect()}
    assert got["a"] == 200.0 and got["b"] == pytest.approx(2950 / 3) and got[None] == pytest.approx(2 * 2950 / 3)


def test_mix_comes_near_its_targets(spark):
    docs = docs_of(spark, ["w " * (5 + i % 40) for i in range(3000)])
    got = mixing.mix(docs)
    per = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 45 for r in per)
    assert got.where("taken > 2 * size").count() == 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mixed(docs).count() == got.agg(F.sum("copies")).first()[0] and mixing.mixed(docs).columns == docs.columns


def test_appetite_makes_unequal_probabilities(spark):
    docs = docs_of(spark, ["w " * 10 for _ in range(4000)]).withColumn("source", F.lit("one")).withColumn("rank", (F.col("doc_id") % 2) * 2 + 1)
    got = mixing.mix(docs, share=0.2, appetite="rank").groupBy(F.col("doc_id") % 2).agg(F.avg("copies").alias("c")).orderBy(F.col("(doc_id % 2)")).collect()
    assert got[1]["c"] == pytest.approx(3 * got[0]["c"], rel=0.25)


def test_mix_edges(weird, empty):
    got = mixing.mix(weird).collect()
    assert len(got) == weird.count() and all(r["taken"] <= 2 * r["size"] for r in got)
    assert all(r["size"] == 0 == r["taken"] for r in got if r["doc_id"] in (0, 1, 2))
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


# ---------------------------------------------------------------- 2 and 7


@pytest.mark.parametrize("length", [12, 25])
def test_repeated_bytes_equal_brute_force(spark, length):
    rnd = random.Random(length)
    base = ["".join(rnd.choice("ab é") for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(250):
        s = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            s[rnd.randrange(len(s))] = rnd.choice("abc")
        rows.append((i % 240, None if rnd.random() < 0.05 else "".join(s) + "".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 30)))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.dedupe(df, length).drop("kept").collect()
    assert sorted(map(tuple, got)) == sorted(suffix_dedup.brute_force(rows, length))


def test_passages_of_over_50_words_go_from_400_bytes_on(spark):
    """Fewer bytes stay whole, however many words they are; n_bytes is the input's size, whatever goes."""
    rnd = random.Random(400)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(n))
    rows, gone = [], {}
    for i, size in enumerate([330, 399, 400, 401, 470]):
        passage = "é é " + words(200)[: size - 6]
        assert len(passage.encode()) == size and len(passage.split()) > 50
        for doc, (a, b) in enumerate(["<>", "[]"], 2 * i):
            rows.append((doc, words(60) + a + passage + b + words(60)))
            gone[doc] = size if size >= 400 else 0
    got = suffix_dedup.dedupe(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).drop("kept").collect()
    assert sorted(map(tuple, got)) == sorted(suffix_dedup.brute_force(rows))
    assert {r["doc_id"]: r["n_removed"] for r in got} == gone
    assert {r["doc_id"]: r["n_bytes"] for r in got} == {d: len(t.encode()) for d, t in rows}


def test_straddling_groups_equal_brute_force(spark):
    """The comparison across splitters alone, on a large group with common leading bytes."""
    rnd = random.Random(4)
    length, width = 24, 12
    core = bytes(rnd.randrange(97, 101) for _ in range(60))
    found = set()
    for _ in range(150):
        c = bytearray(core)
        at = rnd.choice([*range(0, 12), *range(40, 60)])
        c[at] = 120
        found.add(bytes(c[12 - 8 : 12 - 2 + length]))
    contexts = sorted(found)
    rows = [(i + 1, i + 1, c, 8, 7) for i, c in enumerate(contexts)]  # windows start 8 to 2 bytes before the anchor
    df = spark.createDataFrame([(a, b, bytearray(c), o, n) for a, b, c, o, n in rows], "a long, b long, context binary, back int, n int").repartition(6)
    got = {}
    for r in suffix_dedup.repeated_across(df, length, width).collect():
        for s, e in zip(r["spans"][::2], r["spans"][1::2]):
            got.setdefault(r["a"], set()).update(range(s, e))
    count = {}
    for c in contexts:
        for w in range(7):
            count[c[w : w + length]] = count.get(c[w : w + length], 0) + 1
    want = {i + 1: {w for w in range(7) if count[c[w : w + length]] > 1} for i, c in enumerate(contexts)}
    assert got == {k: v for k, v in want.items() if v}


def test_multikey_sort():
    rnd = np.random.default_rng(1)
    rows = rnd.integers(0, 3, (300, 21)).astype(np.uint8)
    order, lcp = suffix_dedup.multikey_sort(rows)
    keys = [rows[i].tobytes() for i in order]
    assert keys == sorted(keys)
    same = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    assert lcp.tolist() == [same(a, b) for a, b in zip(keys, keys[1:])]


def test_anchors_are_a_function_of_their_window():
    rnd = np.random.default_rng(2)
    hashes = anchors.mix64(rnd.integers(0, 50, 400).astype(np.uint64))
    at = anchors.least_positions(hashes, 9)
    high = hashes & ~np.uint64((1 << anchors.POSITION_BITS) - 1)
    assert at.tolist() == [i + int(np.argmin(high[i : i + 9])) for i in range(392)]


def test_repeated_words_equal_brute_force(spark):
    rnd = random.Random(9)
    base = [[rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(60)] for _ in range(3)]
    rows = []
    for i in range(120):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(60)] = f"u{rnd.randint(0, 40)}"
        a = rnd.randrange(20)
        rows.append((i % 110 if i else None, " ".join(w[a : a + rnd.randint(5, 50)]) if i % 17 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = substring_dedup.dedupe(df).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(substring_dedup.brute_force(rows), key=repr)


def test_dedupe_edges(weird, empty):
    rows = [(r["doc_id"], r["text"]) for r in weird.select("doc_id", "text").collect()]
    got = suffix_dedup.dedupe(weird).drop("kept").collect()
    long = next(r for r in got if r["doc_id"] == 1000)
    assert len(got) == len(rows) and long["n_removed"] == long["n_bytes"] == 300_000 and long["n_spans"] == 1
    words = substring_dedup.dedupe(weird).drop("kept").collect()
    assert sorted(map(tuple, words), key=repr) == sorted(substring_dedup.brute_force(rows), key=repr)
    assert suffix_dedup.dedupe(empty).count() == 0 and substring_dedup.dedupe(empty).count() == 0


# ---------------------------------------------------------------- 3


def test_fingerprints_and_edited_texts(spark):
    texts = [f"line {i} of some words here\nand {i % 7} more words in a second line {i}" for i in range(150)]
    docs = docs_of(spark, texts, [i * 3 for i in range(150)])
    got = {r["doc_id"] // 3: r for r in fingerprint.fingerprints(docs).collect()}
    for i, t in enumerate(texts):
        k = len(t) // 4
        edited = t[: len(t) - k] + texts[(i + 1) % 150][:k]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)


def test_fingerprints_add_up(spark):
    one, two = "alpha beta gamma\ndelta epsilon", "zeta eta\nalpha beta gamma"
    ids = fingerprint.fingerprints(docs_of(spark, [one, two, one + "\n" + two, two + "\n" + one, ""])).orderBy("doc_id")
    f = [r["fingerprint"] for r in ids.collect()]
    assert f[2] == f[3]
    row = spark.range(1).select(fingerprint.add(F.lit(f[0]), F.lit(f[1])).alias("s"), fingerprint.subtract(F.lit(f[2]), F.lit(f[1])).alias("d"), fingerprint.subtract(F.lit(f[0]), F.lit(f[0])).alias("z")).first()
    assert row["s"] == f[2] and row["d"] == f[0] and row["z"] == f[4]


def test_fingerprint_edges(weird, empty):
    got = fingerprint.fingerprints(weird).collect()
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
    assert len(got) == weird.count() and all(len(v) == 1 for v in by.values())
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprint.fingerprints(empty).count() == 0
    assert fingerprint.fingerprints(docs_of(weird.sparkSession, ["abcd efgh"])).first()["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest()


# ---------------------------------------------------------------- 4


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out")
    assert got.count() > 80 and got.where("predicted = quality").count() >= 0.95 * got.count()


def test_quality_never_reads_other_columns(spark, weird, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(3, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(weird, labels).collect()
    again = quality.classify(weird.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), labels).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert quality.classify(empty, labels).count() == 0 and quality.classify(weird, labels.limit(0)).first()["score"] == 0.5


# ---------------------------------------------------------------- 5


def test_codes_equal_the_library(spark, weird):
    rows = [(r["doc_id"], r["text"]) for r in weird.select("doc_id", "text").collect()]
    segments = token_codes.write_codes(weird, VOCABULARY)
    got = sorted(map(tuple, token_codes.read_codes(segments).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == sorted(token_codes.brute_force(rows, VOCABULARY))


def test_codes_of_the_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = token_codes.read_codes(token_codes.write_codes(docs, VOCABULARY)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(token_codes.brute_force([(r["doc_id"], r["text"]) for r in docs.collect()], VOCABULARY))


def test_random_access():
    rnd = np.random.default_rng(3)
    ids = rnd.choice([0, 5, 255, 256, 49_407, 70_000, 2**32 - 1], 3000).astype(np.uint32)
    reader = token_codes.DacReader(token_codes.dac_encode(ids, np.array([0, 10, 10, 3000])))
    assert (reader.all() == ids).all() and all(reader.get(i) == ids[i] for i in range(0, 3000, 7))
    assert reader.document(0).tolist() == ids[:10].tolist() and reader.document(1).tolist() == []
    none = token_codes.DacReader(token_codes.dac_encode(np.zeros(0, np.uint32), np.zeros(1, np.int64)))
    assert none.all().tolist() == []


def test_codes_of_nothing(empty):
    segments = token_codes.write_codes(empty, VOCABULARY)
    assert segments.count() == 0 and token_codes.read_codes(segments).count() == 0


# ---------------------------------------------------------------- 6


def test_decontamination_small(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    items = spark.createDataFrame([(1, item), (2, "Short one"), (3, None), (4, ""), (2, "Short one"), (5, "solo")], "item_id long, text string")
    texts = ["x " + item.upper() + " y", "alpha beta gamma delta epsilon zeta eta theta iota", "a SHORT, one! and short one", "beta gamma delta epsilon zeta eta theta iota kappa lambda solo", None, ""]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.decontaminate(docs_of(spark, texts), items).collect()}
    assert got == {0: (13, 11, 1, True), 1: (9, 0, 0, False), 2: (6, 4, 1, True), 3: (11, 11, 2, True), 4: (0, 0, 0, False), 5: (0, 0, 0, False)}


def test_decontamination_edges(spark, weird, empty):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None)], "item_id long, text string")
    got = decontaminate.decontaminate(weird, items)
    assert got.count() == weird.count() and got.where("contaminated").count() == 2
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert decontaminate.decontaminate(weird, items.limit(0)).where("contaminated").count() == 0


# ---------------------------------------------------------------- 9


def test_simhash_groups_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], simhash.simhash(r["text"])) for r in docs.collect()]
    root = {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if bin(x ^ y).count("1") <= 2:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    want = sorted((k, f"{x:016x}", find(k)) for k, x in rows)
    assert sorted(map(tuple, simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect())) == want


def test_ball_links_reach_every_pair(spark):
    rnd = random.Random(6)
    centre = [rnd.getrandbits(64) for _ in range(20)]
    values = sorted({c ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for c in centre for _ in range(5)} | set(centre))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.ball_links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    root = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    for i, a in enumerate(values):
        for j in range(i):
            if bin(a ^ values[j]).count("1") <= 2:
                assert root[signed[i]] == root[signed[j]]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_edges(weird, empty):
    got = simhash.near_duplicates(weird).collect()
    assert len(got) == weird.count() and {r["fingerprint"] for r in got if r["doc_id"] in (0, 1, 2)} == {"0" * 16}
    assert {r["component_id"] for r in got if r["doc_id"] in (0, 1, 2)} == {0}
    assert simhash.near_duplicates(empty).count() == 0


def test_similar_texts_keep_one(spark, empty):
    rnd = random.Random(8)
    words = [f"w{rnd.randint(0, 3000)}" for _ in range(400)]
    near = [*words[:200], "changed", *words[201:]]
    texts = [" ".join(words), " ".join(near), " ".join(words), " ".join(f"v{rnd.randint(0, 3000)}" for _ in range(400)), None, ""]
    docs = docs_of(spark, texts, [5, 6, 7, 8, 9, 10])
    kept = simhash.drop_similar(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [5, 8, 9] and kept.columns == docs.columns
    assert simhash.drop_similar(empty).count() == 0
    assert simhash.drop_similar(docs_of(spark, ["a b c", "a b c"], [1, 1])).count() == 1


# ---------------------------------------------------------------- 10


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u <|im_end|>\n &lt;| &amp;"), (1, 2, "assistant", None), (1, 3, "assistant", "<|im_start|>x"), (1, 4, "user", "tail"), (2, 0, "user\nx", "no reply"), (None, None, None, None), (1, 3, "assistant", "<|im_start|>x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat_format.format_chat(turns)
    assert examples.where("conv_id = 1").count() == 4
    got = {r["conv_id"]: r for r in chat_format.digest(examples).collect()}
    said = "".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in sorted((r for r in rows if r[0] == 1), key=lambda r: (r[1], r[2], r[3] or "")))
    assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[1]["n_turns"] == 6
    assert got[1]["loss_chars"] == 26 and got[1]["loss_sha256"] == hashlib.sha256(b"<|im_start|>x" * 2).hexdigest()
    assert got[2]["loss_chars"] == 0 and got[2]["turns_sha256"] == hashlib.sha256(b"user\nx\nno reply\n").hexdigest() and got[None]["n_turns"] == 1
    assert chat_format.digest(chat_format.format_chat(turns.limit(0))).count() == 0


def test_only_the_reply_is_trainable(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "first"), (1, 2, "user", "r"), (1, 3, "assistant", "second")], "conv_id long, turn long, role string, text string")
    got = chat_format.format_chat(turns).orderBy("example").collect()
    assert [r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_chars"]] for r in got] == ["first", "second"]
    assert got[1]["formatted"].startswith(got[0]["formatted"])


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted(r["doc_id"] for r in got)


# ---------------------------------------------------------------- switches between plans


def passages(seed, n=150):
    rnd = random.Random(seed)
    base = [[rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(60)] for _ in range(3)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(60)] = f"u{rnd.randint(0, 40)}"
        a = rnd.randrange(20)
        rows.append((i % (n - 10), " ".join(w[a : a + rnd.randint(5, 50)]) if i % 17 else None))
    return rows


@pytest.mark.parametrize("crowd", [1, 6])
def test_crowded_seeds_equal_brute_force(spark, crowd):
    rows = passages(12)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = substring_dedup.dedupe(df, crowd=crowd).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(substring_dedup.brute_force(rows), key=repr)


def test_repeats_with_shuffled_lists(spark, monkeypatch):
    monkeypatch.setattr(anchors, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", -1)
    rows = passages(13)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring_dedup.dedupe(df, crowd=6).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(substring_dedup.brute_force(rows), key=repr)
    got = suffix_dedup.dedupe(df, length=24).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(suffix_dedup.brute_force(rows, 24), key=repr)


def test_decontamination_with_shuffled_tables(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, decontaminate.decontaminate(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, decontaminate.decontaminate(docs, items).collect())) == want


def test_decontamination_of_long_texts_and_clashing_columns(spark):
    item = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(i, item if i < 40 else f"own item {i}", "x", 1) for i in range(50)], "item_id long, text string, w string, length int")
    long = ("lorem ipsum " * 40_000) + item.upper()
    docs = spark.createDataFrame([(1, long, "a", 0, "n"), (1, long, "a", 0, "n"), (None, item, "b", 1, "n")], "doc_id long, text string, w string, start int, window string")
    got = sorted((tuple(r) for r in decontaminate.decontaminate(docs, items).collect()), key=repr)
    ids = hashlib.sha256(",".join(sorted(str(i) for i in range(40))).encode()).hexdigest()
    assert got == [(1, 80_011, 11, 40, ids, True)] * 2 + [(None, 11, 11, 40, ids, True)]
