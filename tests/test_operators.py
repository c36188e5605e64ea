"""Operators on hand-built rows, folds against plain loops, and partition invariance."""

import random

from pyspark.sql import functions as F

from pagemill.operators import batching, layout, scope, spatial
from pagemill.sources import readers
from pagemill.streaming import limiter


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_batches_close_at_either_limit(spark):
    blocks = frame(spark, [(1, i, "x" * 100) for i in range(60)] + [(2, i, "y" * 3000) for i in range(6)], "doc_id long, ord int, text string")
    got = batching.greedy_batches(blocks).groupBy("doc_id", "batch").count().orderBy("doc_id", "batch").collect()
    assert [r["count"] for r in got] == [25, 25, 10, 3, 3]


def test_batches_equal_a_loop(spark):
    rnd = random.Random(5)
    rows = [(d, i, "z" * rnd.randint(1, 900)) for d in range(5) for i in range(80)]
    got = {(r["doc_id"], r["ord"]): r["batch"] for r in batching.greedy_batches(frame(spark, rows, "doc_id long, ord int, text string"), max_blocks=7, max_chars=2500).collect()}
    for d in range(5):
        batch = count = chars = 0
        for _, i, t in (r for r in rows if r[0] == d):
            if count and (count >= 7 or chars + len(t) > 2500):
                batch, count, chars = batch + 1, 0, 0
            count, chars = count + 1, chars + len(t)
            assert got[d, i] == batch


def test_review_budget(spark):
    rows = [("ph", 1, 5, ["PLACEHOLDER_ERROR"]), ("num", 2, 5, ["NUMERIC_MISMATCH"]), ("sym", 3, 5, ["SYMBOL_MISMATCH"]), ("neg", 4, 9, ["NEGATION_WITH_OUTCOME"]), ("low", 5, 1, ["NEGATION_WITH_OUTCOME"])]
    got = batching.select_review(frame(spark, rows, "id string, ord int, score int, triggers array<string>"), 40, 0.1).where("selected").select("id").collect()
    assert {r["id"] for r in got} == {"ph", "num", "sym", "neg"}


def test_replies_and_cache(spark):
    sent = frame(spark, [(1, "a"), (2, "b"), (3, "c")], "id int, text string")
    reply = frame(spark, [(1, "x", 0), (1, "y", 1), (9, "z", 2), (3, " ", 3)], "id int, translation string, seq int")
    ok, missing = batching.accept_reply(sent, reply)
    assert [(r["id"], r["translation"]) for r in ok.collect()] == [(1, "x")] and sorted(r["id"] for r in missing.collect()) == [2, 3]
    cache = frame(spark, [("zh", "h", "a b", "old", 1)], "lang string, term_hash string, norm_text string, translation string, at int")
    newer = batching.cache_upsert(cache, frame(spark, [("zh", "h", "a b", "new", 2)], cache.schema))
    probe = batching.cache_probe(frame(spark, [(" a  b ",), ("c",)], "text string"), newer, "zh", "h")
    assert {r["norm_text"]: r["translation"] for r in probe.collect()} == {"a b": "new", "c": None}


def test_context_is_pruned_inside_a_batch(spark):
    units = frame(spark, [(1, 0, 0, None, "n"), (1, 1, 0, "p", "n"), (1, 2, 1, "p", None)], "doc_id int, ord int, batch int, previous_context string, next_context string")
    got = batching.prune_context(units).orderBy("ord").collect()
    assert [(r["previous_context"], r["next_context"]) for r in got] == [(None, None), (None, "n"), ("p", None)]


def test_body_size_first_wins(spark):
    items = frame(spark, [(1, 0, "abc", 10.0), (1, 1, "def", 12.0)], "doc_id int, item_id long, text string, font_size double")
    assert layout.body_font_size(items).first()["body_size"] == 10.0


def test_baselines_do_not_chain(spark):
    rows = [(1, 1, i, 10.0 * i, 100.0 - 2.0 * i, 10.0, "word") for i in range(4)]
    got = layout.baseline_groups(frame(spark, rows, "doc_id int, page int, item_id long, x double, y double, font_size double, text string"))
    assert [r["row"] for r in got.orderBy("item_id").collect()] == [0, 0, 1, 1]


def test_lines_and_bands(spark):
    rows = [(1, 1, 0, 0.0, 700.0, 20.0, 10.0, "a"), (1, 1, 1, 22.0, 700.0, 20.0, 10.0, "b"), (1, 1, 2, 90.0, 700.0, 20.0, 10.0, "c")]
    got = layout.line_text(frame(spark, rows, "doc_id int, page int, item_id long, x double, y double, width double, font_size double, text string")).orderBy("line").collect()
    assert [r["text"] for r in got] == ["a b", "c"]
    bands = layout.bands(frame(spark, [(1, 0.0, 5.0), (1, 6.0, 9.0), (1, 20.0, 25.0)], "k int, lo double, hi double"), "k", F.lit(3.0)).orderBy("start").collect()
    assert [(b["start"], b["end"]) for b in bands] == [(0.0, 9.0), (20.0, 25.0)]


def test_page_runs_and_levels(spark):
    pages = frame(spark, [(1, p) for p in (3, 1, 2, 7, 5, 6)], "k int, page int")
    runs = scope.page_runs(pages, "k")
    assert sorted((r["start"], r["end"]) for r in runs.collect()) == [(1, 3), (5, 7)]
    assert scope.run_suffix(runs, "k").first()["suffix"] == "_p1-3_5-7"
    settled = scope.settle_levels(frame(spark, [(1, 0, 2), (1, 1, 5), (1, 2, 3)], "doc_id int, ord long, level int"))
    assert [r["level"] for r in settled.orderBy("ord").collect()] == [1, 2, 2]


def test_boxes(spark):
    boxes = frame(spark, [(1, 1, 1, 0.0, 0.0, 100.0, 100.0), (1, 1, 2, 10.0, 10.0, 20.0, 20.0), (1, 1, 3, 10.0, 10.0, 20.0, 20.0), (1, 1, 4, 300.0, 0.0, 310.0, 10.0)], "doc_id int, page int, box_id long, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r["box_id"] for r in spatial.leaf_boxes(boxes).collect()) == [2, 4]
    assert {r["box_id"]: r["cluster"] for r in spatial.clusters(boxes).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    ink = spark.range(1).select(*[spatial.text_color(F.lit(c)).alias(f"c{i}") for i, c in enumerate(["#f4f3ec", "#1f3864", "#000000"])], spatial.text_color(F.lit(None).cast("string")).alias("none")).first()
    assert tuple(ink) == ("dark", "light", "light", "dark")


def test_glossary(spark):
    texts = frame(spark, [("a", "# c\nheart rate (HR) = 心率\nbad line\nx -> y"), ("b", '{"risk": "風險"}')], "key string, text string")
    got = {(r["key"], r["source"]): r for r in readers.parse_glossary(texts).collect()}
    assert got["a", "heart rate"]["abbreviation"] == "HR" and got["b", "risk"]["target"] == "風險" and sum(r["error"] for r in got.values()) == 1
    terms = readers.parse_glossary(texts).where("not error")
    assert {r["key"]: r["glossary"] for r in readers.worker_glossary(terms).collect()}["a"]["heart rate"] == "心率（HR）"


def test_matrices_and_pdf(spark):
    one = spark.range(1)
    m = F.array(*map(F.lit, (2.0, 0.0, 0.0, 2.0, 5.0, 5.0)))
    assert one.select(readers.transform_box(m, F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("b")).first()["b"].asDict() == {"x0": 5.0, "y0": 5.0, "x1": 7.0, "y1": 7.0}
    assert one.select(readers.compose(m, m).alias("m")).first()["m"] == [4.0, 0.0, 0.0, 4.0, 15.0, 15.0]
    assert one.select(readers.is_pdf(F.lit(b"\xff%PDF-1.7"), F.lit("A.PDF")).alias("p")).first()["p"] is True


def test_items_round_trip(spark, tmp_path):
    rows = [(1, 0, 1, "text", 1.005, 2.0, 3.0, 4.0, 9.0, "f", "s", "r", False, [1.0, 0.0, 0.0, 12.0, 0.0, 0.0]), (1, 1, 1, " ", 0.0, 0.0, 0.0, 0.0, 9.0, "f", "s", "r", False, None)]
    frame(spark, rows, readers.ITEMS).write.json(str(tmp_path / "items"))
    got = readers.read_items(spark, str(tmp_path / "items"), "json").collect()
    assert len(got) == 1 and got[0]["font_size"] == 12.0


def test_limiter_batch_equals_the_loop(spark):
    rnd = random.Random(11)
    buckets = (("a", 3, 60), ("b", 100, 30))
    events = [(f"k{rnd.randint(0, 3)}", float(rnd.randint(0, 400)), i, rnd.randint(1, 60)) for i in range(300)]
    got = {r["seq"]: (r["allowed"], r["bucket"], r["retry_after"]) for r in limiter.admit_batch(frame(spark, events, "key string, at double, seq long, cost int"), buckets, {"b": F.col("cost")}).collect()}
    states = {}
    for key, at, seq, cost in sorted(events, key=lambda e: (e[1], e[2])):
        state = states.setdefault(key, limiter.Limiter(buckets))
        assert got[seq] == state.admit(at, {"b": cost}), seq


def test_limiter_clock_and_leases():
    one = limiter.Limiter((("x", 3, 60),))
    assert [one.admit(t, {})[0] for t in (0, 0, 0)] == [True] * 3
    assert one.admit(30, {}) == (False, "x", 30) and one.admit(60, {})[0]
    many = limiter.Limiter((("a", 10, 60), ("b", 100, 60)))
    assert many.admit(0, {"b": 60})[0] and not many.admit(0, {"b": 60})[0] and many.open["a"][0] == 1
    leased = limiter.Limiter(())
    assert leased.admit(0, {}, ("1", 2, 10))[0] and leased.admit(0, {}, ("2", 2, 10))[0]
    assert leased.admit(0, {}, ("3", 2, 10)) == (False, None, 2) and leased.release("1") and leased.admit(0, {}, ("3", 2, 10))[0]


def test_limiter_stream_equals_batch(spark, tmp_path):
    rows = [(f"k{i % 3}", float(i * 7), i) for i in range(60)]
    schema = "key string, at double, seq long"
    frame(spark, rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    buckets = (("x", 3, 60),)
    stream = limiter.admit_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), buckets)
    q = stream.writeStream.format("memory").queryName("decisions").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["seq"]: r["allowed"] for r in spark.sql("select * from decisions").collect()}
    want = {r["seq"]: r["allowed"] for r in limiter.admit_batch(frame(spark, rows, schema), buckets).collect()}
    assert got == want and len(got) == 60


def test_partitions_change_nothing(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 5), i, "t" * rnd.randint(1, 300)) for i in range(300)]
    seen = []
    for n in (1, 2, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = frame(spark, rows, "doc_id int, ord int, text string").repartition(n)
        seen.append(sorted((r["doc_id"], r["ord"], r["batch"]) for r in batching.greedy_batches(df, max_chars=900).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert seen[0] == seen[1] == seen[2]


def test_deep_chapters_and_ends(spark):
    rows = [(1, i, level, page, top) for i, (level, page, top) in enumerate([(1, 1, 700.0), (9, 1, 600.0), (12, 2, 700.0), (9, 3, 780.0), (1, 5, 100.0)])]
    tree = scope.chapter_tree(frame(spark, rows, "doc_id int, ord long, level int, page int, top double"))
    got = {r["ord"]: (r["parent"], r["until"]) for r in tree.collect()}
    assert got == {0: (None, 4), 1: (0, 3), 2: (1, 3), 3: (0, 4), 4: (None, None)}
    ends = {r["ord"]: r["end_page"] for r in scope.end_of_chapter(tree).collect()}
    assert ends == {0: 5, 1: 2, 2: 2, 3: 5, 4: None}
