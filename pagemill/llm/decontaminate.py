"""Benchmark decontamination by a prefix-filtered set join (DataFrame functions only).

A window is 10 consecutive words of an item (the whole item if it is shorter), seen as a set of 3-word
shingles.  A first pass over the corpus counts the shingles of the benchmark, in partial sums only, which
orders them by rarity.  A document holds a window only if it holds all of its shingles, so the necessary
prefix is the rarest one: the second pass joins the corpus with these alone, and a window with a shingle
that the corpus lacks is dropped at once.  Where the shingle stands fixes where the window would start
(positional bound) and end (length bound); survivors are verified word by word.

Nothing but matches of prefixes is ever shuffled, and texts move only for documents with a candidate.  A
window is named by its MD5 digest; the items that share it stay in a table of their own until the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, staged

WINDOW = 10
SHINGLE = 3
#: Tables about the benchmark, and names of documents, are sent to all executors up to this many bytes; beyond,
#: both sides are shuffled.
BROADCAST_BYTES = 48 << 20
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), lambda w: w != "")


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles_of(words: Column, size: int) -> Column:
    """array<long>: the hash of ``size`` words from every position that has as many."""
    at = lambda ws, i: F.xxhash64(*[F.get(ws, i + j) for j in range(size)])
    full = lambda ws: F.when(F.size(ws) >= size, F.transform(F.slice(ws, F.lit(1), F.size(ws) - (size - 1)), lambda w, i: at(ws, i)))
    return bound(words, full)


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(w, window, length, item_id): the windows of every item as words joined by spaces, each item's once."""
    ws = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words_of(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    length = F.least(F.size("ws"), F.lit(window))
    each = ws.select("item_id", length.alias("length"), "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - length + 1)).alias("p"))
    return each.select("item_id", "length", F.concat_ws(" ", F.slice("ws", F.col("p"), F.col("length"))).alias("window")).select(F.md5("window").alias("w"), "window", "length", "item_id").distinct()


def sent(df: DataFrame, row_bytes: Column) -> DataFrame:
    """``df``, marked for sending to all executors where it is small by the given size of its rows."""
    size = df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def positions(docs: DataFrame, sizes: list[int]) -> list[DataFrame]:
    """For each size (doc_id, text_key, n_words, at, h, size): the shingles of every text."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("ws"))
    return [keyed.select("doc_id", "text_key", F.size("ws").alias("n_words"), F.posexplode(shingles_of(F.col("ws"), k)).alias("at", "h"), F.lit(k).alias("size")) for k in sizes]


def prefixes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct (w, window, length) -> (w, window, length, size, h, offset): the rarest shingle of each, if the corpus has all."""
    size = F.least(F.col("length"), F.lit(SHINGLE))
    parts = windows.select("w", "window", "length", size.alias("size"), F.split("window", " ").alias("ws"))
    by_size = [parts.where(F.col("size") == k).select("w", "window", "length", "size", F.posexplode(shingles_of(F.col("ws"), k)).alias("offset", "h")) for k in range(1, SHINGLE + 1)]
    shingles = staged(by_size[0].union(by_size[1]).union(by_size[2]), "shingles")
    sizes = [r["size"] for r in shingles.select("size").distinct().orderBy("size").collect()]  # at most SHINGLE rows
    known = shingles.select("h", "size").distinct()
    counts = shingles.select("h", "size", F.lit(0).cast("long").alias("n")).where(F.lit(False))
    for k, part in zip(sizes, positions(docs, sizes)):
        own = sent(known.where(F.col("size") == k).select("h"), F.lit(24))
        counts = counts.unionByName(part.select("h", "size").join(own, "h").groupBy("h", "size").agg(F.count("*").alias("n")))
    found = staged(counts, "counts")
    rare = shingles.join(found, ["h", "size"], "left").groupBy("w", "window", "length", "size").agg(F.min_by(F.struct("h", "offset"), F.struct("n", "offset")).alias("p"), F.min(F.col("n").isNotNull()).alias("all_known"))
    return staged(rare.where("all_known").select("w", "window", "length", "size", F.col("p.h").alias("h"), F.col("p.offset").alias("offset")), "prefixes")


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text), ``items`` (item_id, text) -> two tables.

    (doc_id, text_key, found) for documents with a hit, ``found`` holding (start, length, w) of every
    occurrence of a window, by start; and (w, window, length, item_id).
    """
    every = staged(item_windows(items, window), "windows")
    prefix = prefixes(docs, every.select("w", "window", "length").distinct())
    sizes = [r["size"] for r in prefix.select("size").distinct().orderBy("size").collect()]  # at most SHINGLE rows
    start = F.col("at") - F.col("offset")
    nothing = docs.select("doc_id", F.lit(0).cast("long").alias("text_key"), F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("w"), F.lit("").alias("window")).where(F.lit(False))
    candidates = nothing
    for k, part in zip(sizes, positions(docs, sizes)):
        own = sent(prefix.where(F.col("size") == k).drop("size"), F.length("window") + 80)
        met = part.join(own, "h").where((start >= 0) & (start + F.col("length") <= F.col("n_words")))
        candidates = candidates.unionByName(met.select("doc_id", "text_key", start.alias("start"), "length", "w", "window"))
    per_doc = staged(candidates.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "length", "w", "window")).alias("candidates")), "candidates")
    names = sent(per_doc.select(F.col("doc_id").alias("n_doc"), F.col("text_key").alias("n_key")), F.lit(24))
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("k"), "text")
    texts = texts.join(names, F.col("d").eqNullSafe(F.col("n_doc")) & (F.col("k") == F.col("n_key")), "left_semi")
    both = per_doc.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))
    verified = bound(words_of(F.col("text")), lambda ws: F.filter("candidates", lambda c: F.concat_ws(" ", F.slice(ws, c["start"] + 1, c["length"])) == c["window"]))
    found = F.transform(F.array_sort(verified), lambda c: F.struct(c["start"].alias("start"), c["length"].alias("length"), c["w"].alias("w")))
    return both.select("doc_id", "text_key", found.alias("found")).where(F.size("found") > 0).dropDuplicates(["doc_id", "text_key"]), every


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key) of the documents that hold a window."""
    return occurrences(docs, items, window)[0].select("doc_id", "text_key")


def covered(found: Column) -> Column:
    """Positions inside any of the occurrences, which are sorted by start."""
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
    step = lambda s, f: F.struct((s["total"] + F.greatest(F.lit(0), f["start"] + f["length"] - F.greatest(s["end"], f["start"]))).alias("total"), F.greatest(s["end"], f["start"] + f["length"]).alias("end"))
    return F.aggregate(found, zero, step, lambda s: s["total"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text, ...), ``items`` (item_id, text, ...) -> doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated, one row per input row.

    Null and empty texts have no words and no hits; items without words have no windows; repeated items
    count once and a null item_id reads "null"; rows that repeat a document each get its result; texts of any
    length are read whole; an empty table of either kind gives no hits; other columns are ignored.
    """
    found, windows = occurrences(docs, items, window)
    found = staged(found, "found")
    # which items: a document's distinct windows, each with its items, each item once
    distinct = found.select("doc_id", "text_key", F.explode(F.array_distinct(F.transform("found", lambda f: f["w"]))).alias("w"))
    named = distinct.join(sent(windows.select("w", "item_id"), F.length("item_id") + 48), "w").groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    named = named.select(F.col("doc_id").alias("i_doc"), F.col("text_key").alias("i_key"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("sha"))
    hit = found.select("doc_id", "text_key", covered(F.col("found")).cast("long").alias("n_hit"))
    hit = hit.join(named, hit["doc_id"].eqNullSafe(named["i_doc"]) & (hit["text_key"] == named["i_key"])).select(F.col("doc_id").alias("d"), "text_key", "n_hit", "n_items", "sha")
    base = docs.select("doc_id", F.xxhash64("text").alias("k"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = base.join(hit, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k") == F.col("text_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the rows (doc_id, text_key) of ``found``: in place when those are few, else shuffled.

    A null text or doc_id is compared like any other value; other columns may have any name.
    """
    names = sent(found.select(F.col("doc_id").alias("g_doc"), F.col("text_key").alias("g_key")), F.lit(24))
    return docs.join(names, docs["doc_id"].eqNullSafe(names["g_doc"]) & (F.xxhash64(docs["text"]) == names["g_key"]), "left_anti")


ORACLE = r"""
WITH b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[p:p + least(len(ws), 10) - 1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS p FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
g AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i) WHERE len(ws) >= n)),
h AS (SELECT g.doc_id, g.p, g.n, i.item_id FROM g JOIN i ON g.n = i.n AND g.w = i.w),
c AS (SELECT doc_id, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
