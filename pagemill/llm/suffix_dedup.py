"""Repeated strings by a distributed sparse suffix array, over bytes.

Only suffixes that can matter are sorted: of every 400-byte window one anchor (see ``anchors``), and of
the anchors those whose leading 201 bytes stand elsewhere too.  Each comes with the bytes around it that
its windows reach (its *context*); equal contexts collapse to one, whose number of places is kept.

Splitters sampled from the suffixes' leading bytes deal them out by range.  A bucket sorts its suffixes
locally by multikey quicksort on 8-byte characters, and their reversed left contexts likewise.  A window
that starts o bytes before its anchor repeats where another suffix agrees in at least 400 - o bytes
rightwards and o bytes leftwards: adjacent common-prefix lengths of the two sorted orders give, for each
o, classes of equal sides, and a window repeats when a second context falls into both of its classes.

A group of suffixes with the same leading 201 bytes may straddle a splitter, however large it is.  Such
groups are compared across the boundary: their windows go out one by one, named by 128 bits of hash, and
a partially aggregated count says which of them stand in a second context (see ``repeated_across``).  So no task holds more than
a bucket and no group needs a cap.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import AnchorFn, anchors_of, keyed, merged, mix64, pack_range, repeated_anchors, runs_per_document, unpack, with_lists
from .common import lean, staged, tasks

LENGTH = 400
#: Windows of this many k-grams share an anchor at most.
WIDTH = 200
#: A bucket is planned for this many bytes of contexts.
BUCKET_BYTES = 24 << 20
SAMPLES_A_BUCKET = 40
#: Blocks of window offsets that straddling groups are first compared by.
BLOCKS = 8

BASE = np.uint64(0x5851F42D4C957F2D)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """BASE and its inverse modulo 2^64 to the powers 0 .. n - 1."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        size = max(n, 1 << 13)
        for i, b in enumerate((BASE, inverse)):
            table = np.full(size, b, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of all runs of k bytes: differences of a polynomial's prefix sums."""
    up, down = _power_tables(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix64((sums[k:] - sums[:-k]) * down[: len(raw) - k + 1])


def byte_anchors(length: int, width: int) -> AnchorFn:
    """The anchors of a text's windows of ``length`` bytes."""

    def find(text: str):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        k = length - width + 1
        return anchors_of(lambda i, j: gram_hashes(raw[i : j + k - 1], k), len(raw) - k + 1, width)

    return find


# ---------------------------------------------------------------- local sort


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the byte rows and the common-prefix lengths of neighbours in it.

    Multikey quicksort with 8-byte characters, all groups of a level at once: rows that agree so far
    form groups, and each round sorts the groups that still hold several by their next character.
    """
    n, width = rows.shape
    padded = -(-width // 8) * 8
    if padded != width:
        rows = np.pad(rows, ((0, 0), (0, padded - width)))
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order, group = np.arange(n), np.zeros(n, np.int64)
    open_ = np.arange(n)  # positions in the order whose group is not settled
    for depth in range(words.shape[1]):
        if len(open_) < 2:
            break
        keys = words[order[open_], depth]
        by = np.lexsort((keys, group[open_]))
        order[open_] = order[open_][by]
        keys, own = keys[by], group[open_]  # groups are contiguous, so their numbers stay in place
        new = np.r_[True, (own[1:] != own[:-1]) | (keys[1:] != keys[:-1])]
        heads = open_[new]
        group[open_] = heads[np.cumsum(new) - 1]
        alone = new & np.r_[new[1:], True]
        open_ = open_[~alone]
    lcp = np.zeros(max(0, n - 1), np.int64)
    for a in range(0, n - 1, 1 << 14):
        part = rows[order[a : a + (1 << 14) + 1]]
        differ = part[1:, :width] != part[:-1, :width]
        lcp[a : a + len(differ)] = np.where(differ.any(1), differ.argmax(1), width)
    return order, lcp


def repeated_windows(contexts: list[bytes], offsets: np.ndarray, counts: np.ndarray, length: int, width: int) -> list[np.ndarray]:
    """For each distinct context which of its windows another context has too.

    Window i of a context starts at its byte i; its anchor stands ``offsets`` bytes into the context.
    """
    n = len(contexts)
    right, left = np.zeros((n, length), np.uint8), np.zeros((n, width - 1), np.uint8)
    for i, (c, o) in enumerate(zip(contexts, offsets.tolist())):
        b = np.frombuffer(c, np.uint8)
        right[i, : len(b) - o] = b[o : o + length]
        left[i, :o] = b[:o][::-1]
    order_r, lcp_r = multikey_sort(right)
    order_l, lcp_l = multikey_sort(left)
    lowest = offsets - counts + 1
    found = [np.zeros(c, bool) for c in counts.tolist()]
    for o in range(int(lowest.min()), int(offsets.max()) + 1):
        here = np.flatnonzero((lowest <= o) & (o <= offsets))
        if len(here) < 2:
            continue
        cls_r, cls_l = np.empty(n, np.int64), np.empty(n, np.int64)
        cls_r[order_r] = np.r_[0, np.cumsum(lcp_r < length - o)]
        cls_l[order_l] = np.r_[0, np.cumsum(lcp_l < o)]
        both = cls_r[here] << 32 | cls_l[here]
        by = np.argsort(both, kind="stable")
        same = both[by][1:] == both[by][:-1]
        twice = np.r_[same, False] | np.r_[False, same]
        for i in here[by[twice]].tolist():
            found[i][int(offsets[i]) - o] = True
    return found


def spans_of(mask: np.ndarray) -> np.ndarray:
    """start, end, start, end ... of the true runs."""
    return np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))


# ---------------------------------------------------------------- Spark


def contexts_of(met: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_key, text, places) -> (doc_id, text_key, first, n, a, b, back, context).

    (a, b) names the context; ``back`` is the anchor's place in it; ``context`` is null where the batch
    has shown the same context before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            rows, firsts, ns, a, b, backs, shown = [], [], [], [], [], [], []
            for i, (text, places) in enumerate(zip(batch.column(2), batch.column(3))):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                at, first, last = unpack(np.unique(places.values.to_numpy()))
                for p, f, t in zip(at.tolist(), first.tolist(), last.tolist()):
                    context = raw[f : t + length]
                    name = xxhash.xxh3_128_intdigest(context, seed=p - f)
                    rows.append(i), firsts.append(f), ns.append(t - f + 1), backs.append(p - f)
                    a.append((name >> 64) - (1 << 63)), b.append((name & (2**64 - 1)) - (1 << 63))
                    shown.append(None if name in seen else context)
                    seen.add(name)
            at_row = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at_row), batch.column(1).take(at_row), pa.array(firsts, pa.int64()), pa.array(ns, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(backs, pa.int32()), pa.array(shown, pa.binary())],
                ["doc_id", "text_key", "first", "n", "a", "b", "back", "context"],
            )

    return met.select("doc_id", "text_key", "text", "places").mapInArrow(lean(run), "doc_id long, text_key long, first long, n int, a long, b long, back int, context binary")


def sampled_splitters(contexts: DataFrame, buckets: int, rows: int, lead: int) -> list[bytes]:
    """At most ``buckets`` - 1 splitters from a sample of the suffixes' leading bytes.

    The sample is sorted by Spark, equal suffixes by their names so that none gathers in one task; only every
    so many-th of it, one splitter a bucket, reaches the driver.
    """
    if buckets < 2:
        return []
    share = min(1.0, buckets * SAMPLES_A_BUCKET / max(1, rows))
    suffix = F.substring(F.col("context"), F.col("back") + 1, F.lit(2 * lead))
    picked = contexts.where((F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 20) - 1)) <= int(share * (1 << 20)))).select(suffix.alias("s"), "a", "b")
    ordered = picked.repartitionByRange(tasks(contexts.sparkSession), "s", "a", "b").sortWithinPartitions("s", "a", "b")
    index = F.monotonically_increasing_id()
    ranked = staged(ordered.select("s", F.shiftright(index, 33).alias("part"), index.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "sample")
    sizes = {r["part"]: r["n"] for r in ranked.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    if not total:
        return []
    wanted = [i * total // buckets for i in range(1, buckets)]
    at = [max((p for p in before if before[p] <= w), key=lambda p: before[p]) for w in wanted]
    named = contexts.sparkSession.createDataFrame([(p, w - before[p]) for p, w in zip(at, wanted)], "part long, place long").distinct()
    found = ranked.join(F.broadcast(named), ["part", "place"])  # one row a bucket
    return sorted({bytes(r["s"]) for r in found.select("s").collect()})


def repeated_in_contexts(shown: DataFrame, length: int, width: int) -> DataFrame:
    """Distinct contexts -> (a, b, spans): the windows that stand in another context as well."""
    spark = shown.sparkSession
    lead = length - width + 1
    total = shown.agg(F.count("*").alias("n"), F.sum(F.length("context")).alias("bytes")).first()
    rows, size = total["n"], int(total["bytes"] or 0)
    buckets = max(tasks(spark), size // BUCKET_BYTES + 1)
    splitters = sampled_splitters(shown, buckets, rows, lead)
    sent = spark.sparkContext.broadcast(splitters)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = sent.value
        straddling = {s[:lead] for s in marks}
        for batch in batches:
            bucket = []
            for context, back in zip(batch.column(2), batch.column(3)):
                c, o = context.as_py(), back.as_py()
                bucket.append(-1 if c[o : o + lead] in straddling else bisect_right(marks, c[o : o + length]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket, pa.int32())], [*batch.schema.names, "bucket"])

    placed = staged(shown.select("a", "b", "context", "back", "n").mapInArrow(lean(place), "a long, b long, context binary, back int, n int, bucket int"), "placed")

    def sort_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts).to_pydict()
        # leading bytes that only one context has cannot repeat
        leads: dict[bytes, int] = {}
        heads = [c[o : o + lead] for c, o in zip(rows["context"], rows["back"])]
        for h in heads:
            leads[h] = leads.get(h, 0) + 1
        keep = [i for i, h in enumerate(heads) if leads[h] > 1]
        if not keep:
            return
        found = repeated_windows([rows["context"][i] for i in keep], np.array([rows["back"][i] for i in keep]), np.array([rows["n"][i] for i in keep]), length, width)
        hit = [(rows["a"][i], rows["b"][i], spans_of(m)) for i, m in zip(keep, found) if m.any()]
        yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hit], pa.int64()), pa.array([h[1] for h in hit], pa.int64()), pa.array([h[2] for h in hit], pa.list_(pa.int64()))], ["a", "b", "spans"])

    inside = placed.where("bucket >= 0").repartitionById(len(splitters) + 1, F.col("bucket")).select("a", "b", "context", "back", "n").mapInArrow(lean(sort_bucket), "a long, b long, spans array<long>")

    straddling = placed.where("bucket < 0").select("a", "b", "context", "back", "n")
    return inside.unionByName(repeated_across(straddling, length, width))


def repeated_across(contexts: DataFrame, length: int, width: int) -> DataFrame:
    """Contexts of groups that straddle a splitter -> (a, b, spans), compared across all buckets.

    The windows that start o bytes before their anchor are taken in blocks of o.  All windows of a block
    share a core of the context, so a block whose core no other context has is settled by one row.  The
    windows of the other blocks are named one by one; those that a batch holds in two contexts are settled
    there, and of each other name one row goes on.  So neither what is unique nor what is common to many
    is multiplied.
    """
    step = -(-width // BLOCKS)

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, block, h = [], [], [], []
            for p, q, context, back, n in zip(*(batch.column(k).to_pylist() for k in range(5))):
                for k in range((back - n + 1) // step, back // step + 1):
                    core = context[back - k * step : back + length - min(width - 1, k * step + step - 1)]
                    a.append(p), b.append(q), block.append(k), h.append(xxhash.xxh3_64_intdigest(core, seed=k) - (1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(block, pa.int32()), pa.array(h, pa.int64())], ["a", "b", "block", "h"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[int, tuple[int, int]] = {}  # name of a window: context and place where it was met first
            again: dict[int, set[int]] = {}  # context: its windows that the batch has elsewhere
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(6))))
            for r, (_, _, context, back, n, blocks) in enumerate(rows):
                for k in blocks:
                    for w in range(max(0, back - k * step - step + 1), min(n - 1, back - k * step) + 1):
                        name = xxhash.xxh3_128_intdigest(context[w : w + length])
                        met = first.setdefault(name, (r, w))
                        if met != (r, w):
                            again.setdefault(r, set()).add(w)
                            again.setdefault(met[0], set()).add(met[1])
            out: list[tuple] = [(rows[r][0], rows[r][1], sorted(ws), 0, 0) for r, ws in again.items()]
            out += [(rows[r][0], rows[r][1], [w], (name >> 64) - (1 << 63), (name & (2**64 - 1)) - (1 << 63)) for name, (r, w) in first.items()]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["a", "b", "at", "x", "y"])

    block_rows = contexts.mapInArrow(lean(cores), "a long, b long, block int, h long")
    shared = block_rows.groupBy("h", "block").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi").select("h", "block")
    open_blocks = staged(block_rows.join(shared, ["h", "block"]).select("a", "b", "block"), "blocks").groupBy("a", "b").agg(F.collect_set("block").alias("blocks"))
    named = staged(contexts.join(open_blocks, ["a", "b"]).select("a", "b", "context", "back", "n", "blocks").mapInArrow(lean(windows), "a long, b long, at array<long>, x long, y long"), "names")
    # a name that one batch has met twice goes on under one context, and matches the others' batches too
    single = named.where("x <> 0 OR y <> 0")
    twice = single.groupBy("x", "y").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi").select("x", "y")
    found = named.where("x = 0 AND y = 0").select("a", "b", "at").unionByName(single.join(twice, ["x", "y"]).select("a", "b", "at"))
    return found.select("a", "b", F.flatten(F.transform("at", lambda v: F.array(v, v + 1))).alias("spans"))


def repeats(docs: DataFrame, length: int = LENGTH, width: int = WIDTH) -> tuple[DataFrame, DataFrame, int]:
    """The keyed texts, (doc_id, text_key, runs) of repeated bytes, and their bytes."""
    texts = keyed(docs)
    found = repeated_anchors(texts, lambda: byte_anchors(length, width))
    places = staged(contexts_of(with_lists(texts, found, "inner"), length), "contexts")
    copies = places.groupBy("a", "b").agg(F.count("*").alias("places"), F.max("n").alias("n")).where("places > 1")
    whole = copies.select("a", "b", F.array(F.lit(0).cast("long"), F.col("n").cast("long")).alias("spans"))
    shown = staged(places.where("context IS NOT NULL").select("a", "b", "n", "back", "context").dropDuplicates(["a", "b"]), "distinct")
    other = repeated_in_contexts(shown, length, width)
    # written before the join, so that the places of one context need not meet in one task
    spans = staged(whole.unionByName(other).groupBy("a", "b").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    hit = places.select("doc_id", "text_key", "first", "a", "b").join(spans, ["a", "b"])
    stop = lambda i: F.col("first") + F.get("spans", i + 1) + (length - 1)
    at = F.filter(F.sequence(F.lit(0), F.size("spans") - 1), lambda i: i % 2 == 0)
    ranges = hit.select("doc_id", "text_key", F.transform(at, lambda i: pack_range(F.col("first") + F.get("spans", i), stop(i))).alias("ranges"))
    runs, size = runs_per_document(ranges, "runs")
    return texts, runs, size


def dedupe(docs: DataFrame, length: int = LENGTH, width: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, one row per input row.

    Every byte that a repeated string of ``length`` bytes covers goes, wherever the string also starts:
    in another row (repeated rows included) or elsewhere in the same one.  ``kept`` is the remaining
    bytes.  Null and empty texts have no bytes; an empty table gives an empty result; other columns are
    ignored.  Very long texts are read whole.  Repeated rows of one doc_id and text remove each other whole when they are long enough.
    """
    docs = docs.select("doc_id", "text")
    texts, runs, size = repeats(docs, length, width or max(1, length // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, spans, sha, kept = [], [], [], [], []
            for text, own in zip(batch.column(1), batch.column(2)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                cuts = np.array(own.as_py() or [], np.int64).reshape(-1, 2).tolist()
                edges = [0, *(x for cut in cuts for x in cut), len(raw)]
                left = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                n.append(len(raw)), gone.append(len(raw) - len(left)), spans.append(len(cuts)), sha.append(hashlib.sha256(left).hexdigest()), kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return with_lists(texts, runs, "left", size).select("doc_id", "text", "runs").mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def brute_force(rows: list[tuple[int | None, str | None]], length: int = LENGTH) -> list[tuple]:
    """The same results from a count of all strings, for tests."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for _, t in rows]
    count: dict[bytes, int] = {}
    name = (lambda s: s) if length < 32 else (lambda s: hashlib.blake2b(s, digest_size=16).digest())
    for raw in raws:
        for i in range(len(raw) - length + 1):
            w = name(raw[i : i + length])
            count[w] = count.get(w, 0) + 1
    out = []
    for (doc, _), raw in zip(rows, raws):
        at = np.array([i for i in range(len(raw) - length + 1) if count[name(raw[i : i + length])] > 1], np.int64)
        starts, ends = merged(at, at + length) if len(at) else (at, at)
        left, last = b"", 0
        for a, b in zip(starts.tolist(), ends.tolist()):
            left, last = left + raw[last:a], b
        left += raw[last:]
        out.append((doc, len(raw), len(raw) - len(left), len(starts), hashlib.sha256(left).hexdigest()))
    return out
