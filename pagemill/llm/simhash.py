"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits have a common variant within half the radius of
each.  Every distinct fingerprint emits all its variants in that ball, variants are dealt out by value,
and fingerprints that meet in a variant are linked and verified.  Distinct fingerprints that share a
variant lie in one ball around it, so a meeting holds at most 65 of them for radius 2 whatever the
data: copies collapse before this, and no bucket needs a cap.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import BROADCAST_BYTES, mix64
from .common import lean, staged, tasks
from .components import connected_components

BITS = 64
#: Bands of a text's least hashes, and least hashes in a band: two texts that are 0.8 alike share no band
#: with probability (1 - 0.8 ** 5) ** 24, less than 1 in 10,000.
BANDS, BAND = 24, 5
#: Meetings of up to this many texts compare all pairs at once; larger ones start from up to so many pivots.
SMALL, PIVOTS = 16, 32
#: Larger meetings are read in parts of about this many texts, and no part holds much more than this many shingles.
PART, PART_BYTES = 4096, 2 << 20


def simhash(text: str | None, shingle: int = 3, fold: bool = True) -> int:
    """Bits set in over half of the XXH64 (seed 42) hashes of all word shingles; 0 without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = (raw.lower() if fold else raw).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), 42)
    if shingle == 3:
        hashes = [digest(b"%b %b %b" % t, 42) for t in zip(words, words[1:], words[2:])]
    else:
        hashes = [digest(b" ".join(words[i : i + shingle]), 42) for i in range(len(words) - shingle + 1)]
    return majority(hashes)


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits set in over half of the hashes, 0 without any."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, fold: bool = True) -> DataFrame:
    """``docs`` -> doc_id, fp (the fingerprint's 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([simhash(t.as_py(), shingle, fold) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


def ball(radius: int) -> list[int]:
    """Masks of all changes of at most ``radius`` bits, as signed longs."""
    masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(BITS), r)]
    return [m - (1 << BITS) if m >> 63 else m for m in masks]


def ball_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct fingerprints (fp) -> verified links (a, b), enough to connect all within ``radius``.

    Within a meeting all fingerprints are linked to its least one; for an even radius any two of them
    are within the radius by the triangle inequality, and the distance is verified all the same.  For
    an odd radius one side emits the larger half, and the check decides.
    """
    near, far = ball(radius // 2), ball(radius - radius // 2)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_v = last_head = None
        for batch in batches:
            if not batch.num_rows:
                continue
            v, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            start = np.r_[True, v[1:] != v[:-1]]
            if last_v is not None and v[0] == last_v:
                start[0] = False
            at = np.maximum.accumulate(np.where(start, np.arange(len(v)), -1))
            head = np.where(at >= 0, fp[at], last_head if last_head is not None else 0)
            last_v, last_head = v[-1], head[-1]
            gap = np.unpackbits((head ^ fp).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1).sum(1)
            keep = (head != fp) & (gap <= radius)
            yield pa.RecordBatch.from_arrays([pa.array(fp[keep]), pa.array(head[keep])], ["a", "b"])

    masks = F.array(*[F.lit(m).cast("long") for m in far])
    variants = distinct.select("fp", F.explode(masks).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp")
    if len(near) != len(far):
        raise ValueError("only even radii are supported")
    dealt = variants.repartition(tasks(distinct.sparkSession), "variant").sortWithinPartitions("variant", "fp")
    return dealt.mapInArrow(lean(met), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, fold: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, fingerprint, component_id, one row per input row.

    component_id is the least doc_id reachable over links of at most ``radius`` differing bits.
    Null and empty texts have fingerprint 0 and are linked like any other; a repeated row gives a
    repeated result; a null doc_id keeps its row and never names a component unless it is alone; an
    empty table gives an empty result; other columns are ignored.
    """
    fps = staged(fingerprints(docs, shingle, fold), "simhash")
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = connected_components(ball_links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select(F.col("fp").alias("n_fp"), "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(named, F.col("fp") == F.col("n_fp")).select("doc_id", hexed, "component_id")


# ---------------------------------------------------------------- lower similarity

# Texts first meet by ball hashing of their SimHash, and what meets is verified on the sets of shingles.  Two
# texts of five-word shingles that are 0.8 alike differ in about 0.15 of their SimHash bits, far
# beyond a radius that a ball of variants can cover, and slices of a wider fingerprint lose a third of such
# pairs.  So what the balls leave apart meets again by bands of least hashes (a band is shared with probability
# similarity ** BAND, however short or long the texts are), and is verified likewise.


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``shingle`` words, of all words where there are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]][:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n)


SALTS = mix64(np.arange(1, BANDS * BAND + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """For each of SALTS the least salted hash of a text's shingles."""
    least = np.full(len(SALTS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, mix64(hashes[None, at : at + (1 << 12)] ^ SALTS[:, None]).min(1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One hash a band over its number and its least hashes."""
    parts = least.reshape(BANDS, BAND)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND):
        keys = mix64(keys ^ parts[:, i])
    return keys


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that sets of shingles take little memory at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def meetings(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.Table]:
    """The rows of each value of the first column, from batches sorted by it; in parts of about ``most`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        v = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else []
        for lo, hi in zip(edges, np.r_[edges[1:], len(v)].astype(int)):
            if held and (held[0].column(0)[0].as_py() != v[lo] or (most and sum(b.num_rows for b in held) >= most)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def plausible(p: np.ndarray, q: np.ndarray, size: np.ndarray, sketch: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs of rows p, q can be that alike, by the sizes of their sets and by their sketches.

    Sketches may fall short of the similarity by four standard deviations of their estimate.
    """
    n = sketch.shape[1]
    least = n * (similarity - 4 * (similarity * (1 - similarity) / n) ** 0.5)
    fits = np.minimum(size[p], size[q]) + 1e-9 >= similarity * np.maximum(size[p], size[q])
    return fits & ((sketch[p] == sketch[q]).sum(1) >= least)


def pivot_pairs(sketch: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a meeting that join most of what is alike: each row with its two nearest pivots, and all pivots.

    The first pivot is the row nearest to all; the next ones are nearest to what is not clearly like a pivot yet.
    """
    k, n = sketch.shape
    left, pivots, alike = np.arange(k), [], []
    while len(left) and len(pivots) < PIVOTS:
        common = np.array([np.bincount(c, minlength=256).argmax() for c in sketch[left].T], np.uint8)
        pivots.append(left[(sketch[left] == common).sum(1).argmax()])
        alike.append((sketch == sketch[pivots[-1]]).sum(1).astype(np.int16))
        left = left[alike[-1][left] < n * min(1.0, similarity + 0.05)]
    order = np.argsort(-np.stack(alike), axis=0, kind="stable")
    every, at = np.arange(k), np.array(pivots)
    for nth in order[:2]:
        other = at[nth]
        yield every[every != other], other[every != other]
    i, j = np.triu_indices(len(at), 1)
    if len(i):
        yield at[i], at[j]


def meeting_pairs(similarity: float):
    """A mapInArrow function over sorted (variant, node, root, size, sketch) that yields plausible pairs (a, b) of different roots.

    All pairs of small meetings; of larger ones, which are read in parts, those of ``pivot_pairs``.
    """

    def pairs_of(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        node, root, size = (t.column(c).to_numpy() for c in ("node", "root", "size"))
        if (root == root[0]).all():
            return
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
        for p, q in [np.triu_indices(len(node), 1)] if len(node) <= SMALL else pivot_pairs(sketch, similarity):
            near = (root[p] != root[q]) & plausible(p, q, size, sketch, similarity)
            x, y = node[p[near]], node[q[near]]
            yield np.maximum(x, y), np.minimum(x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for t in meetings(batches, PART):
            for pair in pairs_of(t) if t.num_rows > 1 else ():
                held.append(pair)
                rows += len(pair[0])
                if rows > 1 << 15 or len(held) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], ["a", "b"])
                    held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], ["a", "b"])

    return run


def tile_links(similarity: float):
    """A mapInArrow function over sorted (tile, band, left, right, node, root, main, size, sketch, keys, shingles) that yields links (a, b).

    In a tile every left text is compared with every right one of another component; the most alike first, and
    none of a component that it has just been linked to.  Two texts that share several bands are compared in
    the first of them, two stragglers from the side of the greater one.
    """

    def links_of(t: pa.Table) -> Iterator[tuple[int, int]]:
        left, right, main = (t.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right", "main"))
        node, root, size, band = (t.column(c).to_numpy() for c in ("node", "root", "size", "band"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
        keys = np.frombuffer(b"".join(t.column("keys").to_pylist()), "<i8").reshape(len(node), -1)
        sets, linked = t.column("shingles"), set()
        others = np.flatnonzero(right)
        for i in np.flatnonzero(left).tolist():
            j = others[(root[others] != root[i]) & (main[others] | (node[others] < node[i]))]
            j = j[plausible(np.full(len(j), i), j, size, sketch, similarity)]
            j = j[~(keys[j, : band[i]] == keys[i, : band[i]]).any(1)] if band[i] else j
            if not len(j):
                continue
            x = np.frombuffer(sets[i].as_py(), "<u8")
            for k in j[np.argsort(-(sketch[j] == sketch[i]).sum(1), kind="stable")].tolist():
                pair = (root[i], root[k])
                if pair not in linked and alike(x, np.frombuffer(sets[k].as_py(), "<u8"), similarity):
                    linked |= {pair, pair[::-1]}
                    yield node[i], node[k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in meetings(batches):
            found = list(links_of(t))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets are that alike by Jaccard."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common + 1e-9 >= similarity * (len(x) + len(y) - common)


def sets_of(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, shingles) of the distinct ``nodes``."""
    needed = staged(nodes.distinct(), "needed")
    few = needed.count() * 16 <= BROADCAST_BYTES
    return staged(rows.select("node", "shingles").join(F.broadcast(needed) if few else needed, "node", "left_semi").dropDuplicates(["node"]), "sets")


def verified(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose sets of shingles (node, shingles in ``rows``) are that alike by Jaccard."""
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), rows)
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias("set_" + name))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = [alike(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8"), similarity) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(lean(check), "a long, b long")


def crossing_links(named: DataFrame, mixed: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """Links between components inside the larger meetings of several, all pairs compared -> (a, b).

    Most of such a meeting is one component, its main one; the others are stragglers.  The meeting's texts are cut
    into ``blocks``, and a tile is a block of stragglers against a block of all, with their sets: so a task
    holds two blocks, however large the meeting, and what leaves it are links, not pairs.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = [np.frombuffer(k.as_py(), "<i8") for k in batch.column(0)]
            at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            band = np.concatenate([*(np.arange(len(k)) for k in keys), np.zeros(0, np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), pa.array(band), *(c.take(at) for c in batch.columns[1:])], ["variant", "band", *batch.schema.names[1:]])

    few = mixed.count() * 32 <= BROADCAST_BYTES
    slim = named.select("keys", "node", "root").mapInArrow(lean(emit), "variant long, band int, node long, root long")
    members = staged(slim.join(F.broadcast(mixed) if few else mixed, "variant"), "members")
    main = members.groupBy("variant", "root").count().groupBy("variant").agg(F.max_by("root", F.struct("count", "root")).alias("m_root")).withColumnRenamed("variant", "m_variant")
    placed = members.join(F.broadcast(main) if few else main, F.col("variant") == F.col("m_variant")).withColumn("main", F.col("root") == F.col("m_root")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_right = F.transform(every, lambda r: F.struct(r.alias("r"), F.col("own").alias("c")))
    as_left = F.transform(every, lambda c: F.struct(F.col("own").alias("r"), c.alias("c")))
    tiled = placed.withColumn("t", F.explode(F.when(F.col("main"), as_right).otherwise(F.array_union(as_right, as_left))))
    left = ~F.col("main") & (F.col("t.r") == F.col("own"))
    tiled = tiled.select(F.xxhash64("variant", "t.r", "t.c").alias("tile"), "band", left.alias("left"), (F.col("t.c") == F.col("own")).alias("right"), "node", "root", "main")
    sets = sets_of(members.select("node"), rows)
    both = tiled.join(named.select("node", "size", "sketch", "keys"), "node").join(sets, "node").select("tile", "band", "left", "right", "node", "root", "main", "size", "sketch", "keys", "shingles")
    dealt = both.repartition(tasks(named.sparkSession), "tile").sortWithinPartitions("tile", "node")
    return dealt.mapInArrow(lean(tile_links(similarity)), "a long, b long").distinct()


def ball_pairs(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Texts (node, fp) -> pairs (a, b) of nodes that connect all whose SimHash is within ``radius`` bits, not verified."""
    distinct = staged(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fps")
    links = staged(ball_links(distinct.select("fp"), radius), "balls")
    side = lambda name: distinct.select(F.col("fp").alias(name), F.col("least").alias("n_" + name))
    met = links.join(side("a"), "a").join(side("b"), "b").select(F.col("n_a").alias("a"), F.col("n_b").alias("b"))
    same = nodes.join(distinct, "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return met.union(same)


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, text_key, keeper: the least (doc_id, text_key) of each row's group.

    Texts whose SimHash, over their set of shingles, is within ``radius`` bits meet by ball hashing.  Then every
    text emits the keys of its bands, for what is alike beyond the balls.  Small meetings compare all pairs; larger ones first link
    their members to a few of them, and then compare all pairs that these links have not joined into one
    component, which need no link any more (``crossing_links``).  A link stands if the Jaccard similarity of
    the sets of shingles is ``similarity`` or more.  Texts with one set of shingles collapse first, so repeated
    rows and copies cost nothing.  Null and empty texts are one group; texts of any length are read whole; an
    empty table gives an empty result; other columns are ignored.
    """

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes = [np.unique(shingle_hashes(t.as_py(), shingle)).astype("<u8") for t in batch.column(2)]
            sets = [h.tobytes() for h in hashes]
            node = np.array([xxhash.xxh64_intdigest(s, 42) for s in sets], np.uint64).view(np.int64)
            least = [least_hashes(h) for h in hashes]
            keys = [band_keys(v).astype("<u8").tobytes() if len(h) else b"" for h, v in zip(hashes, least)]
            sketch = [v.astype(np.uint8).tobytes() for v in least]
            fp = np.array([majority(h) for h in hashes], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(node), pa.array(fp), *(pa.array(c, pa.binary()) for c in (sets, keys, sketch))], ["doc_id", "text_key", "node", "fp", "shingles", "keys", "sketch"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = [np.frombuffer(k.as_py(), "<i8") for k in batch.column(0)]
            at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), *(c.take(at) for c in batch.columns[1:])], ["variant", *batch.schema.names[1:]])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    schema = "doc_id long, text_key long, node long, fp long, shingles binary, keys binary, sketch binary"
    rows = staged(slim.mapInArrow(lean(marks), schema), "marks")
    nodes = staged(rows.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first(F.length("shingles")).alias("size")), "nodes")
    balls = staged(verified(staged(ball_pairs(nodes.select("node", "fp"), radius), "meet"), rows, similarity), "near")
    near = staged(connected_components(balls), "near")
    rooted = nodes.join(near, "node", "left").select("keys", "node", F.coalesce("root", "node").alias("root"), "size", "sketch")
    own = rooted.mapInArrow(lean(emit), "variant long, node long, root long, size int, sketch binary")
    dealt = own.repartition(tasks(docs.sparkSession), "variant").sortWithinPartitions("variant", "node")
    first = staged(dealt.mapInArrow(lean(meeting_pairs(similarity)), "a long, b long").distinct(), "pairs")
    links = staged(verified(first, rows, similarity).union(near.select("node", "root")), "verified")
    roots = staged(connected_components(links), "roots")
    named = nodes.join(roots, "node", "left").select("keys", "node", F.coalesce("root", "node").alias("root"), "size", "sketch")
    slim_keys = named.select("keys", "root", "size").mapInArrow(lean(emit), "variant long, root long, size int")
    kinds = slim_keys.groupBy("variant").agg(F.count("*").alias("k"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum(F.col("size").cast("long")).alias("bytes"))
    mixed = staged(kinds.where((F.col("k") > SMALL) & (F.col("lo") < F.col("hi"))).select("variant", F.ceil(F.greatest(F.col("k") / PART, F.col("bytes") / PART_BYTES)).cast("int").alias("blocks")), "mixed")
    if mixed.limit(1).count():
        more = staged(crossing_links(named, mixed, rows, similarity), "crossing")
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    # a text without a link keeps itself; the groups of the others are sent where they are few, so a large one is not dealt to one task
    grouped = staged(nodes.join(roots, "node", "left").select(F.col("node").alias("n"), "least", "root"), "grouped")
    keepers = staged(grouped.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("keeper")).withColumnRenamed("root", "k_root"), "keepers")
    few = keepers.count() * 32 <= BROADCAST_BYTES
    kept = grouped.join(F.broadcast(keepers) if few else keepers, F.col("root") == F.col("k_root"), "left").select("n", F.coalesce("keeper", "least").alias("keeper"))
    return rows.select("doc_id", "text_key", "node").join(kept, F.col("node") == F.col("n")).select("doc_id", "text_key", "keeper")


def drop_similar(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, the one with the least doc_id, all its columns.

    Rows that repeat a doc_id and its text are one document.  Null and empty texts are one group; of equal
    least ids the text's hash decides; other columns may have any name; an empty table gives an empty result.
    """
    groups = staged(similar_groups(docs.select("doc_id", "text"), **options), "groups")
    own = F.struct("doc_id", "text_key")
    gone = groups.where(~own.eqNullSafe(F.col("keeper"))).select("doc_id", "text_key").distinct()
    kept = without(docs, staged(gone, "gone"))
    if groups.where(own.eqNullSafe(F.col("keeper"))).groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows (doc_id, text_key) of ``gone``: in place when those are few, else shuffled."""
    few = gone.count() * 24 <= BROADCAST_BYTES
    names = gone.select(F.col("doc_id").alias("g_doc"), F.col("text_key").alias("g_key"))
    met = docs["doc_id"].eqNullSafe(names["g_doc"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == names["g_key"])
    return docs.join(F.broadcast(names) if few else names, met, "left_anti")
