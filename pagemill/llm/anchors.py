"""Winnowed anchors, shared by the two operators that look for repeated passages.

Of every window of a text one k-gram, the one with the least hash, is the window's anchor: the leftmost
of equals.  Equal windows have equal anchors at equal offsets, so whatever repeats can be found from its
anchors alone, and an anchor whose k-gram stands nowhere else rules out all of its windows at once.

An anchor row is (doc_id, text_key, place): ``place`` packs the anchor's position and the offsets from
the first and the last of its windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, staged, tasks

POSITION_BITS = 24
#: A text's k-grams are looked at in pieces of this many, so positions in a piece fit their bits.
PIECE = 1 << 20
#: Lists of runs are sent to all executors up to this many bytes; beyond, texts are shuffled to them.
BROADCAST_BYTES = 24 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def least_positions(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` values the position of its least, the leftmost of equals."""
    low = np.uint64((1 << POSITION_BITS) - 1)
    m = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
    return (m & low).astype(np.int64)


def anchors_of(gram: Callable[[int, int], np.ndarray], n_grams: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, position, first window, last window) of a text's anchors.

    ``gram(i, j)`` gives the mixed hashes of k-grams i to j - 1; a window is ``width`` k-grams long.
    """
    out: list[tuple[np.ndarray, ...]] = []
    for base in range(0, n_grams - width + 1, PIECE):
        hashes = gram(base, min(n_grams, base + PIECE + width - 1))
        at = least_positions(hashes, width)
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        end = np.r_[start[1:], len(at)] - 1
        out.append((hashes[at[start]], base + at[start], base + start, base + end))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))  # type: ignore[return-value]
    return out[0] if len(out) == 1 else tuple(map(np.concatenate, zip(*out)))  # type: ignore[return-value]


def pack(position: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return position << 16 | (position - first) << 8 | (position - last)


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, last window)"""
    position = place >> 16
    return position, position - (place >> 8 & 255), position - (place & 255)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): rows that repeat a doc_id with another text are told apart by text_key.

    Where no doc_id repeats, text_key is 0, which costs nothing to move.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    repeated = bool(slim.groupBy("doc_id").count().where("count > 1").limit(1).count())
    return slim.select("doc_id", (F.xxhash64("text") if repeated else F.lit(0).cast("long")).alias("text_key"), "text")


AnchorFn = Callable[[str], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def repeated_anchors(texts: DataFrame, find: Callable[[], AnchorFn]) -> DataFrame:
    """The anchors whose k-gram stands in more than one place: (doc_id, text_key, places).

    A k-gram that a batch of documents holds several times is known to repeat there and then: only one
    of its rows goes on to meet the other batches under its key, the rest travel under keys of their
    own, so a passage that a third of all documents hold does not gather in one task.  The rows are
    sorted by key and neighbours compared in a stream.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = find()
        for batch in batches:
            keys, places, owners = [], [], []
            for i, text in enumerate(batch.column(2)):
                key, position, first, last = anchors(text.as_py())
                if len(key):
                    keys.append(key), places.append(pack(position, first, last)), owners.append(np.full(len(key), i))
            if not keys:
                continue
            key, place, owner = np.concatenate(keys), np.concatenate(places), np.concatenate(owners)
            order = np.argsort(key, kind="stable")
            key, place, owner = key[order], place[order], owner[order]
            same = key[1:] == key[:-1]
            sure = np.r_[same, False] | np.r_[False, same]
            route = key >> np.uint64(16)  # 48 bits: a rare false meeting costs a candidate, never a result
            later = np.r_[False, same]
            doc, text_key = batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner))
            route[later] = mix64(place[later].astype(np.uint64) + mix64(owner[later].astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), doc, text_key, pa.array(place), pa.array(sure)], ["route", "doc_id", "text_key", "place", "sure"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None  # the last row waits for its next neighbour; ``before`` is the key before it
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            route, sure = batch.column(0).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)
            same = route[1:] == route[:-1]
            keep = sure[:-1] | same | np.r_[before is not None and route[0] == before, same[:-1]][: len(same)]
            if keep.any():
                yield batch.slice(0, len(same)).filter(pa.array(keep)).select(["doc_id", "text_key", "place"])
            if len(same):
                before = route[-2]
            held = batch.slice(len(same))
        if held is not None and (held.column(4)[0].as_py() or (before is not None and held.column(0)[0].as_py() == before)):
            yield held.select(["doc_id", "text_key", "place"])

    rows = texts.mapInArrow(lean(emit), "route long, doc_id long, text_key long, place long, sure boolean")
    dealt = rows.repartition(tasks(texts.sparkSession), "route").sortWithinPartitions("route")
    found = dealt.mapInArrow(lean(meet), "doc_id long, text_key long, place long")
    return staged(found.groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("places")), "anchors")


def with_lists(texts: DataFrame, lists: DataFrame, how: str, size: int | None = None) -> DataFrame:
    """``texts`` joined to per-document lists: in place when ``size`` bytes of lists are few, else shuffled."""
    small = size is not None and size <= BROADCAST_BYTES
    other = lists.select(F.col("doc_id").alias("l_doc"), F.col("text_key").alias("l_key"), *[c for c in lists.columns if c not in ("doc_id", "text_key")])
    met = texts["doc_id"].eqNullSafe(other["l_doc"]) & (texts["text_key"] == other["l_key"])
    return texts.join(F.broadcast(other) if small else other, met, how).drop("l_doc", "l_key")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that half-open ranges cover together; ranges that touch are one run."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    return starts[new], ends[np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]]


#: Bits of a packed range that hold its length.
RANGE_BITS = 31


def pack_range(start: Column, stop: Column) -> Column:
    """A half-open range as one long."""
    return F.shiftleft(start, RANGE_BITS).bitwiseOR(stop - start)


def runs_per_document(ranges: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(doc_id, text_key, ranges) -> (doc_id, text_key, runs) of merged runs, and their bytes.

    ``ranges`` is an array of packed ranges; ``runs`` holds start, end, start, end ...
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = []
            for packed in batch.column(2):
                v = packed.values.to_numpy()
                start = v >> RANGE_BITS
                a, b = merged(start, start + (v & ((1 << RANGE_BITS) - 1)))
                runs.append(np.c_[a, b].reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, pa.list_(pa.int64()))], ["doc_id", "text_key", "runs"])

    per = ranges.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    out = staged(per.mapInArrow(lean(merge), "doc_id long, text_key long, runs array<long>"), name)
    size = out.agg(F.sum(F.size("runs") * 8 + 32)).first()[0] or 0
    return out, int(size)
