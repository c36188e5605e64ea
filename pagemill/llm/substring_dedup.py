"""Repeated passages by seed and extend, over words.

Seeds are winnowed anchors: of the 5-word grams of every 13-word window the one with the least hash.
Documents are joined on the anchors whose gram stands in more than one place.  A seed brings its *context*,
the words of all windows that it anchors; where two documents meet in a seed, the match is extended
to both sides of it, word by word, as far as both contexts agree, and kept from 13 words on.  Since equal
windows have equal anchors, the kept matches of neighbouring seeds overlap or touch and merge into the maximal
repeats.  A match counts against the document with the larger doc_id, so the first document keeps its words.

No pairs are formed: in a meeting the documents come in order of doc_id, and each is extended against what
the earlier ones hold.  Equal contexts of a batch collapse to the one of its first document before they are
dealt out, with all its places, so a passage that many documents hold is a row a batch.  A seed that more
than ``CROWD`` rows share is not met in one task: its windows are dealt out one by one, with their words,
and compared in a sorted stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import BROADCAST_BYTES, RANGE_BITS, AnchorFn, anchors_of, keyed, merged, mix64, pack_range, repeated_anchors, runs_per_document, unpack, with_lists
from .common import forget, lean, staged, tasks

LENGTH, GRAM = 13, 5
#: Seeds with more rows than this are met window by window.
CROWD = 4096
STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Mixed hashes of all runs of k words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, salt + 1, np.uint64)
    for j in range(k):
        total = (total ^ hashes[j : j + n]) * STEP + np.uint64(j + 1)
        total ^= total >> np.uint64(29)
    return mix64(total)


def word_anchors(length: int = LENGTH, gram: int = GRAM) -> AnchorFn:
    """The anchors of a text's windows of ``length`` words."""

    def find(text: str):
        hashes = word_hashes(words_of(text))
        return anchors_of(lambda i, j: rolling(hashes[i : j + gram - 1], gram), len(hashes) - gram + 1, length - gram + 1)

    return find


def contexts(met: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, text_key, text, places) -> (key, doc_id, text_key, firsts, back, n, context).

    ``firsts`` are the places of a context in its document, ``back`` its words before the seed, ``n`` its
    windows.  Where an earlier document of the batch has the same context it is repeated already: such rows
    come without a key and a context.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_pylist()
            held: dict[tuple[bytes, int], dict[int, list[int]]] = {}  # context: row: places
            seeds: dict[tuple[bytes, int], int] = {}
            for i, (text, places) in enumerate(zip(batch.column(2), batch.column(3))):
                words = words_of(text.as_py())
                for at, first, last in zip(*(v.tolist() for v in unpack(np.unique(places.values.to_numpy())))):
                    name = b" ".join(words[first : last + length]), at - first
                    rows = held.get(name)
                    if rows is None:
                        rows = held[name] = {}
                        seeds[name] = xxhash.xxh64_intdigest(b" ".join(words[at : at + gram])) - (1 << 63)
                    rows.setdefault(i, []).append(first)
            out: list[tuple] = []
            for name, rows in held.items():
                least = min(docs[i] for i in rows)
                n = name[0].count(b" ") + 2 - length
                out += [(seeds[name], i, at, name[1], n, name[0]) if docs[i] == least else (None, i, at, name[1], n, None) for i, at in rows.items()]
            key, row, firsts, back, n, words_ = zip(*out) if out else ((),) * 6
            at_row = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), batch.column(0).take(at_row), batch.column(1).take(at_row), pa.array(firsts, pa.list_(pa.int64())), pa.array(back, pa.int32()), pa.array(n, pa.int32()), pa.array(words_, pa.binary())],
                ["key", "doc_id", "text_key", "firsts", "back", "n", "context"],
            )

    return met.select("doc_id", "text_key", "text", "places").mapInArrow(lean(run), "key long, doc_id long, text_key long, firsts array<long>, back int, n int, context binary")


def windows_of(context: bytes, back: int, n: int, length: int) -> list[tuple[int, bytes]]:
    """The windows of a context, each with its seed's offset."""
    words = context.split(b" ")
    return [(back - w, b" ".join(words[w : w + length])) for w in range(n)]


def extended(rows: list[tuple], length: int) -> Iterator[tuple[int, list[bool]]]:
    """Rows (doc_id, back, n, context) of one seed, by doc_id -> (row, which windows an earlier document has)."""
    if rows[0][0] == rows[-1][0]:
        return
    if len({(r[1], r[3]) for r in rows}) == 1:
        yield from ((i, [True] * r[2]) for i, r in enumerate(rows) if r[0] > rows[0][0])
        return
    whole: set[tuple[int, bytes]] = set()  # contexts of earlier documents
    seen: set[tuple[int, bytes]] = set()  # and their windows
    at = 0
    while at < len(rows):
        end = next((k for k in range(at, len(rows)) if rows[k][0] != rows[at][0]), len(rows))
        fresh = []
        for i in range(at, end):
            _, back, n, context = rows[i]
            if (back, context) in whole:
                yield i, [True] * n
                continue
            windows = windows_of(context, back, n, length)
            hit = [w in seen for w in windows]
            if any(hit):
                yield i, hit
            fresh.append((back, context))
            fresh += windows
        whole.update(f for f in fresh)
        seen.update(f for f in fresh)
        at = end


def ranges_of(firsts: list[int], hit: list[bool], length: int) -> list[int]:
    """Packed ranges of words that the hit windows cover, at every place of the context."""
    edges = np.flatnonzero(np.diff(np.r_[0, np.array(hit, np.int8), 0])).tolist()
    return [first + a << RANGE_BITS | (b - a + length - 1) for first in firsts for a, b in zip(edges[::2], edges[1::2])]


RANGES = "doc_id long, text_key long, ranges array<long>"


def arrow_ranges(out: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
    doc, key, ranges = zip(*out) if out else ((),) * 3
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(ranges, pa.list_(pa.int64()))], ["doc_id", "text_key", "ranges"])


def met_in_seeds(rows: DataFrame, length: int) -> DataFrame:
    """Contexts -> (doc_id, text_key, ranges) that an earlier document has, seed by seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != key:
                    out += resolved(group)
                    key, group = row[0], []
                group.append(row)
            if out:
                yield arrow_ranges(out)
                out = []
        out += resolved(group)
        if out:
            yield arrow_ranges(out)

    def resolved(group: list[tuple]) -> list[tuple[int, int, list[int]]]:
        if len(group) < 2:
            return []
        return [(group[i][1], group[i][2], ranges_of(group[i][3], hit, length)) for i, hit in extended([(r[1], r[4], r[5], r[6]) for r in group], length)]

    dealt = rows.repartition(tasks(rows.sparkSession), "key").sortWithinPartitions("key", "doc_id")
    return dealt.mapInArrow(lean(run), RANGES)


def met_in_windows(rows: DataFrame, length: int) -> DataFrame:
    """The same for contexts of crowded seeds, window by window in a sorted stream."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, window, doc, key, ranges = [], [], [], [], []
            for _, d, k, firsts, back, n, context in zip(*(c.to_pylist() for c in batch.columns)):
                for w, (_, words) in enumerate(windows_of(context, back, n, length)):
                    x.append(xxhash.xxh64_intdigest(words) - (1 << 63)), window.append(words), doc.append(d), key.append(k)
                    ranges.append([f + w << RANGE_BITS | length for f in firsts])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(window, pa.binary()), pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(ranges, pa.list_(pa.int64()))], ["x", "window", "doc_id", "text_key", "ranges"])

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, least = None, 0  # the open window and its first document
        for batch in batches:
            keep = []
            for window, doc in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if window != name:
                    name, least = window, doc
                keep.append(doc > least)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["doc_id", "text_key", "ranges"])

    windows = rows.mapInArrow(lean(emit), f"x long, window binary, {RANGES}")
    dealt = windows.repartition(tasks(rows.sparkSession), "x").sortWithinPartitions("x", "window", "doc_id")
    return dealt.mapInArrow(lean(later), RANGES)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> tuple[DataFrame, DataFrame, int]:
    """The keyed texts, (doc_id, text_key, runs) of word runs that an earlier document also has, and their bytes."""
    texts = keyed(docs)
    named = texts.where("doc_id IS NOT NULL")
    found = repeated_anchors(named, lambda: word_anchors(length, gram))
    rows = staged(contexts(with_lists(named, found, "inner"), length, gram), "contexts")
    keyed_rows = rows.where("key IS NOT NULL")
    crowded = staged(keyed_rows.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowded")
    hit = rows.where("key IS NULL").select("doc_id", "text_key", F.transform("firsts", lambda f: pack_range(f, f + F.col("n") + (length - 1))).alias("ranges"))
    if crowded.limit(1).count():
        # a crowded seed has over ``crowd`` rows, so there are fewer of them than rows by that factor
        few = crowded.count() * 16 <= BROADCAST_BYTES
        marks = F.broadcast(crowded) if few else crowded
        hit = hit.unionByName(met_in_seeds(keyed_rows.join(marks, "key", "left_anti").select(*rows.columns), length))
        hit = hit.unionByName(met_in_windows(keyed_rows.join(marks, "key", "left_semi").select(*rows.columns), length))
    else:
        hit = hit.unionByName(met_in_seeds(keyed_rows, length))
    runs, size = runs_per_document(hit, "runs")
    forget(found)
    forget(rows)
    return texts, runs, size


def dedupe(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, n_words, n_removed, kept_sha256, kept, one row per input row.

    ``kept`` is the kept words joined by spaces.  Null and empty texts have no words; rows with equal
    doc_id are one document's and never remove words from each other; a null doc_id neither removes nor
    loses words; very long texts are read whole; an empty table gives an empty result; other columns are
    ignored.
    """
    texts, runs, size = repeats(docs, length, gram, crowd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sha, kept = [], [], [], []
            for text, own in zip(batch.column(1), batch.column(2)):
                words = words_of(text.as_py())
                left, at = [], 0
                for a, b in np.array(own.as_py() or [], np.int64).reshape(-1, 2).tolist():
                    left += words[at:a]
                    at = b
                left += words[at:]
                whole = b" ".join(left)
                n.append(len(words)), gone.append(len(words) - len(left)), sha.append(hashlib.sha256(whole).hexdigest()), kept.append(whole.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return with_lists(texts, runs, "left", size).select("doc_id", "text", "runs").mapInArrow(lean(run), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def brute_force(rows: list[tuple[int | None, str | None]], length: int = LENGTH) -> list[tuple]:
    """The same results from a table of all windows, for tests."""
    least: dict[tuple, int] = {}
    words = [words_of(t or "") for _, t in rows]
    for (doc, _), ws in zip(rows, words):
        for i in range(len(ws) - length + 1):
            w = tuple(ws[i : i + length])
            if doc is not None:
                least[w] = min(doc, least.get(w, doc))
    out = []
    for (doc, _), ws in zip(rows, words):
        at = [i for i in range(len(ws) - length + 1) if doc is not None and least[tuple(ws[i : i + length])] < doc]
        gone = set()
        for a, b in zip(*(x.tolist() for x in merged(np.array(at), np.array(at) + length))) if at else ():
            gone.update(range(a, b))
        left = [w for i, w in enumerate(ws) if i not in gone]
        out.append((doc, len(ws), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS t
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM d WHERE len(ws) >= 13)),
m AS (SELECT doc_id, p, t, min(doc_id) OVER (PARTITION BY t) AS origin FROM w),
h AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM m WHERE origin < doc_id),
k AS (SELECT d.doc_id, list(ws[q] ORDER BY q) AS kept
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS q FROM d) d
  WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = d.doc_id AND h.q = d.q) GROUP BY d.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(len(kept), 0))::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
