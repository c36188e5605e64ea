"""Token-ID output as directly addressable codes.

An id is split into chunks of 8 bits, lowest first.  Level k holds the k-th chunk of every id that has
one, and a bitmap that says which of them continue on level k + 1; a rank directory counts the
continuation bits before every 512th.  The chunk of id i on the next level is found by rank, so any
token can be read without decoding its neighbours (``DacReader.get``).

File format, one *segment* (all numbers little-endian):

    magic   4 bytes  ``PMD1``
    n_docs  u32, n_ids u64
    bounds  (n_docs + 1) x u64     where each document's ids start in the segment
    levels  u32, then for each level
        n_chunks u64
        chunks   n_chunks bytes
        bitmap   ceil(n_chunks / 8) bytes, bit i of byte i // 8 first
        ranks    (n_chunks // 512 + 1) x u64   continuation bits before bit 512 j

Segments are written by Spark as the binary column of a Parquet table, so that any store which Spark
can write holds them and a failed task leaves no half-written file.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, lean, staged, tasks

MAGIC = b"PMD1"
RANK_STEP = 512
#: A segment is closed when it holds this many ids.
SEGMENT_IDS = 1 << 20
#: Words whose ids a Python worker remembers.
CACHE_WORDS = 300_000


# ---------------------------------------------------------------- tokenizer


class WordEncoder:
    """Ids of texts by a tokenizer file whose pre-tokenizer drops white space.

    No piece crosses white space there, so a text's ids are its words' ids in order and repeated words
    are encoded once.  A plain word skips the alignment bookkeeping of the normalizer: it is lowered and
    cut by the file's own pattern, and its pieces go to the library's BPE model.  Every other word goes
    through the library's whole pipeline, and a text with separators on which Python and the library
    differ is encoded whole.
    """

    #: Letters that NFC leaves alone and that lower-case one to one, and printable ASCII.
    PLAIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u0144]+")
    ODD_SPACE = re.compile("[\x1c-\x1f\u180e\u200b\ufeff]")
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        marks = [t["content"] for t in spec["added_tokens"]]
        self.marks = re.compile("|".join(map(re.escape, marks)) or r"(?!)")
        self.model = self.whole.model
        self.by_word: dict[str, bytes] = {}
        self.by_piece: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.direct = self._same_rules(spec)

    @staticmethod
    def _same_rules(spec: dict) -> bool:
        """Whether the file's rules are the ones that the plain path follows."""
        steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        return steps == ["NFC", "Replace", "Lowercase"] and len(cuts) == 2 and cuts[0].get("pattern", {}).get("Regex") == pattern and cuts[1]["type"] == "ByteLevel" and not cuts[1]["add_prefix_space"]

    def _piece(self, piece: str) -> bytes:
        got = self.by_piece.get(piece)
        if got is None:
            mapped = piece.encode().decode("latin-1").translate(self.table)
            got = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
            if len(self.by_piece) < CACHE_WORDS:
                self.by_piece[piece] = got
        return got

    #: Superscript digits and fractions are numbers to the library but not digits to Python.
    NUMBERS = re.compile("[\u00aa\u00b2\u00b3\u00b9\u00ba\u00bc-\u00be]")

    def _word(self, word: str) -> bytes:
        if self.PLAIN.fullmatch(word) and not self.marks.search(word) and not self.NUMBERS.search(word):
            return b"".join(map(self._piece, self.PIECES.findall(word.lower())))
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.direct or self.ODD_SPACE.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words, known = text.split(), self.by_word
        out = list(map(known.get, words))
        if None in out:
            for i, got in enumerate(out):
                if got is None:
                    word = words[i]
                    out[i] = got = known.get(word) or self._word(word)
                    if len(known) < CACHE_WORDS:
                        known[word] = got
        return b"".join(out)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- codes


def dac_encode(ids: np.ndarray, bounds: np.ndarray) -> bytes:
    """One segment from all ids (u4) and the start of each document, with the end as last bound."""
    parts = [MAGIC, struct.pack("<IQ", len(bounds) - 1, len(ids)), bounds.astype("<u8").tobytes()]
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        counts = np.r_[0, np.cumsum(np.add.reduceat(more, np.arange(0, len(more), RANK_STEP), dtype=np.int64))] if len(more) else np.zeros(1, np.int64)
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + np.packbits(more, bitorder="little").tobytes() + counts[: len(rest) // RANK_STEP + 1].astype("<u8").tobytes())
        if not more.any():
            break
        rest = rest[more] >> 8
    return b"".join([*parts, struct.pack("<I", len(levels)), *levels])


class DacReader:
    """Random access to a segment."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a segment")
        self.n_docs, self.n_ids = struct.unpack_from("<IQ", data, 4)
        at = 16
        self.bounds = np.frombuffer(data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        (n_levels,) = struct.unpack_from("<I", data, at)
        at += 4
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            bitmap = np.frombuffer(data, np.uint8, (n + 7) // 8, at)
            at += (n + 7) // 8
            ranks = np.frombuffer(data, "<u8", n // RANK_STEP + 1, at)
            at += 8 * (n // RANK_STEP + 1)
            self.levels.append((chunks, bitmap, ranks))

    def get(self, i: int) -> int:
        """The i-th id, from one chunk and one rank a level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            first = i // RANK_STEP * RANK_STEP
            bits = np.unpackbits(bitmap[first >> 3 : (i >> 3) + 1], bitorder="little")[: i - first]
            i = int(ranks[i // RANK_STEP]) + int(bits.sum())
        return value

    def all(self) -> np.ndarray:
        """All ids at once, from the last level to the first."""
        values = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            more = np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)
            here = chunks.astype(np.uint32)
            here[more] |= values << np.uint32(8)
            values = here
        return values

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document by random access."""
        return np.array([self.get(i) for i in range(int(self.bounds[k]), int(self.bounds[k + 1]))], np.uint32)


# ---------------------------------------------------------------- Spark


def write_codes(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> the written segments: part, seq, n_ids, doc_ids, segment.

    Documents are dealt out by ranges of doc_id and sorted within them, so (part, seq) is in ascending
    doc_id order.  Null text is empty; equal doc_ids are ordered by text; a null doc_id comes first;
    an empty table gives no segments; other columns are ignored.  A text is encoded whole; memory holds
    one segment, the encoder and one batch of texts, a small one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        enc, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        ids: list[bytes] = []
        keys: list[int | None] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, held
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            data = dac_encode(np.frombuffer(b"".join(ids), "<u4"), np.r_[0, np.cumsum(sizes)])
            row = {"part": [part], "seq": [seq], "n_ids": [int(sizes.sum())], "doc_ids": [list(keys)], "segment": [data]}
            ids.clear()
            keys.clear()
            seq, held = seq + 1, 0
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("segment", pa.binary())]))

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = enc.encode(text.as_py() or "") + end
                ids.append(got)
                keys.append(key)
                held += len(got) // 4
                if held >= SEGMENT_IDS:
                    yield close()
        if ids:
            yield close()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = slim.repartitionByRange(tasks(docs.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return staged(ordered.mapInArrow(lean(run), "part int, seq int, n_ids long, doc_ids array<long>, segment binary"), "codes", BATCH_BYTES // 4)


def read_codes(segments: DataFrame) -> DataFrame:
    """Written segments -> doc_id, start, n_tokens, ids_crc32, read back from their bytes.

    Where a part starts is a running sum over the parts' totals, one row a part.
    """
    from pyspark.sql import Window

    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = totals.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = segments.select("part", "seq", "n_ids").withColumn("inside", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part")
    offsets = offsets.select("part", "seq", (F.col("before") + F.col("inside")).alias("start"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoders.clear()  # the workers that wrote the codes hold words that reading does not need
        for batch in batches:
            for part, seq, keys, data in zip(*(batch.column(i) for i in range(4))):
                reader = DacReader(data.as_py())
                ids, bounds, keys = reader.all().astype("<u4"), reader.bounds, keys.as_py()
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
                n = len(keys)
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([part.as_py()] * n, pa.int32()), "seq": pa.array([seq.as_py()] * n, pa.int32()), "doc_id": pa.array(keys, pa.int64()), "at": bounds[:-1], "n_tokens": np.diff(bounds), "ids_crc32": pa.array(crc, pa.int64())}
                )

    read = segments.select("part", "seq", "doc_ids", "segment").mapInArrow(lean(run), "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return read.join(offsets, ["part", "seq"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def brute_force(rows: Iterable[tuple[int, str | None]], vocabulary: str, end_id: int = 1) -> list[tuple[int, int, int, int]]:
    """The same results in one loop over the library's own encoding, for tests."""
    from tokenizers import Tokenizer

    whole, out, start = Tokenizer.from_file(vocabulary), [], 0
    for key, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "")):
        ids = [*chain(whole.encode(text or "", add_special_tokens=False).ids), end_id]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out
