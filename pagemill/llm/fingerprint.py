"""Homomorphic multiset fingerprints of documents (DataFrame functions only).

A fingerprint is a vector that a document's paragraphs are summed into, lane by lane modulo a power of
two, so it does not depend on their order, and a paragraph is inserted or deleted by adding or
subtracting its own vector (``add``, ``subtract``).  Every paragraph's vector has

* 8 identity lanes modulo 2^32, hashed from the whole paragraph, for equality;
* a count of its word pairs modulo 2^32 and 63 likeness lanes modulo 2^32: lane j counts the pairs whose
  64-bit hash has bit j.  Twice a lane less the count is a random +-1 projection of the document's
  multiset of pairs, so the cosine of two such vectors estimates the cosine of the documents.

In hex: 8 x 8 digits, 8 digits, 63 x 8 digits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, tasks

IDENTITY, LIKENESS = 8, 63
#: Likeness lanes that share one long while they are summed, in fields of 32 bits.  A text has less than
#: 2^31 word pairs, so no field carries into its neighbour and a signed sum never wraps.
PACK = 2
SEARCH_STEP = 32


def paragraphs(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, r"\n"), lambda p: F.regexp_like(p, F.lit(rf"[^{WS}]")))


def word_pairs(text: Column) -> Column:
    """array<long>: the hash of every word with the next one of its paragraph."""
    words = F.transform(paragraphs(text), lambda p: F.filter(F.split(p, rf"[{WS}]+"), lambda w: w != ""))
    return F.flatten(F.transform(words, lambda ws: F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1)))))


def identity_lanes(text: Column) -> Column:
    """The 8 identity lanes in hex."""
    hashed = F.transform(paragraphs(text), lambda p: F.struct(F.xxhash64(p).alias("a"), F.xxhash64(F.lit("pagemill"), p).alias("b")))
    low = F.lit((1 << 32) - 1).cast("long")
    lane = lambda hs, j: F.aggregate(hs, F.lit(0).cast("long"), lambda total, h: (total + F.xxhash64(j, h["a"], h["b"]).bitwiseAND(low)).bitwiseAND(low))
    every = F.transform(F.array(hashed), lambda hs: F.concat(*[hex_lane(lane(hs, F.lit(j)), 32) for j in range(IDENTITY)]))
    return F.get(every, F.lit(0))


def hex_lane(value: Column, bits: int) -> Column:
    return F.lower(F.lpad(F.hex(value.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))), bits // 4, "0"))


def packed(group: int) -> Column:
    """The bits of lanes 2 g and 2 g + 1 of hash ``a``, each in a 32-bit field."""
    one = F.lit(1).cast("long")
    bits = [F.shiftleft(F.shiftrightunsigned("a", PACK * group + i).bitwiseAND(one), 32 * i) for i in range(PACK)]
    return reduce(lambda x, y: x + y, bits)


def lanes(fingerprint: Column, first: int, width: int, n: int) -> Column:
    """n lanes of ``width`` hex digits from digit ``first`` (from 0)."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.conv(F.substr(fingerprint, i * width + (first + 1), F.lit(width)), 16, 10).cast("long"))


def _combine(a: Column, b: Column, sign: int) -> Column:
    n = IDENTITY + 1 + LIKENESS
    total = F.zip_with(lanes(a, 0, 8, n), lanes(b, 0, 8, n), lambda x, y: x + y * sign)
    return F.concat_ws("", F.transform(total, lambda v: hex_lane(v, 32)))


def add(a: Column, b: Column) -> Column:
    """The fingerprint of both documents' paragraphs together."""
    return _combine(a, b, 1)


def subtract(a: Column, b: Column) -> Column:
    """The fingerprint of a's paragraphs without b's."""
    return _combine(a, b, -1)


def projection(fingerprint: Column) -> Column:
    """63 signed sums from a fingerprint."""
    n = F.conv(F.substr(fingerprint, F.lit(8 * IDENTITY + 1), F.lit(8)), 16, 10).cast("long")
    centred = lambda c: F.pmod(c * 2 - n + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return F.transform(lanes(fingerprint, 8 * IDENTITY + 8, 8, LIKENESS), lambda c: centred(c).cast("double"))


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cosine(x: Column, y: Column) -> Column:
    """Cosine of two arrays, 0 where it is negative or a side is all zero."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    ratio = lambda d: F.when(d["xx"] * d["yy"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), d["xy"] / F.sqrt(d["xx"] * d["yy"])))).otherwise(F.lit(0.0))
    dots = lambda s: bound(F.struct(dot(s["x"], s["x"]).alias("xx"), dot(s["y"], s["y"]).alias("yy"), dot(s["x"], s["y"]).alias("xy")), ratio)
    return bound(F.struct(x.alias("x"), y.alias("y")), dots)


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, text, run, lent, next_text: the next row by (doc_id, text).

    Only rows with lent = 0 are the documents; the rows of a run are sorted within one partition.

    Quantiles of doc_id split the order into runs of about as many rows; the rows at a run's start are
    also dealt to the run before it, where they only lend their text.  So the text moves once, and no
    task holds more than a few runs.  After the last row comes the first.
    """
    runs = 8 * tasks(docs.sparkSession)
    rank = [F.col("doc_id").asc_nulls_first(), F.col("text").asc()]
    marks = docs.agg(F.percentile_approx("doc_id", [i / runs for i in range(1, runs)], max(10_000, 20 * runs)).alias("m")).first()["m"]
    marks = sorted(set(marks or []))
    first = docs.orderBy(*rank).limit(1)
    if marks:
        coarse, fine = F.lit(marks[::SEARCH_STEP]), F.lit(marks)
        below = lambda values: F.size(F.filter(values, lambda m: m <= F.col("doc_id")))
        block = F.greatest(below(coarse) - 1, F.lit(0))
        run = block * SEARCH_STEP + below(F.slice(fine, block * SEARCH_STEP + 1, SEARCH_STEP))
        placed = docs.withColumn("run", run)
        starts = (F.col("run") > 0) & (F.get(fine, F.col("run") - 1) == F.col("doc_id"))
        placed = placed.select("doc_id", "text", F.explode(F.when(starts, F.array(F.struct(F.col("run").alias("run"), F.lit(0).alias("lent")), F.struct((F.col("run") - 1).alias("run"), F.lit(1).alias("lent")))).otherwise(F.array(F.struct(F.col("run").alias("run"), F.lit(0).alias("lent"))))).alias("r"))
        placed = placed.select("doc_id", "text", "r.run", "r.lent")
    else:
        placed = docs.select("doc_id", "text", F.lit(0).alias("run"), F.lit(0).alias("lent"))
    placed = placed.unionByName(first.select("doc_id", "text", F.lit(len(marks)).alias("run"), F.lit(2).alias("lent")))
    order = Window.partitionBy("run").orderBy("lent", *rank)
    return placed.withColumn("next_text", F.lead("text").over(order))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, one row per input row.

    Null and empty texts have the fingerprint of no paragraphs; likeness is 1 for equal fingerprints
    and 0 where one side has no words; rows with equal doc_id follow each other by text; null doc_ids
    come first; an empty table gives an empty result; other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed = with_next(slim)
    n = F.length("text")
    moved = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - moved), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), moved))
    both = placed.select(F.monotonically_increasing_id().alias("row"), "run", "lent", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    # one row a side, then one row a pair; what only the result needs rides along in the key
    side = lambda name: F.struct(F.lit(name == "edited").alias("edited"), identity_lanes(F.col(name)).alias("identity"), word_pairs(F.col(name)).alias("pairs"))
    sides = both.select("row", "run", "lent", "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("sha"), F.explode(F.array(side("text"), side("edited"))).alias("s"))
    sides = sides.select("row", "run", "lent", "doc_id", "n_chars", F.unhex("sha").alias("sha"), "s.edited", F.unhex("s.identity").alias("identity"), F.size("s.pairs").cast("long").alias("n"), "s.pairs")
    keys = ["row", "run", "lent", "doc_id", "n_chars", "sha", "edited", "identity", "n"]
    one = sides.select(*keys, F.explode_outer("pairs").alias("a"))
    summed = one.groupBy(*keys).agg(*[F.coalesce(F.sum(packed(g)), F.lit(0)).alias(f"l{g}") for g in range(-(-LIKENESS // PACK))])
    counts = [hex_lane(F.shiftright(f"l{j // PACK}", 32 * (j % PACK)), 32) for j in range(LIKENESS)]
    written = summed.select("row", "run", "lent", "doc_id", "n_chars", "sha", "edited", F.concat(F.lower(F.hex("identity")), hex_lane(F.col("n"), 32), *counts).alias("f"))
    of = lambda edited: F.max(F.when(F.col("edited") == edited, F.col("f")))
    marked = written.groupBy("row", "run", "lent", "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256")).agg(of(False).alias("fingerprint"), of(True).alias("edited_fingerprint"))
    # within a run the row numbers follow the order of the documents
    after = marked.withColumn("next_fingerprint", F.lead("fingerprint").over(Window.partitionBy("run").orderBy("row"))).where("lent = 0")
    like = lambda a, b: F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(cosine(projection(F.col(a)), projection(F.col(b))))
    return after.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("fingerprint", "edited_fingerprint").alias("near_edited"), like("fingerprint", "next_fingerprint").alias("near_next"))
