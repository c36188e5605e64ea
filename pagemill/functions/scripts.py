"""Raised and lowered runs: markers by geometry, and markers glued to a word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE

# The form of a citation marker and the geometry of a raised or lowered run.
_W = f"[{SPACE}]"
MARKER = rf"\d{{1,3}}(?:{_W}*[,;]{_W}*\d{{1,3}}(?:{_W}*[–—-]{_W}*\d{{1,3}})?|{_W}*[–—-]{_W}*\d{{1,3}})*"
GLUED = rf"(?<=[A-Za-z一-鿿)\]][.,;:!?])({MARKER})(?![\d.%A-Za-z一-鿿])"
SUBSCRIPT = r"^[A-Za-z0-9](?:[A-Za-z0-9,;+–—-]*[A-Za-z0-9])?$"
SIZE, RISE, DROP, LONGEST, LONGEST_SUB, ANCHOR = 0.86, 0.14, 0.08, 16, 6, 8


def is_marker(c: Column) -> Column:
    t = F.trim(c)
    return (F.length(t) > 0) & (F.length(t) <= LONGEST) & F.regexp_like(t, F.lit(f"^{MARKER}$"))


def normalize_marker(c: Column) -> Column:
    return F.regexp_replace(c, f"{_W}+", "")


def glued_markers(c: Column) -> Column:
    """Markers that stand right after a sentence's punctuation, in order."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(GLUED), F.lit(1)), normalize_marker), lambda m: F.length(m) <= LONGEST)


def trailing_marker(c: Column) -> Column:
    """The marker that a text ends with, glued to a word; null for a number of its own."""
    t = F.regexp_replace(c, f"{_W}+$", "")
    found = F.regexp_extract(t, rf"[A-Za-z一-鿿)\]][.,;:!?]?({MARKER})$", 1)
    return F.when((found != "") & (F.length(normalize_marker(found)) <= LONGEST), normalize_marker(found))


def anchor(before: Column) -> Column:
    """The identifier that a text ends with, its last eight characters."""
    return F.right(F.regexp_extract(before, "([A-Za-z0-9]*)$", 1), F.lit(ANCHOR))


def line_scripts(items: Column, line_y: Column, line_size: Column) -> Column:
    """array<struct<text, anchor, raised>> of a line's items (text, y, font_size) in reading order."""
    small = lambda i: i["font_size"] <= line_size * SIZE
    up = lambda i: is_marker(i["text"]) & small(i) & (i["y"] - line_y >= line_size * RISE)
    low = lambda i: (F.length(F.trim(i["text"])) <= LONGEST_SUB) & F.regexp_like(F.trim(i["text"]), F.lit(SUBSCRIPT)) & small(i) & (line_y - i["y"] >= line_size * DROP)
    run = lambda i, before: F.struct(F.when(up(i), normalize_marker(i["text"])).otherwise(F.trim(i["text"])).alias("text"), anchor(before).alias("anchor"), up(i).alias("raised"))
    zero = F.struct(F.lit("").alias("before"), F.array().cast("array<struct<text:string,anchor:string,raised:boolean>>").alias("out"))

    def step(s: Column, i: Column) -> Column:
        counts = up(i) | (low(i) & (anchor(s["before"]) != ""))
        return F.struct(F.concat(s["before"], i["text"]).alias("before"), F.when(counts, F.concat(s["out"], F.array(run(i, s["before"])))).otherwise(s["out"]).alias("out"))

    none = F.array().cast("array<struct<text:string,anchor:string,raised:boolean>>")
    return F.when(F.size(items) < 2, none).otherwise(F.aggregate(items, zero, step, lambda s: s["out"]))


def block_markers(raised: Column, text: Column) -> Column:
    """All raised runs, repeats included, and the glued ones that none of them names already."""
    new = F.filter(F.array_distinct(glued_markers(text)), lambda m: ~F.array_contains(raised, m))
    return F.concat(raised, new)
