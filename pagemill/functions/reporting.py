"""What users and logs read: numbers, page labels, rates; and small checks on replies."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

# Fixed value: the marker that a footnote starts with.
FOOTNOTE_MARKER = r"^(\d{1,3}|[*∗⁎†‡§¶]{1,2}|[¹²³⁴⁵⁶⁷⁸⁹⁰]{1,3})(?=\s|[A-Z(\[“\"])"
# Roles of block types before any detector runs, and the roles that a request names.
DEFAULT_ROLES = {"HEADING": "HEADING", "TITLE": "HEADING", "CAPTION": "CAPTION", "TABLE": "TABLE", "FIGURE": "FIGURE", "FOOTNOTE": "FOOTNOTE", "REFERENCE": "REFERENCE"}
REQUEST_ROLES = ["STRUCTURED_LABEL", "SIDEBAR_HEADING", "SIDEBAR_LABEL", "SIDEBAR_BODY"]
# Words that are not counted in a label.
LABEL_STOPS = ["and", "of", "the", "in"]


def tokens(n: Column) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(F.floor(n + 0.5).cast("long"), 0)


def seconds(ms: Column) -> Column:
    """Milliseconds as seconds with one decimal."""
    return F.format_string("%.1f", F.round(ms / 1000, 1))


def page_label(start: Column, end: Column) -> Column:
    """``p.3`` or ``p.3–5``."""
    one = F.concat(F.lit("p."), start.cast("string"))
    return F.when(F.coalesce(end, start) > start, F.concat(one, F.lit("–"), end.cast("string"))).otherwise(one)


def correction_rate(corrected: Column, checked: Column) -> Column:
    """Per cent with one decimal, ``n/a`` where nothing was checked."""
    return F.when(checked > 0, F.concat(F.format_string("%.1f", F.round(corrected / checked * 100, 1)), F.lit("%"))).otherwise("n/a")


def keep_footnote_marker(kind: Column, source: Column, translation: Column) -> Column:
    """A footnote's translation, with the marker that it lost put back."""
    marker = F.regexp_extract(F.ltrim(source), FOOTNOTE_MARKER, 1)
    bare = F.ltrim(translation)
    kept = F.when(F.startswith(bare, marker), bare).otherwise(F.concat(marker, F.lit(" "), bare))
    return F.when((kind != "FOOTNOTE") | (marker == ""), translation).otherwise(kept)


def label_hint_share(label: Column, hints: list[str]) -> Column:
    """The share of a label's words that are hints, 0 without words."""
    words = F.filter(F.split(F.regexp_replace(F.lower(label), r"[^a-z\s-]", " "), r"[\s-]+"), lambda w: (F.length(w) >= 2) & ~w.isin(LABEL_STOPS))
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: w.isin(hints))) / F.size(words)).otherwise(F.lit(0.0))


def keyed_hash(key: str, message: Column, digits: int = 64) -> Column:
    """HMAC-SHA-256 of a text in hex, or its first ``digits`` digits."""
    raw = key.encode("utf-8")
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(outer, first), 256), 1, digits)


def reply_verdicts(reply: Column) -> Column:
    """The well-typed entries of a reply ``{"verdicts": [{"id", "ok", "correction"}]}``; none of a broken one."""
    parsed = F.from_json(reply, "verdicts array<struct<id:string,ok:boolean,correction:string>>", {"mode": "PERMISSIVE"})
    return F.filter(F.coalesce(parsed["verdicts"], F.array().cast("array<struct<id:string,ok:boolean,correction:string>>")), lambda v: v["id"].isNotNull() & v["ok"].isNotNull())


def usage_count(n: Column) -> Column:
    """A count of tokens that a provider said: negative, not finite or missing counts as 0."""
    good = n.isNotNull() & ~F.isnan(n) & (n >= 0) & (n < F.lit(float("inf")))
    return F.when(good, F.floor(n).cast("long")).otherwise(F.lit(0).cast("long"))


def glossary_lines(terms: Column) -> Column:
    """array<struct<source, target>> as the lines of a prompt."""
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit("- "), trim(t["source"]), F.lit(" => "), trim(t["target"]))), "\n")


def role_of(kind: Column, role: Column) -> Column:
    """A block's own role, else that of its type; BODY for every other type."""
    named = F.create_map(*[F.lit(v) for pair in DEFAULT_ROLES.items() for v in pair])
    return F.coalesce(role, F.element_at(named, F.coalesce(kind, F.lit(""))), F.lit("BODY"))


def report_line(label: str, value: Column) -> Column:
    """A line of a report: the label in 26 columns, the value to the right in 12."""
    padded = F.when(F.length(value) < 12, F.lpad(value, 12, " ")).otherwise(value)
    return F.concat(F.lit("  " + label.ljust(26)), padded)


def usage_lines(usage: Column) -> Column:
    """The report lines of struct<input, cached, output, reasoning, ms> in order."""
    named = [("input tokens", "input"), ("cached input tokens", "cached"), ("output tokens", "output"), ("reasoning tokens", "reasoning")]
    lines = [report_line(label, tokens(usage[field].cast("double"))) for label, field in named]
    processed = report_line("processed (in + out)", tokens((usage["input"] + usage["output"]).cast("double")))
    return F.array(*lines, processed, report_line("time", F.concat(seconds(usage["ms"]), F.lit("s"))))
