"""What a font can show: code points of Symbol fonts, stand-ins for characters without a glyph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, bound

# The characters of a Symbol font by code, each row from its first code on without gaps.
SYMBOL_ROWS = {
    0x21: "!∀#∃%&∋()∗+,−./0123456789:;<=>?≅ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ[∴]⊥_",
    0x61: "αβχδεφγηιϕκλμνοπθρστυϖωξψζ{|}∼",
    0xA0: "€ϒ′≤⁄∞ƒ♣♦♥♠↔←↑→↓°±″≥×∝∂•÷≠≡≈…",
    0xBF: "↵ℵℑℜ℘⊗⊕∅∩∪⊃⊇⊄⊂⊆∈∉∠∇",
    0xD5: "∏√⋅¬∧∨⇔⇐⇑⇒⇓◊〈",
    0xE5: "∑",
    0xF1: "〉∫⌠",
    0xF5: "⌡",
}
# Fixed value: where a Symbol font's codes stand in the private use area.
SYMBOL_BASE = 0xF000
# Fixed value: names of Symbol fonts, without the prefix of a subset.
SYMBOL_FONT = r"(?i)^Symbol(MT|PS)?([,-].*)?$"
# Stand-ins for characters that text fonts often lack, and the mark of a character without one.
STAND_INS = {"∗": "*", "⁎": "*", "−": "-", "‐": "-", "‑": "-", "‒": "-", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
MISSING = "□"

SYMBOL_FROM = "".join(chr(SYMBOL_BASE + first + i) for first, row in SYMBOL_ROWS.items() for i in range(len(row)))
SYMBOL_TO = "".join(SYMBOL_ROWS.values())


def is_symbol_font(font: Column) -> Column:
    """Whether a font's name, less the prefix of a subset, is that of a Symbol font; false for none."""
    return F.coalesce(F.regexp_like(F.regexp_replace(font, "^[A-Z]{6}[+]", ""), F.lit(SYMBOL_FONT)), F.lit(False))


def normalize_symbol_font(text: Column, font: Column) -> Column:
    """struct<text, mapped>: the text of a Symbol font in Unicode and how many characters changed; other fonts' as it is."""
    changed = F.length(F.regexp_replace(text, f"[^{SYMBOL_FROM}]", ""))
    symbol = is_symbol_font(font)
    return F.struct(F.when(symbol, F.translate(text, SYMBOL_FROM, SYMBOL_TO)).otherwise(text).alias("text"), F.when(symbol, changed).otherwise(0).alias("mapped"))


def _has(ranges: list[tuple[int, int]], chars: str) -> bool:
    return all(any(low <= ord(c) <= high for low, high in ranges) for c in chars)


def sanitize_for_font(text: Column, ranges: list[tuple[int, int]]) -> Column:
    """struct<text, replaced>: characters outside the font's code point ranges as a space, a stand-in or a box.

    White space without a glyph is a space; a stand-in counts only where all its characters have glyphs;
    ``replaced`` counts the boxes.
    """
    shown = "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in ranges)
    known = F.regexp_replace(text, f"[{SPACE}&&[^{shown}]]", " ")
    for char, plain in STAND_INS.items():
        if not _has(ranges, char) and _has(ranges, plain):
            known = F.replace(known, F.lit(char), F.lit(plain))
    lost = f"[^ {shown}]"
    return bound(known, lambda t: F.struct(F.regexp_replace(t, lost, MISSING).alias("text"), F.regexp_count(t, F.lit(lost)).alias("replaced")))
