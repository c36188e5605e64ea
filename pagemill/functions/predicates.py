"""Tests on a block's text, as boolean Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import B0, B1, SPACE, bound, collapse, trim

# Forms that are never translated.
DOI = r"(?i)^(doi:?[{s}]*)?(https?:\/\/(dx\.)?doi\.org\/)?10\.\d{{4,9}}\/[^{s}]+$".format(s=SPACE)
URL = r"(?i)^(https?:\/\/[^{s}]+|www\.[^{s}]+)$".format(s=SPACE)
EMAIL = r"(?i)^[\w.+-]+@[\w-]+(\.[\w-]+)+$"
CITATION = r"^[\[(]?[{s}]*\d+([{s}]*[,;–-][{s}]*\d+)*[{s}]*[\])]?$".format(s=SPACE)
PAGE_NUMBER = r"(?i)^(page[{s}]+)?\d{{1,4}}([{s}]+(of|\/)[{s}]+\d{{1,4}})?$".format(s=SPACE)
VALUE_MARKS = r"[\d{s}.,;:±+\-−–—%‰()\[\]{{}}<>=≤≥*∗†‡§¶#/×x^~≈]".format(s=SPACE)
PLACEHOLDER = r"^(?:[-–—―.…]+|NA|N\/A|n\/a|NR|ND|NS|ns|n\.s\.|NE|NC|Ref\.?|REF)$"
NUMBER_WITH_UNIT = r"^[<>≤≥≈~]?[{s}]*[-–−+]?\d[\d.,]*(?:[{s}]*[-–−—±×x/][{s}]*\d[\d.,]*)*[{s}]*%?[{s}]*(?:\([^()]*\)|\[[^\[\]]*\])?[{s}]*[A-Za-zµμ]{{1,2}}$".format(s=SPACE)
STATISTICS = [
    "OR", "HR", "RR", "IRR", "AOR", "AHR", "ARR", "CI", "CRI", "SD", "SE", "SEM", "IQR", "N", "NO", "NOS", "P", "DF", "Z", "T", "F", "R", "R2",
    "AUC", "ROC", "MD", "SMD", "RD", "NNT", "REF", "NA", "NS",
]
STATISTICS_LOWER = ["n", "p", "z", "t", "r", "df", "vs", "ns"]
STATISTICS_MIXED = ["aOR", "aHR", "aRR", "aIRR"]
MATH = r"[=+−×÷±∑∏∫√∞≈≠≤≥∂∇αβγδεθλμπσφψωΔΣΩ∈∉⊂⊃∪∩]"


def like(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^A-Za-z]+", ""))


def has_three_letters(c: Column) -> Column:
    return like(c, "(?s)[A-Za-z].*?[A-Za-z].*?[A-Za-z]")


def words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, rf"[{SPACE}]+"), lambda w: w != ""))


def is_numeric_only(c: Column) -> Column:
    """Nothing but numbers, operators and n / p / NS / NA tokens, with a digit or only dashes."""
    left = F.regexp_replace(F.regexp_replace(c, B0 + r"(n|N|p|P|r|R|NS|ns|NA|N\/A|vs)" + B1, ""), VALUE_MARKS, "")
    return (left == "") & (like(c, r"\d") | like(trim(c), rf"^[-−–—{SPACE}]+$"))


def is_numeric_row(c: Column) -> Column:
    """At least three values, and three fifths of the tokens that carry a letter or digit."""
    tokens = lambda: F.filter(F.split(c, rf"[{SPACE}]+"), lambda t: F.regexp_like(t, F.lit("[A-Za-z0-9]")))
    values = lambda ts: F.struct(F.size(F.filter(ts, is_numeric_only)).alias("values"), F.size(ts).alias("tokens"))
    share = lambda n: (n["values"] >= 3) & (n["values"] / n["tokens"] >= 0.6)
    # a value has a digit, so a text of fewer than three digits is not taken apart
    return F.when(like(c, r"\d\D*\d\D*\d"), bound(bound(tokens(), values), share)).otherwise(F.lit(False))


def is_abbreviation_only(c: Column) -> Column:
    t = trim(c)
    return (F.length(t) <= 24) & like(t, rf"^[A-Z][A-Z0-9₀-₉²³.{SPACE}+/&-]*$") & like(t, "[A-Z]{2}")


def skip_kind(c: Column) -> Column:
    """Why a text needs no translation, the first that holds; null when it does."""
    kind = lambda t: (
        F.when(F.length(t) < 2, "empty")
        .when(like(t, DOI), "doi")
        .when(like(t, URL), "url")
        .when(like(t, EMAIL), "email")
        .when(like(t, CITATION), "citation-marker")
        .when(like(t, PAGE_NUMBER), "page-number")
        .when(~has_three_letters(t), F.when(is_numeric_only(t), "NUMERIC_ONLY").otherwise("no-letters"))
    )
    return bound(trim(c), kind)


def is_untranslatable(c: Column) -> Column:
    return skip_kind(c).isNotNull() | is_numeric_only(trim(c))


def is_numeric_cell(c: Column) -> Column:
    """A table cell without language: values, placeholders, values with a marker or a short unit."""
    t = collapse(c)
    bare = trim(F.regexp_replace(t, r"[a-e*†‡§¶#ᵃᵇᶜᵈᵉ]{1,2}$", ""))
    return (t != "") & (is_numeric_only(t) | like(t, PLACEHOLDER) | ((bare != t) & (bare != "") & is_numeric_only(bare)) | like(t, NUMBER_WITH_UNIT))


def is_stat_notation(c: Column) -> Column:
    """Only statistical notation, numbers and marks: "OR (95% CI)" but not "No"."""
    found = F.regexp_extract_all(c, F.lit(r"([A-Za-zµμ][A-Za-z0-9µμ]*)"), F.lit(1))
    known = lambda w: ((w == F.upper(w)) & w.isin(STATISTICS)) | w.isin(STATISTICS_LOWER + STATISTICS_MIXED)
    return (F.size(found) > 0) & F.forall(found, known)


def is_figure_notation(c: Column) -> Column:
    return is_numeric_cell(c) | is_stat_notation(c) | ~like(c, "[A-Za-zÀ-ɏ]{2}")


def is_reference_entry(c: Column) -> Column:
    """Numbered or "Surname, X." at the start, a DOI, or a year with journal details."""
    t = trim(c)
    start = like(t, rf"^(\[\d{{1,3}}\]|\d{{1,3}}\.)([{SPACE}]|$)") | like(t, rf"^[A-Z][A-Za-z'’-]+,[{SPACE}]+(?:[A-Z]\.[{SPACE}]?-?){{1,3}}(?:,|[{SPACE}]+and{B1}|[{SPACE}]*&)")
    doi = like(t, rf"(?i){B0}10\.\d{{4,9}}\/[^{SPACE}]+|{B0}doi[{SPACE}]*:")
    year = like(t, rf"{B0}(19|20)\d{{2}}[a-z]?{B1}")
    detail = like(t, rf"(?i){B0}et al{B1}") | like(t, rf"{B0}\d+[{SPACE}]*\([{SPACE}]*\d+(?:[-–]\d+)?[{SPACE}]*\)[{SPACE}]*[:,]") | like(t, rf"{B0}pp?\.[{SPACE}]*\d+")
    return start | doi | (year & detail)


def caption_kind(c: Column) -> Column:
    """TABLE, FIGURE or null, by the strict form of a caption."""
    s = SPACE
    prefix = rf"(?i)^(?:(?:online[{s}]+)?(?:supplement(?:al|ary)?(?:[{s}]+(?:materials?|data|information|digital[{s}]+content))?|extended[{s}]+data|appendix(?:[{s}]+[A-Z0-9]{{1,3}})?)[{s}.:-]+)?"
    number, end = rf"[{s}]*(?:[A-Z]?S?\d{{1,3}}[a-z]?|[IVX]{{1,5}})", rf"[{s}]*(?:[.:|—–-]|$)"
    t = trim(c)
    return F.when(like(t, prefix + "e?table" + number + end), "TABLE").when(like(t, prefix + r"e?(?:fig(?:ure)?s?\.?|scheme|chart|plate)" + number + end), "FIGURE")


def looks_like_equation(c: Column) -> Column:
    solid = F.length(F.regexp_replace(c, rf"[{SPACE}]+", ""))
    return (solid == 0) | (letters(c) / solid < 0.4) | ((words(c) <= 12) & (F.regexp_count(c, F.lit(MATH)) >= 3))


def is_all_caps(c: Column) -> Column:
    return has_three_letters(c) & ~like(c, "[a-z]")


def is_title_cased(c: Column) -> Column:
    """Seven tenths of the words of four letters or more start with a capital."""
    long = F.filter(F.split(c, rf"[{SPACE}]+"), lambda w: F.regexp_like(w, F.lit("[A-Za-z]{4,}")))
    capital = F.filter(long, lambda w: F.regexp_like(w, F.lit("^[^A-Za-z]*[A-Z]")))
    return (F.size(long) > 0) & (F.size(capital) / F.size(long) >= 0.7)


def looks_suspicious(c: Column) -> Column:
    """Undecoded glyphs: (cid:n), the replacement character, or mostly private-use code points."""
    private = F.regexp_count(c, F.lit(r"[\ue000-\uf8ff]"))
    return like(c, r"\(cid:\d+\)") | F.contains(c, F.lit("\ufffd")) | (private > F.length(c) * 0.5)


def valid_page_range(start: Column, end: Column, pages: Column) -> Column:
    return (start >= 1) & (start <= end) & (end <= pages)
