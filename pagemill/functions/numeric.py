"""Numbers and statistics in a text, compared between a source and its translation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import B0, B1, SPACE, bound

# What number words, months and roman numerals stand for, and CJK numerals.
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
    "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19",
    "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90",
    "hundred": "100", "thousand": "1000", "million": "1000000", "billion": "1000000000",
    "first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5", "sixth": "6", "seventh": "7", "eighth": "8", "ninth": "9", "tenth": "10",
    "once": "1", "twice": "2", "single": "1", "double": "2", "triple": "3", "half": "0.5", "quarter": "0.25", "dozen": "12", "both": "2",
    "january": "1", "february": "2", "march": "3", "april": "4", "may": "5", "june": "6", "july": "7", "august": "8", "september": "9", "october": "10", "november": "11", "december": "12",
    "jan": "1", "feb": "2", "mar": "3", "apr": "4", "jun": "6", "jul": "7", "aug": "8", "sep": "9", "sept": "9", "oct": "10", "nov": "11", "dec": "12",
}
ROMAN = {"I": "1", "II": "2", "III": "3", "IV": "4", "V": "5", "VI": "6", "VII": "7", "VIII": "8", "IX": "9", "X": "10"}
CJK_NUMERALS = {"0": "零", "1": "一", "2": "二兩", "3": "三", "4": "四", "5": "五", "6": "六", "7": "七", "8": "八", "9": "九", "10": "十"}
MAGNITUDES = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12, "千": 1e3, "萬": 1e4, "百萬": 1e6, "千萬": 1e7, "億": 1e8, "兆": 1e12}
KEPT_SYMBOLS = r"[±≤≥°μµΔ∆αβγδεζηθλσπφχψωΩΣ∑]"

#: A hyphen that is a sign is written with this character while numbers are read.
SIGN = "⁻"
_EN = r"(?i)(?<![A-Za-z0-9_])(\d+(?:\.\d+)?)(?:-(\d+(?:\.\d+)?))?[{s}]*(thousand|million|billion|trillion)".format(s=SPACE) + B1
_ZH = r"(?<![A-Za-z0-9_])(\d+(?:\.\d+)?)(?:-(\d+(?:\.\d+)?))?[{s}]*(千萬|百萬|千|萬|億|兆)(?![A-Za-z])".format(s=SPACE)


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def normalize(c: Column) -> Column:
    """One spelling for digits, dashes, separators, percent signs and spaces around operators."""
    t = F.translate(c, "０１２３４５６７８９．％＝＜＞＋（），–—‐‑−﹣－×\u00a0", "0123456789.%=<>+(),-------x ")
    def grouped(u: Column) -> Column:
        for _ in range(4):
            u = F.regexp_replace(u, r"(\d),(\d{3})(?!\d)", "$1$2")
        return u

    t = bound(t, lambda u: F.when(F.contains(u, F.lit(",")), grouped(u)).otherwise(u))
    s = f"[{SPACE}]"
    for pattern, put in (
        (rf"(?i)(\d){s}*percent{B1}", "$1%"),
        (rf"百分之{s}*(\d+(?:\.\d+)?)", "$1%"),
        (rf"{s}*([=<>≤≥±%]){s}*", "$1"),
        (rf"(\d){s}*(?:-|~|～|至|to){s}*(\d)", "$1-$2"),
        (rf"(?i){B0}p{s}*-?{s}*value{B1}", "p"),
        (rf"(\d){s}+(\d{{3}})(?!\d)", "$1$2"),
    ):
        t = F.regexp_replace(t, pattern, put)
    return t


def canonical(c: Column) -> Column:
    """A number without redundant zeros; a sign on zero goes."""
    t = F.regexp_replace(c, SIGN, "-")
    for pattern, put in ((r"^(-?)\.", "$10."), (r"^(-?)0+(?=\d)", "$1"), (r"\.0+(?=%?$)", ""), (r"^-(?=0%?$)", "")):
        t = F.regexp_replace(t, pattern, put)
    return t


def _magnitudes(t: Column, pattern: str) -> Column:
    """"≈value" of every quantity with a magnitude word, both ends of a range."""
    at = lambda k: F.regexp_extract_all(t, F.lit(pattern), F.lit(k))
    factor = lambda unit: F.element_at(literal_map(MAGNITUDES), F.lower(unit))
    rows = F.arrays_zip(at(1).alias("a"), at(2).alias("b"), at(3).alias("u"))
    values = F.flatten(F.transform(rows, lambda r: F.transform(F.filter(F.array(r["a"], r["b"]), lambda n: n.isNotNull() & (n != "")), lambda n: n.cast("double") * factor(r["u"]))))
    digits = lambda v: F.when(v == 0, v).otherwise(F.round(v / F.pow(F.lit(10.0), F.floor(F.log10(v)) - 5)) * F.pow(F.lit(10.0), F.floor(F.log10(v)) - 5))
    shown = lambda v: F.regexp_replace(F.regexp_replace(F.format_string("%.6f", v), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.transform(values, lambda v: F.concat(F.lit("≈"), shown(digits(v))))


def signature(c: Column) -> Column:
    """struct<numbers, stats>: sorted multisets of the numbers and statistics of a text."""
    return bound(normalize(c), lambda t: bound(F.struct(t.alias("t"), F.when(_has_words(t), F.regexp_replace(t, _EN, " ")).otherwise(t).alias("no_en")), _signature))


def _has_words(t: Column) -> Column:
    return F.regexp_like(t, F.lit("(?i)thousand|illion"))


def _has_cjk_units(t: Column) -> Column:
    return F.regexp_like(t, F.lit("[千萬億兆]"))


def _signature(s: Column) -> Column:
    """Patterns are only tried on texts that hold a mark without which they cannot match."""
    none = F.array().cast("array<string>")
    no_en = s["no_en"]
    big = F.concat(F.when(_has_words(s["t"]), _magnitudes(s["t"], _EN)).otherwise(none), F.when(_has_cjk_units(no_en), _magnitudes(no_en, _ZH)).otherwise(none))
    token = rf"((?<![A-Za-z0-9_]){SIGN}?(?:\d+(?:\.\d+)?|(?<![A-Za-z0-9_.)\]”\"'])\.\d+)%?)"
    signed = lambda rest: F.regexp_replace(rest, rf"(^|[{SPACE}(\[=<>:;,/])-(?=[\d.])", f"$1{SIGN}")
    p, n = r"(?<![A-Za-z])[pP]([=<>≤≥])(\.?\d+(?:\.\d+)?)", r"(?<![A-Za-z])[nN]=(\d+)"
    pm = r"(-?(?:\d+(?:\.\d+)?|\.\d+))±((?:\d+(?:\.\d+)?|\.\d+))"

    def read(rest: Column) -> Column:
        of = lambda pattern, k: F.regexp_extract_all(rest, F.lit(pattern), F.lit(k))
        numbers = F.transform(F.regexp_extract_all(signed(rest), F.lit(token), F.lit(1)), canonical)
        stats = F.concat(
            F.when(F.regexp_like(rest, F.lit("[pP][=<>≤≥]")), F.zip_with(of(p, 1), of(p, 2), lambda o, v: F.concat(F.lit("p"), o, canonical(v)))).otherwise(none),
            F.when(F.regexp_like(rest, F.lit("[nN]=")), F.transform(of(n, 1), lambda v: F.concat(F.lit("n="), canonical(v)))).otherwise(none),
            F.when(F.contains(rest, F.lit("±")), F.zip_with(of(pm, 1), of(pm, 2), lambda a, b: F.concat(canonical(a), F.lit("±"), canonical(b)))).otherwise(none),
        )
        return F.struct(F.array_sort(F.concat(big, numbers)).alias("numbers"), F.array_sort(stats).alias("stats"))

    return bound(F.when(_has_cjk_units(no_en), F.regexp_replace(no_en, _ZH, " ")).otherwise(no_en), read)


def multiset_minus(a: Column, b: Column) -> Column:
    """The members of ``a`` beyond their number in ``b``, repeats included."""
    count = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    extra = lambda s, v: F.greatest(count(s["a"], v) - count(s["b"], v), F.lit(0))
    return bound(F.struct(a.alias("a"), b.alias("b")), lambda s: F.flatten(F.transform(F.array_distinct(s["a"]), lambda v: F.array_repeat(v, extra(s, v)))))


def tolerated(source: Column) -> Column:
    """Numbers that a translation may add: the source has them as words, months or roman numerals."""
    plain = F.regexp_extract_all(F.lower(source), F.lit(B0 + r"([a-z]+)" + B1), F.lit(1))
    roman = F.regexp_extract_all(source, F.lit(B0 + r"(I{1,3}|IV|VI{0,3}|IX|X)" + B1), F.lit(1))
    known = F.concat(F.transform(plain, lambda w: F.element_at(literal_map(NUMBER_WORDS), w)), F.transform(roman, lambda w: F.element_at(literal_map(ROMAN), w)))
    return F.array_distinct(F.array_compact(known))


def compare(source: Column, target: Column) -> Column:
    """struct<ok, missing, added> of two texts' numbers and statistics."""
    cjk = literal_map(CJK_NUMERALS)
    as_cjk = lambda s, v: F.regexp_like(s["target"], F.concat(F.lit("["), F.element_at(cjk, v), F.lit("]")))

    def diff(s: Column) -> Column:
        a, b = s["a"], s["b"]
        missing = F.concat(F.filter(multiset_minus(a["numbers"], b["numbers"]), lambda v: ~F.coalesce(as_cjk(s, v), F.lit(False))), multiset_minus(a["stats"], b["stats"]))
        added = F.concat(F.filter(multiset_minus(b["numbers"], a["numbers"]), lambda v: ~F.array_contains(s["may"], v)), multiset_minus(b["stats"], a["stats"]))
        return F.struct(missing.alias("missing"), added.alias("added"))

    sides = F.struct(signature(source).alias("a"), signature(target).alias("b"), tolerated(source).alias("may"), target.alias("target"))
    said = bound(bound(sides, diff), lambda d: F.struct(((F.size(d["missing"]) == 0) & (F.size(d["added"]) == 0)).alias("ok"), d["missing"].alias("missing"), d["added"].alias("added")))
    return said


def missing_symbols(source: Column, target: Column) -> Column:
    """Symbols of the source that the target lacks; look-alikes count as one, the source's form is given."""
    found = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(f"({KEPT_SYMBOLS})"), F.lit(1)))
    same = lambda s: F.translate(s, "µ∆∑", "μΔΣ")
    have = F.transform(found(target), same)
    return F.filter(found(source), lambda s: ~F.array_contains(have, same(s)))


def density(c: Column) -> Column:
    return bound(signature(c), lambda s: F.struct(F.size(s["numbers"]).alias("numbers"), F.size(s["stats"]).alias("stats"), F.regexp_count(c, F.lit("[(（]")).alias("parentheses")))
