"""Entities that a translation must keep: found, protected by placeholders, restored, compared.

``citations`` and ``compare`` are native.  ``protect`` numbers placeholders inside the replacement, which
no built-in function does, so it and ``restore`` are Arrow-batched functions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numeric import multiset_minus
from .text import SPACE, bound

# The patterns of protected entities, in the order in which they are looked for.
_W = f"[{SPACE}]"
_START = r"(?<![A-Za-z0-9_])"
_AUTHOR = rf"[A-Z][A-Za-z'’\-]+(?:{_W}+(?:van|von|de|der|da|di|le){_W}+[A-Z][A-Za-z'’\-]+)?(?:{_W}+(?:and|&){_W}+[A-Z][A-Za-z'’\-]+)*(?:{_W}+et{_W}+al\.?)?"
_YEAR = r"\d{4}[a-z]?"
_ONE = rf"(?:(?:see|see also|e\.g\.|cf\.|also|i\.e\.),?{_W}+)?{_AUTHOR},?{_W}+{_YEAR}(?:,{_W}*(?:pp?\.{_W}*)?\d+(?:[–\-]\d+)?)?"
_NUMBER = r"(?:\(?(?:S\d+|[A-Z]\d+|\d+(?:\.\d+)*)[A-Za-z]?\)?|[A-Z](?![A-Za-z0-9])|[IVX]{1,4}(?![A-Za-z]))"
PATTERNS = [
    ("EMAIL", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+"),
    ("URL", rf"(?:https?:\/\/|www\.)[^{SPACE}<>\"'）)\]]+[^{SPACE}<>\"'）)\].,;:]"),
    ("DOI", rf"(?i){_START}(?:doi:{_W}*)?10\.\d{{4,9}}\/[^{SPACE}\"<>]+[^{SPACE}\"<>.,;:)]"),
    ("CITE", rf"\[\d{{1,4}}(?:{_W}*[,;–\-]{_W}*\d{{1,4}})*\]"),
    ("CITE", rf"\((?:{_ONE})(?:;{_W}*(?:{_ONE}))*\)"),
    ("CITE", rf"{_START}{_AUTHOR}{_W}+\({_YEAR}(?:,{_W}*{_YEAR})*\)"),
    ("REF", rf"{_START}(?:(?:Supplementary|Supplemental|Online|Extended Data){_W}+)?(?:Figures?|Figs?\.|Tables?|Appendix|Appendices|Equations?|Eqs?\.){_W}+(?:{_NUMBER})(?:{_W}*(?:[,–\-]|and|to|&){_W}*(?:{_NUMBER}))*"),
]
PLACEHOLDER = r"__(CITE|REF|DOI|URL|EMAIL)_(\d+)__"
LENIENT = re.compile(r"[_＿]{1,2}\s?(CITE|REF|DOI|URL|EMAIL)\s?[_＿]?\s?0*(\d+)\s?[_＿]{1,2}")
_TOKEN = T.StructType([T.StructField(n, T.StringType()) for n in ("token", "kind", "value")])
PROTECTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("placeholders", T.ArrayType(_TOKEN))])
RESTORED = T.StructType([T.StructField("text", T.StringType()), T.StructField("missing", T.ArrayType(T.StringType())), T.StructField("leftover", T.ArrayType(T.StringType()))])
_COMPILED = [(kind, re.compile(p)) for kind, p in PATTERNS]


def normalize_citation(c: Column) -> Column:
    t = F.translate(c, "–—‐‑−", "-----")
    for pattern, put in ((rf"[{SPACE}]+", " "), (r" *([,;-]) *", "$1"), (r"\( +", "("), (r" +\)", ")"), (r"^ +| +$", "")):
        t = F.regexp_replace(t, pattern, put)
    return t


def citations(c: Column) -> Column:
    """Sorted citations and references; a text that already holds a placeholder has none."""
    rest, found = c, []
    for kind, pattern in PATTERNS:
        if kind in ("CITE", "REF"):
            found.append(F.regexp_extract_all(rest, F.lit(f"({pattern})"), F.lit(1)))
        rest = F.regexp_replace(rest, pattern, f"__{kind}__")
    every = F.array_sort(F.transform(F.concat(*found), normalize_citation))
    return F.when(F.regexp_like(c, F.lit(PLACEHOLDER)), F.array().cast("array<string>")).otherwise(every)


def compare(source: Column, target: Column) -> Column:
    """struct<ok, missing, added> of two texts' citations."""
    sides = F.struct(citations(source).alias("a"), citations(target).alias("b"))
    diff = bound(sides, lambda s: F.struct(multiset_minus(s["a"], s["b"]).alias("missing"), multiset_minus(s["b"], s["a"]).alias("added")))
    return bound(diff, lambda d: F.struct(((F.size(d["missing"]) == 0) & (F.size(d["added"]) == 0)).alias("ok"), d["missing"].alias("missing"), d["added"].alias("added")))


def content(c: Column) -> Column:
    """A text with its protected entities blanked, so that years in citations are no statistics."""
    rest = c
    for _, pattern in PATTERNS:
        rest = F.regexp_replace(rest, pattern, " ")
    return F.when(F.regexp_like(c, F.lit(PLACEHOLDER)), F.regexp_replace(c, r"__[A-Z]+_\d+__", " ")).otherwise(rest)


def _protect(text: str) -> tuple[str, list[dict]]:
    if re.search(PLACEHOLDER, text):
        return text, []
    found: list[dict] = []
    counts: dict[str, int] = {}
    for kind, pattern in _COMPILED:

        def put(m: re.Match, kind: str = kind) -> str:
            counts[kind] = counts.get(kind, 0) + 1
            found.append({"token": f"__{kind}_{counts[kind]}__", "kind": kind, "value": m[0]})
            return found[-1]["token"]

        text = pattern.sub(put, text)
    return text, found


@F.pandas_udf(PROTECTED)
def protect(texts: pd.Series) -> pd.DataFrame:
    """Entities replaced by numbered tokens; numbers follow the order of patterns, not of the text."""
    rows = [_protect(t) if t is not None else (None, []) for t in texts]
    return pd.DataFrame({"text": [r[0] for r in rows], "placeholders": [r[1] for r in rows]})


@F.pandas_udf(RESTORED)
def restore(texts: pd.Series, placeholders: pd.Series) -> pd.DataFrame:
    """Values put back for tokens in any spelling; tokens that were lost or that nobody knows are listed."""
    out = []
    for text, known in zip(texts, placeholders):
        by = {(p["kind"], int(re.sub(r"\D+", "", p["token"]))): p for p in (known if known is not None else [])}
        if text is None or not by:
            out.append((text, [], []))
            continue
        seen: set = set()
        left: list[str] = []

        def back(m: re.Match, by: dict = by, seen: set = seen, left: list[str] = left) -> str:
            key = (m[1], int(m[2]))
            if key not in by:
                left.append(m[0])
                return m[0]
            seen.add(key)
            return by[key]["value"]

        out.append((LENIENT.sub(back, text), [p["token"] for k, p in by.items() if k not in seen], left))
    return pd.DataFrame(out, columns=["text", "missing", "leftover"])
