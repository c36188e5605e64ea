"""Excerpts of a document for terminology extraction, under a budget of characters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

from .folds import dealt

# The budget, and what each pass takes at most.
BUDGET, EXCERPT, TITLE, OPENING, HEADING, CAPTION, DENSE = 7000, 1200, 300, 900, 120, 300, 600
OPENINGS, CAPTIONS, DEFINITIONS = 5, 8, 10
DEFINITION = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z][a-z]+(?:[ -][a-z]+){0,6}\s*\(\s*[A-Z][A-Za-z0-9]{1,9}\s*\)")
_DENSITY = [(re.compile(rf"(?<![A-Za-z0-9_]){p}(?![A-Za-z0-9_])"), n) for p, n in (("[A-Z][A-Z0-9]{1,8}", 2), ("[a-z]+-[a-z]+(?:-[a-z]+)?", 1), (r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+", 1))]

UNITS = "doc_id long, ord long, unit_id string, page int, type string, text string"
SAMPLES = "doc_id long, seq int, pass string, excerpt string"


def clip(text: str, n: int) -> str:
    t = " ".join(text.split())
    return t if len(t) <= n else t[:n] + "…"


def density(text: str) -> float:
    return sum(n * len(p.findall(text)) for p, n in _DENSITY) / len(text) ** 0.5 if text else 0.0


def definition(text: str, around: int = 160) -> str | None:
    m = DEFINITION.search(text)
    return clip(text[max(0, m.start() - around) : m.end() + around], 2 * around + 40) if m else None


class Budget:
    """Takes excerpts while they fit; a unit gives one at most."""

    def __init__(self, size: int) -> None:
        self.size, self.spent, self.used, self.out = size, 0, set(), []

    def take(self, step: str, unit: str | None, text: str) -> bool:
        t = clip(text, EXCERPT)
        if not t or unit in self.used or self.spent + len(t) > self.size:
            return False
        if unit is not None:
            self.used.add(unit)
        self.out.append((step, t))
        self.spent += len(t)
        return True


def samples_of(units: list, size: int = BUDGET, skip_used: bool = False) -> list[tuple[str, str]]:
    """(pass, excerpt) in order.  A small document goes whole; else titles, opening, headings, captions,
    definitions and the densest paragraph of each page follow each other while the budget lasts.

    The definition pass ends at the first unit that is used already, unless ``skip_used``.
    """
    units = [u for u in units if u.type != "REFERENCE" and u.text.strip()]
    if sum(len(u.text) for u in units) <= size:
        return [("whole", clip(u.text, size)) for u in units]
    b = Budget(size)
    of = lambda kind: [u for u in units if u.type == kind]
    for u in of("TITLE"):
        b.take("title", u.unit_id, clip(u.text, TITLE))
    left = OPENINGS
    for u in of("BODY"):
        if left and u.page <= 2 and len(u.text) >= 80:
            left -= b.take("opening", u.unit_id, clip(u.text, OPENING))
    headings = of("HEADING")
    if headings:
        b.used.update(u.unit_id for u in headings)
        b.take("headings", None, " | ".join(clip(u.text, HEADING) for u in headings)[:EXCERPT])
    left = CAPTIONS
    for u in of("CAPTION"):
        if left:
            left -= b.take("caption", u.unit_id, clip(u.text, CAPTION))
    left = DEFINITIONS
    for u in units:
        if b.spent > size * 0.8 or not left or (u.unit_id in b.used and not skip_used):
            break
        found = definition(u.text)
        if found:
            left -= b.take("definition", u.unit_id, found)
    pages: set[int] = set()
    dense = sorted((u for u in of("BODY") if u.unit_id not in b.used and len(u.text) >= 200), key=lambda u: -density(u.text))
    for u in dense:
        if b.spent >= size * 0.95:
            break
        if u.page not in pages and b.take("dense", u.unit_id, clip(u.text, DENSE)):
            pages.add(u.page)
    return b.out


def term_samples(units: DataFrame, size: int = BUDGET) -> DataFrame:
    """``units`` with the columns of ``UNITS`` -> ``SAMPLES``; the passes share one running budget, so a document is one fold."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = samples_of(list(pdf.sort_values("ord").itertuples(index=False)), size)
        return pd.DataFrame([(key[0], i, *r) for i, r in enumerate(rows)], columns=["doc_id", "seq", "pass", "excerpt"])

    return dealt(units, ["doc_id"]).groupBy("doc_id").applyInPandas(run, SAMPLES)
