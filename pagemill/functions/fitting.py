"""Breaking and fitting text by a width model; Arrow-batched, since line breaking is a scan with look-back."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as text_functions

# Marks that start or end no line.
NO_START = set("，。、；：？！）》」』】〉〕］｝〗〙〛％‰′″℃〜～…—‧・,.;:?!)]}")
NO_END = set("（《「『【〈〔［｛〖〘〚([{")
CJK = re.compile(text_functions.CJK)


class WidthModel:
    """Widths in em: CJK and full-width 1, space 0.25, everything else 0.5."""

    def width(self, text: str, size: float) -> float:
        return size * sum(1.0 if CJK.match(c) else 0.25 if c == " " else 0.5 for c in text)


@dataclass
class Piece:
    """What stays together on a line."""

    text: str
    kind: str  # word, space, cjk, open, close


def pieces(text: str) -> list[Piece]:
    out: list[Piece] = []
    word = ""

    def end_word() -> None:
        nonlocal word
        if word:
            out.append(Piece(word, "word"))
        word = ""

    for c in text:
        if c.isspace():
            end_word()
            if not out or out[-1].kind != "space":
                out.append(Piece(" ", "space"))
        elif c in NO_START and word and c < "\x80":
            word += c
        elif c in NO_START:
            end_word()
            out.append(Piece(c, "close"))
        elif c in NO_END:
            end_word()
            if c < "\x80":
                word = c
            else:
                out.append(Piece(c, "open"))
        elif CJK.match(c):
            end_word()
            out.append(Piece(c, "cjk"))
        else:
            word += c
    end_word()
    return out


def wrap(text: str, size: float, width: float, model: WidthModel | None = None, indent: float = 0.0) -> list[str]:
    """Lines filled greedily; a closing mark pulls its neighbour down or hangs, an opening one moves down."""
    model = model or WidthModel()
    queue = pieces(text)[::-1]
    lines: list[str] = []
    line: list[Piece] = []

    def room() -> float:
        return max(1.0, width - (indent if not lines else 0.0)) - sum(model.width(p.text, size) for p in line)

    def close_line(keep: int = 0) -> None:
        """End the line, its last ``keep`` pieces open the next one."""
        nonlocal line
        done, line = line[: len(line) - keep], line[len(line) - keep :]
        lines.append("".join(p.text for p in done).rstrip(" "))

    while queue:
        p = queue.pop()
        free, w = room(), model.width(p.text, size)
        if p.kind == "space":
            if line and w <= free:
                line.append(p)
        elif w <= free:
            line.append(p)
        elif not line and len(p.text) > 1:
            n = 1
            while n < len(p.text) and model.width(p.text[: n + 1], size) <= free:
                n += 1
            if n < len(p.text):
                queue.append(Piece(p.text[n:], "word"))
            line.append(Piece(p.text[:n], "word"))
        elif not line:
            line.append(p)
        elif p.kind == "close" and len(line) > 1 and line[-1].kind not in ("space", "open"):
            close_line(1)
            queue.append(p)
        elif p.kind == "close" or (len(line) == 1 and line[-1].kind == "open"):
            line.append(p)
        else:
            close_line(1 if line[-1].kind == "open" else 0)
            queue.append(p)
    if line:
        close_line()
    return lines


@dataclass
class Fit:
    size: float
    lines: list[str]
    height: float
    overflow: bool


def fit(text: str, width: float, height: float, start: float, line_height: float = 1.35, floor: float = 6.0, step: float = 0.5, extension: float = 0.25, share: float = 0.7, model: WidthModel | None = None) -> Fit:
    """The largest size from ``start`` down, half a point at a time, at which the text fits the box.

    The floor is 6 points or 0.7 (``share``) of the start; there the box may grow by a quarter before it overflows.
    """
    least = max(floor, share * start)
    size = start
    while True:
        lines = wrap(text, size, width, model)
        needed = len(lines) * size * line_height
        if needed <= height:
            return Fit(size, lines, needed, False)
        if size - step < least:
            return Fit(size, lines, needed, needed > height * (1 + extension))
        size -= step


def fit_cell(text: str, width: float, height: float, start: float, model: WidthModel | None = None) -> Fit:
    """A table cell: tighter lines first, then quarter points down to 5, and no growth."""
    loose = fit(text, width, height, start, line_height=1.15, floor=start, extension=0.0, model=model)
    return loose if not loose.overflow else fit(text, width, height, start, line_height=1.08, floor=5.0, step=0.25, extension=0.0, share=0.0, model=model)


_FIT = T.StructType([T.StructField("size", T.DoubleType()), T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("height", T.DoubleType()), T.StructField("overflow", T.BooleanType())])


@F.pandas_udf(_FIT)
def fit_text(texts: pd.Series, widths: pd.Series, heights: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    found = [fit(t or "", w, h, s) for t, w, h, s in zip(texts, widths, heights, sizes)]
    return pd.DataFrame([(f.size, f.lines, f.height, f.overflow) for f in found], columns=["size", "lines", "height", "overflow"])


@F.pandas_udf(_FIT)
def fit_cells(texts: pd.Series, widths: pd.Series, heights: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    found = [fit_cell(t or "", w, h, s) for t, w, h, s in zip(texts, widths, heights, sizes)]
    return pd.DataFrame([(f.size, f.lines, f.height, f.overflow) for f in found], columns=["size", "lines", "height", "overflow"])
