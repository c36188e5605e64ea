"""Table cells from positioned items: rows, fragments, column bands, cells, alignment.

A table is one Arrow batch: which row an item belongs to depends on the rows before it, and a cell on the
open cells above it.  Readers bound the items of a page, so a table is small.
"""

from __future__ import annotations

from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .folds import dealt

# Fixed values, in em of the cell size unless said otherwise.
ROW, FRAGMENT, BAND, BAND_LEAST, OVERLAP, OVERLAP_LEAST, PITCH = 0.5, 0.75, 0.35, 3.0, 0.15, 1.5, 1.6

ITEMS = "doc_id long, table_id int, page int, item_id long, text string, x double, y double, width double, font_size double"
CELLS = "doc_id long, table_id int, page int, cell_id string, row int, column int, col_span int, text string, item_ids array<long>, x0 double, x1 double, alignment string, status string"


def cell_size(items: list) -> float:
    """The quarter-point size with most characters; the larger of equals."""
    weight: dict[float, int] = {}
    for i in items:
        size = np.floor(i.font_size * 4 + 0.5) / 4
        weight[size] = weight.get(size, 0) + max(1, len(i.text.strip()))
    return max(weight, key=lambda s: (weight[s], s))


def rows_of(items: list, size: float) -> list[list]:
    """Items by baseline from the top; a row's anchor moves to its larger items only."""
    rows: list[list] = []
    anchor, held = 0.0, 0.0
    for i in sorted(items, key=lambda i: (-i.y, i.x)):
        if rows and abs(i.y - anchor) <= ROW * size:
            rows[-1].append(i)
            if i.font_size >= size > held:
                anchor, held = i.y, i.font_size
        else:
            rows.append([i])
            anchor, held = i.y, i.font_size
    return [sorted(r, key=lambda i: i.x) for r in rows]


def fragments_of(row: list, size: float) -> list[dict]:
    """Runs of a row's items that no gap of 0.75 em parts."""
    out: list[dict] = []
    for i in row:
        if out and i.x - out[-1]["x1"] <= FRAGMENT * size:
            f = out[-1]
            gap = i.x - f["x1"] > 0.12 * size and not f["text"].endswith(" ")
            f["text"] += (" " if gap else "") + i.text
            f["x1"] = max(f["x1"], i.x + i.width)
            f["ids"].append(i.item_id)
        else:
            out.append({"text": i.text, "x0": i.x, "x1": i.x + i.width, "ids": [i.item_id], "y": i.y})
    return [f for f in out if f["text"].strip()]


def column_bands(rows: list[list[dict]], size: float) -> list[tuple[float, float]]:
    """Merged extents of the fragments in rows that have at least the usual number of them."""
    usual = max(2, median([len(r) for r in rows]))
    spans = sorted((f["x0"], f["x1"]) for r in rows if len(r) >= usual for f in r)
    bands: list[list[float]] = []
    for lo, hi in spans:
        if bands and lo - bands[-1][1] < max(BAND_LEAST, BAND * size):
            bands[-1][1] = max(bands[-1][1], hi)
        else:
            bands.append([lo, hi])
    return [tuple(b) for b in bands]


def columns_under(f: dict, bands: list[tuple[float, float]]) -> tuple[int, int]:
    """First and last band that a fragment overlaps enough; the nearest where it overlaps none."""
    width = f["x1"] - f["x0"]
    hit = [k for k, (lo, hi) in enumerate(bands) if min(hi, f["x1"]) - max(lo, f["x0"]) >= max(OVERLAP_LEAST, OVERLAP * min(width, hi - lo))]
    if hit:
        return hit[0], hit[-1]
    centre = (f["x0"] + f["x1"]) / 2
    near = min(range(len(bands)), key=lambda k: abs(centre - sum(bands[k]) / 2))
    return near, near


def continues(cell: dict, f: dict, filled: int, size: float) -> bool:
    """Whether a fragment is a wrapped line of the cell above it."""
    close = cell["y"] - f["y"] <= PITCH * size
    aligned = -0.5 * size <= f["x0"] - cell["x0"] <= 3 * size or abs((f["x0"] + f["x1"]) - (cell["x0"] + cell["x1"])) <= 3 * size
    number = lambda t: any(c.isdigit() for c in t) and not any(c.isalpha() for c in t)
    opened = cell["text"].rstrip().endswith((",", "-", "(", "/")) or f["text"].lstrip()[:1].islower() or f["text"].lstrip()[:1] in ("(", ")")
    hanging = 0.4 * size <= f["x0"] - cell["x0"] <= 3 * size
    return close and aligned and not number(cell["text"]) and not number(f["text"]) and filled == 1 and (opened or hanging)


def alignment(parts: list[tuple[float, float]]) -> str:
    """The side that varies least; left, then centre, of equals; left for a single sample."""
    if len(parts) < 2:
        return "left"
    spread = {name: max(v) - min(v) for name, v in (("left", [a for a, _ in parts]), ("center", [(a + b) / 2 for a, b in parts]), ("right", [b for _, b in parts]))}
    return min(spread, key=lambda k: spread[k])


def cells_of(items: list) -> tuple[str, list[dict]]:
    """(status, cells) of one table on one page."""
    items = [i for i in items if i.text.strip()]
    if not items:
        return "NO_ITEMS", []
    size = cell_size(items)
    rows = [r for r in (fragments_of(r, size) for r in rows_of(items, size)) if r]
    if len(rows) < 2:
        return "SINGLE_ROW", []
    bands = column_bands(rows, size)
    if len(bands) < 2:
        return "NO_COLUMNS", []
    cells: list[dict] = []
    open_: dict[tuple[int, int], dict] = {}
    for n, row in enumerate(rows):
        now: dict[tuple[int, int], dict] = {}
        for f in row:
            at = columns_under(f, bands)
            above = open_.get(at)
            if above and continues(above, f, len(row), size):
                above["text"] += " " + f["text"]
                above["ids"] += f["ids"]
                above["x0"], above["x1"], above["y"] = min(above["x0"], f["x0"]), max(above["x1"], f["x1"]), f["y"]
                now[at] = above
            else:
                cell = f | {"row": n, "first": at[0], "last": at[1]}
                cells.append(cell)
                now[at] = cell
        open_ = now
    for first in {c["first"] for c in cells}:
        side = alignment([(c["x0"], c["x1"]) for c in cells if c["first"] == first == c["last"]])
        for c in cells:
            if c["first"] == first:
                c["alignment"] = "center" if c["last"] > first else side
    return "RESOLVED", cells


def table_cells(items: DataFrame) -> DataFrame:
    """``items`` with the columns of ``ITEMS`` -> ``CELLS``; an unresolved table is one row with its status."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        status, cells = cells_of(list(pdf.itertuples(index=False)))
        doc, table, page = key
        out, seen = [], set()
        for c in cells:
            name = f"p{page}-t{table}-r{c['row']}c{c['first']}"
            if name in seen:
                name += "-2"
            seen.add(name)
            out.append((doc, table, page, name, c["row"], c["first"], c["last"] - c["first"] + 1, " ".join(c["text"].split()), c["ids"], c["x0"], c["x1"], c["alignment"], status))
        if not out:
            out = [(doc, table, page, None, None, None, None, None, [], None, None, None, status)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in CELLS.split(", ")]).astype({"row": "Int32", "column": "Int32", "col_span": "Int32"})

    keys = ["doc_id", "table_id", "page"]
    return dealt(items, keys).groupBy(*keys).applyInPandas(run, CELLS)
