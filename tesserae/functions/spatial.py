"""Coverings of boxes by quadtree cells, and a curve key that keeps neighbours in the same row groups."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LEVEL, MAX_CELLS = 15, 8


def box_of(cell: str) -> tuple[float, float, float, float]:
    """Longitude and latitude bounds of a cell; its digits are quadrants, from the whole globe down."""
    x1, y1, x2, y2 = -180.0, -90.0, 180.0, 90.0
    for q in cell:
        mx, my = (x1 + x2) / 2, (y1 + y2) / 2
        x1, x2 = (mx, x2) if q in "13" else (x1, mx)
        y1, y2 = (my, y2) if q in "23" else (y1, my)
    return x1, y1, x2, y2


def covering(x1: float, y1: float, x2: float, y2: float, max_cells: int = MAX_CELLS, max_level: int = MAX_LEVEL) -> list[str]:
    """Few cells that cover the box: the coarsest are refined as long as at most `max_cells` result."""
    def meets(c: str) -> bool:
        a, b, c2, d = box_of(c)
        return a <= x2 and c2 >= x1 and b <= y2 and d >= y1

    heap, done = [(0, "")], []
    while heap:
        level, cell = heapq.heappop(heap)
        below = [cell + q for q in "0123" if meets(cell + q)] if level < max_level else []
        if not below or len(heap) + len(done) + len(below) > max_cells:
            done.append(cell)
        else:
            for c in below:
                heapq.heappush(heap, (level + 1, c))
    return sorted(done)


def index_terms(box: tuple, **limits: int) -> list[str]:
    """Terms of a stored box: its cells, and their ancestors marked with `$`."""
    cells = covering(*box, **limits)
    return sorted({*cells, *(f"${c[:k]}" for c in cells for k in range(len(c)))})


def query_terms(box: tuple, **limits: int) -> list[str]:
    """Terms of a query box: a stored box that meets it shares one. Roles are the reverse of index_terms."""
    cells = covering(*box, **limits)
    return sorted({*(f"${c}" for c in cells), *(c[:k] for c in cells for k in range(len(c) + 1))})


def cells_column(min_x: str = "min_x", min_y: str = "min_y", max_x: str = "max_x", max_y: str = "max_y") -> Column:
    """index_terms as a column, for the optional spatial index; NULL without a box."""
    @F.pandas_udf("array<string>")
    def f(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if x[0] != x[0] else index_terms(x) for x in zip(a, b, c, d, strict=True)])

    return f(min_x, min_y, max_x, max_y)


def curve_column(bits: int = 16) -> Column:
    """Z-order key of the box's centre: interleaved bits, most significant first. NULL without a box."""
    def scaled(low: str, high: str, span: float) -> Column:
        mid = (F.col(low) + F.col(high)) / 2
        return F.least(F.greatest(F.floor((mid / span + 0.5) * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("bigint")

    def spread(v: Column) -> Column:
        for s, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, s)).bitwiseAND(F.lit(mask).cast("bigint"))
        return v

    return spread(scaled("min_x", "max_x", 360.0)).bitwiseOR(F.shiftleft(spread(scaled("min_y", "max_y", 180.0)), 1))
