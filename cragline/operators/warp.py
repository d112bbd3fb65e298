"""Grids of one system on the grid of another: every new cell's centre is projected back and sampled by a kernel.

A task holds one tile of the source. It projects the tile's outline, looks at the new cells in and around that, projects
their centres back and adds up the weighted source cells that it holds; sums of cells on a border of tiles are put
together by a map-side reduced aggregation. No source cell is shuffled more than once, for its tile.

The kernel is widened where new cells are larger than the source's, so that no source cell is passed over.

Defined results: missing cells take no part; a new cell is there if the source cell that holds its centre is; repeated
cells keep the one of greatest value; an empty grid gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.projection import ARRAYS, forward, inverse
from ..session import materialize
from . import tiles as T


@dataclass(frozen=True)
class Frame:
    """Where a grid lies: the upper left corner of cell (0, 0), the cells' sizes, and the system's central meridian (None: degrees)."""

    x0: float
    y0: float
    dx: float
    dy: float
    meridian: float | None = None

    def degrees(self, x, y):
        return (x, y) if self.meridian is None else inverse(x, y, self.meridian, ARRAYS)

    def plane(self, lon, lat):
        return (lon, lat) if self.meridian is None else forward(lon, lat, self.meridian, ARRAYS)

    def place(self, r, c):
        """System's coordinates of a row and column, counted from the corner."""
        return self.x0 + c * self.dx, self.y0 - r * self.dy

    def cell(self, x, y):
        """Row and column, with fractions, of a place."""
        return (self.y0 - y) / self.dy, (x - self.x0) / self.dx


def aligned(x: float, y: float, size: float, meridian: float | None) -> Frame:
    """The frame whose cell borders are multiples of size, with (x, y) in cell (0, 0)."""
    return Frame(np.floor(x / size) * size, np.ceil(y / size) * size, size, size, meridian)


def between(source: Frame, target: Frame, r, c):
    """Row and column in target of a row and column in source."""
    x, y = source.place(r, c)
    if source.meridian != target.meridian:
        x, y = target.plane(*source.degrees(x, y))
    return target.cell(x, y)


def kernel(d: np.ndarray, cubic: bool) -> np.ndarray:
    """Weight at a distance of d cells."""
    d = np.abs(d)
    if not cubic:
        return np.maximum(0.0, 1 - d)
    return np.where(d < 1, (1.5 * d - 2.5) * d * d + 1, np.where(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2, 0.0))


def _sample(z: np.ndarray, top: int, left: int, row: np.ndarray, col: np.ndarray, wide: tuple[float, float], cubic: bool):
    """(weighted sum, weight, whether the middle cell is there) of a tile's cells around fractional rows and columns."""
    reach = 2 if cubic else 1
    (wr, wc), there = wide, ~np.isnan(z)
    value = np.where(there, z, 0.0)
    total, weight = np.zeros(len(row)), np.zeros(len(row))
    first = lambda at, w: np.ceil(at - 0.5 - reach * w).astype(np.int64)
    r0, c0 = first(row, wr), first(col, wc)
    for i in range(int(2 * reach * wr) + 1):
        r = r0 + i
        a = kernel((r + 0.5 - row) / wr, cubic)
        r_in = (r >= top) & (r < top + z.shape[0]) & (a != 0)
        for j in range(int(2 * reach * wc) + 1):
            c = c0 + j
            w = a * kernel((c + 0.5 - col) / wc, cubic)
            ok = np.flatnonzero(r_in & (c >= left) & (c < left + z.shape[1]) & (w != 0))
            at = (r[ok] - top, c[ok] - left)
            total[ok] += w[ok] * value[at]
            weight[ok] += w[ok] * there[at]
    r, c = np.floor(row).astype(np.int64) - top, np.floor(col).astype(np.int64) - left
    middle = (r >= 0) & (r < z.shape[0]) & (c >= 0) & (c < z.shape[1])
    middle[middle] = there[r[middle], c[middle]]
    return total, weight, middle


def warp(cells: DataFrame, source: Frame, target: Frame, cubic: bool = True, side: int = T.SIDE, extent: tuple[int, int, int, int] | None = None) -> DataFrame:
    """r, c, z on target's grid of cells(r, c, z) on source's; with an extent (rows from and below, columns from and
    below), of its new cells only."""
    r_from, r_to, c_from, c_to = extent or (-(1 << 62), 1 << 62, -(1 << 62), 1 << 62)
    packed = materialize(T.pack(cells.filter(F.col("z").isNotNull()), {"z": "f8"}, side), "source")

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                z = T.widen(b.column("z")[k].as_py(), "f8", side)
                top, left = b.column("tr")[k].as_py() * side, b.column("tc")[k].as_py() * side
                rs, cs = np.nonzero(~np.isnan(z))
                z = z[rs.min() : rs.max() + 1, cs.min() : cs.max() + 1]
                top, left = int(top + rs.min()), int(left + cs.min())
                yield from _tile(z, top, left)

    def _tile(z, top, left):
        h, w = z.shape
        y, x = np.arange(-2, h + 3), np.arange(-2, w + 3)  # an outline a little outside
        outline_r = np.r_[np.full(len(x), -2), np.full(len(x), h + 2), y, y] + top
        outline_c = np.r_[x, x, np.full(len(y), -2), np.full(len(y), w + 2)] + left
        r, c = between(source, target, outline_r, outline_c)
        more = 3  # a widened kernel's reach, in new cells, beyond the outline
        cols = np.arange(max(c_from, int(np.floor(c.min())) - more), min(c_to, int(np.ceil(c.max())) + more))
        rows = np.arange(max(r_from, int(np.floor(r.min())) - more), min(r_to, int(np.ceil(r.max())) + more))
        if not len(rows) or not len(cols):
            return
        for row in np.array_split(rows, max(1, len(rows) * len(cols) >> 18)):
            rr, cc = (x.ravel() for x in np.meshgrid(row, cols, indexing="ij"))
            at, across = between(target, source, rr + 0.5, cc + 0.5)
            near = (at > top - 3 * scale[0]) & (at < top + h + 3 * scale[0]) & (across > left - 3 * scale[1]) & (across < left + w + 3 * scale[1])
            rr, cc, at, across = rr[near], cc[near], at[near], across[near]
            total, weight, middle = _sample(z, top, left, at, across, scale, cubic)
            keep = (weight != 0) | middle
            yield pa.RecordBatch.from_pydict({"r": rr[keep], "c": cc[keep], "s": total[keep], "w": weight[keep], "m": middle[keep]})

    scale = widening(source, target)
    sums = packed.mapInArrow(run, "r long, c long, s double, w double, m boolean").groupBy("r", "c").agg(F.sum("s").alias("s"), F.sum("w").alias("w"), F.max("m").alias("m"))
    return sums.filter("m and w > 1e-6").select("r", "c", (F.col("s") / F.col("w")).alias("z"))


def widening(source: Frame, target: Frame) -> tuple[float, float]:
    """How many source rows and columns a new cell spans, 1 at least, at target's corner; one number for the whole grid."""
    r, c = between(target, source, np.array([0.0, 1.0, 0.0]), np.array([0.0, 0.0, 1.0]))
    return max(1.0, abs(float(r[1] - r[0]))), max(1.0, abs(float(c[2] - c[0])))
