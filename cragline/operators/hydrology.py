"""Drainage on the filled surface: levels, flat areas, downhill pointers, accumulation, streams and their basins.

Everything works on tiles (tiles.py). Flat areas get two distances across tiles, to where water leaves them and from
the higher ground around them; water goes to the outlet and away from the slopes. Accumulation is summed inside tiles;
only cells that water enters from another tile form a graph, which is summed with `accumulation`.

Defined results: cells at the edge or beside a missing one are where water leaves; of equally steep neighbours the first
in NEIGHBOURS order is taken; an empty grid gives empty results; further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import tiles as T
from .graph import pointer_jump
from .raster import NEIGHBOURS, accumulation, fill_sinks

#: No neighbour: water leaves here.
OUT = 8
_FAR = [1.0 if dr == 0 or dc == 0 else float(np.sqrt(2)) for dr, dc in NEIGHBOURS]


def shifted(a: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """The neighbours at (dr, dc) of the inner cells of an array with a margin."""
    return a[1 + dr : a.shape[0] - 1 + dr, 1 + dc : a.shape[1] - 1 + dc]


def _spread(a: dict, name: str) -> np.ndarray:
    """Steps within equal levels, lowered until nothing changes."""
    w, d = a["w"], a[name].copy()
    same = [shifted(w, *o) == w[1:-1, 1:-1] for o in NEIGHBOURS]
    while True:
        inner = d[1:-1, 1:-1]
        best = inner
        for ok, o in zip(same, NEIGHBOURS, strict=True):
            best = np.where(ok, np.fmin(best, shifted(d, *o) + 1), best)
        if np.array_equal(best, inner, equal_nan=True):
            return best
        d[1:-1, 1:-1] = best


def _starts(side: int):
    """Layers low, high: 0 where water leaves a level, 1 beside higher ground, infinite elsewhere, nan where no cell is."""

    def step(tr, tc, a):
        w = a["w"]
        own = w[1:-1, 1:-1]
        there = ~np.isnan(own)
        around = np.stack([shifted(w, *o) for o in NEIGHBOURS])
        leaves = (around < own).any(0) | np.isnan(around).any(0)
        low = np.where(there, np.where(leaves, 0.0, np.inf), np.nan)
        high = np.where(there, np.where((around > own).any(0), 1.0, np.inf), np.nan)
        return pa.table({"tr": [tr], "tc": [tc], "pix": [T.squeeze(a["pix"])], "w": [T.squeeze(own)], "low": [T.squeeze(low)], "high": [T.squeeze(high)]})

    return step


def _towards(tr, tc, a):
    """Layer dir: the neighbour that water goes to."""
    w, low, high = a["w"], a["low"], a["high"]
    mask = 2 * low - np.where(np.isinf(high), 0.0, high)
    own = w[1:-1, 1:-1]
    drop = np.stack([(own - shifted(w, *o)) / d for o, d in zip(NEIGHBOURS, _FAR, strict=True)])
    open_ = np.isnan(drop).any(0)
    drop = np.where(np.isnan(drop), -np.inf, drop)
    level = np.stack([np.where(shifted(w, *o) == own, shifted(mask, *o), np.inf) for o in NEIGHBOURS])
    to = np.where(drop.max(0) > 0, drop.argmax(0), level.argmin(0))
    to = np.where(np.isnan(own), T.NONE, np.where(open_, OUT, to)).astype(np.int64)
    return pa.table({"tr": [tr], "tc": [tc], "pix": [T.squeeze(a["pix"])], "dir": [T.squeeze(to)]})


def directions(filled: DataFrame, side: int = T.SIDE) -> DataFrame:
    """Tiles with layers pix and dir of a filled grid(pix, r, c, w)."""
    base = materialize(T.pack(filled, {"pix": "i8", "w": "f8"}, side), "surface")
    flat = materialize(T.with_margin(base, {"pix": "i8"}, {"w": "f8"}, _starts(side), "tr long, tc long, pix binary, w binary, low binary, high binary", side), "flats")
    pix = {"pix": "i8"}
    for name, other in (("low", "high"), ("high", "low")):
        flat = T.settle(flat, pix | {other: "f8"}, name, lambda a, name=name: _spread(a, name), side, {"w": "f8"})
    return materialize(T.with_margin(flat, pix, {"w": "f8", "low": "f8", "high": "f8"}, _towards, "tr long, tc long, pix binary, dir binary", side), "directions")


def _local(to: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next cell inside the tile or the cell itself, whether water goes on outside, row and column steps) of each cell."""
    steps = np.array([*NEIGHBOURS, (0, 0)])
    k = np.where(to == T.NONE, OUT, to).ravel()
    r, c = np.divmod(np.arange(side * side), side)
    r, c = r + steps[k, 0], c + steps[k, 1]
    inside = (r >= 0) & (r < side) & (c >= 0) & (c < side)
    return np.where(inside, r * side + c, np.arange(side * side)), ~inside, steps[k]


def _sum_up(nxt: np.ndarray, amount: np.ndarray) -> np.ndarray:
    """Amounts of all cells above each one, its own included; leaves go first."""
    total, here = amount.copy(), np.arange(len(nxt))
    live = nxt != here
    waits = np.bincount(nxt[live], minlength=len(nxt))
    leaf = np.flatnonzero(live & (waits == 0))
    while len(leaf):
        to = nxt[leaf]
        np.add.at(total, to, total[leaf])
        np.subtract.at(waits, to, 1)
        to = np.unique(to)
        leaf = to[(waits[to] == 0) & live[to]]
    return total


def _ends(nxt: np.ndarray) -> np.ndarray:
    while (nxt[nxt] != nxt).any():
        nxt = nxt[nxt]
    return nxt


def _goal(tr: int, tc: int, cell: np.ndarray, step: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tile row, tile column, place in that tile) of the cells beside `cell`."""
    r, c = np.divmod(cell, side)
    r, c = r + step[:, 0] + tr * side, c + step[:, 1] + tc * side
    return r // side, c // side, (r % side) * side + c % side


def flow(dirs: DataFrame, side: int = T.SIDE) -> DataFrame:
    """Tiles with layers pix, dir and cells: how many cells drain through each one, itself included."""

    def leaving(batches):
        for b in batches:
            for i in range(b.num_rows):
                tr, tc = b.column("tr")[i].as_py(), b.column("tc")[i].as_py()
                to = T.widen(b.column("dir")[i].as_py(), "i8", side)
                nxt, out, step = _local(to, side)
                total = _sum_up(nxt, (to.ravel() != T.NONE).astype(np.int64))
                e = np.flatnonzero(out)
                gr, gc, at = _goal(tr, tc, e, step[e], side)
                yield pa.RecordBatch.from_pydict({"tr": gr, "tc": gc, "at": at, "n": total[e]})

    entries = materialize(dirs.select("tr", "tc", "dir").mapInArrow(leaving, "tr long, tc long, at long, n long").groupBy("tr", "tc", "at").agg(F.sum("n").alias("n")), "entries")

    def links(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = pa.schema([("tr", pa.int64()), ("tc", pa.int64()), ("at", pa.int64()), ("ur", pa.int64()), ("uc", pa.int64()), ("ut", pa.int64()), ("n", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        tr, tc = left["tr"][0].as_py(), left["tc"][0].as_py()
        nxt, out, step = _local(T.widen(left["dir"][0].as_py(), "i8", side), side)
        at = right["at"].to_numpy()
        end = _ends(nxt)[at]
        gr, gc, gt = _goal(tr, tc, end, step[end], side)
        on = out[end]
        mine = lambda far, own: np.where(on, far, own)
        return pa.table({"tr": np.full(len(at), tr), "tc": np.full(len(at), tc), "at": at, "ur": mine(gr, tr), "uc": mine(gc, tc), "ut": mine(gt, at), "n": right["n"].to_numpy()}, schema=kinds)

    met = dirs.select("tr", "tc", "dir").groupBy("tr", "tc").cogroup(entries.groupBy("tr", "tc")).applyInArrow(links, "tr long, tc long, at long, ur long, uc long, ut long, n long")
    # a number for each entry: tile row and column are below 2^23 with side 256
    number = lambda r, c, a: (F.shiftleft(F.col(r), 40) + F.shiftleft(F.col(c), 17) + F.col(a)).cast("long")
    if side * side > 1 << 17:
        raise ValueError("tiles of at most 131,072 cells")
    graph = materialize(met.select("tr", "tc", "at", number("tr", "tc", "at").alias("id"), number("ur", "uc", "ut").alias("parent"), "n"), "links")
    full = accumulation(graph.select("id", "parent", F.col("n").alias("cells")))
    inflow = graph.select("tr", "tc", "at", "id").join(full, "id").select("tr", "tc", "at", F.col("cells").alias("n"))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return T._schema({"pix": "", "dir": "", "cells": ""}).empty_table()
        row = left.to_pylist()[0]
        to = T.widen(row["dir"], "i8", side)
        nxt, _, _ = _local(to, side)
        amount = (to.ravel() != T.NONE).astype(np.int64)
        if right.num_rows:
            amount[right["at"].to_numpy()] += right["n"].to_numpy()
        total = np.where(to.ravel() == T.NONE, T.NONE, _sum_up(nxt, amount))
        return pa.table({"tr": [row["tr"]], "tc": [row["tc"]], "pix": [row["pix"]], "dir": [row["dir"]], "cells": [T.squeeze(total)]})

    return materialize(dirs.groupBy("tr", "tc").cogroup(inflow.groupBy("tr", "tc")).applyInArrow(finish, "tr long, tc long, pix binary, dir binary, cells binary"), "flow")


def _behind(to: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Layer a (with margin) at the cell that water goes to, at the cell itself where it leaves."""
    out = a[1:-1, 1:-1]
    for k, o in enumerate(NEIGHBOURS):
        out = np.where(to == k, shifted(a, *o), out)
    return out


def _joins(least: int):
    """Layer joint: 1 where two streams or more come together."""

    def step(tr, tc, a):
        n = np.zeros(a["pix"].shape, np.int64)
        for k, o in enumerate(NEIGHBOURS):
            back = NEIGHBOURS.index((-o[0], -o[1]))
            n += (shifted(a["dir"], *o) == back) & (shifted(a["cells"], *o) >= least)
        inner = lambda x: T.squeeze(a[x][1:-1, 1:-1])
        return pa.table({"tr": [tr], "tc": [tc], "pix": [T.squeeze(a["pix"])], "dir": [inner("dir")], "cells": [inner("cells")], "joint": [T.squeeze((n > 1).astype(np.int64))]})

    return step


def _segments(least: int):
    """pix, stream, parent: where the way to a stream, or along one to its next joint, goes on."""

    def step(tr, tc, a):
        pix, stream = a["pix"][1:-1, 1:-1], a["cells"] >= least
        ends = stream & (_behind(a["dir"], a["joint"]) == 1) & (a["dir"] != OUT)
        there = pix != T.NONE
        return pa.table({"pix": pix[there], "stream": stream[there], "parent": np.where(ends, pix, _behind(a["dir"], a["pix"]))[there]})

    return step


def drainage(dem: DataFrame, side: int = T.SIDE, rise: float = 0.0) -> DataFrame:
    """pix, cells: how many cells drain through each cell of dem(pix, r, c, z) on its filled surface."""
    tiles = flow(directions(fill_sinks(dem, rise, side), side), side)
    return T.cells(tiles, {"pix": "i8", "cells": "i8"}, side, "pix").select("pix", "cells")


def basins(dem: DataFrame, least: int = 5000, side: int = T.SIDE, rise: float = 0.0) -> DataFrame:
    """pix, r, c, z, basin of dem(pix, r, c, z): one basin for each stretch of stream between joints, named after its last cell.

    Streams are cells that at least `least` cells drain through; cells whose water meets no stream have no basin.
    """
    flows = flow(directions(fill_sinks(dem, rise, side), side), side)
    joined = materialize(T.with_margin(flows, {"pix": "i8"}, {"dir": "i8", "cells": "i8"}, _joins(least), "tr long, tc long, pix binary, dir binary, cells binary, joint binary", side), "joints")
    ways = materialize(T.with_margin(joined, {"dir": "i8", "cells": "i8"}, {"pix": "i8", "joint": "i8"}, _segments(least), "pix long, stream boolean, parent long", side), "ways")
    roots = pointer_jump(ways.select(F.col("pix").alias("id"), "parent"))
    named = roots.join(ways.filter("stream").select(F.col("pix").alias("root")), "root").select(F.col("id").alias("pix"), F.col("root").alias("basin"))
    return dem.select("pix", "r", "c", "z").join(named, "pix")
