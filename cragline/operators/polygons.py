"""Polygons of equal-valued cells: boundary edges chained to rings, tile by tile.

Every side of a cell whose neighbour is of another region is a directed edge with the cell on its right; at a corner it
goes on along the same region, and turns to its own cell where regions touch diagonally. Edges are chained inside
tiles; a ring that leaves its tile is a cycle of paths, whose least edge is found and whose paths are counted by
pointer doubling. Regions are 4-connected.

Defined results: outer rings go clockwise on a grid whose rows grow downwards, holes the other way; a ring starts at its
least edge, ends with its first corner, and has a corner only where its direction changes; cells without a value
belong to no polygon; repeated cells keep one value; an empty table gives an empty result; further columns are not
looked at. A ring is one row, so one ring's corners must fit a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import tiles as T
from .graph import components
from .raster import scatter

#: Sides of a cell in the order of a walk around it: the neighbour behind each, the corner that it starts from, its direction.
_SIDES = [((-1, 0), (0, 0), (0, 1)), ((0, 1), (0, 1), (1, 0)), ((1, 0), (1, 1), (0, -1)), ((0, -1), (1, 0), (-1, 0))]
_PATH = "id long, succ long, region long, edges long, dirs binary, rs binary, cs binary"


def regions(cells: DataFrame, value: str) -> DataFrame:
    """cells with `region`, the least pix of the 4-connected cells of one value."""
    cells = cells.filter(F.col(value).isNotNull())
    sent = scatter(cells.withColumn("_v", F.col(value)), ["pix", "_v"], [(0, 1), (1, 0)]).select("r", "c", F.col("pix").alias("dst"), F.col("_v").alias("_w"))
    edges = sent.join(cells.select("r", "c", F.col("pix").alias("src"), F.col(value).alias("_v")), ["r", "c"]).filter("_v = _w").select("src", "dst")
    found = components(edges, cells.select(F.col("pix").alias("id")))
    return cells.join(found, F.col("pix") == F.col("id")).drop("id").withColumnRenamed("comp", "region")


def _edges(a: np.ndarray, pix: np.ndarray) -> tuple[np.ndarray, ...]:
    """(id, id of the next one, region, row and column of the start, side) of a tile's directed edges; arrays have margins."""
    at = lambda x, o: x[1 + o[0] : x.shape[0] - 1 + o[0], 1 + o[1] : x.shape[1] - 1 + o[1]]
    own, number = at(a, (0, 0)), at(pix, (0, 0))
    out = []
    for s, (beside, corner, way) in enumerate(_SIDES):
        r, c = np.nonzero((own != T.NONE) & (at(a, beside) != own))
        ahead, turn = at(a, way)[r, c] == own[r, c], at(a, (way[0] + beside[0], way[1] + beside[1]))[r, c] == own[r, c]
        straight, left = ahead & ~turn, ahead & turn
        cell = np.where(left, at(pix, (way[0] + beside[0], way[1] + beside[1]))[r, c], np.where(straight, at(pix, way)[r, c], number[r, c]))
        side = np.where(left, (s + 3) % 4, np.where(straight, s, (s + 1) % 4))
        out.append((number[r, c] * 4 + s, cell * 4 + side, own[r, c], r + corner[0], c + corner[1], np.full(len(r), s)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _paths(tr: int, tc: int, a: dict, side: int) -> pa.Table:
    """The tile's edges as paths in their order; succ is the first edge of the next path, the path's own if it is a ring."""
    ids, after, region, r, c, way = _edges(a["region"], a["pix"])
    n = len(ids)
    if not n:
        return pa.table({k: pa.array([], t) for k, t in _PATH_ARROW})
    order = np.argsort(ids)
    at = np.minimum(np.searchsorted(ids, after, sorter=order), n - 1)
    nxt = np.where(ids[order[at]] == after, order[at], n)  # n: goes on in another tile
    # the least edge ahead within the tile; edges that never leave it are rings, cut before their least edge
    least, jump = np.append(ids, np.iinfo(np.int64).max), np.append(nxt, n)
    low = least.copy()
    for _ in range(n.bit_length() + 1):
        low = np.minimum(low, low[jump])
        jump = jump[jump]
    closed = jump[:n] != n
    cut = closed & (after == low[:n])
    nxt = np.where(cut, n, nxt)
    ahead, jump = np.append((nxt != n).astype(np.int64), 0), np.append(nxt, n)
    for _ in range(n.bit_length() + 1):
        ahead = ahead + ahead[jump]
        jump = jump[jump]
    last = np.arange(n + 1)
    step = np.append(nxt, n)
    step = np.where(step == n, last, step)
    while (step[step] != step).any():
        step = step[step]
    o = np.lexsort((-ahead[:n], step[:n]))
    first = np.flatnonzero(np.diff(step[o], prepend=-1))
    ends = np.append(first[1:], n)
    rows = {"id": ids[o[first]], "succ": after[step[o[first]]], "region": region[o[first]], "edges": ends - first}
    d, rr, cc = way[o].astype(np.int8), r[o] + tr * side, c[o] + tc * side
    # corners only: where the direction changes within the path, and its first edge
    turn = np.append(True, d[1:] != d[:-1])
    turn[first] = True
    parts = [np.flatnonzero(turn[x:y]) + x for x, y in zip(first, ends, strict=True)]
    return pa.table({**rows, "dirs": [d[p].tobytes() for p in parts], "rs": [rr[p].tobytes() for p in parts], "cs": [cc[p].tobytes() for p in parts]}, schema=pa.schema(_PATH_ARROW))


_PATH_ARROW = [(n, pa.int64()) for n in ("id", "succ", "region", "edges")] + [(n, pa.binary()) for n in ("dirs", "rs", "cs")]


def _order(paths: DataFrame) -> DataFrame:
    """id, ring, place: the least path of each cycle and how many paths stand between it and this one."""
    now = paths.select("id", "succ", F.col("succ").alias("jump"), F.col("id").alias("low"))
    while True:
        far = now.select(F.col("id").alias("jump"), F.col("jump").alias("far"), F.col("low").alias("other"))
        now = materialize(now.join(far, "jump").select("id", "succ", F.col("far").alias("jump"), F.least("low", "other").alias("low")), "cycles")
        beside = now.select(F.col("id").alias("succ"), F.col("low").alias("next"))
        if now.join(beside, "succ").filter("low != next").isEmpty():
            break
    # paths up to the end of the ring, which is cut before its least path
    now = now.select("id", F.when(F.col("succ") != F.col("low"), F.col("succ")).alias("jump"), F.col("low").alias("ring"), F.when(F.col("succ") != F.col("low"), 1).otherwise(0).cast("long").alias("left"))
    while not now.filter("jump is not null").isEmpty():
        far = now.select(F.col("id").alias("jump"), F.col("jump").alias("far"), F.col("left").alias("more"))
        now = materialize(now.join(far, "jump", "left").select("id", F.col("far").alias("jump"), "ring", (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "places")
    return now.select("id", "ring", (-F.col("left")).alias("place"))


def _join_up(batches):
    """ring, region, points of rings whose paths come in order."""
    for b in batches:
        out = []
        for row in b.to_pylist():
            ways = sorted(row["paths"], key=lambda p: p["place"])
            d = np.frombuffer(b"".join(p["dirs"] for p in ways), np.int8)
            r, c = (np.frombuffer(b"".join(p[k] for p in ways), np.int64) for k in ("rs", "cs"))
            keep = np.flatnonzero(d != np.roll(d, 1))
            points = [{"r": int(r[i]), "c": int(c[i])} for i in [*keep, keep[0]]]
            out.append({"ring": row["ring"], "region": row["region"], "points": points})
        if out:
            yield pa.RecordBatch.from_pylist(out, _RING_ARROW)


_RING = "ring long, region long, points array<struct<r: long, c: long>>"
_RING_ARROW = pa.schema([("ring", pa.int64()), ("region", pa.int64()), ("points", pa.list_(pa.struct([("r", pa.int64()), ("c", pa.int64())])))])


def rings(cells: DataFrame, side: int = T.SIDE) -> DataFrame:
    """ring, region, points, area of cells(pix, r, c, region): the rings' corners, and their area, below 0 for holes."""
    layers = {"pix": "i8", "region": "i8"}
    packed = materialize(T.pack(cells, layers, side), "regions")
    paths = materialize(T.with_margin(packed, {}, layers, lambda tr, tc, a: _paths(tr, tc, a, side), _PATH, side), "paths")
    alone = paths.filter("id = succ").select("id", F.col("id").alias("ring"), F.lit(0).cast("long").alias("place"))
    placed = alone.unionByName(_order(paths.filter("id != succ")))
    whole = paths.join(placed, "id").groupBy("ring", "region").agg(F.collect_list(F.struct("place", "dirs", "rs", "cs")).alias("paths"))
    return whole.mapInArrow(_join_up, _RING).withColumn("area", ring_area(F.col("points")))


def ring_area(points: Column) -> Column:
    """Cells inside a ring of corners, above 0 if it goes clockwise."""
    edges = F.arrays_zip(F.slice(points, 1, F.size(points) - 1).alias("p"), F.slice(points, 2, F.size(points) - 1).alias("q"))
    twice = F.aggregate(edges, F.lit(0).cast("long"), lambda a, e: a + e.p.c * e.q.r - e.q.c * e.p.r)
    return (twice / 2).cast("long")


def polygonize(cells: DataFrame, value: str, side: int = T.SIDE) -> tuple[DataFrame, DataFrame]:
    """(cells with their region, polygons) of cells(pix, r, c, value). A polygon has region, value, outer, holes, area, length."""
    named = materialize(regions(cells.select("pix", "r", "c", value), value), "polygons")
    made = materialize(rings(named, side), "rings")
    length = F.aggregate(F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("p"), F.slice("points", 2, F.size("points") - 1).alias("q")), F.lit(0).cast("long"), lambda a, e: a + F.abs(e.p.r - e.q.r) + F.abs(e.p.c - e.q.c))
    shape = made.withColumn("length", length).groupBy("region").agg(F.max(F.when(F.col("area") > 0, F.col("points"))).alias("outer"), F.sort_array(F.collect_list(F.when(F.col("area") < 0, F.col("points")))).alias("holes"), F.sum("area").alias("area"), F.sum("length").alias("length"))
    values = named.filter("pix = region").select("region", value)
    return named, shape.join(values, "region").select("region", value, "outer", "holes", "area", "length")
