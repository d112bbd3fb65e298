"""Topographic prominence without a sequential scan; flat summits have none and an empty grid gives no summits.

Cells are ordered by falling height, then pixel. Each tile is merged by itself, in that order: where two parts meet, the
one of the lower peak has its key col there for certain if no cell of it lies on a border with another tile. What is
left undecided are edges between peaks of parts that touch a border, and the crossings of the borders. That graph is
reduced in rounds, each summit hooking along its best edge to an earlier one; once few edges are left, a descending
merge on them finishes.

Defined results: missing cells are no ground; of repeated cells the highest counts; further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import tiles as T
from .graph import pointer_jump
from .raster import NEIGHBOURS

#: Edges that may be merged in one process (about 50 MB).
FEW = 200_000


#: What a row of a tile's tree says.
TOP, OFFER, EDGE, BORDER, NODE, CROSS, LOW = range(7)
_TREE = "kind int, a long, b long, nz double, p long"
_TREE_ARROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("nz", pa.float64()), ("p", pa.int64())])


def _tree(tr: int, tc: int, arrays: dict) -> pa.Table:
    """A tile's summits, decided key cols, undecided merges, border cells with their peaks, crossings, and lowest height."""
    there = np.argwhere(~np.isnan(arrays["z"][1:-1, 1:-1]))
    if not len(there):
        return _TREE_ARROW.empty_table()
    box = tuple(slice(lo, hi + 3) for lo, hi in zip(there.min(0).tolist(), there.max(0).tolist(), strict=True))
    z, pix = arrays["z"][box], arrays["pix"][box]
    wide = z.shape[1]
    own = np.zeros(z.shape, bool)
    own[1:-1, 1:-1] = ~np.isnan(z[1:-1, 1:-1])
    near = np.stack([z[1 + dr : z.shape[0] - 1 + dr, 1 + dc : wide - 1 + dc] for dr, dc in NEIGHBOURS])
    strict = own[1:-1, 1:-1] & (np.isnan(near) | (near < z[1:-1, 1:-1])).all(0)
    cells = np.flatnonzero(own)
    order = cells[np.lexsort((pix.ravel()[cells], -z.ravel()[cells]))]
    size = z.size
    rank = np.full(size, size, np.int64)
    rank[order] = np.arange(len(order))
    outer = (~np.isnan(z) & ~own).ravel().tolist()
    rank, height, number = rank.tolist(), z.ravel().tolist(), pix.ravel().tolist()
    steps = [dr * wide + dc for dr, dc in NEIGHBOURS]
    up, peak, open_ = list(range(size)), list(range(size)), [False] * size
    rows: list[tuple] = []
    nodes: set[int] = set()

    def find(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for here, cell in enumerate(order.tolist()):
        parts, beyond = set(), []
        for step in steps:
            q = cell + step
            if rank[q] < here:
                parts.add(find(q))
            elif outer[q]:
                beyond.append(q)
        if parts:
            top, *lower = sorted(parts, key=lambda x: rank[peak[x]])
            for x in lower:
                a, b = peak[x], peak[top]
                if open_[x]:
                    rows.append((EDGE, number[a], number[b], -height[cell], number[cell]))
                    nodes.update((a, b))
                    open_[top] = True
                else:
                    rows.append((OFFER, number[a], None, -height[cell], number[cell]))
                    if height[a] == height[b]:
                        rows.append((OFFER, number[b], None, -height[cell], number[cell]))
                up[x] = top
            up[cell] = top
        else:
            top = cell
        if beyond:
            open_[top] = True
            nodes.add(peak[top])
            rows.append((BORDER, number[cell], number[peak[top]], None, None))
            for q in beyond:
                if number[cell] < number[q]:
                    nz, p = max((-height[cell], number[cell]), (-height[q], number[q]))
                    rows.append((CROSS, number[cell], number[q], nz, p))
    rows += [(NODE, number[n], None, -height[n], None) for n in nodes]
    r, c = np.nonzero(strict)
    rows += [(TOP, number[k], None, -height[k], None) for k in ((r + 1) * wide + c + 1).tolist()]
    rows.append((LOW, None, None, -float(np.nanmin(z[own])), None))
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _TREE_ARROW, strict=True)], schema=_TREE_ARROW)


def trees(dem: DataFrame, side: int = T.SIDE) -> DataFrame:
    """The tiles' trees of dem(pix, r, c, z), written."""
    layers = {"z": "f8", "pix": "i8"}
    packed = materialize(T.pack(dem.filter(F.col("z").isNotNull()), layers, side), "heights")
    return materialize(T.with_margin(packed, {}, layers, _tree, _TREE, side), "trees")


def undecided(tree: DataFrame) -> DataFrame:
    """edges(a, b, s): merges and crossings between peaks of different tiles' parts, s = (falling height, pixel)."""
    s = F.struct("nz", "p").alias("s")
    border = tree.filter(F.col("kind") == BORDER)
    cross = tree.filter(F.col("kind") == CROSS).select("a", "b", s)
    for end in ("a", "b"):
        cross = cross.join(border.select(F.col("a").alias(end), F.col("b").alias("to")), end).withColumn(end, F.col("to")).drop("to")
    every = tree.filter(F.col("kind") == EDGE).select("a", "b", s).unionByName(cross)
    return every.filter("a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("s").alias("s"))


def _merge(edges: pd.DataFrame, height: dict) -> list[tuple[int, float, int]]:
    """(peak, saddle height, saddle pixel) offers of a descending merge."""
    parent: dict[int, int] = {}

    def find(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    offers = []
    for a, b, nz, p in sorted(zip(edges.a, edges.b, edges.nz, edges.p, strict=True), key=lambda e: (e[2], e[3])):
        x, y = find(a), find(b)
        if x == y:
            continue
        if (-height[x], x) > (-height[y], y):
            x, y = y, x
        offers.append((int(y), float(-nz), int(p)))
        if height[x] == height[y]:
            offers.append((int(x), float(-nz), int(p)))
        parent[y] = x
    return offers


def key_cols(peaks: DataFrame, edges: DataFrame, few: int = FEW) -> DataFrame:
    """peak, s: the key col of every one of peaks(peak, z) that has one by edges(a, b, s)."""
    spark = peaks.sparkSession
    offers = []
    while (n := edges.count()) > few:
        both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "s").unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"), "s"))
        both = both.join(peaks.select(F.col("peak").alias("y"), F.col("z").alias("zy")), "y").join(peaks.select(F.col("peak").alias("x"), F.col("z").alias("zx")), "x")
        best = both.groupBy("x", "zx").agg(F.min(F.struct("s", (-F.col("zy")).alias("nz"), F.col("y").alias("y"))).alias("b"))
        hook = materialize(best.filter(F.struct(F.col("b.nz").alias("nz"), F.col("b.y").alias("p")) < F.struct((-F.col("zx")).alias("nz"), F.col("x").alias("p"))).select("x", F.col("b.y").alias("y"), F.col("b.s").alias("s"), (F.col("zx") == -F.col("b.nz")).alias("tie")), "hooks")
        offers.append(hook.select(F.col("x").alias("peak"), "s").unionByName(hook.filter("tie").select(F.col("y").alias("peak"), "s")))
        forest = hook.select(F.col("x").alias("id"), F.col("y").alias("parent")).unionByName(hook.select(F.col("y").alias("id")).distinct().join(hook.select(F.col("x").alias("id")), "id", "left_anti").select("id", F.col("id").alias("parent")))
        top = pointer_jump(forest)
        for side in ("a", "b"):
            edges = edges.join(top.select(F.col("id").alias(side), F.col("root").alias("to")), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        edges = materialize(edges.filter("a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("s").alias("s")), "summits")
    if n:
        left = edges.select("a", "b", "s.nz", "s.p").toPandas()
        ends = edges.select(F.explode(F.array("a", "b")).alias("peak")).distinct().join(peaks, "peak").toPandas()
        rest = spark.createDataFrame(_merge(left, dict(zip(ends.peak.tolist(), ends.z.tolist(), strict=True))), "peak long, z double, pix long")
        offers.append(rest.select("peak", F.struct((-F.col("z")).cast("double").alias("nz"), F.col("pix").alias("p")).alias("s")))
    if not offers:
        return peaks.filter("false").select("peak", F.struct((-F.col("z")).alias("nz"), F.col("peak").alias("p")).alias("s"))
    every = offers[0]
    for o in offers[1:]:
        every = every.unionByName(o)
    return every.groupBy("peak").agg(F.min("s").alias("s"))


def prominence(dem: DataFrame, few: int = FEW, side: int = T.SIDE) -> DataFrame:
    """pix, z, keycol, keycol_pix, prom of the strict maxima; without a higher neighbour the key col is the lowest cell."""
    kind = dem.schema["z"].dataType
    tree = trees(dem, side)
    peaks = materialize(tree.filter(F.col("kind") == NODE).select(F.col("a").alias("peak"), (-F.col("nz")).alias("z")).distinct(), "peaks")
    later = key_cols(peaks, materialize(undecided(tree), "undecided"), few)
    cols = tree.filter(F.col("kind") == OFFER).select(F.col("a").alias("peak"), F.struct("nz", "p").alias("s")).unionByName(later).groupBy("peak").agg(F.min("s").alias("s"))
    low = tree.filter(F.col("kind") == LOW).agg(F.min(-F.col("nz")).alias("gmin"))  # one row
    tops = tree.filter(F.col("kind") == TOP).select(F.col("a").alias("pix"), (-F.col("nz")).alias("z"))
    out = tops.join(cols, F.col("pix") == F.col("peak"), "left").join(F.broadcast(low))
    key = F.coalesce(-F.col("s.nz"), F.col("gmin"))
    return out.select("pix", F.col("z").cast(kind).alias("z"), key.cast(kind).alias("keycol"), F.col("s.p").alias("keycol_pix"), (F.col("z") - key).cast(kind).alias("prom")).filter("prom > 0")
