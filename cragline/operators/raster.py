"""Raster operators on the long table dem(pix, r, c, z): one row a valid cell.

Defined results: cells that are missing have no row and count as outside; pix is unique; ties between heights go to the
smaller pix; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import tiles
from .graph import components, pointer_jump

#: The eight neighbours in the order NW, N, NE, W, E, SW, S, SE.
NEIGHBOURS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def _offsets(pairs) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for i, (dr, dc) in enumerate(pairs)])).alias("o")


def scatter(dem: DataFrame, payload: list[str], pairs=NEIGHBOURS) -> DataFrame:
    """Every cell's payload sent to the neighbours it is at offset `ord` of: r, c, ord, payload. One shuffle, map-side reducible."""
    return dem.select("r", "c", *payload, _offsets(pairs)).select((F.col("r") - F.col("o.dr")).alias("r"), (F.col("c") - F.col("o.dc")).alias("c"), F.col("o.ord").alias("ord"), *payload)


def valid_mask(cells: DataFrame, nodata: float | None = None) -> DataFrame:
    ok = F.col("z").isNotNull() & ~F.isnan(F.col("z").cast("double")) & (F.abs(F.col("z").cast("double")) != float("inf"))
    return cells.filter(ok & (F.col("z") != nodata) if nodata is not None else ok)


def focal_max(dem: DataFrame) -> DataFrame:
    """pix, z, focal: the maximum of the 3x3 window; cells outside count as minus infinity."""
    sent = scatter(dem, ["z"], [(0, 0), *NEIGHBOURS])
    own = F.max(F.when(F.col("ord") == 0, F.col("z")))
    cells = sent.groupBy("r", "c").agg(own.alias("z"), F.max("z").alias("focal")).filter("z is not null")
    return cells.select("r", "c", "z", "focal")


def local_maxima(dem: DataFrame) -> DataFrame:
    """Cells that no neighbour exceeds; all cells of a plateau qualify."""
    return focal_max(dem).filter("z = focal").select("r", "c", "z")


def strict_maxima(dem: DataFrame) -> DataFrame:
    sent = scatter(dem, ["z"], [(0, 0), *NEIGHBOURS])
    own, other = F.max(F.when(F.col("ord") == 0, F.col("z"))), F.max(F.when(F.col("ord") > 0, F.col("z")))
    return sent.groupBy("r", "c").agg(own.alias("z"), other.alias("near")).filter("z is not null and (near is null or z > near)").select("r", "c", "z")


def grid_counts(dem: DataFrame) -> DataFrame:
    """valid, peaks, low, consistent of the grid in one scan: cells, local maxima, lowest height, and whether no cell repeats."""
    sent = scatter(dem, ["z"], [(0, 0), *NEIGHBOURS])
    own = F.when(F.col("ord") == 0, F.col("z"))
    cells = sent.groupBy("r", "c").agg(F.max(own).alias("z"), F.count(own).alias("n"), F.max("z").alias("focal")).filter("n > 0")
    return cells.agg(F.sum("n").alias("valid"), F.count(F.when(F.col("z") == F.col("focal"), 1)).alias("peaks"), F.min("z").alias("low"), (F.max("n") == 1).alias("consistent"))


def mosaic(*sources: DataFrame) -> DataFrame:
    """Cells of all sources; where several have one, the later source wins."""
    rows = None
    for k, s in enumerate(sources):
        s = s.select("r", "c", "z", F.lit(k).alias("rank"))
        rows = s if rows is None else rows.unionByName(s)
    return rows.groupBy("r", "c").agg(F.max_by("z", "rank").alias("z"))


def block_mean(dem: DataFrame, factor: int) -> DataFrame:
    """Aligned resampling to a coarser grid: r, c, total, n (mean = total / n)."""
    if factor == 1:
        return dem.select("r", "c", F.col("z").cast("long").alias("total"), F.lit(1).cast("long").alias("n"))
    cell = lambda x: F.floor(F.col(x) / factor).alias(x)
    return dem.groupBy(cell("r"), cell("c")).agg(F.sum("z").alias("total"), F.count("*").alias("n"))


def region_centroids(mask: DataFrame) -> DataFrame:
    """Centroid sums of the 4-connected regions of mask(pix, r, c, z): region, cells, sum_r, sum_c, z."""
    steps = scatter(mask, ["pix"], [(0, 1), (1, 0)]).select("r", "c", F.col("pix").alias("dst"))
    edges = steps.join(mask.select("r", "c", F.col("pix").alias("src")), ["r", "c"]).select("src", "dst")
    comp = components(edges, mask.select(F.col("pix").alias("id")))
    return mask.join(comp, F.col("pix") == F.col("id")).groupBy(F.col("comp").alias("region")).agg(F.count("*").alias("cells"), F.sum("r").alias("sum_r"), F.sum("c").alias("sum_c"), F.max("z").alias("z"))


def _kernel(d: Column, cubic: bool) -> Column:
    """Weight of a cell centre at distance d, in cells."""
    d = F.abs(d)
    if not cubic:
        return F.greatest(F.lit(0.0), 1 - d)
    return F.when(d < 1, (1.5 * d - 2.5) * d * d + 1).when(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2).otherwise(0.0)


def resample(dem: DataFrame, size: float, target: float, cubic: bool = False) -> DataFrame:
    """Resampling to cells of `target`: r, c, z by the 2 x 2 (cubic: 4 x 4) cell centres around each new one.

    Missing cells take no part; new cells have their centre in the grid's box. Cells of (almost) the target's size stay
    as they are.
    """
    if abs(size - target) <= 1e-6:
        return dem.select("r", "c", F.col("z").cast("double").alias("z"))
    ratio, reach = target / size, 2 if cubic else 1
    # the new centres less than `reach` source cells away
    first = lambda x: F.ceil((F.col(x) + 0.5 - reach) / ratio - 0.5)
    last = lambda x: F.floor((F.col(x) + 0.5 + reach) / ratio - 0.5)
    span = lambda x: F.explode(F.when(first(x) <= last(x), F.sequence(first(x), last(x))))
    sent = dem.withColumn("tr", span("r")).withColumn("tc", span("c"))
    weight = lambda t, x: _kernel((F.col(t) + 0.5) * ratio - 0.5 - F.col(x), cubic)
    edge = dem.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    new = lambda lo, hi, t: ((F.col(t) + 0.5) * ratio >= F.col(lo)) & ((F.col(t) + 0.5) * ratio <= F.col(hi) + 1)
    sent = sent.withColumn("w", weight("tr", "r") * weight("tc", "c")).filter("w != 0")
    got = sent.groupBy(F.col("tr").alias("r"), F.col("tc").alias("c")).agg(F.sum(F.col("w") * F.col("z")).alias("s"), F.sum("w").alias("w"))
    got = got.filter("w > 1e-9").select("r", "c", (F.col("s") / F.col("w")).alias("z"))
    return got.join(F.broadcast(edge)).filter(new("r0", "r1", "r") & new("c0", "c1", "c")).select("r", "c", "z")  # one row


def aligned(dem: DataFrame, size: int, target: int, shift: tuple[int, int] = (0, 0)) -> DataFrame:
    """r, c, z on the common grid of `target` cells, of a source of `size` cells whose corner lies `shift` away from the
    grid's (x, y, in the same whole units). Smaller cells are averaged by their centres, larger ones fill what they cover."""
    x0, y0 = shift
    low = lambda x, o: (F.col(x) * size + o).cast("long")
    if size <= target:
        cell = lambda x, o: F.floor((low(x, o) + size / 2) / target)
        return dem.groupBy(cell("r", y0).alias("r"), cell("c", x0).alias("c")).agg(F.avg("z").alias("z"))
    inside = lambda x, o: F.explode(F.sequence(F.ceil((low(x, o)) / target - 0.5), F.ceil((low(x, o) + size) / target - 0.5) - 1))
    return dem.select(inside("r", y0).alias("r"), "c", "z").select("r", inside("c", x0).alias("c"), F.col("z").cast("double").alias("z"))


def _drain(a: dict, rise: float) -> np.ndarray:
    """A tile's levels, lowered as far as those around them allow."""
    z, w = a["z"], a["w"].copy()
    steps = [(dr, dc, rise * (1.0 if dr == 0 or dc == 0 else 2**0.5)) for dr, dc in NEIGHBOURS]
    n, m = w.shape
    while True:
        inner, low = w[1:-1, 1:-1], np.full(z.shape, np.inf)
        for dr, dc, up in steps:
            low = np.fmin(low, w[1 + dr : n - 1 + dr, 1 + dc : m - 1 + dc] + up)
        new = np.minimum(inner, np.maximum(z, low))
        if np.array_equal(new, inner, equal_nan=True):
            return new
        w[1:-1, 1:-1] = new


def fill_sinks(dem: DataFrame, rise: float = 0.0, tile: int = 256) -> DataFrame:
    """pix, r, c, z, w: cells raised to the lowest level at which water reaches the edge, `rise` higher for each cell it
    passes (times the square root of two on diagonals); cells at the edge or beside a missing one keep their height.

    Each round settles the tiles beside a changed border, given the levels around them, until no border changes; rounds
    grow with the tiles that a flow path crosses. w has z's type if nothing rises, else it is a double. Heights are
    exact up to 2^53.
    """

    def start(tr, tc, a):
        own = a["z"][1:-1, 1:-1]
        open_ = np.isnan(np.stack([a["z"][1 + dr : tile + 1 + dr, 1 + dc : tile + 1 + dc] for dr, dc in NEIGHBOURS])).any(0)
        w = np.where(np.isnan(own), np.nan, np.where(open_, own, np.inf))
        return pa.table({"tr": [tr], "tc": [tc], "pix": [tiles.squeeze(a["pix"])], "z": [tiles.squeeze(own)], "w": [tiles.squeeze(w)]})

    own, kind = {"pix": "i8", "z": "f8"}, dem.schema["z"].dataType
    packed = materialize(tiles.pack(dem, own, tile), "grid")
    begun = materialize(tiles.with_margin(packed, {"pix": "i8"}, {"z": "f8"}, start, "tr long, tc long, pix binary, z binary, w binary", tile), "fill")
    done = tiles.settle(begun, own, "w", lambda a: _drain(a, rise), tile)
    out = tiles.cells(done, own | {"w": "f8"}, tile, "z")
    return out.select("pix", "r", "c", F.col("z").cast(kind).alias("z"), "w" if rise else F.col("w").cast(kind).alias("w"))


def accumulation(pointers: DataFrame) -> DataFrame:
    """id, cells: how many cells drain through each cell, itself included; pointers(id, parent) is a forest whose roots
    point to themselves; a column cells says how many each one brings (1 without it). Leaves are cut off round by round,
    sums go along."""
    cells = pointers.select("id", "parent", F.col("cells") if "cells" in pointers.columns else F.lit(1).cast("long").alias("cells"))
    out = None
    while True:
        busy = cells.filter("id != parent").select(F.col("parent").alias("id")).distinct()
        marked = materialize(cells.join(busy.withColumn("fed", F.lit(True)), "id", "left"), "flow")
        leaf, rest = marked.filter("fed is null").drop("fed"), marked.filter("fed").drop("fed")
        done = leaf.select("id", "cells")
        out = done if out is None else out.unionByName(done)
        if rest.isEmpty():
            return out
        sums = leaf.filter("id != parent").groupBy(F.col("parent").alias("id")).agg(F.sum("cells").alias("more"))
        cells = rest.join(sums, "id", "left").select("id", "parent", (F.col("cells") + F.coalesce("more", F.lit(0))).alias("cells"))


def earliest_neighbour(dem: DataFrame) -> DataFrame:
    """id, parent: each cell's first cell, in descending height and then pixel order, of its 3x3 window."""
    key = F.struct((-F.col("z")).alias("nz"), F.col("pix").alias("p"))
    sent = scatter(dem.withColumn("k", key), ["k"], [(0, 0), *NEIGHBOURS])
    got = sent.groupBy("r", "c").agg(F.min("k").alias("best"), F.min(F.when(F.col("ord") == 0, F.col("k.p"))).alias("id")).filter("id is not null")
    return got.select("id", F.col("best.p").alias("parent"))


def watershed(dem: DataFrame, least: int = 1) -> DataFrame:
    """id, root of cells whose ascent ends in a summit that drains at least `least` cells."""
    roots = materialize(pointer_jump(earliest_neighbour(dem)), "roots")
    big = roots.groupBy("root").count().filter(F.col("count") >= least).select("root")
    return roots.join(big, "root").select("id", "root")


def divide_pairs(basins: DataFrame) -> DataFrame:
    """u, v of basins(r, c, basin): v is the first of the eight neighbours, in order, that differs; unpaired cells go."""
    sent = scatter(basins, ["basin"]).withColumnRenamed("basin", "nb")
    met = sent.join(basins, ["r", "c"]).filter("nb != basin")
    return met.groupBy("r", "c").agg(F.first("basin").alias("u"), F.min_by("nb", "ord").alias("v")).select("r", "c", F.col("u").cast("string").alias("u_basin"), F.col("v").cast("string").alias("v_basin"))


def disc_heights(points: DataFrame, dem: DataFrame, radius: int, side: int = tiles.SIDE) -> DataFrame:
    """fid, low, high, pix, d2, own of the cells within `radius` cells of each of points(fid, pr, pc): least and greatest
    height, the first cell of the greatest and its squared distance, and the point's own height; none without a cell.

    Cells go to the tiles that can ask for them, places asked for to their own tile, once each; no pair of a point and a
    cell is ever a row. Unknown heights count as lowest, and not as `low`. Of repeated cells the highest counts (`low`: the lowest).
    """
    steps = [(dr, dc) for dr in range(-radius, radius + 1) for dc in range(-radius, radius + 1) if dr * dr + dc * dc <= radius * radius]
    wide = side + 2 * radius
    spread = lambda x: F.explode(F.sequence(F.floor((F.col(x) - radius) / side), F.floor((F.col(x) + radius) / side)))
    sent = dem.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "pix", "z", spread("r").alias("tr")).select("*", spread("c").alias("tc"))
    asked = points.select(F.col("pr").cast("long").alias("r"), F.col("pc").cast("long").alias("c")).dropna().distinct()
    asked = asked.select("r", "c", F.floor(F.col("r") / side).alias("tr"), F.floor(F.col("c") / side).alias("tc"))
    z_kind, pix_kind = (dem.schema[n].dataType.simpleString() for n in ("z", "pix"))

    def run(key, places: pa.Table, cells: pa.Table) -> pa.Table:
        top, left = key[0].as_py() * side - radius, key[1].as_py() * side - radius
        z, pix = cells["z"], cells["pix"].to_numpy()
        known = np.asarray(z.is_valid())
        order = np.lexsort((-pix, z.fill_null(0).to_numpy(), known))  # the greatest last, the first cell of equal ones
        at = ((cells["r"].to_numpy() - top) * wide + cells["c"].to_numpy() - left)[order]
        none = len(order)
        highest, lowest = np.full(wide * wide, -1), np.full(wide * wide, none)
        highest[at] = np.arange(none)
        sure = np.flatnonzero(known[order])[::-1]
        lowest[at[sure]] = sure
        here = (places["r"].to_numpy() - top) * wide + places["c"].to_numpy() - left
        best, least, d2 = np.full(len(here), -1), np.full(len(here), none), np.zeros(len(here), np.int64)
        for dr, dc in steps:
            there = highest[here + dr * wide + dc]
            d2[there > best] = dr * dr + dc * dc
            best = np.maximum(best, there)
            least = np.minimum(least, lowest[here + dr * wide + dc])
        own = highest[here]
        ok = np.flatnonzero(best >= 0)
        pick = lambda col, k: col.take(pa.array(np.r_[order, 0][k[ok]], mask=(k[ok] < 0) | (k[ok] == none)))
        found = {"low": pick(z, least), "high": pick(z, best), "pix": pick(cells["pix"], best), "d2": d2[ok].astype(np.int32), "own": pick(z, own)}
        return pa.table({"r": places["r"].take(ok), "c": places["c"].take(ok), **found})

    kinds = f"r long, c long, low {z_kind}, high {z_kind}, pix {pix_kind}, d2 int, own {z_kind}"
    found = asked.groupBy("tr", "tc").cogroup(sent.groupBy("tr", "tc")).applyInArrow(run, kinds)
    # both sides grow with the grid: their estimated sizes, of packed files, must not have one broadcast
    return points.join(found.hint("merge"), (F.col("pr") == F.col("r")) & (F.col("pc") == F.col("c"))).select("fid", "low", "high", "pix", "d2", "own")
