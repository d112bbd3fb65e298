"""Clipping grids by buffered areas: areas become column spans of each row, cells meet the spans of their row.

A row's spans come from the area's edges: where its centre line crosses them the area begins and ends, and the part of it
within the buffer of an edge is one span (the edge's neighbourhood is convex). Overlapping spans are merged. The join
of cells and spans is on row and block of columns.

Defined results: an area is what an odd number of its rings holds, so holes are rings of their own; a cell belongs to it
if its centre lies in it or within `reach` of an edge; rings repeat their first point; an area without rings holds
nothing; an empty side gives an empty result; nulls in coordinates are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def _edges(areas: DataFrame) -> DataFrame:
    """px, py, qx, qy of areas(area, rings): rings are arrays of arrays of structs x, y."""
    ring = areas.select("area", F.explode("rings").alias("g"))
    edge = ring.select("area", F.explode(F.arrays_zip(F.slice("g", 1, F.greatest(F.size("g") - 1, F.lit(0))).alias("p"), F.slice("g", 2, F.greatest(F.size("g") - 1, F.lit(0))).alias("q"))).alias("e"))
    d = lambda a, b: F.col(f"e.{a}.{b}").cast("double").alias(a + b)
    return edge.select("area", d("p", "x"), d("p", "y"), d("q", "x"), d("q", "y")).dropna(subset=["px", "py", "qx", "qy"])


def _crossing(x1: Column, y1: Column, x2: Column, y2: Column, y: Column) -> Column:
    """x where a line meets height y, null where it doesn't."""
    return F.when((F.least(y1, y2) <= y) & (y <= F.greatest(y1, y2)) & (y1 != y2), x1 + (x2 - x1) * (y - y1) / (y2 - y1))


def _near(reach: float, y: Column) -> tuple[Column, Column]:
    """Least and greatest x within `reach` of an edge at height y, null where none is."""
    px, py, qx, qy = (F.col(c) for c in ("px", "py", "qx", "qy"))
    length = F.hypot(qx - px, qy - py)
    nx, ny = F.try_divide((py - qy) * reach, length), F.try_divide((qx - px) * reach, length)
    found = []
    for x0, y0 in ((px, py), (qx, qy)):
        half = F.when(F.abs(y - y0) <= reach, F.sqrt(F.greatest(F.lit(0.0), reach * reach - (y - y0) * (y - y0))))
        found += [x0 - half, x0 + half]
    corners = [(px + nx, py + ny), (qx + nx, qy + ny), (qx - nx, qy - ny), (px - nx, py - ny)]
    found += [_crossing(*a, *b, y) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]
    return F.least(*found), F.greatest(*found)


def spans(areas: DataFrame, x0: float, y0: float, dx: float, dy: float, reach: float = 0.0) -> DataFrame:
    """area, r, c0, c1: the columns, both ends included, of each row whose cell centres belong to areas(area, rings).

    Cell (0, 0) begins at (x0, y0); rows go along y, by dy, which may be below 0."""
    edges = _edges(areas)
    row = lambda y: (y - y0) / dy - 0.5
    low, high = F.least(row(F.col("py") - reach), row(F.col("qy") - reach), row(F.col("py") + reach), row(F.col("qy") + reach)), F.greatest(row(F.col("py") - reach), row(F.col("qy") - reach), row(F.col("py") + reach), row(F.col("qy") + reach))
    lines = edges.withColumn("_lo", F.ceil(low)).withColumn("_hi", F.floor(high)).filter("_lo <= _hi").withColumn("r", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    y = y0 + (F.col("r") + 0.5) * dy
    lines = lines.withColumn("y", y)
    # the area itself: every second gap between crossings, half-open in y so that a corner counts once
    hit = (F.col("py") > F.col("y")) != (F.col("qy") > F.col("y"))
    cross = lines.filter(hit).select("area", "r", (F.col("px") + (F.col("qx") - F.col("px")) * (F.col("y") - F.col("py")) / (F.col("qy") - F.col("py"))).alias("x"))
    along = Window.partitionBy("area", "r").orderBy("x")
    inside = cross.withColumn("k", F.row_number().over(along)).withColumn("to", F.lead("x").over(along)).filter("k % 2 = 1").select("area", "r", F.col("x").alias("a"), F.col("to").alias("b"))
    found = inside
    if reach > 0:
        a, b = _near(reach, F.col("y"))
        found = found.unionByName(lines.select("area", "r", a.alias("a"), b.alias("b")).filter("a is not null"))
    col = lambda x: (F.col(x) - x0) / dx - 0.5
    # a cell centre on the left end belongs to the area, one on the right end to a buffer only
    last = F.floor(col("b")) if reach > 0 else F.ceil(col("b")) - 1
    whole = found.select("area", "r", F.ceil(col("a")).alias("c0"), last.alias("c1")).filter("c0 <= c1")
    return merged(whole.groupBy("area", "r", "c0").agg(F.max("c1").alias("c1")))


def merged(found: DataFrame) -> DataFrame:
    """Spans (area, r, c0, c1) with those that touch or overlap put together."""
    before = Window.partitionBy("area", "r").orderBy("c0").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("area", "r").orderBy("c0")
    new = found.withColumn("far", F.max("c1").over(before)).withColumn("new", F.when(F.col("c0") <= F.col("far") + 1, 0).otherwise(1))
    return new.withColumn("run", F.sum("new").over(upto)).groupBy("area", "r", "run").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("run")


def clip(cells: DataFrame, found: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of cells(r, c, ...) in any of the spans, once each."""
    every = merged(found.select(F.lit(0).alias("area"), "r", "c0", "c1"))
    of = lambda c: F.floor(F.col(c) / block)
    sent = every.select(F.col("r").alias("_r"), "c0", "c1", F.explode(F.sequence(of("c0"), of("c1"))).alias("_b"))
    return cells.join(sent, (F.col("r") == F.col("_r")) & (of("c") == F.col("_b")) & F.col("c").between(F.col("c0"), F.col("c1")), "left_semi")
