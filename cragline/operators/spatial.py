"""Bounded neighbour search and point/polygon predicates as equi-joins on grid cells.

Defined results: rows with a null coordinate meet nothing; equal distances go to the smaller id; an empty side gives an
empty result; a ring's last point repeats its first; names that start with _c or _o belong to the joins.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def near(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """All pairs of a(fid, x, y) and b(bid, qx, qy, ...) within radius, with d2. b is sent to the 3x3 cells around its own."""
    cell = lambda x: F.floor(F.col(x) / radius)
    ring = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = a.withColumn("_cx", cell("x")).withColumn("_cy", cell("y"))
    right = b.withColumn("_o", ring).withColumn("_cx", cell("qx") + F.col("_o.i")).withColumn("_cy", cell("qy") + F.col("_o.j")).drop("_o")
    d2 = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
    return left.join(right, ["_cx", "_cy"]).drop("_cx", "_cy").withColumn("d2", d2).filter(F.col("d2") <= radius * radius)


#: Rows of one group of around(), of either side; candidates compared at once.
MOST = 1 << 20
BLOCK = 1 << 19


class _Strips:
    """Targets in horizontal strips, each sorted by x; a strip holds some `fill` of them within the radius' width, if they lie evenly."""

    def __init__(self, x: np.ndarray, y: np.ndarray, id_: np.ndarray, n: np.ndarray, radius: float):
        wide, high = (max(float(np.ptp(v)), 1e-9) for v in (x, y))
        # the higher a strip, the more is compared; the lower, the more strips a search looks at
        self.step = float(np.clip(8 * wide * high / (max(len(x), 1) * radius), radius / 32, radius))
        self.low = float(y.min())
        row = self.row(y)
        o = np.lexsort((id_, x, row))
        self.x, self.y, self.id, row = x[o], y[o], id_[o], row[o]
        self.sums = np.r_[0, np.cumsum(n[o])]
        self.n = n[o]
        self.rows = int(row[-1]) + 1
        # one sorted key for all strips: searches in a strip are searches in it
        self.left, self.width = float(x.min()), wide * 1.5 + 1
        self.key = row * self.width + (self.x - self.left)
        self.slack = (self.key[-1] + self.width) * 1e-12

    def row(self, y: np.ndarray) -> np.ndarray:
        return np.floor((y - self.low) / self.step).astype(np.int64)

    def span(self, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, more: bool) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the targets of each strip whose x lies in [lo, hi]; with `more` none of them is left out, else no other is in."""
        slack = self.slack if more else -self.slack
        a, b = (np.clip(v - self.left, -0.1, self.width - 0.5) for v in (lo, hi))
        first = np.searchsorted(self.key, row * self.width + a - slack, "left")
        last = np.searchsorted(self.key, row * self.width + b + slack, "right")
        out = (row < 0) | (row >= self.rows)
        first[out] = last[out] = 0
        return first, np.maximum(first, last)


def _expand(first: np.ndarray, last: np.ndarray):
    """(which span, position) of all positions of the spans, in parts of about BLOCK."""
    size = last - first
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
        n = size[at:to]
        which = np.repeat(np.arange(at, to), n)
        yield which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:to], n)
        at = to


def _around(qx: np.ndarray, qy: np.ndarray, s: _Strips, radius: float, count: bool):
    """(number of targets within radius, squared distance and id of the nearest, infinite without one) of each query."""
    limit = radius * radius
    n, best, name = np.zeros(len(qx), np.int64), np.full(len(qx), np.inf), np.full(len(qx), np.iinfo(np.int64).max)

    def closer(q, at):
        """Settle the nearest by these pairs of query and target; returns the squared distances."""
        d = (s.x[at] - qx[q]) ** 2 + (s.y[at] - qy[q]) ** 2
        ok = np.flatnonzero(d <= np.minimum(limit, best[q]))
        o = ok[np.lexsort((s.id[at[ok]], d[ok], q[ok]))]
        o = o[np.r_[True, q[o][1:] != q[o][:-1]]] if len(o) else o
        k, e, i = q[o], d[o], s.id[at[o]]
        new = (e < best[k]) | ((e == best[k]) & (i < name[k]))
        best[k[new]], name[k[new]] = e[new], i[new]
        return d

    # a first bound: the targets beside the query in its own strip and the strips around it
    own = s.row(qy)
    for k in (-1, 0, 1):
        mid = s.span(own + k, qx, qx, True)[0]
        for at in (mid - 1, mid):
            ok = np.flatnonzero((at >= 0) & (at < len(s.x)))
            closer(ok, at[ok])
    most = int(np.ceil(radius / s.step)) + 1
    for k in sorted(range(-most, most + 1), key=abs):
        row, bound = own + k, np.sqrt(np.minimum(best, limit)) * (1 + 1e-9)
        floor_, top = s.low + row * s.step, s.low + (row + 1) * s.step
        gap = np.maximum(0, np.maximum(floor_ - qy, qy - top) - s.step * 1e-9)
        far = np.maximum(np.abs(floor_ - qy), np.abs(top - qy)) + s.step * 1e-9
        # all that can be nearest
        q = np.flatnonzero(gap <= bound)
        half = np.sqrt(np.maximum(0, bound[q] ** 2 - gap[q] ** 2)) + radius * 1e-9
        first, last = s.span(row[q], qx[q] - half, qx[q] + half, True)
        for which, at in _expand(first, last):
            closer(q[which], at)
        if not count:
            continue
        # what is within for certain is counted by sums, the rest of the strip that can be within by comparison
        q = np.flatnonzero(gap <= radius)
        half = np.sqrt(np.maximum(0, limit - gap[q] ** 2)) + radius * 1e-9
        first, last = s.span(row[q], qx[q] - half, qx[q] + half, True)
        half = np.sqrt(np.maximum(0, limit - far[q] ** 2)) - radius * 1e-9
        a, b = s.span(row[q], qx[q] - half, qx[q] + half, False)
        none = (half <= 0) | (b <= a)
        a, b = np.where(none, last, np.clip(a, first, last)), np.where(none, last, np.clip(b, first, last))
        n[q] += s.sums[b] - s.sums[a]
        for start, end in ((first, a), (b, last)):
            for which, at in _expand(start, end):
                if len(which):
                    i, low = q[which], which[0]
                    ok = (s.x[at] - qx[i]) ** 2 + (s.y[at] - qy[i]) ** 2 <= limit
                    more = np.bincount(which[ok] - low, s.n[at[ok]]).astype(np.int64)
                    n[q[low : low + len(more)]] += more
    return n, best, name


def around(a: DataFrame, b: DataFrame, radius: float, count: bool = True) -> DataFrame:
    """fid, n, d2, bid of each of a(fid, x, y) that has some of b(bid, qx, qy) within radius: how many (none counted without
    `count`), and the nearest's squared distance and id; equal ids are one row of a.

    No pair becomes a row. Places of b, with their numbers, go to the cells of four radii that can ask for them; a task
    counts by sums along sorted strips and compares only what lies on the circle's edge. Cells of more than MOST rows are
    dealt in parts, whose answers are put together."""
    place = lambda df, i, x, y: df.select(F.col(i).cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    cell, side = (lambda x, d=0.0: F.floor((F.col(x) + d) / side)), 4.0 * radius
    reach = radius * (1 + 1e-9)
    spread = lambda x: F.explode(F.sequence(cell(x, -reach), cell(x, reach)))
    asks = place(a, "fid", "x", "y").withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    goals = place(b, "bid", "qx", "qy").groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    goals = goals.withColumn("cx", spread("x")).withColumn("cy", spread("y"))
    # at most a row for each MOST rows
    heavy = lambda df, name: F.broadcast(df.groupBy("cx", "cy").count().filter(F.col("count") > MOST).select("cx", "cy", F.ceil(F.col("count") / MOST).alias(name)))
    parts = lambda df: df.join(heavy(asks, "ap"), ["cx", "cy"], "left").join(heavy(goals, "gp"), ["cx", "cy"], "left").fillna(1, ["ap", "gp"])
    deal = lambda n: F.pmod(F.xxhash64("id", "x", "y"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    key = ["cx", "cy", "i", "j"]
    asks = parts(asks).withColumn("i", deal("ap")).withColumn("j", every("gp")).select(*key, "id", "x", "y")
    goals = parts(goals).withColumn("j", deal("gp")).withColumn("i", every("ap")).select(*key, "id", "x", "y", "n")
    kinds = pa.schema([("fid", pa.int64()), ("n", pa.int64()), ("d2", pa.float64()), ("bid", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        qx, qy, fid = (left[c].to_numpy() for c in ("x", "y", "id"))
        n, best, name = _around(qx, qy, _Strips(*(right[c].to_numpy() for c in ("x", "y", "id", "n")), radius), radius, count)
        ok = np.isfinite(best)
        return pa.table({"fid": fid[ok], "n": n[ok], "d2": best[ok], "bid": name[ok]}, schema=kinds)

    found = asks.groupBy(*key).cogroup(goals.groupBy(*key)).applyInArrow(run, "fid long, n long, d2 double, bid long")
    return found.groupBy("fid").agg(F.sum("n").alias("n"), F.min(F.struct("d2", "bid")).alias("b")).select("fid", "n", "b.d2", "b.bid")


def nearest(pairs: DataFrame, by: list[str], k: int = 1, order: list | None = None) -> DataFrame:
    """The k first pairs of each key, by distance and then id."""
    w = Window.partitionBy(*by).orderBy(*(order or []), "d2", "bid")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def inside(x: str = "x", y: str = "y") -> Column:
    """Half-open containment in the rectangle x0, y0, x1, y1."""
    return (F.col(x) >= F.col("x0")) & (F.col(x) < F.col("x1")) & (F.col(y) >= F.col("y0")) & (F.col(y) < F.col("y1"))


def rect_distance2(x: str = "x", y: str = "y") -> Column:
    """Squared distance to the rectangle (0 inside)."""
    dx = F.greatest(F.col("x0") - F.col(x), F.lit(0), F.col(x) - F.col("x1"))
    dy = F.greatest(F.col("y0") - F.col(y), F.lit(0), F.col(y) - F.col("y1"))
    return dx * dx + dy * dy


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point in a closed ring (array of structs x, y)."""
    edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("p"), F.slice(ring, 2, F.size(ring) - 1).alias("q"))
    hit = lambda e: ((e.p.y > y) != (e.q.y > y)) & (x < (e.q.x - e.p.x) * (y - e.p.y) / F.nullif(e.q.y - e.p.y, F.lit(0.0)) + e.p.x)
    return F.size(F.filter(edges, hit)) % 2 == 1


def segment_distance(line: Column, x: Column, y: Column) -> Column:
    """Distance of a point to a polyline (array of structs x, y)."""
    edges = F.arrays_zip(F.slice(line, 1, F.size(line) - 1).alias("p"), F.slice(line, 2, F.size(line) - 1).alias("q"))

    def one(e):
        vx, vy = e.q.x - e.p.x, e.q.y - e.p.y
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - e.p.x) * vx + (y - e.p.y) * vy, vx * vx + vy * vy), F.lit(0.0))))
        return F.hypot(x - (e.p.x + t * vx), y - (e.p.y + t * vy))

    return F.array_min(F.transform(edges, one))


def densify(line: Column, step: float) -> Column:
    """Points along a polyline, at most `step` apart, its vertices among them."""
    edges = F.arrays_zip(F.slice(line, 1, F.size(line) - 1).alias("p"), F.slice(line, 2, F.size(line) - 1).alias("q"))

    def one(e):
        n = F.greatest(F.lit(1), F.ceil(F.hypot(e.q.x - e.p.x, e.q.y - e.p.y) / step).cast("int"))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((e.p.x + (e.q.x - e.p.x) * i / n).alias("x"), (e.p.y + (e.q.y - e.p.y) * i / n).alias("y")))

    return F.concat(F.flatten(F.transform(edges, one)), F.slice(line, -1, 1))


def polygon_centroid(ring: Column) -> Column:
    """Struct x, y: the centre of area of a closed ring; of a ring without area the mean of its points; null if empty."""
    edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("p"), F.slice(ring, 2, F.size(ring) - 1).alias("q"))
    cross = lambda e: e.p.x * e.q.y - e.q.x * e.p.y
    total = lambda f: F.aggregate(F.transform(edges, f), F.lit(0.0), lambda a, x: a + x)
    area = total(cross)
    mean = lambda c: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[c]) / F.size(ring)
    one = lambda c: F.when(area != 0, total(lambda e: (e.p[c] + e.q[c]) * cross(e)) / F.nullif(3 * area, F.lit(0.0))).otherwise(mean(c))
    return F.when(F.size(ring) > 1, F.struct(one("x").alias("x"), one("y").alias("y")))


def same_place(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """1 if both points are there and equal."""
    return F.when((x1 == x2) & (y1 == y2), 1).otherwise(0)


def polygon_distance(ring: Column, x: Column, y: Column) -> Column:
    """Distance of a point to a polygon, 0 inside."""
    return F.when(ring_contains(ring, x, y), 0.0).otherwise(segment_distance(ring, x, y))


def near_areas(points: DataFrame, areas: DataFrame, reach: float, cell: float) -> DataFrame:
    """Pairs of points(x, y, ...) and areas(ring, ...) whose distance is at most `reach`, with dist (0 inside).

    An area is sent to the grid cells that its box, widened by `reach`, touches; points meet it there.
    """
    edge = lambda f, c, d: F.floor((f(F.transform("ring", lambda p: p[c])) + d) / cell)
    cells = lambda c: F.explode(F.sequence(edge(F.array_min, c, -reach), edge(F.array_max, c, reach)))
    sent = areas.withColumn("_cx", cells("x")).withColumn("_cy", cells("y"))
    here = points.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    dist = polygon_distance(F.col("ring"), F.col("x").cast("double"), F.col("y").cast("double"))
    return here.join(sent, ["_cx", "_cy"]).drop("_cx", "_cy").withColumn("dist", dist).filter(F.col("dist") <= reach)


def meet(points: DataFrame, boxes: DataFrame, cell: float, reach: float = 0.0, x: str = "x", y: str = "y") -> DataFrame:
    """Pairs of points(x, y, ...) and boxes(x0, y0, x1, y1, ...) that share a grid cell that the box, widened by `reach`,
    touches; each pair once. What is asked of the pairs is filtered afterwards."""
    cells = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - reach) / cell), F.floor((F.col(b) + reach) / cell)))
    sent = boxes.withColumn("_cx", cells("x0", "x1")).withColumn("_cy", cells("y0", "y1"))
    here = points.withColumn("_cx", F.floor(F.col(x) / cell)).withColumn("_cy", F.floor(F.col(y) / cell))
    return here.join(sent, ["_cx", "_cy"]).drop("_cx", "_cy")


def closest(points: DataFrame, boxes: DataFrame, distance: Column, reach: float, order: list[str], other: Column | None = None) -> DataFrame:
    """fid, best: the least (distance, *order) of each of points(fid, x, y, ...) over all boxes that `other` lets pass.

    distance is at least that to the box. Points search within `reach`, those without a hit four times as far, until all
    have one or the search covers everything."""
    ends = [*points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first(), *boxes.agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).first()]
    if any(e is None for e in ends):
        return points.select("fid", F.lit(None).alias("best")).filter("false")
    span = sum(max(float(ends[k + 1]), float(ends[k + 5])) - min(float(ends[k]), float(ends[k + 4])) for k in (0, 2))
    open_, found = points, None
    while True:
        met = meet(open_, boxes, reach, reach)
        met = met.filter(other) if other is not None else met
        best = met.withColumn("_d", distance).filter(F.col("_d") <= reach).groupBy("fid").agg(F.min(F.struct(F.col("_d").alias("distance"), *order)).alias("best"))
        best = materialize(best, "closest")
        found = best if found is None else found.unionByName(best)
        if reach > span:
            return found
        open_ = materialize(open_.join(best.select("fid"), "fid", "left_anti"), "open")
        if open_.isEmpty():
            return found
        reach *= 4


def locate(points: DataFrame, areas: DataFrame, cell: float, tolerance: float = 1.0) -> DataFrame:
    """fid, land_id: the area that holds each point, else the nearest one within `tolerance`; the smaller id on a tie."""
    met = near_areas(points, areas, tolerance, cell)
    return met.groupBy("fid").agg(F.min(F.struct("dist", "land_id")).alias("b")).select("fid", F.col("b.land_id").alias("land_id"))


#: Cells of a level of the pyramid that go to every task; there are at most so many by construction.
SMALL = 4096
FAN = 4


def nearest_higher(peaks: DataFrame, radii: list[float] | None = None) -> DataFrame:
    """fid, target, d2 of every peak(fid, x, y, z, kx, ky): the nearest higher one around its key col, or nulls.

    With radii, hits in a smaller square around the key col come before nearer ones outside it, and those outside the last
    square don't count.

    The peaks lie in a pyramid of cells that know their greatest height and the box of their rows. Searches go down
    together, level by level, only into cells that hold something higher and that can hold a better hit than some other
    cell is sure to. Coarse levels are a few thousand cells at most and go to every task; fine ones are joined by cell.
    """
    radii = sorted(radii or [])
    goal = peaks.filter("x is not null and y is not null and z is not null").select(F.col("fid").alias("bid"), F.col("z").alias("bz"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    ends = goal.agg(F.count("*").alias("n"), F.min("qx"), F.max("qx"), F.min("qy"), F.max("qy")).first()
    if not ends["n"]:
        return peaks.select("fid", F.lit(None).cast("long").alias("target"), F.lit(None).cast("double").alias("d2"))
    left, right, low, high = (float(e) for e in ends[1:])
    depth = max(1, math.ceil(math.log(max(1.0, ends["n"] / 64), FAN * FAN)))  # some 64 rows a cell, if they lie evenly
    side = max(right - left, high - low, 1e-9) * (1 + 1e-9) / FAN**depth
    cell = lambda c, start: F.floor((F.col(c) - start) / side)
    goal = goal.withColumn("_cx", cell("qx", left)).withColumn("_cy", cell("qy", low))
    level = materialize(goal.groupBy("_cx", "_cy").agg(F.max("bz").alias("top"), F.min("qx").alias("x0"), F.max("qx").alias("x1"), F.min("qy").alias("y0"), F.max("qy").alias("y1")), "pyramid")
    levels = [level]
    for _ in range(depth):
        up = [F.floor(F.col(c) / FAN).alias(c) for c in ("_cx", "_cy")]
        level = level.groupBy(*up).agg(F.max("top").alias("top"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
        levels.append(level)
    step = lambda far: sum((F.when(far > r, 1).otherwise(0) for r in radii), F.lit(0))
    key = lambda dx, dy: F.struct(step(F.greatest(dx, dy)).alias("step"), (dx * dx + dy * dy).alias("d2"))
    least = lambda c, a, b: F.greatest(F.col(a) - F.col(c), F.lit(0), F.col(c) - F.col(b))
    most = lambda c, a, b: F.greatest(F.abs(F.col(c) - F.col(a)), F.abs(F.col(c) - F.col(b)))
    open_ = peaks.select("fid", "z", F.col("kx").alias("x"), F.col("ky").alias("y")).filter("x is not null and y is not null and z is not null")
    open_ = open_.withColumn("_cx", F.lit(0).cast("long")).withColumn("_cy", F.lit(0).cast("long"))
    for k in range(depth, -1, -1):
        few = (FAN * FAN) ** (depth - k) <= SMALL
        met = open_.join(F.broadcast(levels[k]) if few else levels[k], ["_cx", "_cy"]).filter(F.col("top") > F.col("z"))
        met = met.withColumn("_sure", key(most("x", "x0", "x1"), most("y", "y0", "y1"))).withColumn("_may", key(least("x", "x0", "x1"), least("y", "y0", "y1")))
        met = met.withColumn("_bound", F.min("_sure").over(Window.partitionBy("fid"))).filter(F.col("_may") <= F.col("_bound"))
        open_ = met.select("fid", "z", "x", "y", "_cx", "_cy")
        if k:
            child = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(FAN) for j in range(FAN)]))
            open_ = open_.withColumn("_o", child).withColumn("_cx", F.col("_cx") * FAN + F.col("_o.i")).withColumn("_cy", F.col("_cy") * FAN + F.col("_o.j")).drop("_o")
        if not few:
            open_ = materialize(open_, "search")
    dx, dy = F.abs(F.col("x") - F.col("qx")), F.abs(F.col("y") - F.col("qy"))
    hits = open_.join(goal, ["_cx", "_cy"]).filter(F.col("bz") > F.col("z")).withColumn("_k", key(dx, dy))
    hits = hits.filter(F.col("_k.step") < len(radii)) if radii else hits
    best = hits.groupBy("fid").agg(F.min(F.struct("_k.step", "_k.d2", "bid")).alias("b")).select("fid", F.col("b.bid").alias("target"), F.col("b.d2").alias("d2"))
    return peaks.select("fid").join(best, "fid", "left")
