"""Exact k nearest neighbours on uneven data, with or without a greatest distance.

A sample of both sides is cut into quadtree leaves of about equally many rows, so that dense places have small leaves.
Every query first looks in its own leaf; its k-th distance there (or a bound from the leaves' sampled rows, where the
leaf holds fewer than k) says which other leaves its circle touches, and it looks there too. The sample steers the
work only; all rows are compared as needed, and the result is exact.

No leaf is crowded by one place: of rows at the same place only the k of least id can be among anybody's k nearest, and
only they are kept. Leaves of many queries are dealt over several groups. The table of leaves has a few thousand rows
whatever the data's size.

Defined results: equal distances go to the smaller id; rows with a null coordinate meet nothing; repeated ids count as
one row for each place; an empty side gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SAMPLE = 50_000
MOST = 2_000
BITS = 24
BLOCK = 1 << 20


def morton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Interleaved bits of two whole numbers below 2^24."""
    out = np.zeros(len(x), np.int64)
    for b in range(BITS):
        out |= ((x >> b) & 1) << (2 * b) | ((y >> b) & 1) << (2 * b + 1)
    return out


class Leaves:
    """A quadtree over a square: leaf codes in order, their boxes, sampled places of targets, and groups of queries."""

    def __init__(self, box: tuple[float, float, float], goal: np.ndarray, asked: np.ndarray, goal_rows: float, asked_rows: float, most: int):
        self.x0, self.y0, self.side = box
        goals, asks = np.sort(self.code(*goal.T)), np.sort(self.code(*asked.T))
        # rows that a sampled one stands for
        weight, load = goal_rows / max(1, len(goal)), asked_rows / max(1, len(asked))
        starts, levels = [], []
        todo = [(0, BITS)]
        while todo:
            start, level = todo.pop()
            n = np.diff(np.searchsorted(goals, [start, start + (1 << 2 * level)]))[0]
            q = np.diff(np.searchsorted(asks, [start, start + (1 << 2 * level)]))[0]
            if level and (n > 1 or q > 1) and max(n * weight, q * load) > most:
                todo += [(start + (k << 2 * (level - 1)), level - 1) for k in (3, 2, 1, 0)]
            else:
                starts.append(start)
                levels.append(level)
        self.start, level = np.array(starts, np.int64), np.array(levels, np.int64)
        ends = self.start + (np.int64(1) << 2 * level)
        places = np.unique(goals)
        self.places = np.searchsorted(places, ends) - np.searchsorted(places, self.start)
        asks_in = (np.searchsorted(asks, ends) - np.searchsorted(asks, self.start)) * load
        self.parts = np.maximum(1, np.ceil(asks_in / most)).astype(np.int64)
        x, y = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for b in range(BITS):
            x |= ((self.start >> (2 * b)) & 1) << b
            y |= ((self.start >> (2 * b + 1)) & 1) << b
        unit = self.side / (1 << BITS)
        self.low = np.stack([self.x0 + x * unit, self.y0 + y * unit], 1)
        self.high = np.stack([self.x0 + (x + (np.int64(1) << level)) * unit, self.y0 + (y + (np.int64(1) << level)) * unit], 1)

    def code(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        to = lambda v, v0: np.clip((v - v0) / self.side * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        return morton(to(x, self.x0), to(y, self.y0))

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, self.code(x, y), "right") - 1

    def gap2(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Squared distance of each place to each leaf; a little less, for rounding at the borders."""
        p = np.stack([x, y], 1)[:, None, :]
        d = np.maximum(0, np.maximum(self.low[None] - p, p - self.high[None]) - self.side * 1e-9)
        return (d**2).sum(2)

    def bound2(self, x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        """A squared distance within which each place has k targets for certain, infinite if the sample can't tell."""
        p = np.stack([x, y], 1)[:, None, :]
        far = (np.maximum(np.abs(self.low[None] - p), np.abs(self.high[None] - p)) + self.side * 1e-9) ** 2
        far = far.sum(2)
        order = np.argsort(far, 1)
        enough = np.cumsum(self.places[order], 1) >= k
        first = enough.argmax(1)
        row = np.arange(len(x))
        return np.where(enough.any(1), far[row, order[row, first]], np.inf)


def leaves(a: DataFrame, b: DataFrame, sample: int = SAMPLE, most: int = MOST) -> Leaves | None:
    """The leaves for queries a(x, y) and targets b(x, y); none if a side is empty."""
    both = a.select(F.lit(0).alias("side"), "x", "y", "id").unionByName(b.select(F.lit(1).alias("side"), "x", "y", "id"))
    rows = {r["side"]: r for r in both.groupBy("side").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).collect()}  # two rows
    if len(rows) < 2:
        return None
    share = F.when(F.col("side") == 0, int(min(1.0, sample / rows[0]["n"]) * (1 << 30))).otherwise(int(min(1.0, sample / rows[1]["n"]) * (1 << 30)))
    t = both.filter(F.pmod(F.xxhash64("x", "y", "id"), F.lit(1 << 30)) < share).select("side", "x", "y").toArrow()  # about `sample` rows a side
    which, place = t["side"].to_numpy(), np.stack([t["x"].to_numpy(), t["y"].to_numpy()], 1)
    picks = [(place[which == k], rows[k]["n"]) for k in (0, 1)]
    low, high = ([f(rows[0][c + e], rows[1][c + e]) for c in "xy"] for f, e in ((min, "0"), (max, "1")))
    side = max(high[0] - low[0], high[1] - low[1]) * (1 + 1e-6) or 1.0
    return Leaves((low[0], low[1], side), picks[1][0], picks[0][0], picks[1][1], picks[0][1], most)


def _best(q: np.ndarray, goal: np.ndarray, ids: np.ndarray, k: int, most: np.ndarray):
    """(query, target, d2) of each query's k nearest targets within its squared bound; ids of the targets ascend."""
    out = []
    for a in range(0, len(q), step := max(1, BLOCK // max(1, len(goal)))):
        p = q[a : a + step]
        d = (p[:, None, 0] - goal[None, :, 0]) ** 2 + (p[:, None, 1] - goal[None, :, 1]) ** 2
        d = np.where(d <= most[a : a + step, None], d, np.inf)
        pick = np.argsort(d, 1, kind="stable")[:, :k]  # ties keep the order of ids
        near = np.take_along_axis(d, pick, 1)
        row, col = np.nonzero(np.isfinite(near))
        out.append((row + a, pick[row, col], near[row, col]))
    if not out:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def k_nearest(a: DataFrame, b: DataFrame, k: int = 1, reach: float | None = None, sample: int = SAMPLE, most: int = MOST) -> DataFrame:
    """fid, bid, rank (from 1) of the k nearest of b(bid, qx, qy) to each of a(fid, x, y), within reach if that is given."""
    spark = a.sparkSession
    place = lambda df, n, x, y: df.select(F.col(n).cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    asked, goals = place(a, "fid", "x", "y"), place(b, "bid", "qx", "qy")
    tree = leaves(asked, goals, sample, most)
    asked, goals = asked.distinct(), goals.distinct()
    if tree is None:
        return spark.createDataFrame([], "fid long, bid long, rank int")
    ship = spark.sparkContext.broadcast(tree)
    limit = np.inf if reach is None else float(reach) ** 2

    def own(batches):
        """Queries with their leaf and group."""
        for t in batches:
            x, y, i = (t.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "id"))
            leaf = ship.value.of(x, y)
            yield pa.RecordBatch.from_pydict({"leaf": leaf, "part": i % ship.value.parts[leaf], "id": i, "x": x, "y": y, "bound": np.full(len(x), limit)})

    def dealt(batches):
        """Targets, once for each group of their leaf."""
        for t in batches:
            x, y = (t.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            leaf = ship.value.of(x, y)
            n = ship.value.parts[leaf]
            row = np.repeat(np.arange(len(x)), n)
            part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_pydict({"leaf": leaf[row], "part": part, "id": t.column("id").to_numpy(zero_copy_only=False)[row], "x": x[row], "y": y[row]})

    def local(first: bool):
        kinds = pa.schema([("fid", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("bid", pa.int64()), ("d2", pa.float64())])

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return kinds.empty_table()
            q = np.stack([left["x"].to_numpy(), left["y"].to_numpy()], 1)
            ids = right["id"].to_numpy()
            o = np.argsort(ids, kind="stable")
            goal = np.stack([right["x"].to_numpy()[o], right["y"].to_numpy()[o]], 1)
            row, col, d = _best(q, goal, ids[o], k, left["bound"].to_numpy())
            # a query without any hit goes on too
            lone = np.setdiff1d(np.arange(len(q)), row) if first else np.zeros(0, np.int64)
            every = np.r_[row, lone]
            bid = pa.array(np.r_[ids[o][col], np.zeros(len(lone), np.int64)], pa.int64(), mask=np.arange(len(every)) >= len(row))
            dist = pa.array(np.r_[d, np.zeros(len(lone))], mask=np.arange(len(every)) >= len(row))
            return pa.table({"fid": left["id"].to_numpy()[every], "x": q[every, 0], "y": q[every, 1], "bid": bid, "d2": dist}, schema=kinds)

        return run

    def further(batches):
        """The other leaves that a query's circle touches."""
        tree = ship.value
        for t in batches:
            x, y, i = (t.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "fid"))
            bound = t.column("bound").to_numpy(zero_copy_only=False)
            for s in range(0, len(x), step := max(1, BLOCK // len(tree.start))):
                part = slice(s, s + step)
                most = bound[part].copy()
                short = np.isnan(most)
                most[short] = np.minimum(limit, tree.bound2(x[part][short], y[part][short], k))
                near = tree.gap2(x[part], y[part]) <= most[:, None]
                near[np.arange(len(near)), tree.of(x[part], y[part])] = False
                row, leaf = np.nonzero(near)
                at = row + s
                yield pa.RecordBatch.from_pydict({"leaf": leaf, "part": i[at] % tree.parts[leaf], "id": i[at], "x": x[at], "y": y[at], "bound": most[row]})

    group = "leaf long, part long, id long, x double, y double"
    here = Window.partitionBy("x", "y").orderBy("id")
    few = goals.withColumn("n", F.row_number().over(here)).filter(F.col("n") <= k).drop("n")
    sent = materialize(few.mapInArrow(dealt, group), "targets")
    found = "fid long, x double, y double, bid long, d2 double"
    join = lambda q, first: q.groupBy("leaf", "part").cogroup(sent.groupBy("leaf", "part")).applyInArrow(local(first), found)
    near = materialize(join(asked.mapInArrow(own, group + ", bound double"), True), "near")
    bounds = near.groupBy("fid", "x", "y").agg(F.when(F.count("bid") == k, F.max("d2")).otherwise(F.lit(float("nan"))).alias("bound"))
    far = join(bounds.mapInArrow(further, group + ", bound double"), False)
    both = near.filter("bid is not null").unionByName(far)
    rank = F.row_number().over(Window.partitionBy("fid", "x", "y").orderBy("d2", "bid"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k).select("fid", "bid", "rank")


def pairs(a: DataFrame, b: DataFrame, k: int = 1, reach: float | None = None) -> DataFrame:
    """The rows of a(fid, x, y, ...) with those of their k nearest of b(bid, qx, qy, ...), d2 and rank; ids are unique."""
    found = k_nearest(a, b, k, reach)
    met = a.join(found.withColumnRenamed("bid", "_bid"), "fid").join(b, F.col("bid") == F.col("_bid")).drop("_bid")
    d2 = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
    return met.withColumn("d2", d2)
