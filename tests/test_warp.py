"""Projections, warped grids and clipping against independent plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cragline.functions import projection as P
from cragline.operators import cutline
from cragline.operators.warp import Frame, aligned, between, kernel, warp


def arc(lat, steps=200_000):
    """Length of the meridian from the equator, by summation."""
    e2 = P.FLAT * (2 - P.FLAT)
    phi = (np.arange(steps) + 0.5) / steps * math.radians(lat)
    return float(np.sum(P.A * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5) * math.radians(lat) / steps)


@pytest.mark.parametrize("lat", [0.5, 30.0, 46.25, 49.0, 70.0])
def test_meridian(lat):
    x, y = P.forward(np.array([15.0]), np.array([lat]), 15.0, P.ARRAYS)
    assert abs(x[0] - 500000) < 1e-6 and abs(y[0] - 0.9996 * arc(lat)) < 1e-3


def test_known_place():
    # a tower in zone 17 whose position is known to the metre
    x, y = P.forward(np.array([-(79 + 23 / 60 + 13.7 / 3600)]), np.array([43 + 38 / 60 + 33.24 / 3600]), -81.0, P.ARRAYS)
    assert abs(x[0] - 630084) < 1 and abs(y[0] - 4833439) < 1.5


def test_there_and_back(spark):
    lon, lat = np.meshgrid(np.linspace(9, 21, 25), np.linspace(44, 50, 25))
    x, y = P.forward(lon, lat, 15.0, P.ARRAYS)
    back = P.inverse(x, y, 15.0, P.ARRAYS)
    assert np.abs(back[0] - lon).max() < 1e-9 and np.abs(back[1] - lat).max() < 1e-9  # a tenth of a millimetre
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lon.ravel(), lat.ravel(), strict=True)] + [(None, 1.0)], "lon double, lat double")
    e, n = P.utm33(F.col("lon"), F.col("lat"))
    got = rows.withColumns({"e": e, "n": n}).withColumns(dict(zip(("lo", "la"), P.lonlat33(F.col("e"), F.col("n")), strict=False))).collect()
    assert all(abs(r["e"] - a) < 1e-3 and abs(r["n"] - b) < 1e-3 and abs(r["lo"] - r["lon"]) < 1e-9 and abs(r["la"] - r["lat"]) < 1e-9 for r, a, b in zip(got, x.ravel(), y.ravel(), strict=False))
    assert got[-1]["e"] is None


def plain_warp(z, source, target, cubic, wide):
    reach, rows = (2 if cubic else 1), {}
    corners = [between(source, target, np.array([float(r)]), np.array([float(c)])) for r in (-2, 40) for c in (-2, 40)]
    lo_r, hi_r = int(min(c[0][0] for c in corners)) - 9, int(max(c[0][0] for c in corners)) + 9
    lo_c, hi_c = int(min(c[1][0] for c in corners)) - 9, int(max(c[1][0] for c in corners)) + 9
    for r in range(lo_r, hi_r):
        for c in range(lo_c, hi_c):
            fr, fc = (float(v[0]) for v in between(target, source, np.array([r + 0.5]), np.array([c + 0.5])))
            if (math.floor(fr), math.floor(fc)) not in z:
                continue
            s = w = 0.0
            for i in range(math.floor(fr - reach * wide[0]) - 1, math.ceil(fr + reach * wide[0]) + 1):
                for j in range(math.floor(fc - reach * wide[1]) - 1, math.ceil(fc + reach * wide[1]) + 1):
                    if (i, j) in z:
                        k = float(kernel(np.array([(i + 0.5 - fr) / wide[0]]), cubic)[0] * kernel(np.array([(j + 0.5 - fc) / wide[1]]), cubic)[0])
                        s, w = s + k * z[(i, j)], w + k
            if w > 1e-6:
                rows[(r, c)] = s / w
    return rows


@pytest.mark.parametrize("source, target, cubic, wide", [
    (Frame(13.0, 47.5, 0.0006, 0.0004), Frame(349000.0, 5263000.0, 40.0, 40.0, 15.0), True, (1.0, 1.0)),
    (Frame(500000.0, 5200000.0, 10.0, 10.0, 15.0), Frame(499980.0, 5200020.0, 30.0, 30.0, 15.0), True, (3.0, 3.0)),
    (Frame(500000.0, 5200000.0, 30.0, 30.0, 15.0), Frame(499980.0, 5200020.0, 20.0, 20.0, 15.0), False, (1.0, 1.0)),
])
@pytest.mark.parametrize("side", [7, 256])
def test_warp_against_plain(spark, source, target, cubic, wide, side):
    rng = random.Random(4)
    z = {(r, c): float(rng.randrange(100)) for r in range(23) for c in range(18) if rng.random() < 0.95}
    df = spark.createDataFrame([(r, c, v, "x") for (r, c), v in z.items()] + [(50, 3, None, "")], "r int, c int, z double, s string")
    got = {(r["r"], r["c"]): r["z"] for r in warp(df, source, target, cubic, side).collect()}
    want = plain_warp(z, source, target, cubic, wide)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_warp_odd(spark):
    f = Frame(0.0, 0.0, 10.0, 10.0, 15.0)
    assert warp(spark.createDataFrame([], "r int, c int, z double"), f, f).count() == 0
    same = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (0, 1, 5.0)], "r int, c int, z double")
    assert {tuple(r) for r in warp(same, f, f).collect()} == {(0, 0, 2.0), (0, 1, 5.0)}
    assert aligned(123.0, 457.0, 10.0, None) == Frame(120.0, 460.0, 10.0, 10.0)


def held(x, y, rings, reach):
    odd, near = False, False
    for ring in rings:
        for (px, py), (qx, qy) in zip(ring, ring[1:], strict=False):
            if (py > y) != (qy > y) and x < px + (qx - px) * (y - py) / (qy - py):
                odd = not odd
            d = (qx - px) ** 2 + (qy - py) ** 2
            t = max(0.0, min(1.0, ((x - px) * (qx - px) + (y - py) * (qy - py)) / d)) if d else 0.0
            near |= reach > 0 and math.hypot(x - px - t * (qx - px), y - py - t * (qy - py)) <= reach
    return odd or near


@pytest.mark.parametrize("reach", [0.0, 2.7])
@pytest.mark.parametrize("dy", [1.0, -1.3])
def test_spans_and_clip(spark, reach, dy):
    rng = random.Random(6)
    star = [(15 + math.cos(a) * rng.uniform(6, 14), 15 * (1 if dy > 0 else -1) + math.sin(a) * rng.uniform(6, 14)) for a in [k * 0.35 for k in range(18)]]
    hole = [(13.1, star[0][1] - 2), (17.3, star[0][1] - 2), (15.2, star[0][1] + 3.3), (13.1, star[0][1] - 2)]
    shapes = {1: [[*star, star[0]], hole], 2: [[(30.2, 0.0), (33.4, 0.0), (33.4, 9.0 * dy), (30.2, 9.0 * dy), (30.2, 0.0)]], 3: [], 4: [[(5.0, 5.0)]]}
    point = "struct<x: double, y: double>"
    areas = spark.createDataFrame([(a, [[{"x": x, "y": y} for x, y in g] for g in rings]) for a, rings in shapes.items()], f"area int, rings array<array<{point}>>")
    found = cutline.spans(areas, -3.0, -2.0, 0.9, dy, reach)
    got = {(s["area"], s["r"], c) for s in found.collect() for c in range(s["c0"], s["c1"] + 1)}
    want = {(a, r, c) for a, rings in shapes.items() for r in range(-60, 60) for c in range(-20, 60) if held(-3.0 + (c + 0.5) * 0.9, -2.0 + (r + 0.5) * dy, rings, reach)}
    assert got == want
    cells = spark.createDataFrame([(r, c, "k") for r in range(-40, 40) for c in range(-10, 50)], "r int, c int, area string")
    kept = [(r["r"], r["c"]) for r in cutline.clip(cells, found, 8).collect()]
    assert sorted(kept) == sorted({(r, c) for _, r, c in want if -40 <= r < 40 and -10 <= c < 50})
    assert cutline.clip(cells.limit(0), found).count() == 0 and cutline.clip(cells, found.limit(0)).count() == 0


def test_mosaic_keeps_to_its_extent(spark, tmp_path):
    """Far south the grid in degrees leaves the target's columns."""
    import duckdb

    from cragline import registry

    rng = random.Random(5)
    rows = [(r, [rng.randrange(-5000, 5000) / 10000 for _ in range(64)]) for r in [*range(3), *range(1100, 1125)]]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = set(con.execute(registry.SQL["warped_mosaic"]).fetchall())
    assert {tuple(r) for r in registry.QUERIES["warped_mosaic"](spark, str(tmp_path)).select("r", "c", "z").collect()} == want
    assert min(c for r, c, _ in want) == -20
    whole = warp(spark.createDataFrame([(1110, c, 1.0) for c in range(64)], "r long, c long, z double"), Frame(13.0, 47.5, 0.0006, 0.0004), Frame(349000.0, 5263000.0, 40.0, 40.0, 15.0))
    assert whole.agg(F.min("c")).first()[0] < -20  # the operator itself has no such border
