"""Drainage, basins and polygons against plain versions on small grids, over many small tiles."""

import random
from collections import Counter, deque

import pytest
from test_core import scan
from test_whole import NEAR, flood

from cragline.operators import hydrology, polygons, raster, tiles
from cragline.operators.prominence import prominence

W = 64


def grid(spark, z):
    return spark.createDataFrame([(p, p // W, p % W, v, "x") for p, v in z.items()], "pix long, r long, c long, z int, w string")


def around(z, p):
    r, c = divmod(p, W)
    return [(k, (r + dr) * W + c + dc) for k, (dr, dc) in enumerate(NEAR) if 0 <= c + dc < W and (r + dr) * W + c + dc in z]


def land(kind):
    rng = random.Random(kind)
    z = {r * W + c: rng.randrange(40) for r in range(21) for c in range(19)}
    if kind == "flat":
        z = {p: 7 if 3 < p // W < 17 and 2 < p % W < 15 else v + 10 for p, v in z.items()}
    if kind == "gaps":
        z = {p: v for p, v in z.items() if rng.random() < 0.93}
    return z


def plain_ways(z):
    """Where each cell's water goes on the filled grid; itself at the edge."""
    w = flood(z)
    edge = {p for p in z if len(around(z, p)) < 8}

    def steps(start):
        seen, todo = dict(start), deque(start)
        while todo:
            p = todo.popleft()
            for _, q in around(z, p):
                if w[q] == w[p] and q not in seen:
                    seen[q] = seen[p] + 1
                    todo.append(q)
        return seen

    low = steps({p: 0 for p in z if p in edge or any(w[q] < w[p] for _, q in around(z, p))})
    high = steps({p: 1 for p in z if any(w[q] > w[p] for _, q in around(z, p))})
    mask = {p: 2 * low[p] - high.get(p, 0) for p in z}
    far = lambda k: 1.0 if 0 in NEAR[k] else 2**0.5
    way = {}
    for p in z:
        if p in edge:
            way[p] = p
            continue
        drop = [(-(w[p] - w[q]) / far(k), k, q) for k, q in around(z, p) if w[q] < w[p]]
        way[p] = min(drop)[2] if drop else min((mask[q], k, q) for k, q in around(z, p) if w[q] == w[p])[2]
    return way


def path(way, p):
    out = [p]
    while way[p] != p:
        p = way[p]
        assert len(out) <= len(way)
        out.append(p)
    return out


@pytest.mark.parametrize("kind, side", [("rough", 256), ("flat", 4), ("gaps", 7)])
def test_drainage_and_basins(spark, kind, side):
    z = land(kind)
    way = plain_ways(z)
    cells = Counter(q for p in z for q in path(way, p))
    assert all(len(around(z, path(way, p)[-1])) < 8 for p in z)
    got = {r["pix"]: r["cells"] for r in hydrology.drainage(grid(spark, z), side).collect()}
    assert got == dict(cells)
    least = 9
    stream = {p for p in z if cells[p] >= least}
    joint = {q for q, n in Counter(way[p] for p in stream if way[p] != p).items() if n > 1}
    cut = {p: p if p in stream and way[p] in joint and way[p] != p else way[p] for p in z}
    want = {p: path(cut, p)[-1] for p in z if path(cut, p)[-1] in stream}
    assert {r["pix"]: r["basin"] for r in hydrology.basins(grid(spark, z), least, side).collect()} == want


def plain_rings(region):
    """Rings of {(r, c): region} as sets of directed edges, by walking."""
    sides = [((-1, 0), (0, 0), (0, 1)), ((0, 1), (0, 1), (1, 0)), ((1, 0), (1, 1), (0, -1)), ((0, -1), (1, 0), (-1, 0))]
    todo = {(r, c, s) for (r, c), v in region.items() for s, (o, _, _) in enumerate(sides) if region.get((r + o[0], c + o[1])) != v}
    out = []
    while todo:
        r, c, s = start = min(todo)
        v, points = region[(r, c)], []
        while True:
            todo.discard((r, c, s))
            points.append((r + sides[s][1][0], c + sides[s][1][1]))
            o, _, way = sides[s]
            ahead, across = (r + way[0], c + way[1]), (r + way[0] + o[0], c + way[1] + o[1])
            if region.get(ahead) != v:
                s = (s + 1) % 4
            elif region.get(across) == v:
                r, c, s = *across, (s + 3) % 4
            else:
                r, c = ahead
            if (r, c, s) == start:
                break
        n = len(points)
        corners = [p for i, p in enumerate(points) if (points[i][0] - points[i - 1][0], points[i][1] - points[i - 1][1]) != (points[(i + 1) % n][0] - p[0], points[(i + 1) % n][1] - p[1])]
        out.append((v, sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(points, points[1:] + points[:1], strict=True)) // 2, n, frozenset(corners), len(corners)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("side, seed", [(3, 1), (256, 2)])
def test_rings_with_holes_and_diagonals(spark, side, seed):
    rng = random.Random(seed)
    value = {(r, c): rng.choice([1, 1, 1, 2]) for r in range(17) for c in range(15) if rng.random() < 0.9}
    # a ring within a ring, its inner part touching at corners
    value |= {(20 + r, c): 1 if min(r, c, 8 - r, 8 - c) % 2 == 0 else 2 for r in range(9) for c in range(9)} | {(24, 12): 5, (25, 13): 5}
    df = spark.createDataFrame([(r * W + c, r, c, v, None) for (r, c), v in value.items()] + [(40 * W, 40, 0, None, 1)], "pix long, r long, c long, v int, region int")
    cells, shapes = polygons.polygonize(df, "v", side)
    region = {(r["r"], r["c"]): r["region"] for r in cells.collect()}
    assert region.keys() == value.keys()
    sizes = Counter(region.values())
    got = []
    for s in shapes.collect():
        assert s["area"] == sizes[s["region"]] and s["v"] == value[divmod(s["region"], W)]
        for ring, sign in [(s["outer"], 1), *((h, -1) for h in s["holes"])]:
            points = [tuple(p) for p in ring]
            assert points[0] == points[-1] and len(set(points[:-1])) <= len(points) - 1
            area = sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(points, points[1:], strict=False)) // 2
            assert area * sign > 0
            length = sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for a, b in zip(points, points[1:], strict=False))
            got.append((s["region"], area, length, frozenset(points), len(points) - 1))
    assert sorted(got, key=repr) == plain_rings(region)
    assert any(len(s["holes"]) for s in shapes.collect())


def test_odd_grids(spark):
    empty = grid(spark, {5: 1}).limit(0)
    assert raster.fill_sinks(empty).count() == 0 and hydrology.drainage(empty, 4).count() == 0 and hydrology.basins(empty, 1, 4).count() == 0
    assert polygons.polygonize(empty.withColumn("v", empty["z"]), "v", 4)[1].count() == 0
    one = grid(spark, {5: 1}).union(grid(spark, {5: 3}))
    assert [tuple(r) for r in hydrology.drainage(one, 4).collect()] == [(5, 1)]
    assert [tuple(r) for r in tiles.cells(tiles.pack(one, {"z": "i8"}, 4), {"z": "i8"}, 4, "z").collect()] == [(0, 5, 3)]


@pytest.mark.parametrize("few", [200_000, 0])
def test_prominence_by_small_tiles(spark, few):
    """Trees of many small tiles, merged at once or in rounds, give what a descending scan gives; ties and gaps with them."""
    for kind, side in (("rough", 4), ("gaps", 5), ("flat", 3)):
        z = land(kind)
        rows = [[z.get(r * W + c) for c in range(W)] for r in range(21)]
        strict = {p for p in z if all(z[q] < z[p] for _, q in around(z, p))}
        want = {p: v for p, v in scan(rows).items() if p in strict and v > 0}
        where = scan(rows, pixels=True)
        got = prominence(grid(spark, z), few, side).collect()
        assert {r["pix"]: r["prom"] for r in got} == want
        assert {r["pix"]: r["keycol_pix"] for r in got} == {p: where.get(p) for p in want}
