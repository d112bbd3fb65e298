"""Registered queries against brute force on small tables, where a part of the rows would not do."""

import heapq
import random

import pytest
from test_core import scan

from cragline import registry
from cragline.operators import raster

W, COLS, ROWS = 64, 12, 56
NEAR = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]


@pytest.fixture(scope="module")
def tall(spark, tmp_path_factory):
    """(folder, {pix: z}) of a grid of more than 48 rows."""
    rng = random.Random(11)
    z = [[rng.randrange(-5000, 5000) for _ in range(COLS)] for _ in range(ROWS)]
    folder = str(tmp_path_factory.mktemp("tall"))
    spark.createDataFrame([(r, [v / 10000 for v in row]) for r, row in enumerate(z)], "vec_id long, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    return folder, {r * W + c: v for r, row in enumerate(z) for c, v in enumerate(row)}


def around(z, p, steps=NEAR):
    r, c = divmod(p, W)
    return [q for dr, dc in steps if 0 <= c + dc < W and (q := (r + dr) * W + c + dc) in z]


def collect(spark, name, folder):
    return [r.asDict() for r in registry.QUERIES[name](spark, folder).collect()]


def test_prominence_of_the_whole_grid(spark, tall):
    folder, z = tall
    rows = [[z.get(r * W + c) for c in range(W)] for r in range(ROWS)]
    strict = {p for p in z if all(z[q] < z[p] for q in around(z, p))}
    want = {p: v for p, v in scan(rows).items() if p in strict}
    got = collect(spark, "prominence", folder)
    assert {r["pix"]: r["prom"] for r in got} == want and max(want) >= 48 * W
    where = scan(rows, pixels=True)
    assert {r["pix"]: r["keycol_pix"] for r in got} == {p: where.get(p) for p in want}
    want = {p: v for p, v in want.items() if v >= 1300 and 8 <= p % 64 < 56}
    assert {r["pix"]: r["prom"] for r in collect(spark, "prominence_filter", folder)} == want and max(want) >= 48 * W


def test_watersheds_of_the_whole_grid(spark, tall):
    folder, z = tall
    up = {p: min([p, *around(z, p)], key=lambda q: (-z[q], q)) for p in z}
    root = {}
    for p in z:
        q = p
        while up[q] != q:
            q = up[q]
        root[p] = q
    size = list(root.values())
    want = {p: q for p, q in root.items() if size.count(q) >= 5}
    assert {r["id"]: r["root"] for r in collect(spark, "watershed_labels", folder)} == want and max(want) >= 48 * W


def test_regions_of_the_whole_grid(spark, tall):
    folder, z = tall
    land, seen, want = {p: v for p, v in z.items() if v > 0}, set(), set()
    for p in sorted(land):
        if p in seen:
            continue
        part, todo = {p}, [p]
        while todo:
            for q in around(land, todo.pop(), [(0, 1), (0, -1), (1, 0), (-1, 0)]):
                if q not in part:
                    part.add(q)
                    todo.append(q)
        seen |= part
        want.add((p, len(part), sum(q // W for q in part), sum(q % W for q in part), max(land[q] for q in part)))
    got = {(r["region"], r["cells"], r["sum_r"], r["sum_c"], r["z"]) for r in collect(spark, "region_centroids", folder)}
    assert got == want and max(w[0] for w in want) >= 48 * W


def flood(z, rise=0.0):
    """Water levels by a priority flood from the edge."""
    heap = [(v, p) for p, v in z.items() if len(around(z, p)) < 8]
    w = {p: v for v, p in heap}
    heapq.heapify(heap)
    while heap:
        v, p = heapq.heappop(heap)
        if v > w[p]:
            continue
        for q in around(z, p):
            up = max(v + rise * (1 if q // W == p // W or q % W == p % W else 2**0.5), z[q])
            if up < w.get(q, 10**9):
                w[q] = up
                heapq.heappush(heap, (up, q))
    return w


def test_sinks_of_the_whole_grid(spark, tall):
    folder, z = tall
    assert {r["pix"]: r["w"] for r in collect(spark, "fill_sinks", folder)} == flood(z)
    assert {r["pix"]: r["w"] for r in collect(spark, "fill_sinks_slope", folder)} == flood(z, 0.5)


@pytest.mark.parametrize("tile", [3, 7])
def test_sinks_across_tiles(spark, tall, tile):
    # a channel that winds through many tiles, on top of a random grid
    _, z = tall
    z = {p: -9000 if p // W % 4 == 1 or (p // W % 4 == 3 and p % W == (1 if p // W % 8 == 3 else 10)) else v for p, v in z.items()}
    cells = spark.createDataFrame([(p, p // W, p % W, v) for p, v in z.items()], "pix long, r long, c long, z int")
    assert {r["pix"]: r["w"] for r in raster.fill_sinks(cells, 0.25, tile).collect()} == flood(z, 0.25)


def test_accumulation_of_the_whole_grid(spark, tall):
    folder, z = tall
    up = {p: min([p, *around(z, p)], key=lambda q: (-z[q], q)) for p in z}
    want = dict.fromkeys(z, 0)
    for p in z:
        want[p] += 1
        while up[p] != p:
            p = up[p]
            want[p] += 1
    assert {r["id"]: r["cells"] for r in collect(spark, "flow_accumulation", folder)} == want


def cubic(d):
    d = abs(d)
    return 1.5 * d**3 - 2.5 * d**2 + 1 if d < 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0.0


@pytest.mark.parametrize("name, reach, kernel", [("raster_bilinear", 1, lambda d: max(0.0, 1 - abs(d))), ("raster_cubic", 2, cubic)])
def test_resampling_of_the_whole_grid(spark, tall, name, reach, kernel):
    folder, z = tall
    want = {}
    for r in range(-1, ROWS):
        for c in range(-1, COLS):
            y, x = (r + 0.5) * 1.6 - 0.5, (c + 0.5) * 1.6 - 0.5
            part = [(kernel(y - i) * kernel(x - j), z[i * W + j]) for i in range(ROWS) for j in range(COLS) if abs(y - i) < reach and abs(x - j) < reach]
            if sum(a for a, _ in part) > 1e-9 and 0 <= (r + 0.5) * 1.6 <= ROWS and 0 <= (c + 0.5) * 1.6 <= COLS:
                want[r, c] = sum(a * v for a, v in part) / sum(a for a, _ in part)
    got = {(r["r"], r["c"]): r["z"] for r in collect(spark, name, folder)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_discs_around_all_cells(spark, tall):
    folder, z = tall
    disc = {p: [q for dr in range(-3, 4) for dc in range(-3, 4) if dr * dr + dc * dc <= 9 and 0 <= p % W + dc < W and (q := p + dr * W + dc) in z] for p in z}
    assert {r["fid"]: r["z"] for r in collect(spark, "disc_zonal_max", folder)} == {p: max(z[q] for q in d) for p, d in disc.items()}
    assert {r["fid"]: r["z"] for r in collect(spark, "disc_zonal_min", folder)} == {p: min(z[q] for q in d) for p, d in disc.items()}
    want = {}
    for p, d in disc.items():
        q = min(d, key=lambda q: (-z[q], q))
        want[p] = (z[q], q, (p // W - q // W) ** 2 + (p % W - q % W) ** 2, z[q] - z[p])
    assert {r["fid"]: (r["z"], r["pix"], r["d2"], r["dz"]) for r in collect(spark, "local_max_disc", folder)} == want


@pytest.mark.parametrize("name", ["disc_zonal_max", "disc_zonal_min", "local_max_disc"])
def test_discs_broadcast_no_grid(spark, tall, name):
    """The grid's packed file is far smaller than its cells; no side of a join may go through the driver for it."""
    df = registry.QUERIES[name](spark, tall[0])
    df.collect()
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_discs_over_tiles(spark):
    """Points on the grid and beside it, gaps, unknown heights and ties, on tiles smaller than the grid."""
    rng = random.Random(3)
    z = {(r, c): rng.choice([None, *range(4)]) for r in range(-3, 18) for c in range(13) if rng.random() < 0.6}
    dem = spark.createDataFrame([(r * 100 + c, r, c, v) for (r, c), v in z.items()], "pix long, r long, c long, z int")
    at = {k: (rng.randrange(-9, 24), rng.randrange(-6, 19)) for k in range(300)}
    points = spark.createDataFrame([(k, *p) for k, p in at.items()], "fid long, pr long, pc long")
    want = {}
    for k, (r, c) in at.items():
        d = [((-1 if v is None else v), -(i * 100 + j), (i - r) ** 2 + (j - c) ** 2, v) for (i, j), v in z.items() if (i - r) ** 2 + (j - c) ** 2 <= 4]
        if d:
            _, p, d2, v = max(d, key=lambda x: x[:2])
            want[k] = (min((x[3] for x in d if x[3] is not None), default=None), v, -p, d2, z.get((r, c)))
    for side in (4, 256):
        got = {r["fid"]: tuple(r)[1:] for r in raster.disc_heights(points, dem, 2, side).collect()}
        assert got == want and 0 < len(want) < 300


def test_box_of_all_peaks(spark):
    sf = "/root/testdata/sf0.001"
    peaks = [((k * 7919) % 20011, (k * 10007) % 20021) for (k,) in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()]
    refs = {k: ((k * 7907) % 20011, (k * 10009) % 20021) for (k,) in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()}
    (lx, *_, hx), (ly, *_, hy) = (sorted(v) for v in zip(*peaks, strict=True))
    want = {k for k, (x, y) in refs.items() if lx - 100 <= x <= hx + 100 and ly - 100 <= y <= hy + 100}
    assert {r["bid"] for r in collect(spark, "bbox_filter", sf)} == want
