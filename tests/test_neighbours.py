"""Exact nearest neighbours on uneven data against brute force, and areas by growing searches."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cragline.operators import neighbours as N
from cragline.operators import spatial


def brute(a, b, k, reach):
    out = set()
    for fid, x, y in a:
        if x is None or y is None:
            continue
        near = sorted(((x - u) ** 2 + (y - v) ** 2, bid) for bid, u, v in b if u is not None and v is not None)
        out |= {(fid, bid, r + 1) for r, (d, bid) in enumerate([n for n in near if reach is None or n[0] <= reach**2][:k])}
    return out


def uneven(seed):
    """Most rows in one crowded spot, many of them at one place, the others far apart."""
    rng = random.Random(seed)
    spot = lambda: (round(rng.gauss(500, 2), 2), round(rng.gauss(500, 2), 2))
    wide = lambda: (round(rng.uniform(0, 100_000)), round(rng.uniform(0, 100_000)))
    b = [(i, *((500.0, 500.0) if i % 3 == 0 else spot() if i % 3 == 1 else tuple(map(float, wide())))) for i in range(1500)]
    a = [(i, *(spot() if i % 2 else tuple(map(float, wide())))) for i in range(400)] + [(900, 500.0, 500.0), (901, None, 1.0)]
    return a, [*b, (5000, 1.0, None)]


@pytest.mark.parametrize("k, reach", [(1, None), (5, None), (5, 300.0), (3, 0.5)])
def test_exact_on_uneven_data(spark, k, reach):
    a, b = uneven(k)
    da, db = spark.createDataFrame(a, "fid long, x double, y double"), spark.createDataFrame(b, "bid long, qx double, qy double")
    got = {tuple(r) for r in N.k_nearest(da, db, k, reach, sample=300, most=60).collect()}
    assert got == brute(a, b, k, reach)


def test_no_leaf_above_its_bound(spark):
    a, b = uneven(7)
    k = 5
    place = lambda rows, names: spark.createDataFrame([r for r in rows if None not in r], names)
    asked, goals = place(a, "id long, x double, y double"), place(b, "id long, x double, y double")
    tree = N.leaves(asked, goals, 10_000, 60)
    kept = [r for r in b if None not in r and (r[1:] != (500.0, 500.0) or r[0] in {3 * i for i in range(k)})]
    x, y = np.array([r[1] for r in kept]), np.array([r[2] for r in kept])
    assert max(Counter(tree.of(x, y).tolist()).values()) <= 60 and len(tree.start) > 20
    assert (tree.low[tree.of(x, y)] <= np.stack([x, y], 1) + 1e-3).all() and (tree.high[tree.of(x, y)] >= np.stack([x, y], 1) - 1e-3).all()


def test_odd_sides(spark):
    one = spark.createDataFrame([(1, 2.0, 3.0), (1, 2.0, 3.0)], "fid long, x double, y double")
    goal = spark.createDataFrame([(9, 2.0, 3.0), (8, 2.0, 3.0), (8, 2.0, 3.0)], "bid long, qx double, qy double")
    assert [tuple(r) for r in N.k_nearest(one, goal).collect()] == [(1, 8, 1)]
    assert N.k_nearest(one.limit(0), goal).count() == 0 and N.k_nearest(one, goal.limit(0)).count() == 0
    assert {tuple(r) for r in N.k_nearest(one, goal, 9).collect()} == {(1, 8, 1), (1, 9, 2)}


def test_closest_areas(spark):
    rng = random.Random(3)
    boxes = [(i, x := rng.uniform(0, 5000), x + rng.uniform(1, 40), y := rng.uniform(0, 5000), y + rng.uniform(1, 40)) for i in range(30)]
    points = [(i, rng.uniform(-9000, 9000), rng.uniform(-9000, 9000)) for i in range(60)]
    db = spark.createDataFrame(boxes, "land_id int, x0 double, x1 double, y0 double, y1 double")
    dp = spark.createDataFrame(points, "fid int, x double, y double")
    got = {r["fid"]: r["best"]["land_id"] for r in spatial.closest(dp, db, F.sqrt(spatial.rect_distance2()), 10.0, ["land_id"]).collect()}
    gap = lambda p, b: max(b[1] - p[1], 0, p[1] - b[2]) ** 2 + max(b[3] - p[2], 0, p[2] - b[4]) ** 2
    assert got == {p[0]: min((gap(p, b), b[0]) for b in boxes)[1] for p in points}
    assert spatial.closest(dp, db.limit(0), F.lit(0.0), 10.0, ["land_id"]).count() == 0


@pytest.mark.parametrize("radii", [None, [30.0, 200.0, 1e6], [5.0, 60.0]])
def test_nearest_higher(spark, radii):
    """Crowded and lonely peaks, ties and nulls; by distance, and by squares first."""
    rng = random.Random(8)
    at = lambda: (rng.gauss(0, 3), rng.gauss(0, 3)) if rng.random() < 0.7 else (rng.uniform(-900, 900), rng.uniform(-900, 900))
    rows = [(i, *map(round, at()), rng.randrange(60), *map(round, at())) for i in range(400)] + [(400, None, 1, 70, 0, 0), (401, 3, 4, 2, None, 0), (402, 3, 4, None, 1, 0)]
    df = spark.createDataFrame(rows, "fid long, x long, y long, z int, kx long, ky long")
    want = {}
    for fid, _, _, z, kx, ky in rows:
        found = []
        for bid, x, y, top, _, _ in rows:
            if None not in (x, y, z, top, kx, ky) and top > z:
                step = sum(max(abs(kx - x), abs(ky - y)) > r for r in radii or [])
                if not radii or step < len(radii):
                    found.append((step, (kx - x) ** 2 + (ky - y) ** 2, bid))
        want[fid] = min(found)[1:] if found else (None, None)
    assert {r["fid"]: (r["d2"], r["target"]) for r in spatial.nearest_higher(df, radii).collect()} == want
    assert spatial.nearest_higher(df.limit(0), radii).count() == 0


@pytest.mark.parametrize("kind", ["even", "grid", "clusters", "line", "far"])
def test_around_counts_and_names_the_nearest(spark, kind, monkeypatch):
    """Numbers within a radius, circles' edges and equal places among them, and the nearest, in parts too."""
    from cragline.operators import spatial

    rng = random.Random(kind)
    at = {
        "even": lambda: (rng.uniform(-40, 40), rng.uniform(-40, 40)),
        "grid": lambda: (rng.randrange(-12, 12), rng.randrange(-12, 12)),
        "clusters": lambda: (rng.choice([0, 5, 31]) + rng.gauss(0, 0.01), rng.choice([0, 4]) + rng.gauss(0, 0.01)),
        "line": lambda: (rng.randrange(60), 7),
        "far": lambda: (rng.randrange(1_000_000_000, 1_000_000_030), -rng.randrange(20)),
    }[kind]
    asks, goals = [(k, *at()) for k in range(150)], [(1000 - k, *at()) for k in range(260)]
    a = spark.createDataFrame([(k, float(x), float(y)) for k, x, y in asks] + [(999, None, 1.0)], "fid long, x double, y double")
    b = spark.createDataFrame([(k, float(x), float(y)) for k, x, y in goals] + [(5, 0.0, None)], "bid long, qx double, qy double")
    want = {}
    for k, x, y in asks:
        met = [((x - p) ** 2 + (y - q) ** 2, i) for i, p, q in goals if (x - p) ** 2 + (y - q) ** 2 <= 25]
        if met:
            want[k] = (len(met), *min(met))
    for most in (1 << 20, 40):
        monkeypatch.setattr(spatial, "MOST", most)
        assert {r["fid"]: (r["n"], r["d2"], r["bid"]) for r in spatial.around(a, b, 5).collect()} == want and len(want) > 20
    monkeypatch.setattr(spatial, "BLOCK", 7)
    assert {r["fid"]: (r["d2"], r["bid"]) for r in spatial.around(a, b, 5, False).collect()} == {k: v[1:] for k, v in want.items()}
    assert spatial.around(a, b.filter("false"), 5).count() == 0


def test_near_raw_makes_no_pairs(spark):
    """No side of the search is broadcast or copied to nine cells, and no pair is a row: it goes by numbers."""
    from cragline import registry

    df = registry.QUERIES["near_raw"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "d2" in plan and "Join Inner" not in plan


def joined(df):
    """The most rows that a join of df gave."""
    rows = df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "Join" in name:
            most = max(most, node.metrics().get("numOutputRows").get().value())
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            todo += [node.children().apply(k) for k in range(node.children().size())]
    return rows, most


@pytest.mark.parametrize("name", ["keycol_export", "disc_intersects_first"])
def test_one_crowded_place_makes_no_pairs(spark, tmp_path, name):
    """All rows of both layers at a few places: the results of SQL, and no join as large as their pairs."""
    import duckdb

    from cragline import registry

    whole = 20011 * 20021  # keys this far apart share a place
    keys = [whole * j + i for j in range(120) for i in range(2)]
    spark.createDataFrame([(k, float(k % 9000), f"c{k}") for k in keys], "c_custkey long, c_acctbal double, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, float(k % 900), f"p{k}") for k in keys], "p_partkey long, p_retailprice double, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("customer", "part"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    rows, most = joined(df)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.SQL[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in rows)
    assert 0 < most <= 4 * len(keys) or not most and name == "disc_intersects_first"
