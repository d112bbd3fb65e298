import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cragline import registry
from cragline.functions import rules, text
from cragline.functions.projection import utm33
from cragline.operators import raster, spatial
from cragline.operators.graph import components, pointer_jump
from cragline.operators.prominence import prominence

SF = "/root/testdata/sf0.001"


def grid(spark, rows):
    w = max(map(len, rows))
    cells = [(r * w + c, r, c, z) for r, row in enumerate(rows) for c, z in enumerate(row) if z is not None]
    return spark.createDataFrame(cells, "pix long, r long, c long, z int")


def scan(rows, pixels=False):
    """A plain descending scan: {pix: prominence} of positive prominence, or the key cols' pixels."""
    w = max(map(len, rows))
    z = {r * w + c: v for r, row in enumerate(rows) for c, v in enumerate(row) if v is not None}
    parent, top, col, at = {}, {}, {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p in sorted(z, key=lambda q: (-z[q], q)):
        parent[p], top[p] = p, p
        r, c = divmod(p, w)
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                q = (r + dr) * w + c + dc
                if (dr or dc) and 0 <= c + dc < w and q in parent and q != p:
                    a, b = find(p), find(q)
                    if a != b:
                        if (-z[top[a]], top[a]) > (-z[top[b]], top[b]):
                            a, b = b, a
                        col.setdefault(top[b], z[p])
                        at.setdefault(top[b], p)
                        if z[top[a]] == z[top[b]]:
                            col.setdefault(top[a], z[p])
                            at.setdefault(top[a], p)
                        parent[b] = a
    if pixels:
        return at
    low = min(z.values())
    tops = {top[find(p)] for p in z} | set(col)
    return {p: z[p] - col.get(p, low) for p in tops if z[p] - col.get(p, low) > 0}


@pytest.mark.parametrize("rows, want", [([[5, 3, 9, 4, 7]], {0: 2, 2: 6, 4: 3}), ([[9, 4, 9]], {0: 5, 2: 5}), ([[1, 9, 9, 1]], {}), ([[9, None, 7]], {0: 2})])
def test_prominence_fixtures(spark, rows, want):
    assert {r["pix"]: r["prom"] for r in prominence(grid(spark, rows)).collect()} == want


@pytest.mark.parametrize("few", [0, 10**6])
def test_prominence_random(spark, few):
    rng = random.Random(few)
    rows = [[rng.choice([None, *range(1, 9)]) for _ in range(9)] for _ in range(8)]
    got = {r["pix"]: r["prom"] for r in prominence(grid(spark, rows), few).collect()}
    flat = [p for p, v in scan(rows).items()]
    strict = {r["r"] * 9 + r["c"] for r in raster.strict_maxima(grid(spark, rows)).collect()}
    assert got == {p: v for p, v in scan(rows).items() if p in strict} and flat


@pytest.mark.parametrize("parts", [1, 2, 13])
def test_components_equal_brute_force(spark, parts):
    rng = random.Random(parts)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(50)] + [(300, 300 + i) for i in range(60)]
    rng.shuffle(edges)
    comp = {i: i for e in edges for i in e}
    for _ in comp:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    df = spark.createDataFrame(edges, "src long, dst long").repartition(parts)
    assert {r["id"]: r["comp"] for r in components(df).collect()} == comp
    assert components(df.filter("false"), spark.range(3)).orderBy("id").collect() == [(0, 0), (1, 1), (2, 2)]


@pytest.mark.parametrize("parts", [None, 1, 7])
def test_pointer_chains(spark, parts):
    rng = random.Random(3)
    up = {i: i + 1 for i in range(100)} | {100: 100, 500: 500} | {i: rng.choice([500, *range(501, i)]) for i in range(501, 600)}
    got = {r["id"]: r["root"] for r in pointer_jump(spark.createDataFrame([*up.items()], "id long, parent long"), parts).collect()}
    assert got == {i: 100 if i <= 100 else 500 for i in up}
    assert pointer_jump(spark.createDataFrame([], "id long, parent long"), parts).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    got = components(edges, spark.range(43)).groupBy("comp").count().collect()
    assert {r["comp"]: r["count"] for r in got} == {0: 41, 41: 1, 42: 1}


@pytest.mark.parametrize("d, want", [(None, None), (15, "EXACT_POS"), (15.1, "VERY_NEAR_POS"), (50, "VERY_NEAR_POS"), (100, "NEAR_POS"), (250, "RIDGE_OFFSET"), (250.5, "REMOTE_OFFSET")])
def test_position_bounds(spark, d, want):
    assert spark.createDataFrame([(None if d is None else float(d),)], "d double").select(rules.position_class(F.col("d"))).first()[0] == want


def test_names(spark):
    rows = spark.createDataFrame([("Großglockner",), ("GROSSGLOCKNER ",), (" großglockner",)], "s string")
    assert {r[0] for r in rows.select(text.norm_name(F.col("s"))).collect()} == {"grossglockner"}
    rows = spark.createDataFrame([("KÃ¤rnten", "Kärnten"), ("GroÃŸ", "GroÃŸ"), ("plain â", "plain â")], "s string, w string")
    assert rows.filter(text.mojibake(F.col("s")) != F.col("w")).count() == 0


def test_projection(spark):
    x, y = utm33(F.lit(15.0), F.lit(47.0))
    e, n = spark.range(1).select(x, y).first()
    assert abs(e - 500000) < 1e-6 and abs(n - 5205000) < 2000


def test_ring(spark):
    ring = F.from_json(F.lit('[{"x":0,"y":0},{"x":4,"y":0},{"x":4,"y":4},{"x":0,"y":4},{"x":0,"y":0}]'), "array<struct<x:double,y:double>>")
    row = spark.range(1).select(spatial.ring_contains(ring, F.lit(1.0), F.lit(1.0)), spatial.ring_contains(ring, F.lit(5.0), F.lit(1.0)), spatial.segment_distance(ring, F.lit(1.0), F.lit(2.0))).first()
    assert tuple(row) == (True, False, 1.0)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "part", "nation", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(registry.SQL[name])
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    norm = lambda rows: sorted(repr([float(v) if isinstance(v, float) else v for v in r]) for r in rows)
    assert norm(tuple(r) for r in got.select(*cols).collect()) == norm(want)
