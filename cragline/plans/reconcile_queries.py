"""Sources, polygon joins, name evidence, groups, key-col export and the staged run, each with hand-written SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import raster as O
from ..operators import spatial as S
from ..operators.neighbours import pairs
from ..session import materialize, shared_dir
from ..sources import delimited, grids, layers, sinks, tiff
from .raster_queries import _FOCAL, _ORDER, whole
from .raster_queries import NB as _NB
from .spatial_queries import _MATCH, _REPAIR, _dist, _first, _top, match
from .stages import Stage, result, run_stages
from .views import dem, pick, table, view, with_sql

QUERIES: dict = {}
SQL: dict = {}
_C = F.col


def add(name: str, sql: str | None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return wrap


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/cragline-{uuid.uuid4().hex}/{name}"


# ---- sources and sinks

_LAT = pick("p_partkey", "47.5", " 46.25 ", "x", "48", None, "47.125", "47", "")
_ALT = pick("p_partkey * 3", "2500", "", "1899.5", None)
_ROWS = f"""SELECT p_partkey AS k, {pick('p_partkey', 'OE', 'DL')} AS association, {pick('p_partkey * 5 + 1', '31/12/2099', '31/12/2099', '30/06/2015')} AS valid_to, CASE WHEN p_partkey % 3 = 0 THEN '  OE/ST-' || p_partkey || ' ' ELSE 'OE/ST-' || p_partkey END AS code, CASE p_partkey % 5 WHEN 0 THEN 'Ho "' || p_name || '", Nord' WHEN 1 THEN p_name || chr(10) || '"zwei", drei' WHEN 2 THEN ' ' || p_name || '  ' WHEN 3 THEN NULL ELSE p_name END AS name, {_ALT} AS alt, {_LAT} AS lat, '13.5' AS lon FROM part"""


@add("csv_reference", f"SELECT trim(code) AS code, trim(coalesce(name, '')) AS name, TRY_CAST(alt AS DOUBLE) AS alt, CAST(trim(lat) AS DOUBLE) AS lat, 13.5::DOUBLE AS lon, CASE WHEN association = 'OE' THEN 0 ELSE 1 END AS is_foreign FROM ({_ROWS}) WHERE valid_to = '31/12/2099' AND TRY_CAST(trim(lat) AS DOUBLE) IS NOT NULL")
def _(spark, sf):
    """The table is written with a byte-order mark, loose headers, quotes, commas and line breaks, then read by aliases and filtered."""
    rows = spark.sql(_ROWS.replace("FROM part", "FROM {part}"), part=table(spark, sf, "part"))
    names = {"association": "﻿AssociationName ", "valid_to": " valid_to", "code": "Code", "name": "summit_name", "alt": "Elev_M", "lat": " Latitude", "lon": "lng"}
    path = _folder(spark, "reference")
    rows.select(*[_C(c).alias(h) for c, h in names.items()]).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(path)
    return delimited.reference_rows(delimited.read_table(spark, path), T.strip(_C("association")) == "OE", True)


@add("layer_points", with_sql("peaks") + "SELECT fid, CAST(z AS INTEGER) AS f_code, name, CAST(x AS DOUBLE) AS x, CASE WHEN fid % 11 = 0 THEN NULL ELSE CAST(y AS DOUBLE) END AS y FROM peaks WHERE fid % 11 <> 0 UNION ALL SELECT fid, CAST(z AS INTEGER), name, NULL, NULL FROM peaks WHERE fid % 11 = 0")
def _(spark, sf):
    """Peaks through GeoPackage files that many tasks write, read back as the layer that has the fields."""
    path = _folder(spark, "places")
    rows = view(spark, sf, "peaks").select("fid", _C("z").alias("F_CODE"), _C("name").alias("Name"), "x", F.when(_C("fid") % 11 != 0, _C("y")).alias("y"))
    layers.write_points(rows.repartition(8, "fid"), path, "places", file_rows=1000)
    got = layers.read_layer(spark, path + "/*.gpkg", "fid long, f_code int, name string", ["missing"], [{"F_CODE"}, {"NAME", "Name"}])
    return got.select("fid", "f_code", "name", "x", "y")


@add("wkb_points", with_sql("peaks") + "SELECT fid, CASE WHEN fid % 17 <> 0 THEN CAST(x AS DOUBLE) END AS x, CASE WHEN fid % 17 <> 0 THEN CAST(y AS DOUBLE) END AS y FROM peaks")
def _(spark, sf):
    """Blobs of either byte order and every kind of envelope; some are no points."""

    @F.udf("binary")  # makes the test blobs only; reading them back goes by Arrow batches
    def blob(fid, x, y):
        made = layers.point_blob(float(x), float(y), fid % 5, fid % 2 == 0)
        return made if fid % 17 else [None, b"", b"GP", made[:-3]][fid // 17 % 4]

    return layers.points(view(spark, sf, "peaks").select("fid", blob("fid", "x", "y").alias("geom")))


@add("keyed_update", with_sql("peaks", "refdb", more=_MATCH) + "SELECT p.fid, CASE WHEN h.bid IS NULL THEN p.name ELSE h.ref_name END AS name, h.code AS target_ref FROM peaks p LEFT JOIN hit h ON p.fid = h.fid")
def _(spark, sf):
    changes = match(spark, sf).select("fid", _C("ref_name").alias("name"), _C("code").alias("target_ref"))
    return layers.update(view(spark, sf, "peaks").select("fid", "name"), changes, "fid")


@add("sinks", with_sql("peaks") + "SELECT 'points' AS layer, count(*) AS n, CAST(sum(x) AS BIGINT) AS s FROM peaks WHERE prom >= 150 UNION ALL SELECT 'lines', count(*), CAST(sum(abs(x - kx) + abs(y - ky)) AS BIGINT) FROM peaks WHERE x <> kx OR y <> ky")
def _(spark, sf):
    """A point and a line layer written in one pass over their source; their counters are taken in the same job."""
    end = lambda x, y: F.struct(_C(x).alias("x"), _C(y).alias("y"))
    layers_ = {"points": (_C("prom") >= 150, F.struct("fid", "x", "y", "z", "prom", "name")), "lines": ((_C("x") != _C("kx")) | (_C("y") != _C("ky")), F.struct("fid", F.array(end("x", "y"), end("kx", "ky")).alias("line")))}
    length = F.abs(_C("lines.line")[0].x - _C("lines.line")[1].x) + F.abs(_C("lines.line")[0].y - _C("lines.line")[1].y)
    seen = sinks.write_layers(view(spark, sf, "peaks"), layers_, _folder(spark, "layers"), {"sum_points": F.sum("points.x"), "sum_lines": F.sum(length)})
    return spark.createDataFrame([(n, seen[n], seen[f"sum_{n}"]) for n in layers_], "layer string, n long, s long")


@add("raster_window", with_sql("dem") + "SELECT r, c, z FROM dem WHERE r >= 90 AND r < 300 AND c >= 17 AND c < 40 AND z % 97 <> 0")
def _(spark, sf):
    path = _folder(spark, "tiles")
    grids.write_tiles(dem(spark, sf).filter("z % 97 <> 0"), path, 32)
    return grids.read_window(spark, path, 90, 300, 17, 40, 32)


_XY = "500000 + (c + 0.5) * 10.0::DOUBLE AS x, 5200000 - (r + 0.5) * 10.0::DOUBLE AS y"
_ORIGIN, _SIZE = (500000.0, 5200000.0), (10.0, 10.0)


def _raster_files(spark, sf, window=None):
    path = _folder(spark, "grid")
    tiff.write_grid(dem(spark, sf).filter("z % 97 <> 0"), path, _ORIGIN, _SIZE, side=64, block=4, epsg=32633)
    return tiff.read_grid(spark, path, _ORIGIN, window).select("r", "c", "z", "x", "y")


@add("raster_file", with_sql("dem") + f"SELECT r, c, CAST(z AS DOUBLE) AS z, {_XY} FROM dem WHERE z % 97 <> 0")
def _(spark, sf):
    """The grid through tiled, LZW-packed BigTIFF files, written and read by many tasks."""
    return _raster_files(spark, sf)


@add("raster_file_window", with_sql("dem") + f"SELECT r, c, CAST(z AS DOUBLE) AS z, {_XY} FROM dem WHERE z % 97 <> 0 AND 500000 + (c + 0.5) * 10.0 BETWEEN 500100 AND 500300 AND 5200000 - (r + 0.5) * 10.0 >= 5198000")
def _(spark, sf):
    """A window by coordinates: headers choose the files and tiles that are read."""
    return _raster_files(spark, sf, {"x": (500100, 500300), "y": (5198000, 5200000)})


_GEOM = "CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN [k] WHEN k % 5 = 2 THEN [k, k + 2] ELSE [k, k + 2, k + 7] END"


@add("geometry_normalise", with_sql("cases") + f", g AS (SELECT k, k % 5 AS kind, {_GEOM} AS xs FROM cases) SELECT k, CASE WHEN kind = 0 THEN CASE WHEN k % 10 = 0 THEN NULL ELSE -1.0 END WHEN kind < 3 THEN CAST(xs[1] AS DOUBLE) ELSE list_avg(xs) END AS x FROM g")
def _(spark, sf):
    """A point, the first of several points, the centroid of other shapes, else the row's official point."""
    k = _C("k")
    xs = F.when(k % 5 == 0, None).when(k % 5 == 1, F.array(k)).when(k % 5 == 2, F.array(k, k + 2)).otherwise(F.array(k, k + 2, k + 7))
    g = view(spark, sf, "cases").select("k", xs.alias("xs"), F.when(k % 5 < 3, "POINT").otherwise("LINE").alias("kind"), F.when(k % 10 != 0, -1.0).alias("official"))
    mean = F.aggregate("xs", F.lit(0.0), lambda a, x: a + x) / F.size("xs")
    return g.select("k", F.coalesce(F.when(_C("kind") == "POINT", F.get("xs", F.lit(0)).cast("double")), F.when(F.size("xs") > 0, mean), _C("official")).alias("x"))


@add("field_lengths", "SELECT p_partkey AS k, left(p_name, 8) AS short, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(trunc(p_retailprice) AS INT) END AS whole, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_retailprice END AS num FROM part")
def _(spark, sf):
    """Values fitted to the declared fields of a layer: clipped text, truncated whole numbers, finite doubles."""
    price = _C("p_retailprice")
    raw = table(spark, sf, "part").select(_C("p_partkey").alias("k"), _C("p_name").alias("short"), F.when(_C("k") % 4 == 0, "nan").otherwise(price.cast("string")).alias("whole"), F.when(_C("k") % 6 == 0, float("inf")).otherwise(price).alias("num"))
    kept = layers.ensure_columns(raw, "k long, short string, whole string, num double, spare int", ["k"]).drop("spare")
    return kept.select("k", T.clip(_C("short"), 8).alias("short"), T.whole_number(_C("whole")).alias("whole"), T.clean_number(_C("num")).alias("num"))


# ---- raster


@add("raster_bilinear", None)
def _(spark, sf):
    """The grid of 10 m cells at 16 m."""
    return O.resample(dem(spark, sf), 10.0, 16.0)


@add("raster_cubic", None)
def _(spark, sf):
    return O.resample(dem(spark, sf), 10.0, 16.0, cubic=True)


@add("raster_mosaic_aligned", with_sql("dem") + "SELECT r, c, CAST(coalesce(f, g) AS DOUBLE) AS z FROM (SELECT r * 3 + i AS r, c * 3 + j AS c, z AS g FROM dem, (SELECT unnest(range(3)) AS i), (SELECT unnest(range(3)) AS j)) FULL JOIN (SELECT r // 5 + 40 AS r, c // 5 + 60 AS c, avg(z) AS f FROM dem WHERE z % 97 <> 0 GROUP BY 1, 2) USING (r, c)")
def _(spark, sf):
    """A coarse source of 30 m and over it a fine one of 2 m, which starts 600 m to the right and 400 m below, on one grid of 10 m."""
    g = dem(spark, sf)
    fine = O.aligned(g.filter("z % 97 <> 0"), 2, 10, (600, 400))
    return O.mosaic(O.aligned(g, 30, 10), fine)


@add("polygon_centroid", with_sql("lands") + "SELECT land_id, round(x0 + (4000.0::DOUBLE * 4000 * 2000 - 1500.0 * 1000 * 750) / 14500000, 3) AS x, round(y0 + (4000.0::DOUBLE * 4000 * 2000 - 1500.0 * 1000 * 3500) / 14500000, 3) AS y FROM lands")
def _(spark, sf):
    return _areas(spark, sf).select("land_id", S.polygon_centroid(_C("ring")).alias("m")).select("land_id", F.round("m.x", 3).alias("x"), F.round("m.y", 3).alias("y"))


@add("same_place", with_sql("cases") + "SELECT k, CASE WHEN d = far AND dz = kd THEN 1 ELSE 0 END AS same FROM cases")
def _(spark, sf):
    return view(spark, sf, "cases").select("k", S.same_place(_C("d"), _C("dz"), _C("far"), _C("kd")).alias("same"))


@add("fill_sinks_slope", whole(_NB, "fill(pix, w) USING KEY (pix) AS (SELECT pix, CAST(any_value(z) AS DOUBLE) FROM nb GROUP BY pix HAVING count(*) < 8 UNION SELECT nb.q, min(greatest(nb.zq, f.w + CASE WHEN dr = 0 OR dc = 0 THEN 0.5::DOUBLE ELSE 0.5 * sqrt(2) END)) FROM fill f JOIN nb ON nb.pix = f.pix LEFT JOIN recurring.fill o ON o.pix = nb.q WHERE o.w IS NULL OR greatest(nb.zq, f.w + CASE WHEN dr = 0 OR dc = 0 THEN 0.5::DOUBLE ELSE 0.5 * sqrt(2) END) < o.w GROUP BY 1)") + "SELECT d.pix, d.r, d.c, d.z, f.w FROM dem d JOIN fill f ON d.pix = f.pix")
def _(spark, sf):
    return O.fill_sinks(dem(spark, sf), rise=0.5)


@add("flow_accumulation", whole(_NB, _ORDER, "flow(pix, p) AS (SELECT pix, pix FROM dem UNION ALL SELECT f.pix, par.p FROM flow f JOIN par ON f.p = par.pix WHERE par.p <> f.p)") + "SELECT p AS id, count(*) AS cells FROM flow GROUP BY p")
def _(spark, sf):
    """Cells that drain through each cell on the way up to its summit."""
    return O.accumulation(materialize(O.earliest_neighbour(dem(spark, sf)), "pointers"))


@add("pixel_truncated", with_sql("peaks") + "SELECT fid, CAST(floor((x - 5000) / 200.0) AS BIGINT) AS col_floor, CAST(trunc((x - 5000) / 200.0) AS BIGINT) AS col_trunc FROM peaks")
def _(spark, sf):
    col = (_C("x") - 5000) / 200
    return view(spark, sf, "peaks").select("fid", F.floor(col).alias("col_floor"), col.cast("long").alias("col_trunc"))


@add("raster_counts", with_sql("dem", more=_FOCAL) + "SELECT (SELECT count(*) FROM dem) AS valid, (SELECT count(*) FROM f WHERE z >= near) AS peaks, (SELECT min(z) FROM dem) AS low, true AS consistent")
def _(spark, sf):
    return O.grid_counts(dem(spark, sf))


# ---- polygons: areas with a notch at the upper left corner

_NOTCH = [(0, 0), (4000, 0), (4000, 4000), (1500, 4000), (1500, 3000), (0, 3000), (0, 0)]
_EDGE_ROWS = ", ".join(f"({k}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for k, (a, b) in enumerate(zip(_NOTCH[:-1], _NOTCH[1:], strict=True)))
_EDGES = f"edges AS (SELECT land_id, land, country, CAST(x0 + ax AS DOUBLE) AS px, CAST(y0 + ay AS DOUBLE) AS py, CAST(x0 + bx AS DOUBLE) AS rx, CAST(y0 + by_ AS DOUBLE) AS ry FROM lands, (VALUES {_EDGE_ROWS}) e(k, ax, ay, bx, by_))"
_AT = "greatest(0, least(1, ((x - px) * (rx - px) + (y - py) * (ry - py)) / ((rx - px) * (rx - px) + (ry - py) * (ry - py))))"
_SEG = f"sqrt(pow(x - (px + {_AT} * (rx - px)), 2) + pow(y - (py + {_AT} * (ry - py)), 2))"
_CROSS = "(py > y) <> (ry > y) AND x < (rx - px) * (y - py) / (ry - py) + px"


def _shape(points: str = "peaks", key: str = "fid") -> str:
    return f"pts AS (SELECT {key} AS fid, {'x, y' if points == 'peaks' else 'qx AS x, qy AS y'} FROM {points}), pl AS (SELECT fid, land_id, country, CASE WHEN count(*) FILTER ({_CROSS}) % 2 = 1 THEN 0.0 ELSE min({_SEG}) END AS dist, min({_SEG}) AS line FROM pts, edges GROUP BY fid, land_id, country)"


def _areas(spark, sf):
    ring = F.array(*[F.struct((_C("x0") + float(x)).alias("x"), (_C("y0") + float(y)).alias("y")) for x, y in _NOTCH])
    return view(spark, sf, "lands").select("land_id", "land", "country", ring.alias("ring"))


@add("polygon_land", with_sql("peaks", "lands", more=_EDGES + ", " + _shape()) + "SELECT fid, arg_min(land_id, (dist, land_id)) AS land_id FROM pl WHERE dist <= 1 GROUP BY fid")
def _(spark, sf):
    return S.locate(view(spark, sf, "peaks").select("fid", "x", "y"), _areas(spark, sf), 2000.0)


@add("polygon_clip", with_sql("peaks", "lands", more=_EDGES + ", " + _shape()) + "SELECT DISTINCT fid FROM pl WHERE country = 1 AND dist = 0")
def _(spark, sf):
    return S.near_areas(view(spark, sf, "peaks").select("fid", "x", "y"), _areas(spark, sf).filter("country = 1"), 0.0, 2000.0).select("fid").distinct()


@add("border_line", with_sql("peaks", "lands", more=_EDGES + ", " + _shape()) + "SELECT fid, round(min(line), 1) AS dist, CASE WHEN min(line) > 50 THEN 'INNER' ELSE 'BORDER_ZONE' END AS zone FROM pl WHERE country = 1 GROUP BY fid")
def _(spark, sf):
    """Distance to the nearest border line of one country."""
    line = S.segment_distance(_C("ring"), _C("x").cast("double"), _C("y").cast("double"))
    edge = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    lines = _areas(spark, sf).filter("country = 1").select("land_id", "ring", edge(F.array_min, "x").alias("x0"), edge(F.array_max, "x").alias("x1"), edge(F.array_min, "y").alias("y0"), edge(F.array_max, "y").alias("y1"))
    d = S.closest(view(spark, sf, "peaks").select("fid", "x", "y"), lines, line, 1000.0, ["land_id"]).select("fid", _C("best.distance").alias("d"))
    return d.select("fid", F.round("d", 1).alias("dist"), R.border_zone(_C("d")).alias("zone"))


@add("buffered_filter", with_sql("refdb", "lands", more=_EDGES + ", " + _shape("refdb", "bid")) + "SELECT DISTINCT fid AS bid FROM pl WHERE country = 1 AND dist <= 400")
def _(spark, sf):
    """Reference rows within 400 of a country's areas; also the cut line around a border."""
    p = view(spark, sf, "refdb").select("bid", _C("qx").alias("x"), _C("qy").alias("y"))
    return S.near_areas(p, _areas(spark, sf).filter("country = 1"), 400.0, 2000.0).select("bid").distinct()


@add("disc_intersects_first", with_sql("peaks", more="m AS (SELECT p.fid, q.fid AS hit, row_number() OVER (PARTITION BY p.fid ORDER BY CASE WHEN p.fid = q.fid THEN 0 ELSE 1 END, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y), q.fid) AS k, count(*) OVER (PARTITION BY p.fid) AS n FROM peaks p JOIN peaks q ON (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 90000)") + "SELECT fid, hit, n FROM m WHERE k = 1")
def _(spark, sf):
    """The first row whose disc meets each row's disc, its own before others."""
    p = view(spark, sf, "peaks").select("fid", "x", "y")
    met = S.around(p, p.select(_C("fid").alias("bid"), _C("x").alias("qx"), _C("y").alias("qy")), 300)
    # a row's disc meets itself, which comes before all others
    return met.select("fid", _C("fid").alias("hit"), "n")


@add("identity_attach", with_sql("peaks", more="m AS (SELECT p.fid, q.fid AS hit, row_number() OVER (PARTITION BY p.fid ORDER BY pow(p.x - q.x - q.fid % 7, 2) + pow(p.y - q.y, 2), q.fid DESC) AS k FROM peaks p JOIN peaks q ON pow(p.x - q.x - q.fid % 7, 2) + pow(p.y - q.y, 2) <= 25)") + "SELECT fid, hit FROM m WHERE k = 1")
def _(spark, sf):
    """The row of a shifted layer within 5, the nearest and of equals the last."""
    p = view(spark, sf, "peaks").select("fid", "x", "y")
    moved = p.select(_C("fid").alias("bid"), (_C("x") + _C("fid") % 7).alias("qx"), _C("y").alias("qy"))
    return S.near(p, moved, 5).groupBy("fid").agg(F.min(F.struct("d2", (-_C("bid")).alias("o"))).alias("b")).select("fid", (-_C("b.o")).alias("hit"))


@add("partner_lookup", with_sql("peaks", more="m AS (SELECT p.fid, q.fid AS partner, row_number() OVER (PARTITION BY p.fid ORDER BY (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y), q.fid) AS k FROM peaks p JOIN peaks q ON p.fid <> q.fid AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 640000)") + "SELECT m.fid, partner, q.name AS partner_name, abs(p.z - q.z) AS z_diff, round(sqrt((p.kx - q.kx) * (p.kx - q.kx) + (p.ky - q.ky) * (p.ky - q.ky)), 1) AS keycol_dist, CASE WHEN (p.kx - q.kx) * (p.kx - q.kx) + (p.ky - q.ky) * (p.ky - q.ky) <= 160000 THEN 1 ELSE 0 END AS same_keycol FROM m JOIN peaks p ON p.fid = m.fid JOIN peaks q ON q.fid = partner WHERE k = 1")
def _(spark, sf):
    """Each row's nearest other within 800 and what its row says of it."""
    p = view(spark, sf, "peaks")
    a = p.select("fid", "x", "y")
    near = pairs(a, a.select(_C("fid").alias("bid"), _C("x").alias("qx"), _C("y").alias("qy")), 2, 800).filter("fid <> bid")  # one of two is another
    best = near.groupBy("fid").agg(F.min(F.struct("d2", "bid")).alias("b")).select("fid", _C("b.bid").alias("partner"))
    other = p.select(_C("fid").alias("partner"), _C("name").alias("partner_name"), _C("z").alias("z2"), _C("kx").alias("kx2"), _C("ky").alias("ky2"))
    both = best.join(p.select("fid", "z", "kx", "ky"), "fid").join(other, "partner")
    d = F.sqrt((_C("kx") - _C("kx2")) * (_C("kx") - _C("kx2")) + (_C("ky") - _C("ky2")) * (_C("ky") - _C("ky2")))
    return both.select("fid", "partner", "partner_name", F.abs(_C("z") - _C("z2")).alias("z_diff"), F.round(d, 1).alias("keycol_dist"), (d <= 400).cast("int").alias("same_keycol"))


@add("match_percent", with_sql("peaks", "names", "lands", more=_EDGES + ", " + _shape() + ", " + _dist(300, "names") + ", " + _top(1) + ", l AS (SELECT DISTINCT fid FROM pl WHERE dist <= 1)") + "SELECT round(100.0 * (SELECT count(*) FROM best) / count(*), 1) AS name_pct, round(100.0 * (SELECT count(*) FROM l) / count(*), 1) AS land_pct FROM peaks")
def _(spark, sf):
    p = view(spark, sf, "peaks").select("fid", "x", "y")
    named = _first(spark, sf, "names", 300).select("fid", F.lit(1).alias("named"))
    inside = S.locate(p, _areas(spark, sf), 2000.0).select("fid", F.lit(1).alias("inside"))
    share = lambda c: F.round(F.lit(100.0) * F.count(c) / F.count("*"), 1)
    return p.join(named, "fid", "left").join(inside, "fid", "left").agg(share("named").alias("name_pct"), share("inside").alias("land_pct"))


# ---- texts

_T = with_sql("cases").rstrip() + ", t AS (SELECT k, " + pick("k", " Hochkar ", "KÃ¤rnten", "", "null", "HOCHKAR", None) + " AS a, " + pick("k * 5 + 2", "hochkar", "Kärnten", "Ötscher", None) + " AS b FROM cases)\n"


def _texts(spark, sf):
    return view(spark, sf, "cases").select("k", F.expr(pick("k", " Hochkar ", "KÃ¤rnten", "", "null", "HOCHKAR", None)).alias("a"), F.expr(pick("k * 5 + 2", "hochkar", "Kärnten", "Ötscher", None)).alias("b"))


@add("display_text", _T + f"SELECT k, nullif(trim({_REPAIR.format('a')}), '') AS shown, CASE WHEN upper(trim(a)) = 'NULL' OR trim(a) = '' THEN NULL ELSE trim(a) END AS clean FROM t")
def _(spark, sf):
    return _texts(spark, sf).select("k", T.display(_C("a")).alias("shown"), T.clean_text(_C("a")).alias("clean"))


@add("name_differs", _T + "SELECT k, CASE WHEN a <> '' AND b <> '' AND lower(a) <> lower(b) THEN 1 ELSE 0 END AS differs FROM t")
def _(spark, sf):
    return _texts(spark, sf).select("k", T.differ(_C("a"), _C("b")).alias("differs"))


@add("first_true", with_sql("cases") + "SELECT k, coalesce(nullif(b1, 0), nullif(d, 0), nullif(dz, 0)) AS v FROM cases")
def _(spark, sf):
    return view(spark, sf, "cases").select("k", R.first_true(_C("b1"), _C("d"), _C("dz")).alias("v"))


# ---- rules with all their columns

_NEAR3 = "('EXACT_POS', 'VERY_NEAR_POS', 'NEAR_POS')"


@add("match_elev_links", with_sql("cases") + f", r AS (SELECT *, CASE WHEN pos IN {_NEAR3} AND support = 'BEV_SUPPORTS_CALC' THEN 1 WHEN pos IN {_NEAR3} AND support = 'BEV_SUPPORTS_DB' THEN 2 WHEN hint = 'POSSIBLE_WRONG_SUMMIT_MATCH' AND d <= 250 THEN 3 WHEN pos IN ('RIDGE_OFFSET', 'REMOTE_OFFSET') THEN 4 ELSE 5 END AS way FROM cases) SELECT k, CASE way WHEN 1 THEN 'CALC_POINT_SUPPORTED' WHEN 2 THEN 'DB_HEIGHT_SUPPORTED' WHEN 3 THEN 'OFFICIAL_SUMMIT_REVIEW' WHEN 4 THEN 'MANUAL_REVIEW' END AS preference, CASE WHEN d <= 250 THEN 1 ELSE 0 END AS link, CASE WHEN way = 3 THEN 'MATCH_ELEV_WRONG_SUMMIT_REVIEW' WHEN d <= 250 THEN 'MATCH_ELEV_OFFICIAL_LINK' END AS reason, CASE WHEN way = 3 THEN 1 ELSE 0 END AS ambiguous FROM r")
def _(spark, sf):
    s = R.match_elev_links(_C("pos"), _C("support"), _C("hint"), _C("d"))
    return view(spark, sf, "cases").select("k", s.alias("s")).select("k", "s.*")


_PAIR = "CASE WHEN d IS NOT NULL AND dz <= 5 AND b1 = 1 AND b2 = 1 THEN 'strict' WHEN d IS NOT NULL AND dz <= 10 AND b2 = 1 THEN 'soft' WHEN d IS NOT NULL THEN 'near' ELSE 'none' END"


@add("db_no_peak_links", with_sql("cases") + f", r AS (SELECT k, {_PAIR} AS way FROM cases) SELECT k, CASE way WHEN 'strict' THEN 'OFFICIAL_SUMMIT_PREFERRED' WHEN 'soft' THEN 'OFFICIAL_SUMMIT_REVIEW' WHEN 'near' THEN 'MANUAL_REVIEW' END AS preference, CASE WHEN way = 'none' THEN 0 ELSE 1 END AS link, CASE way WHEN 'strict' THEN 'DB_NO_PEAK_SHARED_KEYCOL' WHEN 'soft' THEN 'DB_NO_PEAK_NEAR_CALC_REVIEW' WHEN 'near' THEN 'DB_NO_PEAK_NEAR_CALC' END AS reason, CASE WHEN way = 'strict' THEN 1 ELSE 0 END AS ambiguous FROM r")
def _(spark, sf):
    status = R.refined_db_no_peak(_C("d"), _C("dz"), _C("b1"), _C("b2"), _C("b3"))
    return view(spark, sf, "cases").select("k", R.pair_links(status, _C("d"), F.lit(True)).alias("s")).select("k", "s.preference", "s.link", "s.reason", "s.ambiguous")


@add("new_calc_links", with_sql("cases") + f", r AS (SELECT *, {_PAIR} AS way, (prom >= 250 AND b3 = 1 AND b4 = 0) OR (prom >= 180 AND b4 = 1) OR (b3 = 0 AND z2 IS NULL) AS own FROM cases), s AS (SELECT *, way = 'near' AND NOT own AND z3 IS NOT NULL AS manual FROM r) SELECT k, CASE way WHEN 'strict' THEN 'OFFICIAL_SUMMIT_PREFERRED' WHEN 'soft' THEN 'OFFICIAL_SUMMIT_REVIEW' END AS preference, CASE WHEN way IN ('strict', 'soft') OR manual THEN 1 ELSE 0 END AS link, CASE WHEN way = 'strict' THEN 'NEW_CALC_SHARED_KEYCOL' WHEN way = 'soft' THEN 'NEW_CALC_NEAR_DB_REVIEW' WHEN manual THEN 'NEW_CALC_MANUAL_REVIEW' END AS reason, CASE WHEN way = 'strict' THEN 1 ELSE 0 END AS ambiguous, CASE WHEN way IN ('strict', 'soft') THEN 1 ELSE 0 END AS adopts, CASE WHEN way IN ('strict', 'soft') THEN coalesce(nullif(z3, 0), z1) END AS partner_z FROM s")
def _(spark, sf):
    status = R.refined_new_calc(_C("d"), _C("dz"), _C("b1"), _C("b2"), _C("prom"), _C("b3"), _C("b4"), _C("z2"))
    got = view(spark, sf, "cases").select("k", "z1", "z3", R.pair_links(status, _C("d"), _C("z3").isNotNull()).alias("s"))
    return got.select("k", "s.*", F.when(_C("s.adopts") == 1, F.coalesce(F.nullif("z3", F.lit(0)), "z1")).alias("partner_z"))


_GRAVE = "IN ('REVIEW', 'STRONG', 'SEVERE')"


@add("coordinate_result", with_sql("cases") + f", g AS (SELECT *, coalesce(sev1 {_GRAVE}, false) AS g1, coalesce(sev2 {_GRAVE}, false) AS g2, coalesce(sev3 {_GRAVE}, false) AS g3, coalesce(z3 - z2 >= 3, false) AS up FROM cases) SELECT k, CASE WHEN NOT (g1 OR g2 OR g3 OR up) THEN 'NONE' WHEN 'SEVERE' IN (sev1, sev2, sev3) THEN 'SEVERE' WHEN 'STRONG' IN (sev1, sev2, sev3) THEN 'STRONG' WHEN 'REVIEW' IN (sev1, sev2, sev3) THEN 'REVIEW' WHEN 'MINOR' IN (sev1, sev2, sev3) THEN 'MINOR' WHEN 'NONE' IN (sev1, sev2, sev3) THEN 'NONE' ELSE 'REVIEW' END AS severity, CASE WHEN g1 OR g2 OR g3 THEN 1 ELSE 0 END AS coord, CASE WHEN up OR (b1 = 1 AND (g1 OR g2 OR g3)) THEN 1 ELSE 0 END AS ident, CASE WHEN b2 = 1 AND (g1 OR g2 OR g3 OR up) THEN 1 ELSE 0 END AS names, CASE WHEN NOT g1 THEN 'UNCHANGED' WHEN code1 = 7302 AND sev3 IN ('NONE', 'MINOR') THEN 'BEV_NAME_7302_REVIEW' WHEN sev2 IN ('NONE', 'MINOR') THEN 'CALC_PEAK_REVIEW' ELSE 'MANUAL_REVIEW' END AS source FROM g")
def _(spark, sf):
    s = R.coordinate_result(_C("sev1"), _C("sev2"), _C("sev3"), _C("code1"), _C("z3") - _C("z2"), _C("b1"), _C("b2") == 1)
    return view(spark, sf, "cases").select("k", s.alias("s")).select("k", "s.severity", "s.coord", "s.ident", "s.names", "s.source")


@add("name_evidence", with_sql("cases") + ", n AS (SELECT *, CASE WHEN k % 3 > 0 THEN 'A' || k END AS cn, CASE WHEN k % 4 > 0 THEN 'B' || k END AS obn, CASE WHEN k % 6 > 0 THEN 'C' END AS db FROM cases), w AS (SELECT *, CASE WHEN cn IS NOT NULL AND code1 IN (7302, 7303) THEN 1 WHEN obn IS NOT NULL AND code2 IN (7302, 7303) THEN 2 ELSE 3 END AS way FROM n) SELECT k, CASE way WHEN 1 THEN cn WHEN 2 THEN obn END AS name, CASE way WHEN 1 THEN 'BEV_CALC_' || code1 WHEN 2 THEN 'BEV_OFFICIAL_' || code2 ELSE 'NO_AUTHORITATIVE_BEV_NAME' END AS source, CASE WHEN way = 1 THEN 'BEV_CALC_' || code1 WHEN way = 2 THEN 'BEV_OFFICIAL_' || code2 WHEN code1 = 7301 OR code2 = 7301 THEN 'BEV_CONTEXT_7301_ONLY' ELSE 'NO_AUTHORITATIVE_BEV_NAME' END AS support, CASE WHEN way = 3 AND db IS NOT NULL THEN 1 ELSE 0 END AS fallback, CASE WHEN origin <> 'CALC_PEAK' THEN 'NOT_CALC_PEAK' WHEN way < 3 THEN 'BEV_AUTH_AVAILABLE' WHEN db IS NOT NULL AND b4 = 1 THEN 'N1_NO_AUTHORITATIVE_BEV_NAME_SOTA_DB_FALLBACK_WITH_GEO_OR_REPLAY' WHEN db IS NOT NULL THEN 'N1_NO_AUTHORITATIVE_BEV_NAME_SOTA_DB_FALLBACK' WHEN b4 = 1 THEN 'N1_NO_AUTHORITATIVE_BEV_NAME_WITH_GEO_OR_REPLAY' ELSE 'N1_NO_AUTHORITATIVE_BEV_NAME_ONLY' END AS queue, CASE WHEN origin = 'CALC_PEAK' AND way = 3 THEN 1 ELSE 0 END AS osm_allowed FROM w")
def _(spark, sf):
    k = _C("k").cast("string")
    names = (F.when(_C("k") % 3 > 0, F.concat(F.lit("A"), k)), F.when(_C("k") % 4 > 0, F.concat(F.lit("B"), k)), F.when(_C("k") % 6 > 0, "C"))
    s = R.name_evidence(names[0], _C("code1"), names[1], _C("code2"), names[2], F.lit(None).cast("string"), _C("origin"), _C("b4") == 1)
    return view(spark, sf, "cases").select("k", s.alias("s")).select("k", "s.*")


@add("calc_name_support", with_sql("cases") + "SELECT k, CASE WHEN k % 3 > 0 AND code1 IN (7302, 7303) THEN 1 ELSE 0 END AS available, CASE WHEN k % 3 > 0 AND code1 IN (7302, 7303) THEN 'BEV_CALC_' || code1 ELSE 'NO_BEV_AT_CALC_POINT' END AS support, round((coalesce(z1, z3) - z2) / 8.0::DOUBLE, 1) AS z_diff FROM cases")
def _(spark, sf):
    s = R.calc_name_support(F.when(_C("k") % 3 > 0, "A"), _C("code1"), F.coalesce("z1", "z3") / 8.0, _C("z2") / 8.0)
    return view(spark, sf, "cases").select("k", s.alias("s")).select("k", "s.*")


_MEMBERS = "m AS (SELECT fid, fid % 97 AS grp, CAST((fid * 37) % 101 AS DOUBLE) / 8 AS score, CASE WHEN fid % 3 = 0 THEN fid % 200 END AS odist, fid % 5 = 0 AS has_z, fid % 7 = 0 AS has_name FROM peaks), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, fid DESC) AS k, row_number() OVER (PARTITION BY grp ORDER BY score DESC, fid) AS plain, lead(score) OVER (PARTITION BY grp ORDER BY score DESC, fid DESC) AS next FROM m), t AS (SELECT *, bool_or(k = 1 AND score - coalesce(next, -999) >= 1.25 AND (coalesce(odist <= 100, false) OR has_z OR has_name)) OVER (PARTITION BY grp) AS won FROM r)"


@add("group_decision", with_sql("peaks", more=_MEMBERS) + "SELECT fid, grp, CASE WHEN NOT won THEN plain WHEN k = 1 THEN 1 ELSE 2 END AS place, CASE WHEN NOT won THEN 'REVIEW_REQUIRED' WHEN k = 1 THEN 'FINAL_SOTA_SUMMIT' ELSE 'SECONDARY_SHARED_KEYCOL' END AS role, CASE WHEN NOT won THEN 'SHARED_KEYCOL_REVIEW_REQUIRED' WHEN k > 1 THEN 'PAIR_SECONDARY_TO_FINAL' WHEN odist IS NULL THEN 'BEV_HEIGHT_HIGHER_SHARED_KEYCOL' ELSE 'OFFICIAL_PREFERRED_SHARED_KEYCOL' END AS basis, CASE WHEN won THEN 'MEDIUM' ELSE 'LOW' END AS confidence, CASE WHEN won AND k = 1 THEN 1 ELSE 0 END AS final_flag, CASE WHEN won THEN 0 ELSE 1 END AS manual, CASE WHEN won THEN 0 ELSE 1 END AS replay FROM t")
def _(spark, sf):
    f = _C("fid")
    m = view(spark, sf, "peaks").select("fid", (f % 97).alias("grp"), (((f * 37) % 101).cast("double") / 8).alias("score"), F.when(f % 3 == 0, f % 200).alias("odist"), ((f % 5 == 0) | (f % 7 == 0)).alias("proof"))
    # the two best of a group by partial maxima; only groups without a winner are ranked
    first = m.groupBy("grp").agg(F.max(F.struct("score", "fid", "odist", "proof")).alias("a"))
    rest = m.join(first, "grp").filter("fid <> a.fid").groupBy("grp").agg(F.max("score").alias("second"))
    both = first.join(rest, "grp", "left")
    good = (_C("a.score") - F.coalesce("second", F.lit(-999.0)) >= 1.25) & (F.coalesce(_C("a.odist") <= 100, F.lit(False)) | _C("a.proof"))
    t = m.join(both.select("grp", good.alias("won"), _C("a.fid").alias("top")), "grp")
    plain = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "fid"))
    sure = t.filter("won").withColumn("place", F.when(_C("fid") == _C("top"), 1).otherwise(2))
    ranked = sure.unionByName(t.filter("not won").withColumn("place", plain))
    return ranked.select("fid", "grp", "place", R.group_decision(_C("won"), _C("place"), _C("odist").isNotNull()).alias("s")).select("fid", "grp", "place", "s.*")


@add("pair_edges", with_sql("cases") + ", e AS (SELECT k AS a, k + 1 + k % 3 AS b FROM cases WHERE k % 4 > 0 AND b1 = 1 AND dz <= 5), u AS (SELECT a, b FROM e WHERE b IN (SELECT k FROM cases) UNION SELECT b, a FROM e WHERE b IN (SELECT k FROM cases)) SELECT a, count(*) AS partners, min(b) AS first_partner FROM u GROUP BY a")
def _(spark, sf):
    """Undirected pairs of rows that share a key col and differ little in height, though one side only may say so."""
    c = view(spark, sf, "cases")
    e = c.filter("k % 4 > 0 and b1 = 1 and dz <= 5").select(_C("k").alias("a"), (_C("k") + 1 + _C("k") % 3).alias("b")).join(c.select(_C("k").alias("b")), "b", "left_semi").select("a", "b")
    both = e.unionByName(e.select(_C("b").alias("a"), _C("a").alias("b"))).distinct()
    return both.groupBy("a").agg(F.count("*").alias("partners"), F.min("b").alias("first_partner"))


@add("gate_note", with_sql("cases") + "SELECT k, CASE WHEN b2 = 1 AND coalesce(tags, '') NOT IN ('', 'NO_COORDINATE_FLAG') THEN tags || ' / ' || sev1 END AS note FROM cases")
def _(spark, sf):
    return view(spark, sf, "cases").select("k", F.when((_C("b2") == 1) & ~F.coalesce("tags", F.lit("")).isin("", "NO_COORDINATE_FLAG"), F.concat_ws(" / ", "tags", "sev1")).alias("note"))


@add("land_and_name", with_sql("refdb") + ", r AS (SELECT bid, CASE WHEN bid % 4 = 0 THEN 'Own' WHEN bid % 4 = 1 THEN '' END AS land, CASE WHEN bid % 3 = 0 THEN bid END AS poly, code, CASE WHEN bid % 2 = 0 THEN 'N' || bid END AS nm, CASE WHEN bid % 5 > 0 THEN ref_name END AS dbn, bid % 7 > 0 AS matched FROM refdb) SELECT bid, CASE WHEN land = 'Own' THEN 'land' WHEN poly IS NOT NULL THEN 'bl_join' WHEN left(code, 6) IN ('OE/VB-', 'OE/TI-', 'OE/TL-', 'OE/SB-', 'OE/KT-', 'OE/ST-', 'OE/OO-', 'OE/NO-', 'OE/BL-', 'OE/WI-') THEN 'sota_ref' ELSE 'missing' END AS origin, coalesce(nm, CASE WHEN matched THEN dbn END) AS name, CASE WHEN nm IS NOT NULL THEN 'BEV_NAME' WHEN matched AND dbn IS NOT NULL THEN 'SOTA_DB' WHEN matched THEN 'UNKNOWN' END AS source FROM r")
def _(spark, sf):
    b = _C("bid")
    land = F.when(b % 4 == 0, "Own").when(b % 4 == 1, "")
    shown = R.display_name(F.when(b % 2 == 0, F.concat(F.lit("N"), b.cast("string"))), F.when(b % 5 > 0, _C("ref_name")), b % 7 > 0)
    return view(spark, sf, "refdb").select("bid", R.land_source(F.when(b % 3 == 0, b), land, _C("code")).alias("origin"), shown.alias("s")).select("bid", "origin", "s.name", "s.source")


# ---- key-col export of reference rows without a peak

_LOST = "lost AS (SELECT bid, qx, qy, alt, CASE WHEN bid % 3 = 0 THEN bid * 2 WHEN bid % 3 = 1 THEN -bid END AS raw_id, CASE WHEN bid % 4 = 0 THEN qx + 10 END AS kx0, CASE WHEN bid % 4 = 0 THEN qy + 10 END AS ky0, CASE WHEN bid % 5 = 0 THEN 40 END AS prom0 FROM refdb WHERE is_foreign = 0)"
_RAW = "raw AS (SELECT fid AS rid, -fid AS attr, x AS rx, y AS ry, z AS rz, prom AS rprom, kx AS rkx, ky AS rky, CASE WHEN fid % 6 > 0 THEN z - prom END AS rcol FROM peaks)"


@add("keycol_export", with_sql("refdb", "peaks", more=f"{_LOST}, {_RAW}, a AS (SELECT l.*, i.rid AS id1, coalesce(kx0, i.rkx) AS kx1, coalesce(ky0, i.rky) AS ky1, i.rcol AS col1, i.rz AS top1, i.rprom AS prom1 FROM lost l LEFT JOIN raw i ON i.rid = (SELECT coalesce((SELECT rid FROM raw r WHERE r.rid = l.raw_id), (SELECT rid FROM raw r WHERE r.attr = l.raw_id)))), n AS (SELECT bid, raw.*, (qx - rx) * (qx - rx) + (qy - ry) * (qy - ry) AS d2, row_number() OVER (PARTITION BY bid ORDER BY (qx - rx) * (qx - rx) + (qy - ry) * (qy - ry), rid) AS k FROM lost JOIN raw ON (qx - rx) * (qx - rx) + (qy - ry) * (qy - ry) <= 360000), b AS (SELECT a.*, kx1 IS NULL OR ky1 IS NULL OR col1 IS NULL OR top1 IS NULL OR prom1 IS NULL AS lacks, n.rid AS id2, n.d2, n.rkx, n.rky, n.rcol, n.rz, n.rprom FROM a LEFT JOIN n ON n.bid = a.bid AND n.k = 1), c AS (SELECT bid, CASE WHEN lacks AND id2 IS NOT NULL THEN id2 ELSE raw_id END AS raw_peak, CASE WHEN lacks THEN round(sqrt(d2), 1) END AS raw_dist, CASE WHEN lacks THEN coalesce(kx1, rkx) ELSE kx1 END AS kx, CASE WHEN lacks THEN coalesce(ky1, rky) ELSE ky1 END AS ky, CASE WHEN lacks THEN coalesce(col1, rcol) ELSE col1 END AS col, coalesce(CASE WHEN lacks THEN coalesce(top1, rz) ELSE top1 END, alt) AS top, coalesce(CASE WHEN lacks THEN coalesce(prom1, rprom) ELSE prom1 END, prom0) AS prom FROM b)") + "SELECT bid, raw_peak, raw_dist, kx, ky, coalesce(col, top - prom) AS z_saddle, top AS z_peak, prom AS prom_ref FROM c")
def _(spark, sf):
    """Values of a row itself, of its raw peak by id (or by the id it carries), of the nearest raw peak if any of five is
    missing, and at last of the reference height and raw prominence."""
    from ..operators.export import keycol_values

    b = _C("bid")
    lost = view(spark, sf, "refdb").filter("is_foreign = 0").select("bid", _C("qx").alias("x"), _C("qy").alias("y"), "alt", F.when(b % 3 == 0, b * 2).when(b % 3 == 1, -b).alias("raw_id"), F.when(b % 4 == 0, _C("qx") + 10).alias("kx"), F.when(b % 4 == 0, _C("qy") + 10).alias("ky"), F.when(b % 5 == 0, 40).alias("raw_prom"))
    f = _C("fid")
    raw = view(spark, sf, "peaks").select("fid", (-f).alias("attr"), "x", "y", "z", "prom", "kx", "ky", F.when(f % 6 > 0, _C("z") - _C("prom")).alias("keycol"))
    return keycol_values(lost, raw, 600.0)


# ---- the staged run


@add("stage_run", with_sql("peaks", more="n AS (SELECT 'peaks' AS stage, count(*) AS rows FROM peaks UNION ALL SELECT 'refined', count(*) FROM peaks UNION ALL SELECT 'kept', count(*) FROM peaks WHERE prom >= 150)") + "SELECT run, t.stage, did, rows FROM (VALUES ('first', 'peaks', 'DONE'), ('first', 'refined', 'DONE'), ('first', 'kept', 'DONE'), ('again', 'peaks', 'SKIP'), ('again', 'refined', 'SKIP'), ('again', 'kept', 'SKIP'), ('forced', 'peaks', 'SKIP'), ('forced', 'refined', 'DONE'), ('forced', 'kept', 'DONE'), ('only', 'peaks', 'LEFT OUT'), ('only', 'refined', 'LEFT OUT'), ('only', 'kept', 'SKIP')) t(run, stage, did) JOIN n ON n.stage = t.stage")
def _(spark, sf):
    folder = _folder(spark, "run")
    stages = [
        Stage("peaks", lambda s, d, c: view(s, sf, "peaks")),
        Stage("refined", lambda s, d, c: d["peaks"].withColumn("band", R.refine_band(_C("prom"))), ["peaks"]),
        Stage("kept", lambda s, d, c: d["refined"].filter(f"prom >= {c['least']}"), ["refined"]),
    ]
    rows = []
    for run, options in (("first", {}), ("again", {}), ("forced", {"force": {"refined"}}), ("only", {"only": {"kept"}})):
        rows += [(run, *x) for x in run_stages(spark, stages, folder, {"least": 150}, **options)]
    # what stands in each stage's table
    counts = {x.name: result(spark, folder, x.name).count() for x in stages}
    return spark.createDataFrame([(*r, counts[r[1]]) for r in rows], "run string, stage string, did string, rows long")


@add("stage_result", with_sql("peaks") + "SELECT fid, CASE WHEN prom >= 170 THEN 'SAFE' ELSE 'REFINE' END AS band FROM peaks WHERE prom >= 150")
def _(spark, sf):
    folder = _folder(spark, "run")
    stages = [Stage("peaks", lambda s, d, c: view(s, sf, "peaks")), Stage("kept", lambda s, d, c: d["peaks"].filter("prom >= 150").select("fid", R.refine_band(_C("prom")).alias("band")), ["peaks"])]
    run_stages(spark, stages, folder)
    return result(spark, folder, "kept")


