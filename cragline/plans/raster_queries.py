"""Raster, graph and prominence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster as O
from ..operators.prominence import prominence
from .views import dem, with_sql

QUERIES: dict = {}
SQL: dict = {}
NB = "nb AS (SELECT a.pix, a.r, a.c, a.z, b.pix AS q, b.z AS zq, (b.r - a.r) AS dr, (b.c - a.c) AS dc FROM dem a JOIN dem b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND a.pix <> b.pix)"


def whole(*more: str) -> str:
    return with_sql("dem", more=",\n".join(more), recursive=True)


def add(name: str, sql: str | None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return wrap


@add("raster_valid_mask", with_sql("dem") + "SELECT pix, z FROM dem WHERE z <> 0 AND z % 97 <> 0")
def _(spark, sf):
    cells = dem(spark, sf).withColumn("z", F.when(F.col("z") % 97 == 0, F.lit(0)).otherwise(F.col("z")))
    return O.valid_mask(cells, 0).select("pix", "z")


_FOCAL = "f AS (SELECT a.pix, a.r, a.c, a.z, max(b.z) AS near FROM dem a JOIN (SELECT pix + o AS pix, c, z FROM dem, (VALUES (-65), (-64), (-63), (-1), (1), (63), (64), (65)) t(o)) b ON a.pix = b.pix AND abs(a.c - b.c) <= 1 GROUP BY ALL)"


@add("focal_max", with_sql("dem", more=_FOCAL) + "SELECT r, c, z, greatest(z, near) AS focal FROM f")
def _(spark, sf):
    return O.focal_max(dem(spark, sf))


@add("local_maxima_3x3", with_sql("dem", more=_FOCAL) + "SELECT r, c, z FROM f WHERE z >= near")
def _(spark, sf):
    return O.local_maxima(dem(spark, sf))


@add("raster_calc", with_sql("dem", more=_FOCAL) + "SELECT r, c, CASE WHEN z >= near AND z > 0 THEN 1 ELSE 0 END AS val FROM f")
def _(spark, sf):
    return O.focal_max(dem(spark, sf)).select("r", "c", F.when((F.col("z") == F.col("focal")) & (F.col("z") > 0), 1).otherwise(0).alias("val"))


@add("raster_mosaic", with_sql("dem") + "SELECT r, c, CASE WHEN z % 3 = 0 THEN z + 1000 ELSE z END AS z FROM dem")
def _(spark, sf):
    g = dem(spark, sf)
    return O.mosaic(g, g.filter("z % 3 = 0").withColumn("z", F.col("z") + 1000))


@add("raster_resample", with_sql("dem") + "SELECT r // 4 AS r, c // 4 AS c, CAST(sum(z) AS BIGINT) AS total, count(*) AS n FROM dem GROUP BY 1, 2")
def _(spark, sf):
    return O.block_mean(dem(spark, sf), 4)


@add("raster_sample", with_sql("dem", "peaks") + "SELECT fid, z_cell FROM (SELECT fid, CAST(floor(x / 200) AS BIGINT) AS pr, CAST(floor(y / 320) AS BIGINT) AS pc FROM peaks) p JOIN (SELECT r, c, z AS z_cell FROM dem) d ON r = pr AND c = pc")
def _(spark, sf):
    from .views import view

    p = view(spark, sf, "peaks").select("fid", F.floor(F.col("x") / 200).alias("r"), F.floor(F.col("y") / 320).alias("c"))
    return p.join(dem(spark, sf), ["r", "c"]).select("fid", F.col("z").alias("z_cell"))


@add("pixel_world", with_sql("dem") + "SELECT pix, 1000 + (c + 0.5::DOUBLE) * 10 AS x, 9000 - (r + 0.5::DOUBLE) * 10 AS y, CAST(floor((1000 + (c + 0.5::DOUBLE) * 10 - 1000) / 10) AS BIGINT) AS back_c FROM dem")
def _(spark, sf):
    x, y = F.lit(1000.0) + (F.col("c") + 0.5) * 10, F.lit(9000.0) - (F.col("r") + 0.5) * 10
    return dem(spark, sf).select("pix", x.alias("x"), y.alias("y"), F.floor((x - 1000) / 10).alias("back_c"))


def _points(spark, sf):
    """Every cell as a disc centre."""
    return dem(spark, sf).select(F.col("pix").alias("fid"), F.col("r").alias("pr"), F.col("c").alias("pc"))


_DISC = "d AS (SELECT p.pix AS fid, q.pix, q.z, (p.r - q.r) * (p.r - q.r) + (p.c - q.c) * (p.c - q.c) AS d2 FROM dem p JOIN dem q ON q.r BETWEEN p.r - 3 AND p.r + 3 AND q.c BETWEEN p.c - 3 AND p.c + 3 WHERE (p.r - q.r) * (p.r - q.r) + (p.c - q.c) * (p.c - q.c) <= 9)"


@add("disc_zonal_max", with_sql("dem", more=_DISC) + "SELECT fid, max(z) AS z FROM d GROUP BY fid")
def _(spark, sf):
    return O.disc_heights(_points(spark, sf), dem(spark, sf), 3).groupBy("fid").agg(F.max("high").alias("z"))


@add("disc_zonal_min", with_sql("dem", more=_DISC) + "SELECT fid, min(z) AS z FROM d GROUP BY fid")
def _(spark, sf):
    return O.disc_heights(_points(spark, sf), dem(spark, sf), 3).groupBy("fid").agg(F.min("low").alias("z"))


@add("local_max_disc", with_sql("dem", more=_DISC) + "SELECT fid, z, pix, d2, z - own AS dz FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY z DESC, pix) AS k, max(CASE WHEN d2 = 0 THEN z END) OVER (PARTITION BY fid) AS own FROM d) WHERE k = 1")
def _(spark, sf):
    best = F.max_by(F.struct("high", "pix", "d2"), F.struct("high", (-F.col("pix")).alias("p")))
    found = O.disc_heights(_points(spark, sf), dem(spark, sf), 3).groupBy("fid").agg(best.alias("b"), F.max("own").alias("own"))
    return found.select("fid", F.col("b.high").alias("z"), "b.pix", "b.d2", (F.col("b.high") - F.col("own")).alias("dz"))


@add("basin_divide_pairs", with_sql("dem", more="b AS (SELECT r, c, r // 5 * 100 + c // 7 AS basin FROM dem)") + "SELECT r, c, CAST(u AS VARCHAR) AS u_basin, CAST(v AS VARCHAR) AS v_basin FROM (SELECT a.r, a.c, a.basin AS u, n.basin AS v, row_number() OVER (PARTITION BY a.r, a.c ORDER BY n.r, n.c) AS k FROM b a JOIN b n ON n.r BETWEEN a.r - 1 AND a.r + 1 AND n.c BETWEEN a.c - 1 AND a.c + 1 AND n.basin <> a.basin) WHERE k = 1")
def _(spark, sf):
    return O.divide_pairs(dem(spark, sf).select("r", "c", (F.floor(F.col("r") / 5) * 100 + F.floor(F.col("c") / 7)).alias("basin")))


@add("zonal_min_max", with_sql("dem") + "SELECT r // 5 * 100 + c // 7 AS basin, min(z) AS z_min, max(z) AS z_max FROM dem GROUP BY 1")
def _(spark, sf):
    return dem(spark, sf).groupBy((F.floor(F.col("r") / 5) * 100 + F.floor(F.col("c") / 7)).alias("basin")).agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"))


_ORDER = "nbo AS (SELECT pix, arg_min(q, (-zq, q)) AS q FROM nb WHERE (-zq, q) < (-z, pix) GROUP BY pix), par AS (SELECT d.pix, coalesce(n.q, d.pix) AS p FROM dem d LEFT JOIN nbo n ON d.pix = n.pix), walk(pix, p, live) AS (SELECT pix, p, true FROM par UNION ALL SELECT w.pix, par.p, par.p <> w.p FROM walk w JOIN par ON w.p = par.pix WHERE w.live), bas AS (SELECT pix, p AS root FROM walk WHERE NOT live)"


@add("watershed_labels", whole(NB, _ORDER) + "SELECT pix AS id, root FROM bas WHERE root IN (SELECT root FROM bas GROUP BY root HAVING count(*) >= 5)")
def _(spark, sf):
    return O.watershed(dem(spark, sf), 5)


@add("region_centroids", whole("m AS (SELECT * FROM dem WHERE z > 0)", "e AS (SELECT a.pix AS a, b.pix AS b FROM m a JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) t(dr, dc) ON true JOIN m b ON b.r = a.r + dr AND b.c = a.c + dc)", "lab(pix, l) USING KEY (pix) AS (SELECT pix, pix FROM m UNION SELECT e.b, min(lab.l) FROM lab JOIN e ON lab.pix = e.a JOIN recurring.lab o ON o.pix = e.b WHERE lab.l < o.l GROUP BY 1)") + "SELECT l AS region, count(*) AS cells, CAST(sum(r) AS BIGINT) AS sum_r, CAST(sum(c) AS BIGINT) AS sum_c, max(z) AS z FROM lab JOIN m ON lab.pix = m.pix GROUP BY l")
def _(spark, sf):
    return O.region_centroids(dem(spark, sf).filter("z > 0"))


@add("fill_sinks", whole(NB, "fill(pix, w) USING KEY (pix) AS (SELECT pix, any_value(z) FROM nb GROUP BY pix HAVING count(*) < 8 UNION SELECT nb.q, min(greatest(nb.zq, f.w)) FROM fill f JOIN nb ON nb.pix = f.pix LEFT JOIN recurring.fill o ON o.pix = nb.q WHERE o.w IS NULL OR greatest(nb.zq, f.w) < o.w GROUP BY 1)") + "SELECT d.pix, d.r, d.c, d.z, f.w FROM dem d JOIN fill f ON d.pix = f.pix")
def _(spark, sf):
    return O.fill_sinks(dem(spark, sf))


# every pair of summits is beyond SQL on the whole grid; the tests compare with a descending scan
@add("prominence", None)
def _(spark, sf):
    return prominence(dem(spark, sf)).select("pix", "z", "keycol", "keycol_pix", "prom")


#: A border that is no rectangle: parts of the grid's rows, and columns.
BORDER = [(0, 8), (1, 8), (1, 56), (0.5, 56), (0.3, 40), (0, 56), (0, 8)]


@add("prominence_filter", None)
def _(spark, sf):
    from ..operators.spatial import ring_contains

    rows = dem(spark, sf).agg((F.max("r") + 1).alias("rows"))  # one row
    kept = prominence(dem(spark, sf)).filter("prom >= 1300").join(F.broadcast(rows))
    ring = F.array(*[F.struct(F.lit(float(c)).alias("x"), (F.col("rows") * float(r)).alias("y")) for r, c in BORDER])
    return kept.filter(ring_contains(ring, F.col("pix") % 64 + 0.5, F.floor(F.col("pix") / 64) + 0.5)).select("pix", "prom", "keycol_pix")
