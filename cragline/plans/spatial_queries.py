"""Spatial joins, reconciliation, text and grouping queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import spatial as S
from ..operators.graph import components
from ..operators.neighbours import pairs
from ..session import materialize
from .views import pick, table, view, with_sql

QUERIES: dict = {}
SQL: dict = {}


def add(name: str, sql: str | None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return wrap


def _dist(r: int, right: str = "refdb") -> str:
    return f"pairs AS (SELECT p.*, q.*, (x - qx) * (x - qx) + (y - qy) * (y - qy) AS d2 FROM peaks p JOIN {right} q ON qx BETWEEN x - {r} AND x + {r} AND qy BETWEEN y - {r} AND y + {r} AND (x - qx) * (x - qx) + (y - qy) * (y - qy) <= {r * r})"


def _top(k: int, by: str = "fid", order: str = "d2, bid") -> str:
    return f"ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS k FROM pairs), best AS (SELECT * FROM ranked WHERE k <= {k})"


def _first(spark, sf, right: str, r: float, k: int = 1):
    """The k nearest rows of `right` to each peak."""
    return pairs(view(spark, sf, "peaks"), view(spark, sf, right), k, r)


def _first_peaks(spark, sf, right: str, r: float):
    """The nearest peak to each row of `right`."""
    turned = view(spark, sf, right).select(F.col("bid").alias("fid"), F.col("qx").alias("x"), F.col("qy").alias("y"))
    goals = view(spark, sf, "peaks").select(F.col("fid").alias("bid"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    return pairs(turned, goals, 1, r).select(F.col("fid").alias("bid"), F.col("bid").alias("fid"), "d2")


@add("knn_name_join", with_sql("peaks", "names", more=_dist(300, "names") + ", " + _top(1)) + "SELECT fid, bid, place, d2 FROM best")
def _(spark, sf):
    return _first(spark, sf, "names", 300).select("fid", "bid", "place", "d2")


_MATCH = _dist(500) + ", " + _top(5) + ", dom AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY d2, bid) AS j FROM best WHERE is_foreign = 0), hit AS (SELECT * FROM dom WHERE j = 1)"


def match(spark, sf):
    """The nearest domestic row among the five nearest of all rows within 500."""
    return S.nearest(_first(spark, sf, "refdb", 500, 5).filter("is_foreign = 0").drop("rank"), ["fid"])


@add("knn_match", with_sql("peaks", "refdb", more=_MATCH) + "SELECT fid, bid, code, round(sqrt(d2), 1) AS dist FROM hit")
def _(spark, sf):
    return match(spark, sf).select("fid", "bid", "code", F.round(F.sqrt("d2"), 1).alias("dist"))


@add("near_calc", with_sql("peaks", "refdb", more=_dist(1000) + ", " + _top(1, "bid", "d2, fid")) + "SELECT bid, fid, round(sqrt(d2), 1) AS dist FROM best")
def _(spark, sf):
    return _first_peaks(spark, sf, "refdb", 1000).select("bid", "fid", F.round(F.sqrt("d2"), 1).alias("dist"))


@add("near_raw", with_sql("peaks", "refdb", more=_dist(600) + ", raw AS (SELECT bid, count(*) AS n FROM pairs GROUP BY bid), " + _top(1, "bid", "d2, fid")) + "SELECT best.bid, n, fid, round(sqrt(d2), 1) AS dist FROM best JOIN raw ON best.bid = raw.bid")
def _(spark, sf):
    turned = view(spark, sf, "refdb").select(F.col("bid").alias("fid"), F.col("qx").alias("x"), F.col("qy").alias("y"))
    goals = view(spark, sf, "peaks").select(F.col("fid").alias("bid"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    found = S.around(turned, goals, 600)
    return found.select(F.col("fid").alias("bid"), "n", F.col("bid").alias("fid"), F.round(F.sqrt("d2"), 1).alias("dist"))


@add("reciprocal_nearest", with_sql("peaks", "refdb", more=_dist(800) + ", r AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY d2, bid) AS k1, row_number() OVER (PARTITION BY bid ORDER BY d2, fid) AS k2 FROM pairs)") + "SELECT fid, bid, CASE WHEN k2 = 1 THEN 1 ELSE 0 END AS reciprocal FROM r WHERE k1 = 1")
def _(spark, sf):
    a = _first(spark, sf, "refdb", 800).select("fid", "bid")
    b = _first_peaks(spark, sf, "refdb", 800).select("fid", "bid", F.lit(1).alias("hit"))
    return a.join(b, ["fid", "bid"], "left").select("fid", "bid", F.coalesce("hit", F.lit(0)).alias("reciprocal"))


@add("nearest_preferred", with_sql("peaks", "names", more=_dist(400, "names") + ", " + _top(1, order="CASE WHEN f_code = 7302 THEN 0 ELSE 1 END, d2, bid")) + "SELECT fid, bid, f_code FROM best")
def _(spark, sf):
    p, names = view(spark, sf, "peaks"), view(spark, sf, "names")
    wanted = pairs(p, names.filter("f_code = 7302"), 1, 400).select("fid", "bid", "f_code")
    others = pairs(p.join(wanted, "fid", "left_anti"), names.filter("f_code <> 7302"), 1, 400).select("fid", "bid", "f_code")
    return wanted.unionByName(others)


@add("db_no_peak_anti", with_sql("peaks", "refdb", more=_MATCH) + "SELECT bid, code FROM refdb WHERE is_foreign = 0 AND bid NOT IN (SELECT bid FROM hit)")
def _(spark, sf):
    return view(spark, sf, "refdb").filter("is_foreign = 0").join(match(spark, sf).select("bid"), "bid", "left_anti").select("bid", "code")


def unified(spark, sf):
    """Calculated rows with their match, unmatched domestic rows and foreign rows in one schema."""
    p = view(spark, sf, "peaks").select("fid", "z").join(match(spark, sf).select("fid", "bid", "code", "alt", "d2"), "fid", "left")
    calc = p.select("fid", "bid", "code", rules.match_status(F.col("bid").isNotNull(), F.col("z"), F.col("alt")).alias("status"), F.lit("CALC_PEAK").alias("origin"))
    ref = view(spark, sf, "refdb")
    lost = ref.filter("is_foreign = 0").join(match(spark, sf).select("bid"), "bid", "left_anti").select("bid", "code", F.lit("DB_NO_PEAK").alias("status"), F.lit("SOTA_DB").alias("origin"))
    foreign = ref.filter("is_foreign = 1").select("bid", "code", F.lit("FOREIGN_PEAK").alias("status"), F.lit("SOTA_DB").alias("origin"))
    return calc.unionByName(lost, allowMissingColumns=True).unionByName(foreign, allowMissingColumns=True)


_UNIFIED = _MATCH + ", u AS (SELECT p.fid, h.bid, h.code, CASE WHEN h.bid IS NULL THEN 'NEW_CALC' WHEN abs(p.z - h.alt) <= 10 THEN 'MATCH_OK' ELSE 'MATCH_ELEV' END AS status, 'CALC_PEAK' AS origin FROM peaks p LEFT JOIN hit h ON p.fid = h.fid UNION ALL SELECT NULL, bid, code, 'DB_NO_PEAK', 'SOTA_DB' FROM refdb WHERE is_foreign = 0 AND bid NOT IN (SELECT bid FROM hit) UNION ALL SELECT NULL, bid, code, 'FOREIGN_PEAK', 'SOTA_DB' FROM refdb WHERE is_foreign = 1)"


@add("unified_table", with_sql("peaks", "refdb", more=_UNIFIED) + "SELECT * FROM u")
def _(spark, sf):
    return unified(spark, sf)


@add("match_summary", with_sql("peaks", "refdb", more=_UNIFIED) + "SELECT status, count(*) AS n FROM u GROUP BY status")
def _(spark, sf):
    return unified(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@add("coverage_pct", with_sql("peaks", "refdb", more=_UNIFIED) + "SELECT count(*) FILTER (status IN ('MATCH_OK','MATCH_ELEV')) AS found, count(*) FILTER (status <> 'FOREIGN_PEAK') AS total, round(100.0 * count(*) FILTER (status IN ('MATCH_OK','MATCH_ELEV')) / count(*) FILTER (status <> 'FOREIGN_PEAK'), 2) AS pct FROM u")
def _(spark, sf):
    found, total = F.count_if(F.col("status").isin("MATCH_OK", "MATCH_ELEV")), F.count_if(F.col("status") != "FOREIGN_PEAK")
    return unified(spark, sf).agg(found.alias("found"), total.alias("total"), F.round(F.lit(100.0) * found / total, 2).alias("pct"))


@add("attr_left_join", with_sql("peaks", "refdb", more=_MATCH) + "SELECT p.fid, p.z, h.alt FROM peaks p LEFT JOIN hit h ON p.fid = h.fid")
def _(spark, sf):
    return view(spark, sf, "peaks").select("fid", "z").join(match(spark, sf).select("fid", "alt"), "fid", "left")


@add("fallback_lookup", with_sql("peaks", "refdb") + "SELECT p.fid, coalesce(a.alt, b.alt) AS alt FROM peaks p LEFT JOIN refdb a ON a.bid = p.fid * 3 LEFT JOIN refdb b ON b.bid = p.fid")
def _(spark, sf):
    p, r = view(spark, sf, "peaks").select("fid"), view(spark, sf, "refdb").select("bid", "alt")
    a, b = r.select(F.col("bid").alias("b1"), F.col("alt").alias("a1")), r.select(F.col("bid").alias("b2"), F.col("alt").alias("a2"))
    return p.join(a, F.col("b1") == F.col("fid") * 3, "left").join(b, F.col("b2") == F.col("fid"), "left").select("fid", F.coalesce("a1", "a2").alias("alt"))


_STEPS = (400, 800, 1600, 4000, 40000)


@add("routing_target", with_sql("peaks", more="c AS (SELECT p.fid, q.fid AS target, (p.kx - q.x) * (p.kx - q.x) + (p.ky - q.y) * (p.ky - q.y) AS d2, CASE WHEN greatest(abs(p.kx - q.x), abs(p.ky - q.y)) <= 400 THEN 1 WHEN greatest(abs(p.kx - q.x), abs(p.ky - q.y)) <= 800 THEN 2 WHEN greatest(abs(p.kx - q.x), abs(p.ky - q.y)) <= 1600 THEN 3 WHEN greatest(abs(p.kx - q.x), abs(p.ky - q.y)) <= 4000 THEN 4 ELSE 5 END AS step FROM peaks p JOIN peaks q ON q.z > p.z), b AS (SELECT fid, arg_min(target, (step, d2, target)) AS target, arg_min(d2, (step, d2, target)) AS d2 FROM c GROUP BY fid)") + "SELECT p.fid, b.target, round(sqrt(b.d2) / 1000, 2) AS km FROM peaks p LEFT JOIN b ON p.fid = b.fid")
def _(spark, sf):
    # the test area is 20 km wide, so the squares are smaller than those of a country; the last one covers it all
    found = S.nearest_higher(view(spark, sf, "peaks"), [float(r) for r in _STEPS])
    return found.select("fid", "target", F.round(F.sqrt("d2") / 1000, 2).alias("km"))


_IN = "x >= x0 AND x < x1 AND y >= y0 AND y < y1"


def _in_lands(spark, sf, reach: float = 0.0):
    """Rows and areas that lie near each other, by grid cells of half an area's side."""
    return S.meet(view(spark, sf, "peaks"), view(spark, sf, "lands"), 2000.0, reach)


@add("pip_land", with_sql("peaks", "lands") + f"SELECT fid, land_id FROM peaks JOIN lands ON {_IN}")
def _(spark, sf):
    return _in_lands(spark, sf).filter(S.inside()).select("fid", "land_id")


@add("join_within_first", with_sql("peaks", "lands", more=f"j AS (SELECT fid, land_id, row_number() OVER (PARTITION BY fid ORDER BY land_id) AS k FROM peaks JOIN lands ON x >= x0 - 500 AND x < x1 + 500 AND y >= y0 - 500 AND y < y1 + 500)") + "SELECT fid, land_id FROM j WHERE k = 1")
def _(spark, sf):
    wide = (F.col("x") >= F.col("x0") - 500) & (F.col("x") < F.col("x1") + 500) & (F.col("y") >= F.col("y0") - 500) & (F.col("y") < F.col("y1") + 500)
    return _in_lands(spark, sf, 500.0).filter(wide).groupBy("fid").agg(F.min("land_id").alias("land_id"))


@add("clip_semi", with_sql("peaks", "lands") + f"SELECT fid FROM peaks WHERE EXISTS (SELECT 1 FROM lands WHERE country = 1 AND {_IN})")
def _(spark, sf):
    return _in_lands(spark, sf).filter(S.inside() & (F.col("country") == 1)).select("fid").distinct()


_RECT = "greatest(x0 - x, 0, x - x1) * greatest(x0 - x, 0, x - x1) + greatest(y0 - y, 0, y - y1) * greatest(y0 - y, 0, y - y1)"


@add("neighbor_land", with_sql("peaks", "lands", more=f"own AS (SELECT p.*, land_id AS own FROM peaks p JOIN lands ON {_IN}), n AS (SELECT fid, land_id, {_RECT} AS d2, row_number() OVER (PARTITION BY fid ORDER BY {_RECT}, land_id) AS k FROM own JOIN lands ON land_id <> own)") + "SELECT fid, land_id AS neighbor, round(sqrt(d2), 1) AS dist, CASE WHEN round(sqrt(d2), 1) <= 50 THEN 'BORDER_ZONE' ELSE 'INNER' END AS zone FROM n WHERE k = 1")
def _(spark, sf):
    own = _in_lands(spark, sf).filter(S.inside()).select("fid", "x", "y", F.col("land_id").alias("own"))
    near = S.closest(own, view(spark, sf, "lands"), F.sqrt(S.rect_distance2()), 1000.0, ["land_id"], F.col("land_id") != F.col("own"))
    dist = F.round("best.distance", 1)
    return near.select("fid", F.col("best.land_id").alias("neighbor"), dist.alias("dist"), F.when(dist <= 50, "BORDER_ZONE").otherwise("INNER").alias("zone"))


@add("border_distance", with_sql("peaks", "lands", more=f"o AS (SELECT fid, least(x - x0, x1 - x, y - y0, y1 - y) AS d FROM peaks JOIN lands ON {_IN})") + "SELECT fid, round(CAST(d AS DOUBLE), 1) AS dist, CASE WHEN d > 50 THEN 'INNER' ELSE 'BORDER_ZONE' END AS zone FROM o")
def _(spark, sf):
    p = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ring = F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("x0", "y0"))
    d = F.round(S.segment_distance(ring, F.col("x").cast("double"), F.col("y").cast("double")), 1)
    return _in_lands(spark, sf).filter(S.inside()).select("fid", d.alias("dist"), rules.border_zone(d).alias("zone"))


@add("bbox_filter", with_sql("peaks", "refdb", more="b AS (SELECT min(x) - 100 AS lx, max(x) + 100 AS hx, min(y) - 100 AS ly, max(y) + 100 AS hy FROM peaks)") + "SELECT bid FROM refdb, b WHERE qx BETWEEN lx AND hx AND qy BETWEEN ly AND hy")
def _(spark, sf):
    box = view(spark, sf, "peaks").agg((F.min("x") - 100).alias("lx"), (F.max("x") + 100).alias("hx"), (F.min("y") - 100).alias("ly"), (F.max("y") + 100).alias("hy"))
    return view(spark, sf, "refdb").join(F.broadcast(box), F.col("qx").between(F.col("lx"), F.col("hx")) & F.col("qy").between(F.col("ly"), F.col("hy"))).select("bid")  # one row


_RING_POINTS = "SELECT land_id, x0 + (x1 - x0) * i / 400 AS x, y0 AS y, i FROM {0} UNION ALL SELECT land_id, x1, y0 + (y1 - y0) * i / 400, i FROM {0} UNION ALL SELECT land_id, x1 - (x1 - x0) * i / 400, y1, i FROM {0} UNION ALL SELECT land_id, x0, y1 - (y1 - y0) * i / 400, i FROM {0}"


@add("densify_vertices", with_sql("lands", more="p AS (SELECT lands.*, i FROM lands, (SELECT unnest(range(400)) AS i))") + "SELECT land_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (" + _RING_POINTS.format("p") + " UNION ALL SELECT land_id, x0, y0, 400 FROM lands)")
def _(spark, sf):
    """Points along all edges of each ring, 10 apart."""
    p = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ring = F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("x0", "y0"))
    return view(spark, sf, "lands").select("land_id", F.explode(S.densify(ring, 10.0)).alias("v")).select("land_id", "v.x", "v.y")


@add("link_lines", with_sql("peaks") + "SELECT fid, 'LINESTRING(' || x || ' ' || y || ', ' || kx || ' ' || ky || ')' AS line, round(sqrt((x - kx) * (x - kx) + (y - ky) * (y - ky)), 1) AS len_m FROM peaks")
def _(spark, sf):
    c = lambda n: F.col(n).cast("string")
    return view(spark, sf, "peaks").select("fid", F.concat(F.lit("LINESTRING("), c("x"), F.lit(" "), c("y"), F.lit(", "), c("kx"), F.lit(" "), c("ky"), F.lit(")")).alias("line"), F.round(F.hypot(F.col("x") - F.col("kx"), F.col("y") - F.col("ky")), 1).alias("len_m"))


@add("prefix_land", with_sql("refdb") + "SELECT bid, CASE left(code, 6) WHEN 'OE/VB-' THEN 8 WHEN 'OE/TI-' THEN 7 WHEN 'OE/TL-' THEN 7 WHEN 'OE/SB-' THEN 5 WHEN 'OE/KT-' THEN 2 WHEN 'OE/ST-' THEN 6 WHEN 'OE/OO-' THEN 4 WHEN 'OE/NO-' THEN 3 WHEN 'OE/BL-' THEN 1 WHEN 'OE/WI-' THEN 9 END AS land_id, CASE left(code, 6) WHEN 'OE/VB-' THEN 'Vorarlberg' WHEN 'OE/TI-' THEN 'Tirol' WHEN 'OE/TL-' THEN 'Tirol' WHEN 'OE/SB-' THEN 'Salzburg' WHEN 'OE/KT-' THEN 'Kärnten' WHEN 'OE/ST-' THEN 'Steiermark' WHEN 'OE/OO-' THEN 'Oberösterreich' WHEN 'OE/NO-' THEN 'Niederösterreich' WHEN 'OE/BL-' THEN 'Burgenland' WHEN 'OE/WI-' THEN 'Wien' END AS land FROM refdb")
def _(spark, sf):
    return view(spark, sf, "refdb").select("bid", rules.prefix_land(F.col("code")).alias("l")).select("bid", "l.land_id", "l.land")


@add("refine_union", with_sql("peaks") + "SELECT fid, prom AS prom_ref, CAST(NULL AS INT) AS z1m FROM peaks WHERE prom >= 170 UNION ALL SELECT fid, prom + 5, z FROM peaks WHERE prom >= 130 AND prom < 170 AND prom + 5 >= 150")
def _(spark, sf):
    p = view(spark, sf, "peaks").withColumn("band", rules.refine_band(F.col("prom")))
    safe = p.filter("band = 'SAFE'").select("fid", F.col("prom").alias("prom_ref"))
    refined = p.filter("band = 'REFINE'").select("fid", (F.col("prom") + 5).alias("prom_ref"), F.col("z").alias("z1m")).filter("prom_ref >= 150")
    return safe.unionByName(refined, allowMissingColumns=True)


def _components(spark, sf):
    """Rows near another of like height, made symmetric: id, comp and the component's size."""
    p = view(spark, sf, "peaks").select("fid", "x", "y", "z")
    b = p.select(F.col("fid").alias("bid"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("bz"))
    edges = S.near(p, b, 250).filter("fid < bid and abs(z - bz) <= 400").select(F.col("fid").alias("src"), F.col("bid").alias("dst"))
    comp = materialize(components(edges, p.select(F.col("fid").alias("id"))), "components")
    return comp.join(comp.groupBy("comp").agg(F.count("*").alias("n")), "comp")


_COMP = "e AS (SELECT p.fid AS a, q.fid AS b FROM peaks p JOIN peaks q ON p.fid <> q.fid AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 62500 AND abs(p.z - q.z) <= 400), reach(id, lab) AS (SELECT fid, fid FROM peaks UNION SELECT e.b, reach.lab FROM reach JOIN e ON reach.id = e.a), comp AS (SELECT id, min(lab) AS comp FROM reach GROUP BY id), sized AS (SELECT *, count(*) OVER (PARTITION BY comp) AS n FROM comp)"


@add("pair_components", with_sql("peaks", more=_COMP, recursive=True) + "SELECT id, comp FROM sized WHERE n >= 2")
def _(spark, sf):
    return _components(spark, sf).filter("n >= 2").select("id", "comp")


def numbered(rows, order: list):
    """rows with k = 1, 2, ... in this order: places within range partitions, plus what lies before each."""
    parts = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # one row a partition
    return parts.join(before, "_p").withColumn("k", F.col("_b") + F.row_number().over(Window.partitionBy("_p").orderBy(*order))).drop("_p", "_b")


@add("group_ids", with_sql("peaks", more=_COMP + ", g AS (SELECT comp, row_number() OVER (ORDER BY CASE WHEN n > 1 THEN 0 ELSE 1 END, comp) AS k FROM (SELECT DISTINCT comp, n FROM sized))", recursive=True) + "SELECT id, 'GRP_' || lpad(CAST(k AS VARCHAR), 5, '0') AS grp FROM sized JOIN g ON sized.comp = g.comp")
def _(spark, sf):
    c = _components(spark, sf)
    # groups come first, then single rows; a group is met first at its smallest id
    ids = numbered(c.select("comp", (F.col("n") == 1).alias("single")).distinct(), [F.col("single"), F.col("comp")])
    return c.join(ids.select("comp", "k"), "comp").select("id", F.concat(F.lit("GRP_"), F.lpad(F.col("k").cast("string"), 5, "0")).alias("grp"))


_SCORE = "CAST((fid * 37) % 101 AS DOUBLE) / 8"
_GROUP = "s AS (SELECT fid, fid % 97 AS grp, " + _SCORE + " AS score FROM peaks), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, fid DESC) AS k, lead(score) OVER (PARTITION BY grp ORDER BY score DESC, fid DESC) AS next FROM s), t AS (SELECT *, max(CASE WHEN k = 1 THEN coalesce(score - next, 99) END) OVER (PARTITION BY grp) AS margin FROM r)"


def _ranked(spark, sf):
    w = Window.partitionBy("grp").orderBy(F.desc("score"), F.desc("fid"))
    s = view(spark, sf, "peaks").select("fid", (F.col("fid") % 97).alias("grp"), (((F.col("fid") * 37) % 101).cast("double") / 8).alias("score"))
    r = s.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("score").over(w))
    return r.withColumn("margin", F.max(F.when(F.col("k") == 1, F.coalesce(F.col("score") - F.col("next"), F.lit(99.0)))).over(Window.partitionBy("grp")))


@add("top2_margin", with_sql("peaks", more=_GROUP) + "SELECT grp, fid, margin, CASE WHEN margin >= 1.25 THEN 1 ELSE 0 END AS is_clear FROM t WHERE k = 1")
def _(spark, sf):
    # the two best of each part of a group, then of the group
    s = view(spark, sf, "peaks").select("fid", (F.col("fid") % 97).alias("grp"), (((F.col("fid") * 37) % 101).cast("double") / 8).alias("score"))
    two = lambda df, *by: df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("fid")))).filter("k <= 2")
    best = two(two(s.withColumn("salt", F.pmod(F.xxhash64("fid"), F.lit(64))), "grp", "salt"), "grp")
    first, second = F.max(F.when(F.col("k") == 1, F.struct("score", "fid"))), F.max(F.when(F.col("k") == 2, F.col("score")))
    t = best.groupBy("grp").agg(first.alias("a"), second.alias("next")).select("grp", "a.fid", F.coalesce(F.col("a.score") - F.col("next"), F.lit(99.0)).alias("margin"))
    return t.select("grp", "fid", "margin", F.when(F.col("margin") >= 1.25, 1).otherwise(0).alias("is_clear"))


@add("candidate_rank", with_sql("peaks", more=_GROUP) + "SELECT fid, grp, CASE WHEN margin >= 1.25 THEN least(k, 2) ELSE row_number() OVER (PARTITION BY grp ORDER BY score DESC, fid) END AS rank_ FROM t")
def _(spark, sf):
    plain = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "fid"))
    return _ranked(spark, sf).select("fid", "grp", F.when(F.col("margin") >= 1.25, F.least("k", F.lit(2))).otherwise(plain).alias("rank_"))


_NAMES = pick("p_partkey", " Großglockner", "GROSS-GLOCKNER ", "Ötscher  (Süd)", "KÃ¤rnten", "plain â", "", "Hohe Wand 7", None)


def _texts(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey AS k", f"concat({_NAMES}, ' ', p_name) AS s", f"{_NAMES} AS raw")


_TEXTS = f"WITH t AS (SELECT p_partkey AS k, {_NAMES} || ' ' || p_name AS s, {_NAMES} AS raw FROM part)\n"
_NORM = "trim(regexp_replace(replace(replace(replace(replace(lower({0}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))"


@add("norm_name", _TEXTS + f"SELECT k, {_NORM.format('s')} AS norm FROM t")
def _(spark, sf):
    return _texts(spark, sf).select("k", text.norm_name(F.col("s")).alias("norm"))


@add("name_match", _TEXTS + f"SELECT k, CASE WHEN {_NORM.format('raw')} <> '' AND {_NORM.format('raw')} = 'grossglockner' THEN 1 ELSE 0 END AS hit FROM t")
def _(spark, sf):
    return _texts(spark, sf).select("k", text.name_match(F.col("raw"), F.lit("GROSSGLOCKNER ")).alias("hit"))


_REPAIR = r"CASE WHEN regexp_matches({0}, '[ÃÂâ]') AND NOT regexp_matches({0}, '[^\x{{0}}-\x{{FF}}]') THEN coalesce(try(decode(from_hex(array_to_string(list_transform(string_split({0}, ''), lambda c: lpad(to_hex(ord(c)), 2, '0')), '')))), {0}) ELSE {0} END"


@add("mojibake", _TEXTS + f"SELECT k, {_REPAIR.format('raw')} AS fixed FROM t")
def _(spark, sf):
    return _texts(spark, sf).select("k", text.mojibake(F.col("raw")).alias("fixed"))


@add("parse_codes", "SELECT p_partkey AS k, array_to_string(list_sort(list_distinct([7301 + p_partkey % 3, 7302, 7300 + p_partkey % 5])), ',') AS codes FROM part")
def _(spark, sf):
    s = F.concat((7301 + F.col("p_partkey") % 3).cast("string"), F.lit(", 7302,x, "), (7300 + F.col("p_partkey") % 5).cast("string"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), text.parse_codes(s).alias("codes"))


@add("sanitize_fields", "SELECT p_partkey AS k, substring(p_name, 1, 8) AS short, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS whole FROM part")
def _(spark, sf):
    raw = F.when(F.col("p_partkey") % 3 == 0, "nan").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".9")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), text.clip(F.col("p_name"), 8).alias("short"), text.whole_number(raw).alias("whole"))
