"""Sources, sinks, the staged run and polygon search on small hand-made inputs."""

import csv
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cragline.operators import spatial
from cragline.operators.export import keycol_values
from cragline.plans.stages import Stage, cascade, run_stages
from cragline.sources import delimited, grids, layers, sinks


def test_headers_are_found_by_alias():
    found = ["\ufeffAssociationName", " VALIDTO ", "SummitCode", "Name", "summitname", "AltM", "lat", "Lon"]
    assert delimited.headers(found) == dict(zip(delimited.ALIASES, [found[0], found[1], "SummitCode", "summitname", "AltM", "lat", "Lon"], strict=True))
    with pytest.raises(ValueError, match="lon"):
        delimited.headers(found[:-1])


def test_reference_rows(spark, tmp_path):
    text = "\ufeffAssociationName,ValidTo,SummitCode,SummitName,AltM,Latitude,Longitude\n"
    text += "A,31/12/2099,c1,n1,1000,47.5,13\nA,31/12/2098,c2,n2,1000,47.5,13\nB,31/12/2099,c3,n3,,47,13\nA,31/12/2099,c4,n4,x,47,13\nA,31/12/2099,c5,n5,1,nan,13\nA,31/12/2099,c6,,900,46,\n"
    (tmp_path / "t.csv").write_text(text, encoding="utf-8")
    t = delimited.read_table(spark, str(tmp_path / "t.csv"))
    both = delimited.reference_rows(t, F.col("association") == "A", True).orderBy("code").collect()
    assert [tuple(r) for r in both] == [("c1", "n1", 1000.0, 47.5, 13.0, 0), ("c3", "n3", None, 47.0, 13.0, 1)]
    assert [r["code"] for r in delimited.reference_rows(t, F.col("association") == "A").collect()] == ["c1"]


#: What the headers of a reference table may be called.
HEADERS = {"association": "AssociationName Association", "valid_to": "ValidTo valid_to validto", "code": "SummitCode summitcode summit_code Code", "name": "SummitName summitname summit_name Name", "alt": "AltM altm Altitude altitude elev_m", "lat": "Latitude latitude lat", "lon": "Longitude longitude lon lng"}


@pytest.mark.parametrize("column, alias", [(c, a) for c, names in HEADERS.items() for a in names.split()])
def test_every_alias(column, alias):
    found = [f" {alias.upper()} " if c == column else names.split()[0] for c, names in HEADERS.items()]
    assert delimited.headers(found)[column] == f" {alias.upper()} "


def test_records_like_the_csv_module(spark, tmp_path):
    """Quoted quotes, commas, line breaks, short and long records, blank lines: the rows that Python's reader gives."""
    text = "\ufeffAssociation,valid_to,Code,summit_name,elev_m,lat,lng\n"
    text += 'A,31/12/2099, c1 ,"Ho ""Klein"", Nord",1000,47.5,13\nA, 31/12/2099 ,c2,"zwei\nZeilen",,47.5, 13 \n\n"A",31/12/2099,c3\nA,31/12/2099,c4,"",5,46,12,mehr\nA,31/12/2099,,n5,  ,46,12\nB,31/12/2099,c6,a "b" c,7,46,12\n'
    (tmp_path / "t.csv").write_text(text, encoding="utf-8")
    want = []
    with open(tmp_path / "t.csv", newline="", encoding="utf-8-sig") as f:
        for row in csv.DictReader(f):
            try:
                alt = float(row["elev_m"]) if row["elev_m"] else None
                want.append(((row["Code"] or "").strip(), (row["summit_name"] or "").strip(), alt, float(row["lat"]), float(row["lng"]), int(row["Association"] != "A")))
            except (TypeError, ValueError):
                continue
    t = delimited.read_table(spark, str(tmp_path / "t.csv"))
    got = [tuple(r) for r in delimited.reference_rows(t, F.col("association") == "A", True).collect()]
    assert sorted(got) == sorted(want) and len(want) == 4


def test_point_blobs():
    for envelope in range(5):
        for little in (True, False):
            assert layers.point_of(layers.point_blob(1.5, -2.25, envelope, little)) == (1.5, -2.25)
    line = layers.point_blob(1.0, 2.0)
    for odd in (None, b"", b"GP", b"XX" + line[2:], line[:-1], line[:3] + b"\x0f" + line[4:], line[:9] + b"\x02" + line[10:], layers.point_blob(float("nan"), 1.0)):
        assert layers.point_of(odd) == (None, None)


def test_layers_are_chosen_by_fields(spark, tmp_path):
    file = layers.layer_file({"a": (["ID"], [(1, 0.0, 0.0)]), "b": (["ID", "NAME"], [(7, None, 1.0, 2.0), (8, "x", 3.0, 4.0)])})
    (tmp_path / "f.gpkg").write_bytes(file)
    read = lambda wanted, fields: layers.read_layer(spark, str(tmp_path / "f.gpkg"), "id long, name string, more double", wanted, fields)
    assert {r["layer"] for r in read(["b"], []).collect()} == {"b"} and {r["layer"] for r in read(["zz"], []).collect()} == {"a"}
    got = read(["a"], [{"NAME", "Name"}]).orderBy("id").collect()
    assert [(r["id"], r["name"], r["more"], r["x"], r["y"]) for r in got] == [(7, None, None, 1.0, 2.0), (8, "x", None, 3.0, 4.0)]
    with pytest.raises(Exception, match="no layer"):
        read([], [{"F_CODE"}]).collect()


def test_update_and_columns(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, None, 5)], "k long, v string, w int")
    assert sorted(map(tuple, layers.update(rows, new, "k").collect()), key=repr) == [(1, "a", None), (2, None, 5)]
    assert layers.ensure_columns(rows, "k long, x double").dtypes == [("k", "bigint"), ("v", "string"), ("x", "double")]
    with pytest.raises(ValueError, match="zz"):
        layers.ensure_columns(rows, "k long", ["zz"])


@pytest.mark.parametrize("pack", [True, False])
def test_raster_files(spark, tmp_path, pack):
    z = np.random.default_rng(1).integers(-50, 50, (130, 9)).astype(float)
    z[5, 3] = np.nan
    (tmp_path / "g.tif").write_bytes(grids.tiff_file(z, (100.0, 900.0), (2.0, 4.0), -7, 64, pack))
    got = {(r["r"], r["c"]): (r["z"], r["x"], r["y"]) for r in grids.read_tiff(spark, str(tmp_path / "g.tif")).collect()}
    assert got == {(r, c): (z[r, c], 101.0 + 2 * c, 898.0 - 4 * r) for r in range(130) for c in range(9) if z[r, c] != -7 and z[r, c] == z[r, c]}


def test_tiles(spark, tmp_path):
    rng = random.Random(2)
    z = {(r, c): rng.randrange(99) for r in range(40) for c in range(25) if rng.random() < 0.8}
    grids.write_tiles(spark.createDataFrame([(*k, v) for k, v in z.items()], "r long, c long, z int"), str(tmp_path / "t"), 16)
    got = {(r["r"], r["c"]): r["z"] for r in grids.read_window(spark, str(tmp_path / "t"), 3, 33, 0, 20, 16).collect()}
    assert got == {(r, c): v for (r, c), v in z.items() if 3 <= r < 33 and c < 20}


def test_tiles_of_repeated_and_missing_cells(spark, tmp_path):
    rows = [(0, 0, 1), (0, 0, 7), (0, 0, None), (0, 1, None), (5, 5, 2), (5, 5, 2)]
    grids.write_tiles(spark.createDataFrame(rows, "r long, c long, z int"), str(tmp_path / "t"), 4)
    assert sorted((r["r"], r["c"], r["z"]) for r in grids.read_window(spark, str(tmp_path / "t"), 0, 9, 0, 9, 4).collect()) == [(0, 0, 7), (5, 5, 2)]


def test_stages(spark, tmp_path):
    ran = []

    def make(name, *inputs):
        def run(s, read, config):
            ran.append(name)
            assert set(read) == set(inputs)
            return s.range(config["n"])

        return Stage(name, run, list(inputs))

    stages = [make("a"), make("b", "a"), make("c", "b"), make("d", "a")]
    assert cascade(stages, {"b"}) == {"b", "c"} and cascade(stages, {"a"}) == {"a", "b", "c", "d"}
    folder = str(tmp_path)
    with pytest.raises(ValueError, match="needs a"):
        run_stages(spark, stages, folder, {"n": 3}, skip={"a"})
    assert [d for _, d in run_stages(spark, stages, folder, {"n": 3})] == ["DONE"] * 4
    assert [d for _, d in run_stages(spark, stages, folder, {"n": 4}, force={"b"})] == ["SKIP", "DONE", "DONE", "SKIP"]
    assert spark.read.parquet(f"{folder}/c").count() == 4 and spark.read.parquet(f"{folder}/d").count() == 3
    (tmp_path / "d" / "_SUCCESS").unlink()  # a run that did not end
    assert run_stages(spark, stages, folder, {"n": 5}, only={"d"})[3] == ("d", "DONE") and spark.read.parquet(f"{folder}/d").count() == 5
    assert [d for _, d in run_stages(spark, stages, f"{folder}/region", {"n": 1}, skip={"d"})] == ["DONE", "DONE", "DONE", "LEFT OUT"]
    with pytest.raises(ValueError, match="no such"):
        run_stages(spark, stages, folder, force={"x"})


def test_nearest_higher_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(300), rng.randrange(300), rng.randrange(20), *rng.choice([(rng.randrange(300), rng.randrange(300)), (None, None)])) for i in range(70)]
    df = spark.createDataFrame(rows, "fid long, x long, y long, z int, kx long, ky long")
    got = {r["fid"]: r["target"] for r in spatial.nearest_higher(df, [20.0, 60.0, 500.0]).collect()}
    for i, _, _, z, kx, ky in rows:
        want = None
        for radius in (20, 60, 500) if kx is not None else ():
            hits = [((x - kx) ** 2 + (y - ky) ** 2, j) for j, x, y, h, _, _ in rows if h > z and abs(x - kx) <= radius and abs(y - ky) <= radius]
            if hits:
                want = min(hits)[1]
                break
        assert got[i] == want, i


def test_areas_on_their_border(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    areas = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ring]), (2, [{"x": x + 10.5, "y": y} for x, y in ring])], "land_id int, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 10.2, 5.0), (3, 10.4, 5.0), (4, 21.4, 5.0), (5, 22.0, 5.0), (6, -0.9, -0.1)], "fid long, x double, y double")
    assert {r["fid"]: r["land_id"] for r in spatial.locate(points, areas, 4.0).collect()} == {1: 1, 2: 1, 3: 2, 4: 2, 6: 1}


def test_keycol_values_of_rows_without_anything(spark):
    rows = spark.createDataFrame([(1, 0, 0, None, None, None, None, None), (2, 0, 0, 500, 9, None, None, 30), (3, 0, 0, 500, None, 1, 1, None)], "bid long, x long, y long, alt int, raw_id long, kx long, ky long, raw_prom int")
    raw = spark.createDataFrame([(7, -7, 900, 0, 100, 10, 5, 5, 90)], "fid long, attr long, x long, y long, z int, prom int, kx long, ky long, keycol int")
    got = {r["bid"]: tuple(r)[1:] for r in keycol_values(rows, raw, 600.0).collect()}
    assert got == {1: (None, None, None, None, None, None, None), 2: (9, None, None, None, 470, 500, 30), 3: (None, None, 1, 1, None, 500, None)}
    assert keycol_values(rows, raw, 1000.0).filter("raw_peak = 7 and raw_dist = 900 and z_saddle = 90").count() == 3


def test_layers_in_one_pass(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50), (4, 500)], "k int, v int")
    path = str(tmp_path / "layers")
    small, all_ = (F.col("v") < 100, F.struct("k", "v")), (F.lit(True), F.struct("k"))
    seen = sinks.write_layers(df, {"small": small, "every": all_, "none": (F.col("v") > 999, F.struct("v"))}, path, {"total": F.sum("small.v")})
    assert seen == {"small": 2, "every": 4, "none": 0, "total": 55}
    back = spark.read.parquet(path)
    assert sorted(tuple(r) for r in sinks.read_layer(back, "small").collect()) == [(1, 5), (3, 50)]
    assert sorted(r["k"] for r in sinks.read_layer(back, "every").collect()) == [1, 2, 3, 4]
    empty = sinks.write_layers(df.limit(0), {"small": small}, str(tmp_path / "empty"))
    assert empty == {"small": 0}


def test_layers_written_by_tasks(spark, tmp_path):
    path = f"file://{tmp_path}/l"
    rows = [(k, f"n{k}" if k % 3 else None, float(k), None if k % 5 == 0 else -float(k)) for k in range(103)]
    cells = spark.createDataFrame(rows, "ID long, NAME string, x double, y double")
    layers.write_points(cells.repartition(3), path, "a", file_rows=10)
    got = layers.read_layer(spark, path + "/*.gpkg", "id long, name string")
    assert got.select("file").distinct().count() >= 11
    assert sorted(tuple(r) for r in got.select("id", "layer", "name", "x", "y").collect()) == sorted((k, "a", n, None if y is None else x, y) for k, n, x, y in rows)
    layers.write_points(cells.filter("ID < 2"), path, "a")
    assert sorted(r["id"] for r in layers.read_layer(spark, path + "/*.gpkg", "id long").collect()) == [0, 1]
    assert not [p for p in (tmp_path / "l").iterdir() if p.name.startswith(".") and p.name.endswith(".gpkg")]
    layers.write_points(cells.filter("ID < 1"), path, "a", mode="append")
    assert layers.read_layer(spark, path + "/*.gpkg", "id long").count() == 3
