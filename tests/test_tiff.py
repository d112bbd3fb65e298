"""Tiled GeoTIFF files: packing, headers, windows that read their tiles only, writers that run in many tasks."""

import random
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest

from cragline.sources import grids, tiff


def nine_bits(codes):
    bits = "".join(f"{c:09b}" for c in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


def test_lzw_example_of_the_format():
    data = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.lzw_encode(data) == nine_bits([256, 7, 258, 8, 8, 258, 6, 6, 257])
    assert tiff.lzw_decode(nine_bits([256, 7, 258, 8, 8, 258, 6, 6, 257])) == data


@pytest.mark.parametrize("n", [0, 1, 2, 254, 255, 256, 257, 510, 511, 3_000, 3_835, 3_836, 3_837, 3_838, 60_000])
def test_lzw_round_trip(n):
    rng = random.Random(n)
    for values in (256, 3, 1):
        data = bytes(rng.randrange(values) for _ in range(n))
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def grid(spark, rows, cols, seed, keep=0.9, low=-500):
    rng = random.Random(seed)
    z = {(r, c): float(rng.randrange(low, 500)) for r in range(rows) for c in range(cols) if rng.random() < keep}
    return z, spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "r long, c long, z double")


@pytest.mark.parametrize(("compress", "cell", "big"), [("lzw", "f4", True), ("deflate", "f8", False), ("none", "i2", True), ("lzw", "i4", False)])
def test_round_trip(spark, tmp_path, compress, cell, big):
    z, cells = grid(spark, 100, 70, 4)
    path = f"file://{tmp_path}/g"
    tiff.write_grid(cells, path, (100.0, 900.0), (2.0, 4.0), -9999, compress, cell, 16, 2, big, 32633)
    files = sorted(p.name for p in Path(tmp_path, "g").iterdir())
    assert files == sorted(f"r{i}_c{j}.tif" for i in range(4) for j in range(3))
    got = {(x["r"], x["c"]): (x["z"], x["x"], x["y"]) for x in tiff.read_grid(spark, path, (100.0, 900.0)).collect()}
    assert got == {(r, c): (v, 101.0 + 2 * c, 898.0 - 4 * r) for (r, c), v in z.items()}


def test_window_reads_its_tiles_only(spark, tmp_path):
    z, cells = grid(spark, 128, 64, 5, 1.0)
    path = f"file://{tmp_path}/g"
    tiff.write_grid(cells, path, (0.0, 0.0), (1.0, 1.0), compress="deflate", side=16, block=4)
    for p in Path(tmp_path, "g").iterdir():  # break every tile but those of rows 16 to 47, columns 16 to 31
        with open(p, "r+b") as f:
            h = tiff.read_header(f)
            r0 = int(p.name[1]) * 64
            for k, (at, n) in enumerate(zip(h.offsets, h.lengths, strict=True)):
                if not (16 <= r0 + k // h.across * 16 < 48 and k % h.across == 1):
                    f.seek(at)
                    f.write(b"\xff" * n)
    read = lambda **window: tiff.read_grid(spark, path, (0.0, 0.0), window)
    want = sorted((r, c, v) for (r, c), v in z.items() if 20 <= r <= 40 and 17 <= c < 30)
    by_index = read(r=(20, 40), c=(17, 29))
    by_place = read(x=(17, 30), y=(-41, -20))
    assert sorted((x.r, x.c, x.z) for x in by_index.collect()) == want
    assert sorted((x.r, x.c, x.z) for x in by_place.collect()) == want
    assert read(r=(30, 30), c=(20, 20)).count() == 1
    assert by_index.join(by_place, ["r", "c"]).count() == len(want)
    with pytest.raises(Exception, match="can't be read"):
        read().count()
    with pytest.raises(ValueError, match="window"):
        read(row=(1, 2))


def test_one_file_in_many_ranges(spark, tmp_path):
    z, cells = grid(spark, 96, 96, 6)
    path = f"file://{tmp_path}/g"
    tiff.write_grid(cells, path, (0.0, 0.0), (1.0, 1.0), side=16, block=8)
    got = tiff.read_grid(spark, path, range_cells=4 * 256)
    assert got.rdd.getNumPartitions() == 9
    assert got.select("file").distinct().count() == 1
    assert {(x.r, x.c): x.z for x in got.collect()} == z


def test_odd_grids(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    rows = [(0, 0, 1.0, "x"), (0, 0, 7.0, "y"), (0, 1, None, "x"), (0, 2, float("nan"), "x"), (-5, -20, 3.0, None), (900, 0, 4.0, "x")]
    tiff.write_grid(spark.createDataFrame(rows, "r long, c long, z double, y string"), path, (0.0, 0.0), (1.0, 1.0), side=16, block=2)
    got = {(x.r, x.c): x.z for x in tiff.read_grid(spark, path, (0.0, 0.0)).collect()}
    assert got == {(0, 0): 7.0, (-5, -20): 3.0, (900, 0): 4.0}
    again = spark.createDataFrame([(0, 0, 2.0)], "r long, c long, z double")
    tiff.write_grid(again, path, (0.0, 0.0), (1.0, 1.0), side=16, block=2)
    assert [(x.r, x.c, x.z) for x in tiff.read_grid(spark, path).collect()] == [(0, 0, 2.0)]
    tiff.write_grid(again.limit(0), path, (0.0, 0.0), (1.0, 1.0), side=16, block=2)
    assert tiff.read_grid(spark, path).count() == 0
    with pytest.raises(ValueError, match="compress"):
        tiff.write_grid(again, path, (0.0, 0.0), (1.0, 1.0), compress="zip")


@pytest.mark.parametrize("pack", [True, False])
def test_files_in_strips(spark, tmp_path, pack):
    z = np.random.default_rng(1).integers(-50, 50, (130, 9)).astype(float)
    z[5, 3] = np.nan
    Path(tmp_path, "g.TIF").write_bytes(grids.tiff_file(z, (100.0, 900.0), (2.0, 4.0), -7, 64, pack))
    got = {(x.r, x.c): (x.z, x.x, x.y) for x in tiff.read_grid(spark, f"file://{tmp_path}/g.TIF").collect()}
    assert got == {(r, c): (z[r, c], 101.0 + 2 * c, 898.0 - 4 * r) for r in range(130) for c in range(9) if np.isfinite(z[r, c]) and z[r, c] != -7}
    assert tiff.read_grid(spark, f"file://{tmp_path}", window={"r": (70, 1000)}).count() == sum(r >= 70 for r, _ in got)


def header(cell, predictor, width=5):
    return tiff.Header("<", width, 3, (3, width), cell, 8, predictor, np.nan, (0, 0), (1, 1), np.zeros(1, np.int64), np.zeros(1, np.int64))


def test_predictors():
    z = np.array([[5, 9, 2, 2, 70], [-3, -3, 8, 0, 1], [300, 1, -300, 4, 4]], "<i2")
    plain = z.view("<u2").copy()
    plain[:, 1:] -= z.view("<u2")[:, :-1]
    assert (tiff.decode(zlib.compress(plain.tobytes()), header("i2", 2)) == z).all()
    f = (z / 7).astype("<f4")
    planes = f.astype(">f4").view(np.uint8).reshape(3, 5, 4).transpose(0, 2, 1).reshape(3, 20).copy()
    planes[:, 1:] -= planes[:, :-1].copy()
    assert (tiff.decode(zlib.compress(planes.tobytes()), header("f4", 3)) == f).all()


def test_what_is_refused(tmp_path):
    for name, content in (("short", b"II*\0"), ("text", b"no picture at all"), ("cut", struct.pack("<2sHI", b"II", 42, 8) + b"\x05\0")):
        p = Path(tmp_path, name)
        p.write_bytes(content)
        with open(p, "rb") as f, pytest.raises((ValueError, struct.error)):
            tiff.read_header(f, name)
