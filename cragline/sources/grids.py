"""Raster grids as long tables, square tiles and plain GeoTIFF files (read whole, from any store that Spark reads; see tiff.py for
tiled files in many tasks).

A grid is pix, r, c, z with valid cells only. Tiles are Parquet rows (tr, tc, z array, row by row, null for missing),
partitioned by tile row, so a window reads the tiles that it touches.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 256


def write_tiles(dem: DataFrame, path: str, side: int = SIDE) -> None:
    """Write dem(r, c, z) as tiles. Of repeated cells the greatest stays; cells without z are missing; no cells, no tiles."""
    dem = dem.groupBy("r", "c").agg(F.max("z").alias("z"))
    cell = F.struct(((F.col("r") % side) * side + F.col("c") % side).cast("int").alias("k"), F.col("z"))
    rows = dem.groupBy(F.floor(F.col("r") / side).alias("tr"), F.floor(F.col("c") / side).alias("tc")).agg(F.map_from_entries(F.collect_list(cell)).alias("m"))  # one tile's cells at most
    rows.select("tr", "tc", F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: F.try_element_at("m", k)).alias("z")).write.partitionBy("tr").parquet(path)


def read_window(spark: SparkSession, path: str, r0: int, r1: int, c0: int, c1: int, side: int = SIDE) -> DataFrame:
    """r, c, z of the valid cells with r0 <= r < r1 and c0 <= c < c1; only their tiles are read."""
    tiles = spark.read.parquet(path).filter(F.col("tr").between(r0 // side, (r1 - 1) // side) & F.col("tc").between(c0 // side, (c1 - 1) // side))
    cells = tiles.select("tr", "tc", F.posexplode("z").alias("k", "z")).filter("z is not null")
    cells = cells.select((F.col("tr") * side + F.floor(F.col("k") / side)).alias("r"), (F.col("tc") * side + F.col("k") % side).alias("c"), "z")
    return cells.filter((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1))


def tiff_file(z: np.ndarray, origin: tuple[float, float], size: tuple[float, float], nodata: float, strip: int = 64, pack: bool = True) -> bytes:
    """A GeoTIFF of one float32 band in strips, deflated if `pack`."""
    h, w = z.shape
    parts = [z[k : k + strip].astype("<f4").tobytes() for k in range(0, h, strip)]
    parts = [zlib.compress(p) for p in parts] if pack else parts
    n = len(parts)
    text = f"{nodata:g}".encode() + b"\0"
    fields = [
        (256, 4, [w]), (257, 4, [h]), (258, 3, [32]), (259, 3, [8 if pack else 1]), (262, 3, [1]), (273, 4, [0] * n), (277, 3, [1]), (278, 4, [strip]),
        (279, 4, [len(p) for p in parts]), (339, 3, [3]), (33550, 12, [size[0], size[1], 0.0]), (33922, 12, [0.0, 0.0, 0.0, origin[0], origin[1], 0.0]), (42113, 2, text),
    ]
    kind = {3: "H", 4: "I", 12: "d"}
    extra, entries = b"", []
    head = 8 + 2 + 12 * len(fields) + 4
    for tag, t, v in fields:
        raw = v if t == 2 else struct.pack(f"<{len(v)}{kind[t]}", *v)
        entries.append([tag, t, len(v), raw, None])
        if len(raw) > 4:
            entries[-1][4] = head + len(extra)
            extra += raw
    at, places = head + len(extra), []
    for p in parts:
        places.append(at)
        at += len(p)
    for e in entries:
        if e[0] == 273:
            raw = struct.pack(f"<{n}I", *places)
            e[3] = raw
            if e[4] is not None:
                extra = extra[: e[4] - head] + raw + extra[e[4] - head + len(raw) :]
    table = b"".join(struct.pack("<HHI", t, k, n_) + (struct.pack("<I", place) if place is not None else raw.ljust(4, b"\0")) for t, k, n_, raw, place in entries)
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(fields)) + table + struct.pack("<I", 0) + extra + b"".join(parts)


def tiff_strips(content: bytes):
    """(tags, iterator of (first row, 2-d array)) of a one-band GeoTIFF in strips, plain or deflated."""
    order = "<" if content[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", content, 4)
    (n,) = struct.unpack_from(order + "H", content, at)
    size, kind = {1: 1, 2: 1, 3: 2, 4: 4, 12: 8}, {1: "B", 3: "H", 4: "I", 12: "d"}
    tags: dict = {}
    for k in range(n):
        tag, t, count, inline = struct.unpack_from(order + "HHI4s", content, at + 2 + 12 * k)
        if t not in size:
            continue
        raw = inline[: size[t] * count] if size[t] * count <= 4 else content[(p := struct.unpack(order + "I", inline)[0]) : p + size[t] * count]
        tags[tag] = raw.rstrip(b"\0").decode() if t == 2 else list(struct.unpack(f"{order}{count}{kind[t]}", raw))
    if tags.get(259, [1])[0] not in (1, 8, 32946) or 273 not in tags or tags.get(277, [1])[0] != 1:
        raise ValueError("only one band in strips, plain or deflated, is read")
    cell = {(3, 32): "f4", (3, 64): "f8", (2, 16): "i2", (2, 32): "i4", (1, 8): "u1", (1, 16): "u2", (1, 32): "u4"}[(tags.get(339, [1])[0], tags[258][0])]
    w, rows = tags[256][0], tags.get(278, tags[257])[0]

    def strips():
        for k, (p, size_) in enumerate(zip(tags[273], tags[279], strict=True)):
            raw = content[p : p + size_]
            raw = zlib.decompress(raw) if tags.get(259, [1])[0] != 1 else raw
            yield k * rows, np.frombuffer(raw, order + cell).reshape(-1, w)

    return tags, strips()


def read_tiff(spark: SparkSession, path: str) -> DataFrame:
    """file, r, c, z, x, y (cell centres) of the valid cells of each file at path: finite and not the no-data value."""

    def run(batches):
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                tags, strips = tiff_strips(content)
                dx, dy = tags.get(33550, [1.0, 1.0])[:2]
                i, j, _, x0, y0, _ = tags.get(33922, [0.0] * 6)
                nodata = float(tags[42113]) if 42113 in tags else np.nan
                for first, z in strips:
                    r, c = np.nonzero(np.isfinite(z) & (z != nodata))
                    yield pa.RecordBatch.from_pydict({"file": pa.array([file] * len(r), pa.string()), "r": pa.array(r + first, pa.int64()), "c": pa.array(c, pa.int64()), "z": pa.array(z[r, c].astype(np.float64)), "x": pa.array(x0 + (c + 0.5 - i) * dx), "y": pa.array(y0 - (r + first + 0.5 - j) * dy)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, r long, c long, z double, x double, y double")
