"""Tiled, compressed GeoTIFF files as a Spark data source.

A grid is a folder of files, each a block of tiles, written by as many tasks as there are blocks. Reading plans one
partition for each range of tiles; the driver reads headers only. A window in r, c, x or y chooses the files and tiles to
read. It is an argument and not taken from filters: Spark 4.1 keeps what a Python source was once told to leave out for
every later use of the same DataFrame. Classic and BigTIFF files of one band are read, in tiles or strips, plain, deflated or LZW, with either predictor.

Defined results: cells that are null, NaN, infinite or the no-data value are not there; a tile without cells is not stored; of repeated
cells the greatest stays; a grid without cells gives a folder without files, which reads as no rows; further
columns are not written. A task that runs twice writes the same files under the same names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators import tiles

FORMAT = "cragline_tiff"
SCHEMA = "file string, r long, c long, z double, x double, y double"
#: Tiles a side of a written file: 8 x 8 tiles of 256 x 256 cells are 16 MB before compression.
BLOCK = 8
#: Cells that one partition reads at most, unless a single tile or strip is larger.
RANGE_CELLS = 4 << 20

# Fixed values of the TIFF 6.0 and BigTIFF formats: bytes and struct letter of each field type, compression names.
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 12: 8, 16: 8}
_LETTER = {1: "B", 3: "H", 4: "I", 12: "d", 16: "Q"}
_COMPRESSION = {"none": 1, "lzw": 5, "deflate": 8}
_CELL = {(3, 32): "f4", (3, 64): "f8", (2, 16): "i2", (2, 32): "i4", (1, 8): "u1", (1, 16): "u2", (1, 32): "u4"}


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: 9 to 12 bit codes from the high bit on, widths change one code early."""
    acc, bits, out = 256, 9, bytearray()
    table: dict = {}
    free, width, last = 258, 9, None

    def put(code):
        nonlocal acc, bits
        acc, bits = (acc << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((acc >> bits) & 255)
        acc &= (1 << bits) - 1

    def grow():
        nonlocal free, width
        free += 1
        if free == 4094:
            put(256)
            table.clear()
            free, width = 258, 9
        elif free >= 1 << width:
            width += 1

    for byte in data:
        if last is None:
            last = byte
        elif (code := table.get((last, byte))) is not None:
            last = code
        else:
            put(last)
            table[last, byte] = free
            grow()
            last = byte
    if last is not None:
        put(last)
        grow()
    put(257)
    return bytes(out) + (bytes([(acc << (8 - bits)) & 255]) if bits else b"")


def lzw_decode(data: bytes) -> bytes:
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, before = list(first), [], b""
    acc = bits = 0
    width = 9
    for byte in data:
        acc, bits = (acc << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, before = list(first), 9, b""
            continue
        if code > len(table) or (code == len(table) and not before):
            raise ValueError("broken LZW data")
        word = table[code] if code < len(table) else before + before[:1]
        out.append(word)
        if before:
            table.append(before + word[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        before = word
    return b"".join(out)


@dataclass
class Header:
    """Where the tiles of one file lie, and what is in them. A strip is a tile as wide as the file."""

    order: str
    width: int
    height: int
    tile: tuple[int, int]
    cell: str
    compression: int
    predictor: int
    nodata: float
    origin: tuple[float, float]
    size: tuple[float, float]
    offsets: np.ndarray
    lengths: np.ndarray

    @property
    def across(self) -> int:
        return -(-self.width // self.tile[1])


def read_header(f, name: str = "file") -> Header:
    """The first directory of an open GeoTIFF; only the header's own bytes are read."""

    def get(at, n):
        f.seek(at)
        raw = f.read(n)
        if len(raw) < n:
            raise ValueError(f"{name} ends within its header")
        return raw

    head = get(0, 8)
    if head[:2] not in (b"II", b"MM"):
        raise ValueError(f"{name} is no TIFF")
    order = "<" if head[:2] == b"II" else ">"
    (version,) = struct.unpack(order + "H", head[2:4])
    if version not in (42, 43):
        raise ValueError(f"{name} is no TIFF")
    big = version == 43
    word, step, inline = ("Q", 20, 8) if big else ("I", 12, 4)
    (at,) = struct.unpack(order + word, get(8, 8) if big else head[4:])
    (n,) = struct.unpack(order + ("Q" if big else "H"), get(at, 8 if big else 2))
    at += 8 if big else 2
    entries = get(at, n * step)
    tags: dict = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HH" + word, entries, k * step)
        if kind not in _SIZE:
            continue
        raw = entries[(k + 1) * step - inline : (k + 1) * step]
        size = _SIZE[kind] * count
        raw = raw[:size] if size <= inline else get(struct.unpack(order + word, raw)[0], size)
        if kind == 2:
            tags[tag] = raw.split(b"\0")[0].decode()
        elif kind in _LETTER:
            tags[tag] = np.frombuffer(raw, np.dtype(order + {"B": "u1", "H": "u2", "I": "u4", "d": "f8", "Q": "u8"}[_LETTER[kind]]))
    one = lambda tag, default: int(tags[tag][0]) if tag in tags else default
    width, height = one(256, 0), one(257, 0)
    tiled = 324 in tags
    cell = _CELL.get((one(339, 1), one(258, 1)))
    if cell is None or one(277, 1) != 1 or one(259, 1) not in (1, 5, 8, 32946) or one(317, 1) not in (1, 2, 3) or not (tiled or 273 in tags):
        raise ValueError(f"{name}: only one band of whole or floating cells is read, plain, deflated or LZW")
    dx, dy = [float(v) for v in tags.get(33550, [1.0, 1.0])][:2]
    i, j, _, x0, y0, _ = [float(v) for v in tags.get(33922, [0.0] * 6)][:6]
    return Header(
        order, width, height, (one(323, 0), one(322, 0)) if tiled else (min(one(278, height), height), width), cell, one(259, 1), one(317, 1),
        float(tags[42113]) if tags.get(42113, "").strip() else np.nan, (x0 - i * dx, y0 + j * dy), (dx, dy),
        tags[324 if tiled else 273].astype(np.int64), tags[325 if tiled else 279].astype(np.int64),
    )


def decode(raw: bytes, h: Header) -> np.ndarray:
    """The cells of one tile or strip, rows x width."""
    raw = lzw_decode(raw) if h.compression == 5 else raw if h.compression == 1 else zlib.decompress(raw)
    w, kind = h.tile[1], np.dtype(h.order + h.cell)
    if h.predictor == 3:  # bytes of a row by significance, each the difference to the one before
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(-1, w * kind.itemsize), axis=1, dtype=np.uint8)
        return np.ascontiguousarray(planes.reshape(-1, kind.itemsize, w).transpose(0, 2, 1)).view(">" + h.cell)[:, :, 0]
    z = np.frombuffer(raw, kind).reshape(-1, w)
    if h.predictor == 2:
        z = np.cumsum(z.view(h.order + f"u{kind.itemsize}").astype(f"u{kind.itemsize}"), axis=1, dtype=f"u{kind.itemsize}").view(h.cell)
    return z


def tiled_file(parts: dict[tuple[int, int], np.ndarray], origin, size, nodata: float, compress: str = "lzw", big: bool = True, epsg: int | None = None) -> bytes:
    """A GeoTIFF of one band from its square tiles by (row, column); tiles that are not given are stored as empty."""
    down, across = (max(k[i] for k in parts) + 1 for i in (0, 1))
    any_tile = next(iter(parts.values()))
    side, cell = any_tile.shape[0], any_tile.dtype.str[1:]
    pack = {"none": bytes, "lzw": lzw_encode, "deflate": zlib.compress}[compress]
    form, bits = next(k for k, v in _CELL.items() if v == cell)
    word, inline = ("Q", 8) if big else ("I", 4)
    offsets, lengths, body, at = [0] * (down * across), [0] * (down * across), [], 16 if big else 8
    for (i, j), z in sorted(parts.items()):
        raw = pack(z.astype(z.dtype.newbyteorder("<")).tobytes())
        offsets[i * across + j], lengths[i * across + j] = at, len(raw)
        body.append(raw)
        at += len(raw)
    long = 16 if big else 4
    fields = [
        (256, 4, [across * side]), (257, 4, [down * side]), (258, 3, [bits]), (259, 3, [_COMPRESSION[compress]]), (262, 3, [1]), (277, 3, [1]), (322, 4, [side]), (323, 4, [side]),
        (324, long, offsets), (325, long, lengths), (339, 3, [form]), (33550, 12, [*size, 0.0]), (33922, 12, [0.0, 0.0, 0.0, *origin, 0.0]),
        *([(34735, 3, [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg])] if epsg else []), (42113, 2, f"{nodata!r}".encode() + b"\0"),
    ]
    extra, table = [], []
    for tag, kind, values in fields:
        raw = values if kind == 2 else struct.pack(f"<{len(values)}{_LETTER[kind]}", *values)
        place = raw.ljust(inline, b"\0")
        if len(raw) > inline:
            place = struct.pack("<" + word, at)
            extra.append(raw)
            at += len(raw)
        table.append(struct.pack("<HH" + word, tag, kind, len(values)) + place)
    if not big and at >= 1 << 32:
        raise ValueError("more than 4 GB need BigTIFF")
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if big else struct.pack("<2sHI", b"II", 42, at)
    return b"".join([head, *body, *extra, struct.pack("<" + ("Q" if big else "H"), len(table)), *table, struct.pack("<" + word, 0)])


@dataclass
class TileRange(InputPartition):
    """Some tiles of one file."""

    path: str
    header: Header
    tiles: list[int]
    shift: tuple[int, int]

    def __init__(self, path, header, tiles, shift):
        super().__init__(None)
        self.path, self.header, self.tiles, self.shift = path, header, tiles, shift


class TiffReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.bounds = {k: (float(options.get(f"{k}_min", -np.inf)), float(options.get(f"{k}_max", np.inf))) for k in "rcxy"}
        self.origin = (float(options["x0"]), float(options["y0"])) if "x0" in options else None
        self.range_cells = int(options.get("range_cells", RANGE_CELLS))

    def partitions(self):
        system, root = pafs.FileSystem.from_uri(self.path)
        info = system.get_file_info(root)
        found = system.get_file_info(pafs.FileSelector(root, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        names = sorted(x.path for x in found if x.is_file and x.path.lower().endswith((".tif", ".tiff")))

        def open_(name):
            with system.open_input_file(name) as f:
                return read_header(f, name)

        with ThreadPoolExecutor(16) as pool:
            ranges = [part for name, h in zip(names, pool.map(open_, names), strict=True) for part in self._ranges(name, h)]
        return ranges or [TileRange("", None, [], (0, 0))]

    def _ranges(self, name: str, h: Header):
        shift = (0, 0)
        if self.origin:
            shift = (round((self.origin[1] - h.origin[1]) / h.size[1]), round((h.origin[0] - self.origin[0]) / h.size[0]))
        index = np.arange(len(h.offsets))
        r, c = index // h.across * h.tile[0], index % h.across * h.tile[1]
        r1, c1 = np.minimum(r + h.tile[0], h.height) - 1, np.minimum(c + h.tile[1], h.width) - 1
        x = lambda k: h.origin[0] + (k + 0.5) * h.size[0]
        y = lambda k: h.origin[1] - (k + 0.5) * h.size[1]
        low, high = {"r": r + shift[0], "c": c + shift[1], "x": x(c), "y": y(r1)}, {"r": r1 + shift[0], "c": c1 + shift[1], "x": x(c1), "y": y(r)}
        ok = h.lengths > 0
        for k, (a, z) in self.bounds.items():
            ok &= (high[k] >= a) & (low[k] <= z)
        index = index[ok]
        step = max(1, self.range_cells // (h.tile[0] * h.tile[1]))
        for k in range(0, len(index), step):
            part = index[k : k + step]
            yield TileRange(name, Header(**(vars(h) | {"offsets": h.offsets[part], "lengths": h.lengths[part]})), part.tolist(), shift)

    def read(self, partition):
        if not partition.path:
            return
        system, _ = pafs.FileSystem.from_uri(self.path)
        h = partition.header
        with system.open_input_file(partition.path) as f:
            for k, at, n in zip(partition.tiles, h.offsets.tolist(), h.lengths.tolist(), strict=True):
                f.seek(at)
                raw = f.read(n)
                r0, c0 = k // h.across * h.tile[0], k % h.across * h.tile[1]
                try:
                    z = decode(raw, h)[: h.height - r0, : h.width - c0]
                except (ValueError, zlib.error) as e:
                    raise ValueError(f"{partition.path}: tile {k} can't be read: {e}") from e
                r, c = np.nonzero(np.isfinite(z) & (z != h.nodata))
                v = z[r, c].astype(np.float64)
                r, c = r + r0, c + c0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.path] * len(r), pa.string()), pa.array(r + partition.shift[0], pa.int64()), pa.array(c + partition.shift[1], pa.int64()), pa.array(v), pa.array(h.origin[0] + (c + 0.5) * h.size[0]), pa.array(h.origin[1] - (r + 0.5) * h.size[1])],
                    names=["file", "r", "c", "z", "x", "y"],
                )


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class TiffWriter(DataSourceArrowWriter):
    """Rows br, bc, tr, tc, z: the tiles of a block come together."""

    def __init__(self, options, overwrite: bool):
        self.options, self.overwrite = dict(options), overwrite

    def write(self, iterator):
        o = self.options
        system, root = pafs.FileSystem.from_uri(o["path"])
        side, block, kind, nodata = int(o["side"]), int(o["block"]), o["cell"], float(o["nodata"])
        size, names = (float(o["dx"]), float(o["dy"])), []
        system.create_dir(root, recursive=True)

        def close(at, parts):
            if not parts:
                return
            origin = (float(o["x0"]) + at[1] * block * side * size[0], float(o["y0"]) - at[0] * block * side * size[1])
            name = f"r{at[0]}_c{at[1]}.tif"
            hidden = f"{root}/.part-{uuid.uuid4().hex}"
            with system.open_output_stream(hidden) as f:
                f.write(tiled_file(parts, origin, size, nodata, o["compress"], o["big"] == "true", int(o["epsg"]) if "epsg" in o else None))
            system.move(hidden, f"{root}/{name}")
            names.append(name)

        at, parts = None, {}
        for b in iterator:
            for row in b.to_pylist():
                if (row["br"], row["bc"]) != at:
                    close(at, parts)
                    at, parts = (row["br"], row["bc"]), {}
                z = tiles.widen(row["z"], "f8", side)
                if (there := np.isfinite(z)).any():
                    parts[row["tr"] - at[0] * block, row["tc"] - at[1] * block] = np.where(there, z, nodata).astype(kind)
        close(at, parts)
        return Written(names)

    def commit(self, messages):
        """Leave whole files only; overwriting also removes those that this write has not made."""
        system, root = pafs.FileSystem.from_uri(self.options["path"])
        mine = {n for m in messages if m for n in m.names}
        for x in system.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if x.base_name.startswith(".part-") or (self.overwrite and x.base_name.endswith(".tif") and x.base_name not in mine):
                system.delete_file(x.path)

    def abort(self, messages):
        system, root = pafs.FileSystem.from_uri(self.options["path"])
        for x in system.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if x.base_name.startswith(".part-"):
                system.delete_file(x.path)


class TiffSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TiffReader(self.options)

    def writer(self, schema, overwrite):
        return TiffWriter(self.options, overwrite)


def write_grid(cells: DataFrame, path: str, origin: tuple[float, float], size: tuple[float, float], nodata: float = -9999.0, compress: str = "lzw", cell: str = "f4", side: int = tiles.SIDE, block: int = BLOCK, big: bool = True, epsg: int | None = None) -> None:
    """Write cells(r, c, z) to the folder as tiled files, one for each block; row 0, column 0 has its outer corner at origin.

    compress: none, lzw or deflate; cell: f4, f8, i2, i4, u1, u2 or u4; epsg: the projected system's code.
    """
    if side % 16 or compress not in _COMPRESSION or cell not in _CELL.values():
        raise ValueError("sides are multiples of 16; compress is none, lzw or deflate; cell is a known type")
    cells.sparkSession.dataSource.register(TiffSource)
    packed = tiles.pack(cells, {"z": "f8"}, side).withColumns({"br": F.floor(F.col("tr") / block), "bc": F.floor(F.col("tc") / block)})
    options = {"x0": origin[0], "y0": origin[1], "dx": size[0], "dy": size[1], "nodata": nodata, "compress": compress, "cell": cell, "side": side, "block": block, "big": big} | ({"epsg": epsg} if epsg else {})
    packed.repartition("br", "bc").sortWithinPartitions("br", "bc", "tr", "tc").select("br", "bc", "tr", "tc", "z").write.format(FORMAT).options(**options).mode("overwrite").save(path)


def read_grid(spark: SparkSession, path: str, origin: tuple[float, float] | None = None, window: dict[str, tuple[float, float]] | None = None, range_cells: int = RANGE_CELLS) -> DataFrame:
    """file, r, c, z, x, y (cell centres) of a file or of all files below a folder.

    r and c count within each file, or from the given origin over all of them. window: least and greatest value of
    any of r, c, x and y; only files and tiles that it touches are read, and only cells in it are returned.
    """
    if bad := set(window or {}) - set("rcxy"):
        raise ValueError(f"a window has r, c, x and y, not {sorted(bad)}")
    spark.dataSource.register(TiffSource)
    options = {"range_cells": range_cells} | ({"x0": origin[0], "y0": origin[1]} if origin else {})
    for k, (low, high) in (window or {}).items():
        options |= {f"{k}_min": low, f"{k}_max": high}
    cells = spark.read.format(FORMAT).options(**options).load(path)
    for k, (low, high) in (window or {}).items():
        cells = cells.filter(F.col(k).between(low, high))
    return cells
