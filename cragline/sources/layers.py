"""Point layers of GeoPackage files, read through Spark's own file reader, and their geometry blobs.

A file is one row of the binary reader (2 GB at most); its tables are opened in memory by the worker that gets it, so
the path may be in any store that Spark reads.
"""

from __future__ import annotations

import sqlite3
import struct
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes of the envelope by its indicator in a blob's header.
ENVELOPE = (0, 32, 48, 48, 64)


def point_blob(x: float, y: float, envelope: int = 0, little: bool = True) -> bytes:
    """A GeoPackage blob of a point."""
    flags = (envelope << 1) | int(little)
    order = "<" if little else ">"
    box = [x, x, y, y, 0.0, 0.0, 0.0, 0.0][: ENVELOPE[envelope] // 8]
    return b"GP\x00" + bytes([flags]) + struct.pack(f"{order}i{len(box)}d", 0, *box) + struct.pack(f"{order}BI2d", int(little), 1, x, y)


def point_of(blob: bytes | None) -> tuple[float | None, float | None]:
    """x, y of a point blob; nothing for other blobs."""
    if not blob or len(blob) < 8 or blob[:2] != b"GP" or (blob[3] >> 1) & 7 >= len(ENVELOPE):
        return None, None
    at = 8 + ENVELOPE[(blob[3] >> 1) & 7]
    if len(blob) < at + 21:
        return None, None
    order = "<" if blob[at] else ">"
    kind, x, y = struct.unpack_from(f"{order}I2d", blob, at + 1)
    return (x, y) if kind % 1000 == 1 and x == x and y == y else (None, None)


def points(rows: DataFrame, blob: str = "geom") -> DataFrame:
    """rows with x, y of their point blobs instead of the blobs."""
    rest = [c for c in rows.columns if c != blob]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "x double", "y double"])

    def run(batches):
        for b in batches:
            xy = [point_of(v) for v in b.column(blob).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array([x for x, _ in xy], pa.float64()), pa.array([y for _, y in xy], pa.float64())], names=[*rest, "x", "y"])

    return rows.mapInArrow(run, schema)


def _open(content: bytes) -> sqlite3.Connection:
    con = sqlite3.connect(":memory:")
    con.deserialize(content)
    return con


def choose_layer(names: dict[str, list[str]], wanted: list[str], fields: list[set[str]]) -> str | None:
    """The first wanted layer that exists and has one name of each set of fields, else the first layer that has them."""
    fits = lambda t: all(any(f in names[t] for f in group) for group in fields)
    for t in [*(w for w in wanted if w in names), *names]:
        if fits(t):
            return t
    return None


def read_layer(spark: SparkSession, path: str, schema: str, wanted: list[str] = (), fields: list[set[str]] = (), blob: str = "geom") -> DataFrame:
    """Rows of one layer of each file at path, with file and layer: the columns of schema by name (case aside; missing
    ones are null) and x, y of the geometry. A file without a fitting layer raises."""
    want = spark.createDataFrame([], schema).schema
    wanted, fields = list(wanted), [set(g) for g in fields]
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in want)

    def run(batches):
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                con = _open(content)
                tables = [r[0] for r in con.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY rowid")]
                names = {t: [r[1] for r in con.execute(f'PRAGMA table_info("{t}")')] for t in tables}
                layer = choose_layer(names, wanted, fields)
                if layer is None:
                    raise ValueError(f"{file}: no layer with the fields {fields} among {names}")
                at = {n.lower(): n for n in names[layer]}
                pick = ", ".join(f'"{at[f.name.lower()]}"' if f.name.lower() in at else "NULL" for f in want)
                geom = f'"{at[blob]}"' if blob in at else "NULL"
                rows = con.execute(f'SELECT {pick}, {geom} FROM "{layer}"')
                while part := rows.fetchmany(20_000):
                    *values, blobs = zip(*part, strict=True)
                    xy = [point_of(v) for v in blobs]
                    arrays = [pa.array(v, t) for v, t in zip(values, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array([layer] * len(part)), *arrays, pa.array([x for x, _ in xy], pa.float64()), pa.array([y for _, y in xy], pa.float64())], names=["file", "layer", *want.names, "x", "y"])
                con.close()

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in want]
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, layer string, " + cols + ", x double, y double")


def layer_file(layers: dict[str, tuple[list[str], list[tuple]]], epsg: int = 32633) -> bytes:
    """A GeoPackage file with these point layers: name to (columns without the geometry, rows of values and x, y)."""
    con = sqlite3.connect(":memory:")
    con.execute(f"PRAGMA application_id = {0x47504B47}")  # "GPKG", a fixed value of the format
    con.execute("PRAGMA user_version = 10300")
    con.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT)")
    con.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, description TEXT, last_change TEXT, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER)")
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT)")
    con.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined', NULL)", [("undefined cartesian", -1, "NONE", -1), ("undefined geographic", 0, "NONE", 0), (f"EPSG:{epsg}", epsg, "EPSG", epsg)])
    for name, (columns, rows) in layers.items():
        place = [r[-2:] for r in rows if r[-2] is not None and r[-1] is not None]
        box = [pick(p[k] for p in place) if place else None for pick in (min, max) for k in (0, 1)]
        con.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, '', '2000-01-01T00:00:00.000Z', ?, ?, ?, ?, ?)", (name, name, *box, epsg))
        con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POINT', ?, 0, 0)", (name, epsg))
        con.execute(f'CREATE TABLE "{name}" ({", ".join(f"{chr(34)}{c}{chr(34)}" for c in columns)}, geom BLOB)')
        con.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * (len(columns) + 1))})', [(*r[:-2], None if r[-2] is None or r[-1] is None else point_blob(*r[-2:])) for r in rows])
    con.commit()
    return con.serialize()


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class LayerWriter(DataSourceArrowWriter):
    """Each task writes files of its own under hidden names; those of the tasks that count become visible at the end."""

    def __init__(self, options, overwrite: bool):
        self.options, self.overwrite = dict(options), overwrite

    def write(self, iterator):
        system, root = pafs.FileSystem.from_uri(self.options["path"])
        most, names, held = int(self.options["file_rows"]), [], []
        system.create_dir(root, recursive=True)

        def close():
            if held:
                names.append(f"{uuid.uuid4().hex}.gpkg")
                with system.open_output_stream(f"{root}/.{names[-1]}") as f:
                    f.write(layer_file({self.options["layer"]: (columns, held)}, int(self.options["epsg"])))
                held.clear()

        for b in iterator:
            columns = b.schema.names[:-2]
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(row)
                if len(held) >= most:
                    close()
        close()
        return Written(names)

    def commit(self, messages):
        system, root = pafs.FileSystem.from_uri(self.options["path"])
        mine = {n for m in messages if m for n in m.names}
        for x in system.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if x.base_name.startswith(".") and x.base_name[1:] in mine:
                system.move(x.path, f"{root}/{x.base_name[1:]}")
            elif x.base_name.endswith(".gpkg") and (self.overwrite or x.base_name.startswith(".")):
                system.delete_file(x.path)

    def abort(self, messages):
        system, root = pafs.FileSystem.from_uri(self.options["path"])
        for x in system.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if x.base_name.startswith(".") and x.base_name.endswith(".gpkg"):
                system.delete_file(x.path)


class LayerSource(DataSource):
    @classmethod
    def name(cls):
        return "cragline_layer"

    def schema(self):
        raise ValueError("layers are read by read_layer()")

    def writer(self, schema, overwrite):
        return LayerWriter(self.options, overwrite)


def write_points(rows: DataFrame, path: str, layer: str, x: str = "x", y: str = "y", file_rows: int = 200_000, epsg: int = 32633, mode: str = "overwrite") -> None:
    """Write rows as GeoPackage files of at most file_rows points of one layer, made by the tasks that hold them.

    Rows without x or y have no geometry; without rows there is no file.
    """
    rows.sparkSession.dataSource.register(LayerSource)
    rest = [c for c in rows.columns if c not in (x, y)]
    out = rows.select(*rest, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    out.write.format("cragline_layer").options(layer=layer, file_rows=file_rows, epsg=epsg).mode(mode).save(path)


def update(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows with the columns of changes added, or replaced where the key has a change; a key changes at most once."""
    new = [c for c in changes.columns if c != key]
    side = changes.select(F.col(key), F.struct(*new).alias("_new"))
    both = rows.join(side, key, "left")
    old = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    value = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(old(c)).alias(c)
    return both.select(*[F.col(c) for c in rows.columns if c not in new], *[value(c) for c in new])


def ensure_columns(rows: DataFrame, schema: str, required: list[str] = ()) -> DataFrame:
    """rows with every column of schema, missing ones null, before any job starts; a missing required one raises."""
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    want = rows.sparkSession.createDataFrame([], schema).schema
    return rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in want if f.name not in rows.columns])

