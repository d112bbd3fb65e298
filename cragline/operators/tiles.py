"""Grids as square tiles: one row a tile, each layer a compressed array, and steps that see a margin of one cell.

Neighbouring tiles send each other the strips along their common border only. `settle` repeats a step until no border
changes; a tile takes part in a round only if a strip that came in differs from the one before.

Defined results: cells that are missing have the layer's fill value; repeated cells keep one row, the one of greatest
value; an empty table gives no tile; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SIDE = 256
#: What stands for a missing cell.
NONE = np.iinfo(np.int64).min
_AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def widen(b: bytes, kind: str, side: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind).reshape(-1, side)


def missing(kind: str):
    return np.nan if kind == "f8" else NONE


def pack(cells: DataFrame, layers: dict[str, str], side: int = SIDE) -> DataFrame:
    """tr, tc and a binary column for each layer (column name: "i8" or "f8") of cells(r, c, ...)."""
    kinds = {"i8": "long", "f8": "double"}
    rows = cells.select(F.floor(F.col("r") / side).alias("tr"), F.floor(F.col("c") / side).alias("tc"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), *[F.col(n).cast(kinds[k]).alias(n) for n, k in layers.items()])
    one = rows.groupBy("tr", "tc", "r", "c").agg(F.max(F.struct(*layers)).alias("v")).select("tr", "tc", "r", "c", *[f"v.{n}" for n in layers])

    def build(t: pa.Table) -> pa.Table:
        tr, tc = t["tr"][0].as_py(), t["tc"][0].as_py()
        at = (t["r"].to_numpy() - tr * side) * side + t["c"].to_numpy() - tc * side
        out = {"tr": [tr], "tc": [tc]}
        for n, k in layers.items():
            a = np.full(side * side, missing(k), k)
            a[at] = t[n].to_numpy()
            out[n] = [squeeze(a)]
        return pa.table(out, schema=_schema(layers))

    return one.groupBy("tr", "tc").applyInArrow(build, _ddl(layers))


def _ddl(layers: dict[str, str]) -> str:
    return "tr long, tc long, " + ", ".join(f"{n} binary" for n in layers)


def _schema(layers: dict[str, str]) -> pa.Schema:
    return pa.schema([("tr", pa.int64()), ("tc", pa.int64()), *((n, pa.binary()) for n in layers)])


def cells(tiles: DataFrame, layers: dict[str, str], side: int, valid: str) -> DataFrame:
    """r, c and the layers of the cells where layer `valid` is there."""
    kinds = {"i8": "long", "f8": "double"}

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                a = {n: widen(b.column(n)[i].as_py(), k, side) for n, k in layers.items()}
                ok = np.isfinite(a[valid]) if layers[valid] == "f8" else a[valid] != NONE
                r, c = np.nonzero(ok)
                yield pa.RecordBatch.from_pydict({"r": r + b.column("tr")[i].as_py() * side, "c": c + b.column("tc")[i].as_py() * side, **{n: x[r, c] for n, x in a.items()}})

    return tiles.select("tr", "tc", *layers).mapInArrow(run, "r long, c long, " + ", ".join(f"{n} {kinds[k]}" for n, k in layers.items()))


def _strip(a: np.ndarray, i: int, j: int) -> np.ndarray:
    """The part of a tile that its neighbour at (i, j) sees."""
    return a[{-1: slice(0, 1), 0: slice(None), 1: slice(-1, None)}[i], {-1: slice(0, 1), 0: slice(None), 1: slice(-1, None)}[j]]


def strips(tiles: DataFrame, layers: dict[str, str], side: int) -> DataFrame:
    """tr, tc, i, j and the layers' strips: what tile (tr, tc) sees of its neighbour at (i, j)."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                a = {n: widen(b.column(n)[k].as_py(), kind, side) for n, kind in layers.items()}
                tr, tc = b.column("tr")[k].as_py(), b.column("tc")[k].as_py()
                rows = [{"tr": tr + i, "tc": tc + j, "i": -i, "j": -j, **{n: squeeze(_strip(x, i, j)) for n, x in a.items()}} for i, j in _AROUND]
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("tr", pa.int64()), ("tc", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), *((n, pa.binary()) for n in layers)])
    return tiles.select("tr", "tc", *layers).mapInArrow(run, "tr long, tc long, i int, j int, " + ", ".join(f"{n} binary" for n in layers))


def _margin(a: np.ndarray, kind: str, side: int, rows: list[dict], name: str) -> np.ndarray:
    out = np.full((side + 2, side + 2), missing(kind), kind)
    out[1:-1, 1:-1] = a
    place = {-1: slice(0, 1), 0: slice(1, -1), 1: slice(-1, None)}
    for s in rows:
        shape = (1 if s["i"] else side, 1 if s["j"] else side)
        out[place[s["i"]], place[s["j"]]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(s[name]), kind).reshape(shape)
    return out


def with_margin(tiles: DataFrame, own: dict[str, str], seen: dict[str, str], step: Callable, out: str, side: int, sent: DataFrame | None = None) -> DataFrame:
    """step(tr, tc, arrays) for each tile, as a table of schema `out`; the layers of `seen` come with a margin of one cell."""
    sent = strips(tiles, seen, side) if sent is None else sent

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _empty
        row, rows = left.to_pylist()[0], right.to_pylist()
        a = {n: widen(row[n], k, side) for n, k in own.items()}
        a |= {n: _margin(widen(row[n], k, side), k, side, rows, n) for n, k in seen.items()}
        return step(row["tr"], row["tc"], a)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    _empty = to_arrow_schema(StructType.fromDDL(out)).empty_table()
    names = list(dict.fromkeys([*own, *seen]))
    return tiles.select("tr", "tc", *names).groupBy("tr", "tc").cogroup(sent.groupBy("tr", "tc")).applyInArrow(run, out)


def settle(tiles: DataFrame, own: dict[str, str], state: str, relax: Callable, side: int, seen: dict[str, str] | None = None) -> DataFrame:
    """tiles with layer `state` (f8) lowered by relax(arrays) -> new state, round by round until no border changes.

    relax sees `state` and `seen` with a margin. A round takes the tiles beside a changed border only; the others stay."""
    seen = {state: "f8", **(seen or {})}
    layers = own | seen
    schema = _schema(layers).append(pa.field("moved", pa.bool_()))

    def step(tr, tc, a):
        old = a[state][1:-1, 1:-1]
        r, c = np.nonzero(~np.isnan(old))
        new = old
        if len(r):  # the part that holds cells
            box = slice(r.min(), r.max() + 1), slice(c.min(), c.max() + 1)
            wide = slice(r.min(), r.max() + 3), slice(c.min(), c.max() + 3)
            new = old.copy()
            new[box] = relax({n: x[wide] if n in seen else x[box] for n, x in a.items()})
        moved = any(not np.array_equal(_strip(new, i, j), _strip(old, i, j), equal_nan=True) for i, j in _AROUND)
        row = {"tr": [tr], "tc": [tc], "moved": [moved]} | {n: [squeeze(x[1:-1, 1:-1] if n in seen else x)] for n, x in a.items()} | {state: [squeeze(new)]}
        return pa.table(row, schema=schema)

    ddl = _ddl(layers) + ", moved boolean"
    now = materialize(with_margin(tiles, own, seen, step, ddl, side), "settle")
    while True:
        moved = now.filter("moved")
        if moved.isEmpty():
            return now.drop("moved")
        around = F.explode(F.array(*[F.struct((F.col("tr") + i).alias("tr"), (F.col("tc") + j).alias("tc")) for i, j in _AROUND])).alias("t")
        called = moved.select(around).select("t.tr", "t.tc").distinct()
        busy = now.drop("moved").join(called, ["tr", "tc"], "left_semi")
        idle = now.join(called, ["tr", "tc"], "left_anti").withColumn("moved", F.lit(False))
        done = with_margin(busy, own, seen, step, ddl, side, strips(now, seen, side).join(called, ["tr", "tc"], "left_semi"))
        now = materialize(done.unionByName(idle), "settle")
