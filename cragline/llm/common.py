"""Vectorised text primitives shared by the operators: flat byte views, word spans, hashes, packed slices.

Texts are handled as one flat uint8 array per Arrow piece plus offsets, so that no Python string is made
per word. Null texts are empty texts.
"""

from __future__ import annotations

import ctypes
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_BYTES = 4 << 20


@functools.cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # no such call on this platform
        return lambda _: 0


def release() -> None:
    """Give freed memory back: workers outlive their tasks, and what they keep counts for the executor."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def releasing(f):
    """f of one or two tables, with freed memory given back after each call."""

    def one(table):
        try:
            return f(table)
        finally:
            release()

    def two(left, right):
        try:
            return f(left, right)
        finally:
            release()

    return two if f.__code__.co_argcount == 2 else one


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: True for bytes of a word `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: True for bytes of a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_pow: dict[str, np.ndarray] = {}


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into pieces of about `limit` text bytes; one longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
    release()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_large_string(column.type) else b"")
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return raw, o - o[0]


def spans(raw: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of each maximal run of word bytes; runs never cross texts."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    m = is_word[raw]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start, end = m.copy(), m.copy()
    start[1:] &= ~m[:-1] | edge[1:n]
    end[:-1] &= ~m[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _pow or len(_pow["p"]) < n:
        size = max(n, (2 << 20) + (1 << 16))
        for key, base in (("p", _BASE), ("i", _INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _pow[key] = np.cumprod(a, dtype=np.uint64)
    return _pow["p"][:n], _pow["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values into uniform ones (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hasher(raw: np.ndarray):
    """A function of starts and ends that gives a 64-bit polynomial hash of those spans of raw, from prefix sums."""
    power, inverse = _powers(len(raw) + 1)
    acc = np.empty(len(raw) + 1, np.uint64)
    acc[0] = 0
    terms = raw.astype(np.uint64)
    terms += np.uint64(1)
    terms *= power[: len(raw)]
    np.cumsum(terms, out=acc[1:])
    return lambda s, e: mix((acc[e] - acc[s]) * inverse[s])


def span_hash(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each span; starts ascend. Long data are taken a piece at a time."""
    if len(raw) <= PIECE_BYTES:
        return span_hasher(raw)(s, e)
    out = np.empty(len(s), np.uint64)
    cut = np.searchsorted(s, np.arange(0, len(raw) + PIECE_BYTES // 2, PIECE_BYTES // 2))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if a < b:
            lo = int(s[a])
            out[a:b] = span_hasher(raw[lo : int(e[a:b].max())])(s[a:b] - lo, e[a:b] - lo)
    return out


_STEP = np.array([pow(0xD6E8FEB86659FD93, j, 1 << 64) for j in range(1, 65)], np.uint64)


def run_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes (len - k + 1 values; texts are not looked at)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += words[j : j + n] * _STEP[j]
    return mix(h)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each range, one after another."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.repeat(np.asarray(starts, np.int64) - first, lengths) + np.arange(total, dtype=np.int64)


def held(column: str, mod: int, rest: int):
    """Fold of a document by its id alone; null ids count as training rows that are not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % mod == rest, F.lit(False))


def fresh(*columns: list[str]) -> str:
    """A prefix that no column of these lists has, whatever its case."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for names in columns for c in names):
        prefix += "_"
    return prefix


def squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def widen(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


PACKED = "slice long, part int, ids binary, offs binary, flag binary, data binary"


def pack(docs: DataFrame, flag: str | None = None, limit: int = 4 << 20, unit: int = 16 << 20) -> DataFrame:
    """Rows of about `limit` text bytes each: ids (nullable ids are marked in flag bit 1), offsets, bytes. Consecutive
    rows of a task, about `unit` bytes together, are the parts of one slice.

    docs must hold doc_id and text (and the boolean flag column, bit 0). Materialise the result before it is
    read twice: slices follow the order in which a task reads its rows.
    """
    cols = ["doc_id", "text"] + ([flag] if flag else [])

    def run(batches):
        task, n, part, held_bytes = TaskContext.get().partitionId(), 0, 0, 0
        for b in pieces(batches, "text", limit):
            raw, offs = flat(b.column("text"))
            if held_bytes and held_bytes + len(raw) > unit:
                n, part, held_bytes = n + 1, 0, 0
            ids = b.column("doc_id")
            bits = (b.column(flag).to_numpy(zero_copy_only=False).astype(np.uint8) if flag else np.zeros(len(ids), np.uint8)) | (pc.is_null(ids).to_numpy(zero_copy_only=False).astype(np.uint8) << 1)
            yield pa.RecordBatch.from_pydict(
                {
                    "slice": pa.array([(task << 32) | n], pa.int64()),
                    "part": pa.array([part], pa.int32()),
                    "ids": pa.array([squeeze(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64))], pa.binary()),
                    "offs": pa.array([squeeze(offs)], pa.binary()),
                    "flag": pa.array([squeeze(bits)], pa.binary()),
                    "data": pa.array([squeeze(raw)], pa.binary()),
                }
            )
            part, held_bytes = part + 1, held_bytes + len(raw)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *cols[1:]).mapInArrow(run, PACKED)


def by_slice(batches):
    """(slice, its rows that lie together) of packed record batches, one slice at a time."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["slice"] != row["slice"]:
                yield held[0]["slice"], held
                held = []
                release()
            held.append(row)
    if held:
        yield held[0]["slice"], held
    release()


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, flags, offsets, bytes of a packed slice."""
    return widen(row["ids"], np.int64), widen(row["flag"], np.uint8), widen(row["offs"], np.int64), widen(row["data"], np.uint8)


def id_array(ids: np.ndarray, flags: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=(flags & 2).astype(bool))


def uniq_counts(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of each value in keys, sorted keys, summed weights)."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, codes.dtype), np.zeros(0, np.int64)
    inv, keys = pd.factorize(codes)
    n = np.bincount(inv, weights=weights, minlength=len(keys))
    o = np.argsort(keys)
    rank = np.empty(len(o), np.int64)
    rank[o] = np.arange(len(o))
    return rank[inv], keys[o], np.rint(n[o]).astype(np.int64)


def crc(data) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
