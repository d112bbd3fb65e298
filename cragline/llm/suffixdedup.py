"""Removal of repeated 50-byte strings by suffix arrays over the places where repeats are possible.

A byte goes if a `LENGTH`-byte string that covers it also starts in a document with a smaller doc_id.

Plan. Every 50-byte string (window) has one anchor, its 20-byte string of least hash, so equal windows have equal anchors
at the same place, and neighbouring windows with one anchor form a region. (1) Slices send their distinct anchors to
buckets, which answer which of them occur in two documents or slices. (2) A slice sends the regions of such anchors to
the anchors' buckets, equal ones once with their smallest doc_id. (3) A bucket puts the distinct regions of an anchor
into one text and sorts its suffixes by linear grouping, the texts of many anchors at once (gsaca.py); neighbours in a
suffix array that agree in 50 bytes are one string and get its smallest doc_id. A region without another one under its
anchor has nothing to be sorted against. Anchors of very many distinct regions are parted by the bytes around the anchor
first, as a few neighbouring windows each, so that no text grows with the corpus. (4) Slices get the smallest doc_id of
each of their windows and cut their texts. What travels for a string that occurs in very many documents is one region a
slice.

Defined results: null texts are empty; rows with a null doc_id lose nothing and take nothing from others; rows of one
repeated id lose nothing to each other; an empty table gives an empty result; columns besides doc_id and text are not
looked at. kept_text drops bytes of characters that were cut in part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch
from .common import by_slice, id_array, mix, pack, ragged, releasing, span_hash, squeeze, uniq_counts, unpack, widen
from .gsaca import suffix_arrays

LENGTH, ANCHOR = 50, 20
SPAN = LENGTH - ANCHOR + 1  # windows that can have an anchor
#: Windows in a unit, by which the regions of crowded anchors are parted, and regions from which an anchor is crowded.
RANGE, CROWD = 4, 64
PIECE_BYTES, SLICE_BYTES, BUCKET_BYTES = 2 << 20, 16 << 20, 16 << 20
SORT_CHARS = 1 << 20
BITS = np.uint64(44)
LOW = np.uint64(0xFFFFFFFF)


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; bytes beyond the end are zero."""
    a = np.zeros(len(raw) + 8, np.uint64)
    a[: len(raw)] = raw
    for k in (1, 2, 4):
        a[:-k] |= a[k:] << np.uint64(8 * k)
    return a[: len(raw)]


def _hash20(raw: np.ndarray) -> np.ndarray:
    a = _words(raw)
    n = len(raw) - ANCHOR + 1
    h = a[:n] * np.uint64(0x9E3779B97F4A7C15) + a[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F) + (a[16 : 16 + n] & LOW) * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _least(a: np.ndarray) -> np.ndarray:
    """Minimum of each SPAN neighbours."""
    k = 1
    while 2 * k <= SPAN:
        a = np.minimum(a[:-k], a[k:])
        k *= 2
    return np.minimum(a[: len(a) - (SPAN - k)], a[SPAN - k :])


def regions(raw: np.ndarray, offs: np.ndarray):
    """Of the regions of all texts, in order: 44-bit anchor hash, first window, windows, anchor's place in the first one.

    Each window of a text lies in one region, that of its leftmost 20-byte string of least hash.
    """
    out = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    cut = np.searchsorted(offs, np.arange(0, len(raw) + (1 << 20), 1 << 20))  # about a megabyte at a time
    for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        a, z = int(offs[x]), int(offs[min(y, len(offs) - 1)])
        if x >= y or z - a < LENGTH:
            continue
        h = _hash20(raw[a:z])
        at = _least((h & ~LOW) | np.arange(len(h), dtype=np.uint64)) & LOW
        o = offs[x : y + 1] - a
        bad = ragged(np.maximum(o[1:] - LENGTH + 1, o[:-1]), np.minimum(np.diff(o), LENGTH - 1))
        at[bad[bad < len(at)]] = LOW
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        many = np.diff(np.r_[first, len(at)])
        live = at[first] != LOW
        first, many = first[live], many[live]
        p = at[first].astype(np.int64)
        for column, part in zip(out, (h[p] >> (np.uint64(64) - BITS), first + a, many, p - first), strict=True):
            column.append(part)
    return tuple(map(np.concatenate, out))


def units(data: np.ndarray, begin: np.ndarray, count: np.ndarray, missing: np.ndarray):
    """(region, first window's place in data, windows, key, content hash) of the units of regions that begin at `begin`
    in data and lack so many of an anchor's windows before; all windows of a unit share the bytes that its key hashes."""
    out = []
    for j0 in range(0, SPAN, RANGE):
        j1 = min(j0 + RANGE, SPAN)
        a, b = np.maximum(missing, j0), np.minimum(missing + count, j1)
        r = np.flatnonzero(a < b)
        at, n, sub = (begin - missing + a)[r], (b - a)[r], (a - j0)[r]
        core = (begin - missing)[r] + j1 - 1
        key = span_hash(data, core, core + LENGTH - (j1 - 1 - j0)) + np.uint64(j0)
        same = span_hash(data, at, at + n + LENGTH - 1) * np.uint64(31) + (sub * 16 + n).astype(np.uint64)
        out.append((r, at, n, key, same))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _sorted(data: np.ndarray, at: np.ndarray, n: np.ndarray, lane: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Smallest doc of each window (flat, by item) among the items of its lane; lanes lie together."""
    size = n + LENGTH
    end = np.cumsum(size)
    index = ragged(at, size)
    index[end - 1] = 0
    text = data[index].astype(np.int64)
    text[end - 1] = 256  # behind each item
    start = np.flatnonzero(np.r_[True, lane[1:] != lane[:-1]])
    sa = suffix_arrays(text, np.add.reduceat(size, start))
    item = np.repeat(np.arange(len(n)), size)
    off = np.arange(len(text)) - (end - size)[item]
    sa = sa[(off < n[item])[sa]]
    word = _words(text.astype(np.uint8))
    same = lane[item[sa[1:]]] == lane[item[sa[:-1]]]
    for k in (0, 8, 16, 24, 32, 40, LENGTH - 8):
        same &= word[sa[1:] + k] == word[sa[:-1] + k]
    first = np.flatnonzero(np.r_[True, ~same])
    out = np.empty(len(sa), np.int64)
    least = np.minimum.reduceat(doc[item[sa]], first)
    out[((np.cumsum(n) - n)[item] + off)[sa]] = np.repeat(least, np.diff(np.r_[first, len(sa)]))
    return out


def least_docs(data: np.ndarray, at: np.ndarray, n: np.ndarray, key: np.ndarray, same: np.ndarray, doc: np.ndarray, missing: np.ndarray | None = None) -> np.ndarray:
    """Smallest doc of each of the n windows from `at` on, item by item, among the items of equal key.

    same: equal for items of equal content. With `missing`, items are regions, and those of crowded keys are parted.
    """
    if not len(n):
        return np.zeros(0, np.int64)
    o = np.lexsort((doc, same, key))
    new = np.r_[True, (same[o][1:] != same[o][:-1]) | (key[o][1:] != key[o][:-1])]
    distinct = np.empty(len(o), np.int64)
    distinct[o] = np.cumsum(new) - 1
    u = o[new]
    place = np.cumsum(n[u]) - n[u]
    low = np.repeat(doc[u], n[u])
    start = np.flatnonzero(np.r_[True, key[u][1:] != key[u][:-1]])
    width = np.diff(np.r_[start, len(u)])
    lane = np.repeat(np.arange(len(start)), width)
    crowded = width > CROWD if missing is not None else np.zeros(len(width), bool)
    part = np.flatnonzero(crowded[lane])
    if len(part):
        v = u[part]
        size = n[v] + LENGTH - 1
        own, begin = data[ragged(at[v], size)], np.cumsum(size) - size
        r, at2, n2, key2, same2 = units(own, begin, n[v], missing[v])
        low[ragged(place[part][r] + at2 - begin[r], n2)] = least_docs(own, at2, n2, mix(key2 ^ key[v][r]), same2, doc[v][r])
    # the texts of lanes of like size are sorted together
    some = np.flatnonzero((width > 1) & ~crowded)
    chars = np.add.reduceat(n[u] + LENGTH, start)[some] if len(start) else np.zeros(0, np.int64)
    some = some[np.argsort(chars, kind="stable")]
    chars.sort()
    for lanes in np.split(some, np.flatnonzero(np.diff(np.cumsum(chars) // SORT_CHARS)) + 1):
        if len(lanes):
            items = ragged(start[lanes], width[lanes])
            v = u[items]
            low[ragged(place[items], n[v])] = _sorted(data, at[v], n[v], lane[items], doc[v])
    return low[ragged(place[distinct], n)]


def _planes(a: np.ndarray) -> bytes:
    """Numbers by byte planes, which compress well if neighbours are close."""
    return squeeze(a.astype("<i8").view(np.uint8).reshape(-1, 8).T)


def _numbers(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(widen(b, np.uint8).reshape(8, -1).T).view("<i8").ravel()


ROW = "kind int, bucket int, slice long, first int, a binary, b binary, c binary, d binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("slice", pa.int64()), ("first", pa.int32()), *[(x, pa.binary()) for x in "abcd"]])


def _row(kind, bucket, slice_id, first=0, a=b"", b=b"", c=b"", d=b""):
    return {"kind": kind, "bucket": bucket, "slice": slice_id, "first": first, "a": a, "b": b, "c": c, "d": d}


def _keys(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.cumsum(widen(x, np.uint64), dtype=np.uint64) for x in blobs]


def _spread(key: np.ndarray, many: np.ndarray, slice_id: int, buckets: int) -> pa.RecordBatch:
    """A slice's distinct anchors (sorted) by bucket."""
    b = (key % np.uint64(buckets)).astype(np.int64)
    o = np.argsort(b, kind="stable")
    edge = np.searchsorted(b[o], np.arange(buckets + 1))
    rows = []
    for k in np.flatnonzero(np.diff(edge)):
        p = o[edge[k] : edge[k + 1]]
        rows.append(_row(0, int(k), slice_id, 0, squeeze(np.diff(key[p], prepend=np.uint64(0))), squeeze(np.packbits(many[p]))))
    return pa.RecordBatch.from_pylist(rows, _SCHEMA)


class _Slice:
    """The texts of a slice's parts and their regions; shared(): those of shared anchors, and the distinct ones."""

    def __init__(self, rows: list[dict]):
        self.parts = [unpack(r) for r in sorted(rows, key=lambda r: r["part"])]
        cols = []
        base = 0
        for ids, flags, offs, raw in self.parts:
            h, first, count, shift = regions(raw, offs)
            text = np.searchsorted(offs, first, "right") - 1
            known = (flags & 2)[text] == 0
            h, first, count, shift, doc = h[known], first[known], count[known], shift[known], ids[text[known]]
            cols.append((h, first + base, count, shift, doc, np.full(len(h), len(cols))))
            base += len(raw)
        self.h, self.first, self.count, self.shift, self.doc, self.part = map(np.concatenate, zip(*cols, strict=True))
        self.raw = np.concatenate([raw for *_, raw in self.parts])
        self.base = np.cumsum([0, *(len(raw) for *_, raw in self.parts)])

    def shared(self, answers: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keeps regions of shared anchors; (distinct region of each, a sample of each distinct one, their buckets)."""
        keys = np.sort(np.concatenate([np.zeros(0, np.uint64), *_keys(answers)]))
        live = keys[np.minimum(np.searchsorted(keys, self.h), len(keys) - 1)] == self.h if len(keys) else np.zeros(len(self.h), bool)
        for c in ("h", "first", "count", "shift", "doc", "part"):
            setattr(self, c, getattr(self, c)[live])
        same = np.concatenate([np.zeros(0, np.uint64), *(span_hash(raw, f, f + n + LENGTH - 1) for raw, f, n in ((raw, self.first[self.part == k] - self.base[k], self.count[self.part == k]) for k, (*_, raw) in enumerate(self.parts)))])
        same = same * np.uint64(31) + self.shift.astype(np.uint64)
        bucket = (self.h % np.uint64(buckets)).astype(np.int64)
        o = np.lexsort((self.doc, same, self.h, bucket))
        new = np.ones(len(o), bool)
        new[1:] = (same[o][1:] != same[o][:-1]) | (self.h[o][1:] != self.h[o][:-1])
        region = np.empty(len(o), np.int64)
        region[o] = np.cumsum(new) - 1
        return region, o[new], bucket[o[new]]


def dedup(docs: DataFrame, with_text: bool = False, piece_bytes: int = PIECE_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (with_text: and text_sha256 and kept_text) of every row."""
    with scratch() as work:
        return work.keep(_dedup(docs, with_text, piece_bytes, slice_bytes), "dedup")


def _dedup(docs: DataFrame, with_text: bool, piece_bytes: int, slice_bytes: int) -> DataFrame:
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = materialize(pack(source, None, piece_bytes, slice_bytes), "slices")
    buckets = max(8, packed.select("slice").distinct().count() * slice_bytes // BUCKET_BYTES)

    def ask(batches):
        for slice_id, rows in by_slice(batches):
            s = _Slice(rows)
            o = np.lexsort((s.doc, s.h))
            h, doc = s.h[o], s.doc[o]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            many = doc[np.r_[start[1:], len(h)] - 1] != doc[start] if len(h) else np.zeros(0, bool)
            yield _spread(h[start], many, slice_id, buckets)

    asked = packed.mapInArrow(ask, ROW)

    def shared(t: pa.Table) -> pa.Table:
        keys = _keys(t["a"].to_pylist())
        many = [np.unpackbits(widen(x, np.uint8))[: len(k)] for x, k in zip(t["b"].to_pylist(), keys, strict=True)]
        inv, _, n = uniq_counts(np.concatenate(keys), 1 + np.concatenate(many).astype(np.int64))
        at = np.cumsum([0, *map(len, keys)])
        yes = n[inv] > 1
        rows = [_row(0, b, s, 0, squeeze(np.diff(k[yes[x:y]], prepend=np.uint64(0)))) for b, s, k, x, y in zip(t["bucket"].to_pylist(), t["slice"].to_pylist(), keys, at[:-1], at[1:], strict=True)]
        return pa.Table.from_pylist(rows, _SCHEMA)

    hot = materialize(asked.groupBy("bucket").applyInArrow(releasing(shared), ROW), "shared")

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            s = _Slice(left.to_pylist())
            _, u, bucket = s.shared(right["a"].to_pylist(), buckets)
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edge)):
                v = u[edge[b] : edge[b + 1]]
                data = s.raw[ragged(s.first[v], s.count[v] + LENGTH - 1)]
                rows.append(_row(1, int(b), left["slice"][0].as_py(), int(edge[b]), _planes(s.doc[v]), squeeze(s.shift[v].astype(np.uint8)), squeeze(s.count[v].astype(np.uint8)), squeeze(data)))
        return pa.Table.from_pylist(rows, _SCHEMA)

    cuts = packed.groupBy("slice").cogroup(hot.groupBy("slice")).applyInArrow(releasing(cut), ROW)

    def settle(t: pa.Table) -> pa.Table:
        docs = [_numbers(x) for x in t["a"].to_pylist()]
        doc = np.concatenate(docs)
        shift, count = (np.concatenate([widen(x, np.uint8) for x in t[c].to_pylist()]).astype(np.int64) for c in "bc")
        data = np.concatenate([widen(x, np.uint8) for x in t["d"].to_pylist()])
        size = count + LENGTH - 1
        begin = np.cumsum(size) - size
        key = span_hash(data, begin + shift, begin + shift + ANCHOR)
        same = span_hash(data, begin, begin + size) * np.uint64(31) + shift.astype(np.uint64)
        low = least_docs(data, begin, count, key, same, doc, SPAN - 1 - shift)
        at = np.r_[0, np.cumsum(count)][np.cumsum([0, *map(len, docs)])]
        rows = [_row(3, b, s, f, _planes(low[x:y])) for b, s, f, x, y in zip(t["bucket"].to_pylist(), t["slice"].to_pylist(), t["first"].to_pylist(), at[:-1], at[1:], strict=True)]
        return pa.Table.from_pylist(rows, _SCHEMA)

    settled = materialize(cuts.groupBy("bucket").applyInArrow(releasing(settle), ROW), "settled")
    back = hot.unionByName(settled)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text_sha256 string, kept_text string" * with_text

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = right.to_pylist()
        s = _Slice(left.to_pylist())
        region, u, _ = s.shared([r["a"] for r in answers if r["kind"] == 0], buckets)
        low = np.concatenate([np.zeros(0, np.int64), *(_numbers(a) for _, a in sorted((r["first"], r["a"]) for r in answers if r["kind"] == 3))])
        place = np.cumsum(s.count[u]) - s.count[u]
        tables = []
        for k, (ids, flags, offs, raw) in enumerate(s.parts):
            own = s.part == k
            step = np.zeros(len(raw) + 1, np.int32)
            n = s.count[own]
            less = low[ragged(place[region[own]], n)] < np.repeat(s.doc[own], n)
            start = ragged(s.first[own] - s.base[k], n)[less]
            step += np.bincount(start, minlength=len(step)).astype(np.int32)
            step -= np.bincount(start + LENGTH, minlength=len(step)).astype(np.int32)
            tables.append(_cut_texts(ids, flags, offs, raw, np.cumsum(step[:-1]) > 0, with_text))
        return pa.concat_tables(tables)

    return packed.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(releasing(finish), schema)


def _cut_texts(ids: np.ndarray, flags: np.ndarray, offs: np.ndarray, raw: np.ndarray, gone: np.ndarray, with_text: bool) -> pa.Table:
    total = np.r_[0, np.cumsum(gone)]
    new = gone.copy()
    new[1:] &= ~gone[:-1]
    begin = offs[:-1][offs[:-1] < len(raw)]
    new[begin] |= gone[begin]
    runs = np.r_[0, np.cumsum(new)]
    ends = offs - total[offs]
    kept = memoryview(np.ascontiguousarray(raw[~gone])).cast("B")
    cols = {
        "doc_id": id_array(ids, flags),
        "n_bytes": pa.array(np.diff(offs), pa.int64()),
        "n_removed": pa.array(np.diff(total[offs]), pa.int64()),
        "n_spans": pa.array(np.diff(runs[offs]), pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.string()),
    }
    if with_text:
        whole = memoryview(np.ascontiguousarray(raw)).cast("B")
        cols["text_sha256"] = pa.array([hashlib.sha256(whole[x:y]).hexdigest() for x, y in zip(offs[:-1], offs[1:], strict=True)], pa.string())
        cols["kept_text"] = pa.array([bytes(kept[x:y]).decode("utf-8", "ignore") for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.string())
    return pa.table(cols)
