"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is `size` consecutive words of an item (an item of fewer words is one window). A document contains a window
only if it contains all its words, so the necessary prefix is one token: the window's rarest word, by its count over
all documents. Documents' words are joined on these tokens; a candidate's place in the document follows from the
token's place in the window (positional bound), must lie within the document (length bound), and is then compared
word by word with the window.

The window table is shipped in blocks of some `block` windows of items; a larger benchmark takes one pass a block. In a block a
window that many items share is there once, with the list of its items, which is looked at after a full match only.

Defined results: null texts and texts without words hold nothing; a null item id counts as an item named by the empty
string; repeated items count once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, flat, fresh, pieces, ragged, run_hash, span_hash, spans

BLOCK = 100_000
#: Candidates compared at a time, and items carried to the next block in one batch; both bound memory, nothing is left out.
CANDIDATES, ENTRIES = 1 << 20, 1 << 18
FINAL = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean"}


def words(text: pa.Array):
    """(hash of each word, its text, first word of each text and the end)."""
    raw, offs = flat(text)
    raw = LOWER[raw]
    s, e, d = spans(raw, offs, ALNUM)
    first = np.searchsorted(d, np.arange(len(offs)))
    return span_hash(raw, s, e), d, first


def windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """item, words: the distinct windows of each item as arrays of word hashes."""

    def run(batches):
        for b in pieces(batches, "text"):
            h, _, first = words(b.column("text"))
            items, rows = [], []
            for item, a, z in zip(b.column("item").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                for k in range(a, max(z - size, a) + 1 if z > a else a):
                    items.append(item)
                    rows.append(h[k : min(k + size, z)].view(np.int64))
            for k in range(0, len(items), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(items[k : k + 20_000], pa.string()), pa.array(rows[k : k + 20_000], pa.list_(pa.int64()))], names=["item", "words"])

    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item string, words array<long>").distinct()


def _counts(docs: DataFrame, tokens: np.ndarray) -> np.ndarray:
    """How often each of the sorted tokens occurs in all documents."""
    ship = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches):
        n = np.zeros(len(ship.value), np.int64)
        for b in pieces(batches, "text"):
            h, _, _ = words(b.column("text"))
            at = np.minimum(np.searchsorted(ship.value, h), len(ship.value) - 1)
            n += np.bincount(at[ship.value[at] == h], minlength=len(n))
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(n[k], pa.int64())], names=["k", "n"])

    t = docs.select("text").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(tokens), np.int64)
    out[t["k"].to_numpy()] = t["n"].to_numpy()
    return out


def _table(docs: DataFrame, part: pa.Table) -> dict:
    """The lookup arrays of one block: each different window once, with the list of its items."""
    lists = part["words"].combine_chunks()
    flat_words = lists.flatten().to_numpy().view(np.uint64)
    size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    end = 8 * np.cumsum(size)
    raw, seen = flat_words.tobytes(), {}
    same = np.array([seen.setdefault(raw[a:z], len(seen)) for a, z in zip((end - 8 * size).tolist(), end.tolist(), strict=True)], np.int64)
    names = sorted(set(part["item"].to_pylist()))
    code = {x: k for k, x in enumerate(names)}
    item = np.array([code[x] for x in part["item"].to_pylist()], np.int64)
    o = np.lexsort((item, same))
    item, held_by = item[o], np.searchsorted(same[o], np.arange(len(seen) + 1))
    _, one = np.unique(same, return_index=True)
    flat_words, size = flat_words[ragged((end // 8 - size)[one], size[one])], size[one]
    first = np.cumsum(size) - size
    tokens, inv = np.unique(flat_words, return_inverse=True)
    n = _counts(docs, tokens)
    # rarest word of each window; ties by hash
    win = np.repeat(np.arange(len(size)), size)
    o = np.lexsort((flat_words, n[inv], win))
    pick = o[first]
    prefix, place = flat_words[pick], pick - first
    o = np.argsort(prefix, kind="stable")
    keys, start = np.unique(prefix[o], return_index=True)
    return {"keys": keys, "start": np.r_[start, len(o)], "win": o, "place": place, "size": size, "first": first, "words": flat_words, "names": names, "item": item, "held_by": held_by}


def _match(t: dict, h: np.ndarray, d: np.ndarray, first: np.ndarray, most: int = CANDIDATES):
    """(first word, window) of every occurrence in the piece, from some `most` candidates at a time."""
    at = np.minimum(np.searchsorted(t["keys"], h), len(t["keys"]) - 1)
    pos = np.flatnonzero(t["keys"][at] == h)
    k = at[pos]
    n = t["start"][k + 1] - t["start"][k]
    total = np.cumsum(n)
    cuts = np.unique(np.r_[0, np.searchsorted(total, np.arange(most, total[-1] if len(n) else 0, most)), len(n)])
    found = [_compare(t, h, d, first, pos[a:z], k[a:z], n[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    return tuple(np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)]) for i in (0, 1))


def _compare(t, h, d, first, pos, k, n):
    win = t["win"][ragged(t["start"][k], n)]
    begin = np.repeat(pos, n) - t["place"][win]
    doc = np.repeat(d[pos], n)
    ok = (begin >= first[doc]) & (begin + t["size"][win] <= first[doc + 1])
    begin, win = begin[ok], win[ok]
    for j in range(int(t["size"].max())):
        live = j < t["size"][win]
        same = np.ones(len(win), bool)
        same[live] = t["words"][t["first"][win[live]] + j] == h[begin[live] + j]
        begin, win = begin[same], win[same]
    return begin, win


def _items(t: dict, win: np.ndarray) -> list[str]:
    """The items that hold any of these windows, sorted."""
    a = t["held_by"][win]
    return [t["names"][k] for k in np.unique(t["item"][ragged(a, t["held_by"][win + 1] - a)]).tolist()]


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, block: int = BLOCK, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The kept columns (doc_id by default) with n_words, n_hit, n_items, items_sha256 and contaminated."""
    keep = keep or ["doc_id"]
    all_windows = windows(benchmark, size).toArrow() if (total := windows(benchmark, size).count()) <= block else None
    blocks = max(1, -(-total // block))
    between = fresh(docs.columns)
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    for k in range(blocks):
        part = all_windows if all_windows is not None else windows(benchmark, size).filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k).toArrow()
        table = _table(docs, part) if part.num_rows else None
        rows = _pass(rows, table, keep if k == blocks - 1 else list(kinds), kinds, k == 0, k == blocks - 1, prefix, between)
    return rows


def _pass(rows: DataFrame, table: dict | None, keep: list[str], kinds: dict, head: bool, tail: bool, prefix: str, between: str) -> DataFrame:
    """One block's hits, or-ed into those of the blocks before."""
    ship = rows.sparkSession.sparkContext.broadcast(table)
    hits, found = between + "hits", between + "items"
    carry = f"{hits} binary, {found} array<string>"
    final = ", ".join(f"`{prefix}{c}` {kind}" for c, kind in FINAL.items())
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", " + (final if tail else carry)

    def run(batches):
        t = ship.value
        for b in pieces(batches, "text"):
            h, d, first = words(b.column("text"))
            hit = np.zeros(len(h), bool) if head else np.unpackbits(np.frombuffer(b"".join(b.column(hits).to_pylist()), np.uint8))[ragged(8 * np.r_[0, np.cumsum(-(-np.diff(first) // 8))][:-1], np.diff(first))].astype(bool)
            pair = np.zeros(0, np.int64)
            if t is not None and len(h):
                begin, win = _match(t, h, d, first)
                step = np.zeros(len(h) + 1, np.int64)
                np.add.at(step, begin, 1)
                np.add.at(step, begin + t["size"][win], -1)
                hit |= np.cumsum(step[:-1]) > 0
                pair = np.unique(d[begin] * len(t["size"]) + win)
            n_hit = np.diff(np.r_[0, np.cumsum(hit)][first])
            own = np.searchsorted(pair, np.arange(b.num_rows + 1) * (len(t["size"]) if t else 1))
            last, names, entries, out, lo = None, [], 0, [], 0
            for k in range(b.num_rows):
                mine = pair[own[k] : own[k + 1]] % (len(t["size"]) if t else 1)
                if last is None or mine.tobytes() != last:  # copies, mostly, follow their like
                    last, names = mine.tobytes(), _items(t, mine) if len(mine) else []
                before = [] if head else b.column(found)[k].as_py()
                items = names if not before else before if not names else sorted({*before, *names})
                out.append((len(items), hashlib.sha256(",".join(items).encode()).hexdigest()) if tail else items)
                entries += 0 if tail else len(items)
                if k + 1 == b.num_rows or entries >= ENTRIES:
                    rest = [b.column(c).slice(lo, k + 1 - lo) for c in keep]
                    if tail:
                        more = [pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.string()), pa.array(n_hit > 0)]
                        yield pa.RecordBatch.from_arrays([*rest, *more], names=[*keep, *(prefix + c for c in FINAL)])
                    else:
                        bits = [np.packbits(hit[a:z]).tobytes() for a, z in zip(first[lo : k + 1], first[lo + 1 : k + 2], strict=True)]
                        yield pa.RecordBatch.from_arrays([*rest, pa.array(bits, pa.binary()), pa.array(out, pa.list_(pa.string()))], names=[*keep, hits, found])
                    lo, out, entries = k + 1, [], 0

    return rows.mapInArrow(run, schema)
