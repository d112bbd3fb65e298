"""Language-model scoring by context-tree weighting over bytes.

The next byte is eight binary decisions; each decision keeps one tree of byte contexts of depth 0 to `depth`. A node's
estimate is Krichevsky-Trofimov; nodes are weighted bottom-up, P_w = (P_kt + product of the children's P_w) / 2, and a
text is scored with the trained weights along each byte's context path.

Plan: texts are packed into slices once. Every slice sends its distinct words and (depth+1)-grams with their training
counts to buckets; a bucket sums them and answers each slice for just its own keys, so neither the vocabulary nor the
model is ever held in one place. Buckets hold whole subtrees below contexts of SPLIT bytes; a subtree's share of the
next shorter context is summed by Spark, and only the tree above (at most 65,536 contexts, whatever the corpus) is
joined on the driver. The text ends with byte 0xFF, which UTF-8 never holds; contexts before a text are 0xFF.

Defined results: null texts are empty (one token, the end); null ids are training rows; with no training rows every bit
is a fair coin and the base is that of an empty vocabulary; repeated rows are scored each; an empty table gives an empty
result; columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch, to_arrow
from .common import LOWER, SPACED, by_slice, held, id_array, mix, pack, ragged, releasing, span_hash, spans, squeeze, uniq_counts, unpack, widen

DEPTH, SPLIT = 5, 3
PIECE_BYTES, SLICE_BYTES, BUCKET_BYTES = 2 << 20, 32 << 20, 64 << 20
#: Keys that a bucket gathers before it sums what is equal.
GATHER = 4 << 20
LN2 = np.log(2.0)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5: Stirling's series at x + 8."""
    y = x + 8
    p = np.ones_like(y)
    for k in range(8):
        p *= x + k
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(p)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi)


def grams(raw: np.ndarray, offs: np.ndarray, depth: int) -> np.ndarray:
    """The code (context, byte) of each byte of each text and of its end."""
    n = np.diff(offs)
    code = np.full(len(raw) + len(n) * (depth + 1), 0xFF, np.uint64)
    at = offs[:-1] + np.arange(len(n)) * (depth + 1) + depth
    code[ragged(at, n)] = raw
    own = np.ones(len(code), bool)
    own[ragged(at - depth, np.full(len(n), depth))] = False
    for k in (1, 2, 4):  # the bytes before each place, up to seven
        if k <= depth:
            code[k:] |= code[:-k] << np.uint64(8 * k)
    return code[own] & np.uint64((1 << (8 * (depth + 1))) - 1)


def _nodes(code: np.ndarray, n: np.ndarray, d: int):
    """Sorted keys (context of d bytes, node) of the binary decisions with their zero and one counts."""
    ctx = ((code >> np.uint64(8)) & np.uint64((1 << (8 * d)) - 1)) << np.uint64(8)
    x = (code & np.uint64(255)).astype(np.int64)
    keys, ones, total = [], [], []
    for j in range(8):
        keys.append(ctx | ((1 << j) | (x >> (8 - j))).astype(np.uint64))
        ones.append(np.where((x >> (7 - j)) & 1, n, 0))
        total.append(n)
    inv, key, t = uniq_counts(np.concatenate(keys), np.concatenate(total))
    o = np.rint(np.bincount(inv, weights=np.concatenate(ones), minlength=len(key))).astype(np.int64)
    return key, t - o, o


def _parents(key: np.ndarray, d: int) -> np.ndarray:
    """Keys one context byte shorter."""
    return key & np.uint64((1 << (8 * d)) - 1)  # context bytes 1..d-1 and the node byte


def weigh(levels: list, deepest: int) -> list:
    """levels[d] = (key, zeros, ones) for consecutive depths, deepest last; adds ln P_w. If the last level has a fourth
    entry it is used as its P_w (a subtree weighted elsewhere)."""
    out: list = [None] * len(levels)
    for k in range(len(levels) - 1, -1, -1):
        key, a, b = levels[k][:3]
        kt = log_kt(a, b)
        if len(levels[k]) == 4:
            w = levels[k][3]
        elif k == len(levels) - 1:
            w = kt
        else:
            child, _, _, _, cw = out[k + 1]
            at = np.searchsorted(key, _parents(child, deepest - (len(levels) - 1) + k + 1))
            w = np.logaddexp(kt, np.bincount(at, weights=cw, minlength=len(key))) - LN2
        out[k] = (key, a, b, kt, w)
    return out


def predict(code: np.ndarray, top: list, sub: list, depth: int) -> np.ndarray:
    """ln probability of each code's byte; top: weighted levels 0..TOP-1, sub: weighted levels TOP..depth."""
    total = np.zeros(len(code))
    x = (code & np.uint64(255)).astype(np.int64)
    ctx = code >> np.uint64(8)
    for j in range(8):
        node, bit = ((1 << j) | (x >> (8 - j))).astype(np.uint64), (x >> (7 - j)) & 1
        p, reach, seen = np.zeros(len(code)), np.ones(len(code)), np.ones(len(code), bool)
        for d, (key, a, b, kt, w) in enumerate([*top, *sub]):
            k = ((ctx & np.uint64((1 << (8 * d)) - 1)) << np.uint64(8)) | node
            at = np.minimum(np.searchsorted(key, k), max(0, len(key) - 1))
            hit = seen & (key[at] == k) if len(key) else np.zeros(len(code), bool)
            p += np.where(seen & ~hit, reach * 0.5, 0)  # nothing was seen here or deeper
            seen = hit
            at = at[hit]
            stop = np.exp(np.minimum(kt[at] - LN2 - w[at], 0)) if d < depth else np.ones(len(at))
            est = (np.where(bit[hit] == 1, b[at], a[at]) + 0.5) / (a[at] + b[at] + 1)
            p[hit] += reach[hit] * stop * est
            reach[hit] *= 1 - stop
        total += np.log(np.maximum(p, 1e-300))
    return total


REQUEST = "bucket int, slice long, keys binary, counts binary"


def _send(kind: np.ndarray, key: np.ndarray, n: np.ndarray, slice_id: int, base: int, buckets: int):
    """Rows of one slice's sorted keys, by bucket."""
    o = np.lexsort((key, kind))
    cut = np.searchsorted(kind[o], np.arange(buckets + 1))
    live = [k for k in range(buckets) if cut[k + 1] > cut[k]]
    part = [o[cut[k] : cut[k + 1]] for k in live]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([base + k for k in live], pa.int32()),
            pa.array([slice_id] * len(live), pa.int64()),
            pa.array([squeeze(np.diff(key[p], prepend=np.uint64(0))) for p in part], pa.binary()),
            pa.array([squeeze(n[p].astype(np.uint32)) for p in part], pa.binary()),
        ],
        names=["bucket", "slice", "keys", "counts"],
    )


def _keys(blob: bytes) -> np.ndarray:
    return np.cumsum(widen(blob, np.uint64), dtype=np.uint64)


def _gram_bucket(code: np.ndarray, split: int, buckets: int) -> np.ndarray:
    return (mix((code >> np.uint64(8)) & np.uint64((1 << (8 * split)) - 1)) % np.uint64(buckets)).astype(np.int64)


class _Counts:
    """Sorted keys and counts, gathered bit by bit."""

    def __init__(self):
        self.key, self.n, self.wait, self.more = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, []

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        self.more.append((key, n))
        self.wait += len(key)
        if self.wait > GATHER:
            self.close()

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        if self.more:
            key, n = map(np.concatenate, zip((self.key, self.n), *self.more, strict=True))
            _, self.key, self.n = uniq_counts(key, n)
            self.wait, self.more = 0, []
        return self.key, self.n


def _parts(rows: list[dict], depth: int):
    """Ids, flags, offsets, text of each word, word hashes and grams of each part of a slice."""
    for row in sorted(rows, key=lambda r: r["part"]):
        ids, flags, offs, raw = unpack(row)
        raw = LOWER[raw]
        s, e, d = spans(raw, offs, SPACED)
        yield ids, flags, offs, d, span_hash(raw, s, e), grams(raw, offs, depth)


def score(docs: DataFrame, depth: int = DEPTH, piece_bytes: int = PIECE_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every text; depth: 1 to 6."""
    with scratch() as work:
        return work.keep(_score(docs, depth, piece_bytes, slice_bytes), "scores")


def _score(docs: DataFrame, depth: int, piece_bytes: int, slice_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    split = min(SPLIT, depth)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held("doc_id", 5, 1).alias("held"))
    packed = materialize(pack(source, "held", piece_bytes, slice_bytes), "slices")
    buckets = max(8, packed.select("slice").distinct().count() * slice_bytes // BUCKET_BYTES)
    train_docs = source.filter("not held").count()

    def ask(batches):
        for slice_id, rows in by_slice(batches):
            words, codes = _Counts(), _Counts()
            for _, flags, offs, d, h, g in _parts(rows, depth):
                train = (flags & 1) == 0
                words.add(*uniq_counts(h, train[d])[1:])
                codes.add(*uniq_counts(g, np.repeat(train, np.diff(offs) + 1))[1:])
            key, n = words.close()
            yield _send((key % np.uint64(buckets)).astype(np.int64), key, n, slice_id, 0, buckets)
            key, n = codes.close()
            yield _send(_gram_bucket(key, split, buckets), key, n, slice_id, buckets, buckets)

    asked = materialize(packed.mapInArrow(ask, REQUEST), "asked")

    def gathered(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        all_keys = _Counts()
        for k, n in zip(t["keys"].to_pylist(), t["counts"].to_pylist(), strict=True):
            all_keys.add(_keys(k), widen(n, np.uint32).astype(np.int64))
        return all_keys.close()

    def subtrees(key: np.ndarray, n: np.ndarray) -> list:
        return weigh([_nodes(key[n > 0], n[n > 0], d) for d in range(split, depth + 1)], depth)

    def summary(t: pa.Table) -> pa.Table:
        """Of a word bucket: tokens and distinct words (key -1); of a gram bucket: its share of the nodes above."""
        key, n = gathered(t)
        if t["bucket"][0].as_py() < buckets:
            return pa.table({"key": pa.array([-1], pa.int64()), "a": pa.array([int(n.sum())], pa.int64()), "b": pa.array([int((n > 0).sum())], pa.int64()), "w": [0.0]})
        k, a, b, _, w = subtrees(key, n)[0]
        inv, k, a = uniq_counts(_parents(k, split), a)
        return pa.table({"key": pa.array(k.astype(np.int64)), "a": a, "b": np.rint(np.bincount(inv, weights=b, minlength=len(k))).astype(np.int64), "w": np.bincount(inv, weights=w, minlength=len(k))})

    shares = asked.groupBy("bucket").applyInArrow(releasing(summary), "key long, a long, b long, w double")
    s = to_arrow(shares.groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("w").alias("w")))
    key, a, b, w = (s[c].to_numpy() for c in ("key", "a", "b", "w"))
    tokens, vocabulary = int(a[key < 0].sum()) + train_docs, int(b[key < 0].sum()) + (train_docs > 0)
    o = np.argsort(key)[int((key < 0).sum()) :]
    levels: list = [(key[o].astype(np.uint64), a[o], b[o], np.logaddexp(log_kt(a[o], b[o]), w[o]) - LN2)]
    for d in range(split - 2, -1, -1):
        inv, k, aa = uniq_counts(_parents(levels[0][0], d + 1), levels[0][1])
        levels.insert(0, (k, aa, np.rint(np.bincount(inv, weights=levels[0][2], minlength=len(k))).astype(np.int64)))
    top = spark.sparkContext.broadcast(weigh(levels, split - 1))  # 65,536 contexts at most

    def answer(t: pa.Table) -> pa.Table:
        key, n = gathered(t)
        words = t["bucket"][0].as_py() < buckets
        out = n if words else predict(key, top.value, subtrees(key, n), depth)
        values = [squeeze(out[np.searchsorted(key, _keys(k))]) for k in t["keys"].to_pylist()]
        return pa.table({"bucket": t["bucket"], "slice": t["slice"], "keys": t["keys"], "values": pa.array(values, pa.binary())})

    answers = asked.groupBy("bucket").applyInArrow(releasing(answer), "bucket int, slice long, keys binary, values binary")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for kind in (np.int64, np.float64):
            part = [(_keys(k), widen(v, kind)) for b, k, v in zip(right["bucket"].to_pylist(), right["keys"].to_pylist(), right["values"].to_pylist(), strict=True) if (b < buckets) == (kind is np.int64)]
            key, value = map(np.concatenate, zip((np.zeros(0, np.uint64), np.zeros(0, kind)), *part, strict=True))
            o = np.argsort(key)
            tables.append((key[o], value[o]))
        (word, seen), (code, chance) = tables
        floor = tokens + 0.5 * (vocabulary + 1)
        out = []
        for ids, flags, offs, d, h, g in _parts(left.to_pylist(), depth):
            n_docs = len(ids)
            c = seen[_lookup(h, word)]
            base = np.bincount(d, weights=np.log10((c + 0.5) / floor), minlength=n_docs) + np.log10((train_docs + 0.5) / floor)
            total = np.add.reduceat(chance[_lookup(g, code)], offs[:-1] + np.arange(n_docs)) / np.log(10)
            size = np.diff(offs)
            out.append(
                pa.table(
                    {
                        "doc_id": id_array(ids, flags),
                        "held_out": (flags & 1) == 1,
                        "n_tokens": pa.array(np.bincount(d, minlength=n_docs) + 1, pa.int64()),
                        "n_known": pa.array(np.bincount(d, weights=c > 0, minlength=n_docs).astype(np.int64) + (train_docs > 0), pa.int64()),
                        "train_tokens": pa.array([tokens] * n_docs, pa.int64()),
                        "base_score": base,
                        "score": total,
                        "n_bytes": pa.array(size, pa.int64()),
                        "bits_per_byte": -total / np.log10(2) / np.maximum(size, 1),
                    }
                )
            )
        return pa.concat_tables(out)

    return packed.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(releasing(finish), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")


def _lookup(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Position of each value in the sorted keys, which hold them all; each distinct value is searched once."""
    inv, distinct = pd.factorize(values)
    return np.searchsorted(keys, distinct)[inv]
