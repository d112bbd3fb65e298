"""Ranked lexical search: document-at-a-time merging of compressed postings, shard by shard.

`index` turns each piece of text (some 8 MB) into a shard: one row with the sorted terms of its documents and, for
each term, the documents that hold it in ascending doc_id order, as compressed differences, and how often they do.
`search` gathers the counts of its terms over all shards, then a task goes through its shards: for each item the
cursors of its terms' postings lie in a heap keyed by document, so that a document is scored once, with all its terms;
a bounded heap keyed by score, then doc_id holds the best. Terms whose greatest scores together can't reach the heap
are not merged but looked up in the documents that the others bring, which changes no result. Tasks send their best
rows, ranked in two steps.

Items go in blocks of about `block` terms, one pass over the index each; one item is never cut.

Defined results: null texts and texts without terms are no documents; each row is a document, so rows of one doc_id
rank each by themselves; a null doc_id comes last among equal scores; the distinct texts of one item_id are one item; an
item without terms, an empty table and scores of 0 give no rows; further columns are not looked at. Hashes of 64 bits
stand for terms.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialize, scratch
from .common import ALNUM, LOWER, flat, pieces, ragged, release, span_hash, spans, squeeze, widen

BLOCK = 100_000
SHARD_BYTES = 8 << 20
INDEX = "n_docs long, n_terms long, ids binary, sizes binary, terms binary, starts binary, docs binary, counts binary"
_INDEX_ARROW = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), *((c, pa.binary()) for c in ("ids", "sizes", "terms", "starts", "docs", "counts"))])
#: Stands for a null doc_id, behind all others.
NO_ID = np.iinfo(np.int64).max


def terms(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of each term `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z lower-cased."""
    raw, offs = flat(text)
    raw = LOWER[raw]
    s, e, d = spans(raw, offs, ALNUM)
    return span_hash(raw, s, e), d


def index(docs: DataFrame) -> DataFrame:
    """One row a shard; write it before it is read more than once."""

    def run(batches):
        for b in pieces(batches, "text", SHARD_BYTES):
            h, d = terms(b.column("text"))
            size = np.bincount(d, minlength=b.num_rows)
            ids = pc.fill_null(b.column("doc_id"), NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.flatnonzero(size)[np.argsort(ids[size > 0], kind="stable")]
            if not len(order):
                continue
            place = np.empty(b.num_rows, np.int64)
            place[order] = np.arange(len(order))
            vocabulary, term = np.unique(h, return_inverse=True)
            pair, count = np.unique(term * len(order) + place[d], return_counts=True)
            term, doc = np.divmod(pair, len(order))
            starts = np.searchsorted(term, np.arange(len(vocabulary) + 1))
            step = np.diff(doc, prepend=0)
            step[starts[:-1]] = doc[starts[:-1]]
            row = [len(order), len(h), squeeze(ids[order]), squeeze(size[order].astype(np.int64)), squeeze(vocabulary), squeeze(starts.astype(np.uint32)), squeeze(step.astype(np.uint32)), squeeze(count.astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _INDEX_ARROW, strict=True)], schema=_INDEX_ARROW)
            release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times: the terms of each item's distinct texts."""
    kind = to_arrow_type(items.schema["item_id"].dataType)

    def run(batches):
        for b in pieces(batches, "text"):
            h, d = terms(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(d)).cast(kind), pa.array(h.view(np.int64))], names=["item_id", "term"])

    texts = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    return texts.mapInArrow(run, f"item_id {items.schema['item_id'].dataType.simpleString()}, term long").groupBy("item_id", "term").agg(F.count("*").alias("times"))


def _holders(shards: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How many documents hold each of the sorted terms."""
    ship = shards.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        n = np.zeros(len(ship.value), np.int64)
        for b in batches:
            for t, s in zip(b.column("terms").to_pylist(), b.column("starts").to_pylist(), strict=True):
                own, starts = widen(t, np.uint64), widen(s, np.uint32).astype(np.int64)
                at = np.minimum(np.searchsorted(own, ship.value), len(own) - 1)
                n += np.where(own[at] == ship.value, starts[at + 1] - starts[at], 0)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(n[k], pa.int64())], names=["k", "n"])

    t = shards.select("terms", "starts").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary), np.int64)
    out[t["k"].to_numpy()] = t["n"].to_numpy()
    return out


def _lengths(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """8 * m of each document; beyond 64 bits by Python's integers."""
    if int(sizes.max()) * 75 * n_docs < 1 << 63:
        return 8 * (25 + (75 * sizes * n_docs) // n_terms)
    return np.array([8 * (25 + (75 * n * n_docs) // n_terms) for n in sizes.tolist()], np.int64)


class Shard:
    """The postings of a block's terms in one shard: documents by place, and what each gives to a score for a weight of 1."""

    def __init__(self, row: dict, vocabulary: np.ndarray, n_docs: int, n_terms: int):
        own, starts = widen(row["terms"], np.uint64), widen(row["starts"], np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(own, vocabulary), len(own) - 1)
        have = np.flatnonzero(own[at] == vocabulary)
        at = at[have]
        n = starts[at + 1] - starts[at]
        pick = ragged(starts[at], n)
        cut = np.r_[0, np.cumsum(n)]
        far = np.cumsum(widen(row["docs"], np.uint32)[pick].astype(np.int64))
        doc = far - np.repeat(np.r_[0, far][cut[:-1]], n)
        tf = widen(row["counts"], np.uint32)[pick].astype(np.int64)
        gain = (1_000_000_000 * tf) // (1000 * tf + _lengths(widen(row["sizes"], np.int64), n_docs, n_terms)[doc])
        self.ids = widen(row["ids"], np.int64).tolist()
        self.at = dict(zip(have.tolist(), range(len(have)), strict=True))
        self.cut, self.doc, self.gain = cut.tolist(), doc, gain
        self.top = np.maximum.reduceat(gain, cut[:-1]).tolist() if len(have) else []
        self._lists: dict[int, tuple[list, list]] = {}

    def postings(self, term: int) -> tuple[list, list] | None:
        """(documents, gains) of a term of the block."""
        if (k := self.at.get(term)) is None:
            return None
        if k not in self._lists:
            a, z = self.cut[k], self.cut[k + 1]
            self._lists[k] = self.doc[a:z].tolist(), self.gain[a:z].tolist()
        return self._lists[k]

    def search(self, query: list[tuple[int, int]], best: list[tuple[int, int]], k: int) -> None:
        """Offer the shard's documents to `best`, a heap of at most k (score, -doc_id); query holds (term, weight)."""
        lists = sorted(((w * self.top[self.at[t]], w, *self.postings(t)) for t, w in query if w and t in self.at), key=lambda x: x[0])
        if not lists:
            return
        bound, total = [0], 0
        for top, *_ in lists:
            total += top
            bound.append(total)
        least = best[0][0] if len(best) == k else 1
        free = 0  # lists before this one can't reach `least` together
        while free < len(lists) and bound[free + 1] < least:
            free += 1
        heap = [(docs[0], j, 0) for j, (_, _, docs, _) in enumerate(lists) if j >= free]
        heapq.heapify(heap)
        while heap:
            here, score, brought = heap[0][0], 0, free
            while heap and heap[0][0] == here:
                _, j, i = heap[0]
                _, w, docs, gains = lists[j]
                score += w * gains[i]
                if i + 1 < len(docs):
                    heapq.heapreplace(heap, (docs[i + 1], j, i + 1))
                else:
                    heapq.heappop(heap)
            for j in range(brought - 1, -1, -1):
                if score + bound[j + 1] < least:
                    break
                _, w, docs, gains = lists[j]
                i = bisect_left(docs, here)
                if i < len(docs) and docs[i] == here:
                    score += w * gains[i]
            if score < least:
                continue
            found = (score, -self.ids[here])
            if len(best) < k:
                heapq.heappush(best, found)
            elif found > best[0]:
                heapq.heapreplace(best, found)
            else:
                continue
            if len(best) == k and best[0][0] > least:
                least = best[0][0]
                while free < len(lists) and bound[free + 1] < least:
                    free += 1
                if free > brought:
                    heap = [c for c in heap if c[1] >= free]
                    heapq.heapify(heap)


def search(docs: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents."""
    with scratch() as work:
        shards = materialize(index(docs), "postings")
        asked = materialize(item_terms(items), "items")
        size = asked.count()
        blocks = max(1, -(-size // block))
        total = shards.agg(F.sum("n_docs").alias("d"), F.sum("n_terms").alias("t")).first()
        found = None
        for b in range(blocks) if total["d"] else []:
            part = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else asked
            rows = _block(shards, part, total["d"], total["t"], k)
            found = rows if found is None else found.unionByName(rows)
        kind = items.schema["item_id"].dataType.simpleString()
        if found is None:
            return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        first = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
        first = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).filter(F.col("rank") <= k)
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
        return work.keep(ranked.select("item_id", "rank", "doc_id", "score"), "ranked")


def _block(shards: DataFrame, asked: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item_id, doc_id, score: every task's best of the block's items."""
    t = asked.sort("item_id").toArrow()
    vocabulary, at = np.unique(t["term"].to_numpy().view(np.uint64), return_inverse=True)
    weight = [int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1)))) for df in _holders(shards, vocabulary).tolist()]
    names: list = []
    queries: list[list[tuple[int, int]]] = []
    for name, j, times in zip(t["item_id"].to_pylist(), at.tolist(), t["times"].to_pylist(), strict=True):
        if not names or names[-1] != name:
            names.append(name)
            queries.append([])
        queries[-1].append((j, times * weight[j]))
    ship = shards.sparkSession.sparkContext.broadcast((vocabulary, queries, names))
    kind = t.schema.field("item_id").type

    def run(batches):
        vocabulary, queries, names = ship.value
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard({c: b.column(c)[i].as_py() for c in b.schema.names}, vocabulary, n_docs, n_terms)
                for query, heap in zip(queries, best, strict=True):
                    shard.search(query, heap, k)
                release()
        rows = [(name, -doc, score) for name, heap in zip(names, best, strict=True) for score, doc in heap]
        for a in range(0, len(rows), 100_000):
            part = rows[a : a + 100_000]
            ids = np.array([r[1] for r in part], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], kind), pa.array(ids, mask=ids == NO_ID), pa.array([r[2] for r in part], pa.int64())], names=["item_id", "doc_id", "score"])

    return shards.select("ids", "sizes", "terms", "starts", "docs", "counts").mapInArrow(run, f"item_id {asked.schema['item_id'].dataType.simpleString()}, doc_id long, score long")
