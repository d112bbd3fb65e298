"""Approximate nearest neighbours by balanced posting lists.

Centroids come from balanced k-means on a bounded sample and are searched by a neighbour graph in memory (beam search
from pivot centroids). Every row is stored in the list of its nearest centroid; rows near a border are replicated to
further lists, if no chosen centroid lies closer to the next one than the row does. A query reads the lists whose
centroid distance is within a ratio of the nearest one; the ratio and the number of centroids searched are calibrated
on the sample for `recall`, up to all lists.
Lists of many rows are split over several tasks. Scores are cosines in double precision on the original vectors.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids;
vectors are near only to those of their own length, and lengths other than the most frequent one are searched without
lists, in blocks; vectors are scaled by powers of two, so no square is too large or small; equal vectors tie to the
smaller vec_id; a repeated id is one candidate, by its nearest vector, and as a query takes its best matches; an empty
table gives an empty result; columns besides vec_id and embedding are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch

#: Lists: one for LIST_ROWS rows, MAX_LISTS at most (the graph is in memory); SAMPLE rows a list are looked at to place them.
LIST_ROWS, MAX_LISTS, SAMPLE = 200, 4096, 40
#: How much nearer a centroid of average load must be than an empty one, in cosine.
LOAD = 0.02
TASK_ROWS = 8192


def valid(rows: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that can take part."""
    e = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null")
    return e.filter("embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x != 0)")


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy().reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, exactly, so that its largest component is between a half and one."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow of squares
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


class Lists:
    """Centroids and their graph."""

    def __init__(self, sample: np.ndarray, lists: int, rounds: int = 6, degree: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        x = np.unique(sample, axis=0)
        x = x[rng.permutation(len(x))]
        lists = min(lists, len(x))
        c = x[:lists].copy()
        load = np.ones(lists)
        for _ in range(rounds):
            near = np.concatenate([(p @ c.T - LOAD * load / load.mean()).argmax(1) for p in np.array_split(x, max(1, len(x) // 4096))])
            load = np.bincount(near, minlength=lists).astype(float) + 1
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            live = np.linalg.norm(total, axis=1) > 1e-6
            c[live] = total[live] / np.linalg.norm(total[live], axis=1, keepdims=True)
        self.c, self.load = c, (LOAD * load / load.mean()).astype(np.float32)
        near = []
        for k in range(0, lists, 512):
            sim = c[k : k + 512] @ c.T
            sim[np.arange(len(sim)), k + np.arange(len(sim))] = 2
            near.append(np.argsort(-sim, axis=1, kind="stable")[:, 1 : degree + 1])
        self.graph = np.concatenate(near) if lists > 1 else np.zeros((lists, 0), int)
        self.pivots = np.arange(0, lists, max(1, int(lists**0.5) // 2))

    def search(self, x: np.ndarray, beam: int, hops: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances), nearest first, of each unit vector by beam search in the graph."""
        beam = min(beam, len(self.c))
        ids, dist = [], []
        for p in np.array_split(x, max(1, len(x) // 256)) if len(x) else []:
            if beam == len(self.c):  # no graph needed
                s = p @ self.c.T
                o = np.argsort(-s, axis=1, kind="stable")
                ids.append(o)
                dist.append(np.sqrt(np.maximum(2 - 2 * np.take_along_axis(s, o, 1), 0)))
                continue
            s = p @ self.c[self.pivots].T
            start = min(beam, s.shape[1])
            at = self.pivots[np.argpartition(-s, start - 1, axis=1)[:, :start]]
            for _ in range(hops if self.graph.shape[1] else 0):
                cand = np.sort(np.concatenate([at, self.graph[at].reshape(len(p), -1)], axis=1), axis=1)
                again = np.zeros(cand.shape, bool)
                again[:, 1:] = cand[:, 1:] == cand[:, :-1]
                s = np.einsum("bd,bkd->bk", p, self.c[cand])
                s[again] = -9
                n = min(beam, cand.shape[1])
                o = np.argpartition(-s, n - 1, axis=1)[:, :n]
                at = np.take_along_axis(cand, o, 1)
                if at.shape[1] < beam:
                    continue
            s = np.einsum("bd,bkd->bk", p, self.c[at])
            same = np.zeros(at.shape, bool)
            o = np.argsort(at, axis=1, kind="stable")
            st = np.take_along_axis(at, o, 1)
            np.put_along_axis(same, o[:, 1:], st[:, 1:] == st[:, :-1], 1)
            s[same] = -9
            o = np.argsort(-s, axis=1, kind="stable")
            s = np.take_along_axis(s, o, 1)
            ids.append(np.where(s < -8, -1, np.take_along_axis(at, o, 1)))
            dist.append(np.where(s < -8, 9, np.sqrt(np.maximum(2 - 2 * s, 0))))
        if not ids:
            return np.zeros((0, 1), int), np.zeros((0, 1))
        width = max(a.shape[1] for a in ids)
        wide = lambda a, v: np.pad(a, ((0, 0), (0, width - a.shape[1])), constant_values=v)
        return np.concatenate([wide(a, -1) for a in ids]), np.concatenate([wide(a, 9) for a in dist])

    def place(self, x: np.ndarray, replicas: int = 4, near: float = 1.15) -> np.ndarray:
        """Lists of each vector (-1: none): the nearest after the lists' load, and border lists not shadowed by a chosen one."""
        ids, dist = self.search(x, 8)
        ids, dist = ids[:, :8], dist[:, :8]
        o = np.argsort(np.where(ids < 0, 9, dist * dist / 2 + self.load[ids]), axis=1, kind="stable")
        ids, dist = np.take_along_axis(ids, o, 1), np.take_along_axis(dist, o, 1)
        out = np.full(ids.shape, -1)
        out[:, 0] = ids[:, 0]
        for j in range(1, ids.shape[1]):
            ok = (ids[:, j] >= 0) & (dist[:, j] <= near * dist[:, 0] + 1e-9) & ((out >= 0).sum(1) < replicas)
            for i in range(j):
                gap = np.sqrt(np.maximum(2 - 2 * np.einsum("bd,bd->b", self.c[ids[:, j]], self.c[ids[:, i]]), 0))
                ok &= (out[:, i] < 0) | (gap > 0.6 * dist[:, j])
            out[ok, j] = ids[ok, j]
        return out

    def probe(self, x: np.ndarray, ratio: float, beam: int, least: int = 1) -> np.ndarray:
        """Lists a query reads (-1: none), the `least` nearest in any case."""
        ids, dist = self.search(x, beam)
        return np.where((dist <= ratio * dist[:, :1] + 1e-9) | (np.arange(ids.shape[1]) < least), ids, -1)


def fit(rows: DataFrame, sample: int = SAMPLE, recall: float = 0.97) -> dict:
    """Centroids, probing ratio and beam from at most `sample` rows a list, chosen by a hash of their ids."""
    n = rows.count()
    many = int(np.clip(n // LIST_ROWS, 1, MAX_LISTS))
    x = _matrix(rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1000, many * sample)).toArrow()["embedding"])
    if not len(x):
        return {"lists": None, "ratio": 1.0, "beam": 1}
    x = _unit(x)
    lists = Lists(x, many)
    # calibrate: nearest neighbours of some sample rows among the sample, against the lists these are stored in
    q = x[:200]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -9
    top = np.argsort(-s, axis=1)[:, : min(5, len(x) - 1)]
    where = lists.place(x)
    beam = min(len(lists.c), 64)
    while True:
        for ratio in (1.02, 1.05, 1.1, 1.15, 1.2, 1.3, 1.4, 1.6, 2.0, 9.0):
            got = lists.probe(q, ratio, beam)
            found = (where[top][:, :, :, None] == np.where(got < 0, -2, got)[:, None, None, :]).any((2, 3)) if top.size else np.ones(1)
            if found.mean() >= recall:
                return {"lists": lists, "ratio": ratio, "beam": beam}
        if beam == len(lists.c):  # even so: read all lists
            return {"lists": lists, "ratio": ratio, "beam": beam, "least": beam}
        beam = min(2 * beam, len(lists.c))


def index(rows: DataFrame, model: dict) -> DataFrame:
    """list, vec_id, embedding: every row in the posting lists it belongs to."""
    ship = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            x = _matrix(b.column("embedding"))
            if not len(x):
                continue
            where = ship.value["lists"].place(_unit(x))
            r, c = np.nonzero(where >= 0)
            t = b.select(["vec_id", "embedding"]).take(pa.array(r))
            yield pa.RecordBatch.from_arrays([pa.array(where[r, c], pa.int32()), t.column(0), t.column(1)], names=["list", "vec_id", "embedding"])

    return rows.select("vec_id", "embedding").mapInArrow(run, "list int, vec_id long, embedding array<double>")


def _best(q_id, q, c_id, c, k: int):
    """k best candidates of each query within one block: (query, candidate, score)."""
    q, c = _scaled(q), _scaled(c)
    # of equal vectors only the k + 1 smallest ids can be among the k nearest, each counted once
    o = np.lexsort((c_id,))
    c_id, c = c_id[o], c[o]
    _, inv = np.unique(c, axis=0, return_inverse=True)
    inv = inv.ravel()
    o = np.lexsort((c_id, inv))
    o = o[np.append(True, (np.diff(c_id[o]) != 0) | (np.diff(inv[o]) != 0))]
    g = inv[o]
    nth = np.arange(len(g)) - np.searchsorted(g, g)
    o = o[nth <= k]
    c_id, c = c_id[o], c[o]
    k *= int(np.unique(c_id, return_counts=True)[1].max())  # rows of one id are one candidate
    qn, cn = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    out = []
    for a in range(0, len(q), 256):
        s = (q[a : a + 256] @ c.T) / qn[a : a + 256, None] / cn[None]
        s[q_id[a : a + 256, None] == c_id[None]] = -9
        cut = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
        r, j = np.nonzero((s >= cut[:, None] - 1e-9) & (s > -8))
        exact = (q[a + r] * c[j]).sum(1) / (qn[a + r] * cn[j])
        o = np.lexsort((c_id[j], -exact, r))
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        o = o[nth < k]
        out.append((q_id[a + r[o]], c_id[j[o]], exact[o]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def search(index_rows: DataFrame, queries: DataFrame, model: dict, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, the query's own id excluded."""
    spark = index_rows.sparkSession
    if model["lists"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = {r["list"]: r["n"] for r in index_rows.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row a centroid
    splits = spark.sparkContext.broadcast(np.array([max(1, -(-size.get(i, 0) // TASK_ROWS)) for i in range(len(model["lists"].c))]))
    ship = spark.sparkContext.broadcast(model)

    def probe(batches):
        for b in batches:
            x = _matrix(b.column("embedding"))
            if not len(x):
                continue
            m = ship.value
            got = m["lists"].probe(_unit(x), m["ratio"], m["beam"], m.get("least", 1))
            r, c = np.nonzero(got >= 0)
            lists = got[r, c]
            n = splits.value[lists]
            r, lists, part = np.repeat(r, n), np.repeat(lists, n), np.concatenate([np.arange(i) for i in n])
            t = b.select(["vec_id", "embedding"]).take(pa.array(r))
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(part, pa.int32()), t.column(0), t.column(1)], names=["list", "part", "vec_id", "embedding"])

    asked = queries.select("vec_id", "embedding").mapInArrow(probe, "list int, part int, vec_id long, embedding array<double>")
    n_of = F.create_map(*[x for i, n in enumerate(splits.value.tolist()) if n > 1 for x in (F.lit(i), F.lit(n))]) if (splits.value > 1).any() else None
    part = F.pmod(F.xxhash64("vec_id", "embedding"), F.coalesce(n_of[F.col("list")], F.lit(1))).cast("int") if n_of is not None else F.lit(0)
    stored = index_rows.withColumn("part", part)

    found = asked.groupBy("list", "part").cogroup(stored.groupBy("list", "part")).applyInArrow(lambda left, right: _match(left, right, k), "query_id long, vec_id long, score double")
    return _ranked(found, k)


def exact(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query among the rows of its length, block by block."""
    sizes = rows.groupBy(F.size("embedding").alias("n")).agg(F.ceil(F.count("*") / TASK_ROWS).cast("int").alias("parts"))
    stored = rows.withColumn("n", F.size("embedding")).join(sizes, "n").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).select("n", "part", "vec_id", "embedding")
    asked = queries.withColumn("n", F.size("embedding")).join(sizes, "n").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*[F.col(c).alias(c) for c in ("n", "part", "vec_id", "embedding")])
    found = asked.groupBy("n", "part").cogroup(stored.groupBy("n", "part")).applyInArrow(lambda left, right: _match(left, right, k), "query_id long, vec_id long, score double")
    return _ranked(found, k)


def _match(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    if not left.num_rows or not right.num_rows:
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    q, c, s = _best(left["vec_id"].to_numpy(), _matrix(left["embedding"]), right["vec_id"].to_numpy(), _matrix(right["embedding"]), k)
    return pa.table({"query_id": q, "vec_id": c, "score": s})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(rows: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Index all rows and search for those whose id is divisible by `every`."""
    with scratch() as work:
        every_length = valid(rows)
        top = every_length.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
        length = top["n"] if top else 0
        found = _nearest(every_length.filter(F.size("embedding") == length), every, k)
        if every_length.filter(F.size("embedding") != length).isEmpty():
            return work.keep(found, "nearest")
        rare = every_length.filter(F.size("embedding") != length)
        both = found.unionByName(exact(rare, rare.filter(F.pmod("vec_id", F.lit(every)) == 0), k))
        return work.keep(_ranked(both.drop("rank"), k), "nearest")


def _nearest(ok: DataFrame, every: int, k: int) -> DataFrame:
    model = fit(ok)
    if model["lists"] is None:
        return search(ok, ok, model, k)
    stored = materialize(index(ok, model), "postings")
    asked = ok.filter(F.pmod("vec_id", F.lit(every)) == 0)
    best = materialize(search(stored, asked, model, k), "nearest")
    want = ok.select("vec_id").distinct().limit(k + 1).count() - 1
    # queries whose lists hold too few candidates read more lists, in the end all
    n = len(model["lists"].c)
    for least in sorted({min(16, n), min(128, n), n}) if want else []:
        full = best.groupBy("query_id").count().filter(F.col("count") >= want)
        short = materialize(asked.join(full, asked["vec_id"] == full["query_id"], "left_anti"), "short")
        if short.isEmpty():
            break
        more = search(stored, short, model | {"beam": max(model["beam"], least), "least": least}, k)
        kept = best.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti")
        best = materialize(kept.unionByName(more), "nearest")
    return best
