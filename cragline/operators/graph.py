"""Graph operators: connected components and pointer jumping as DataFrame loops with written rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

GATHER = 1 << 20


def _stars(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) among these edges."""
    nodes, inv = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = inv[: len(src)], inv[len(src) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return nodes, nodes[root]
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _contract(batches):
    """The components of a partition's edges as stars; memory grows with its nodes, not its edges."""
    src, dst, wait = [], [], 0
    for b in batches:
        src.append(b.column("src").to_numpy(zero_copy_only=False))
        dst.append(b.column("dst").to_numpy(zero_copy_only=False))
        wait += b.num_rows
        if wait > max(GATHER, 2 * len(src[0])):
            x, y = _stars(np.concatenate(src), np.concatenate(dst))
            src, dst, wait = [x], [y], 0
    if src:
        x, y = _stars(np.concatenate(src), np.concatenate(dst))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["id", "root"])


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, comp: the smallest id reachable from each node.

    edges(src, dst) is undirected, without nulls; nodes(id), or all nodes with an edge. Every round contracts each
    partition's edges to stars before anything is shuffled; a node that several partitions know joins their roots, and the
    edges between roots are the next round's graph. A hub has one row a partition.

    Defined results: loops and repeated edges change nothing; a node without edges is its own component.
    """
    rounds = []
    rest = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    while True:
        star = rest.mapInArrow(_contract, "id long, root long")
        star = materialize(star.withColumn("least", F.min("root").over(Window.partitionBy("id"))), "stars")
        rounds.append(star)
        rest = star.filter("root != least").select(F.col("root").alias("src"), F.col("least").alias("dst")).distinct()
        if rest.isEmpty():
            break
    label = None
    for star in reversed(rounds):
        own = star.select("id", F.col("least").alias("comp")).distinct()
        if label is not None:
            up = label.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
            own = own.join(up, "comp", "left").select("id", F.coalesce("up", "comp").alias("comp"))
        label = own
    if nodes is None:
        return label
    return nodes.join(label, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def _shorten(batches):
    """A partition's pointers, each moved along as far as its chain stays in the partition."""
    ids, up = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b in batches:
        ids.append(b.column("id").to_numpy(zero_copy_only=False))
        up.append(b.column("parent").to_numpy(zero_copy_only=False))
    ids, up = np.concatenate(ids), np.concatenate(up)
    if len(ids):
        o = np.argsort(ids)
        ids, up = ids[o], up[o]
        at = np.minimum(np.searchsorted(ids, up), len(ids) - 1)
        step = np.where(ids[at] == up, at, np.arange(len(ids)))
        while (step[step] != step).any():
            step = step[step]
        up = up[step]
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(up, pa.int64())], names=["id", "parent"])


def pointer_jump(pointers: DataFrame, parts: int | None = None) -> DataFrame:
    """id, root: the end of each id's pointer chain; pointers(id, parent) must be a forest whose roots point to themselves.

    Ids are dealt by range, so that chains between near ids are followed inside a partition; only the ids that chains of
    other partitions lead to take part in the rounds after that, whose number grows with the logarithm of the crossings.

    Defined results: an empty table gives an empty one; ids are unique and without nulls.
    """
    rows = pointers.select(F.col("id").cast("long").alias("id"), F.col("parent").cast("long").alias("parent"))
    dealt = rows.repartitionByRange(parts, "id") if parts else rows.repartitionByRange("id")
    short = materialize(dealt.mapInArrow(_shorten, "id long, parent long"), "short")
    cur = short.join(short.select(F.col("parent").alias("id")).distinct(), "id")
    while True:
        up = cur.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
        nxt = materialize(cur.join(up, "parent").select("id", F.col("parent").alias("old"), F.col("grand").alias("parent")), "jump")
        cur = nxt.select("id", "parent")
        if nxt.filter("parent != old").isEmpty():
            break
    ends = cur.select(F.col("id").alias("parent"), F.col("parent").alias("root"))
    return short.join(ends, "parent").select("id", "root")
