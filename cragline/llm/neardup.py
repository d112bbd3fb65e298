"""Near-duplicate detection with bottom-k MinHash sketches.

1. Sketch: the K smallest hashes (one hash function) of a text's distinct 5-word shingles; texts with equal sets, by a
   128-bit digest, form one class and its smallest doc_id stands for it. Only classes that share enough sketch values
   with others can have a link; the rest drop out here.
2. Inverted lists: the WIDE smallest hashes of those classes, each class listing only under its rarest values, so many
   that any linked pair meets at the rarest value it shares.
3. Overlaps: a value's place among a class's values bounds what two classes that share it first can have in common. Each
   list's leaders are compared with the list instead of all pairs of a group; after a few rounds the members that are
   still in different components are compared: those of short lists pair by pair, those of long ones in blocks, the
   lists of one leader together.
   Pairs are estimated by the bottom K of the union of their sketches before their sets are looked at.
4. Exact Jaccard on the full shingle sets confirms each link. A block verifies its pairs itself and gives only edges
   that join components, fewer than it has members.
5. Components, by contraction of the edges between those of the round before.

Defined results: texts without words, null texts and null ids are linked with nothing (a null id has a null component
and is kept); repeated rows of an id share a component; an empty table gives an empty result; columns besides doc_id and
text are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import materialize, scratch
from .common import LOWER, SPACED, flat, mix, pieces, ragged, releasing, run_hash, span_hash, spans

K, WIDE, WORDS = 64, 512, 5
ROUNDS = 3
#: Lists of more members are compared in blocks, of so many members and shingles at most (one larger text is alone).
SHORT, BLOCK, VALUES = 16, 2048, 1 << 20
#: Values with more holders than this in a block are counted by a matrix product, others by their pairs of holders.
COMMON = 256


@functools.cache
def meet(width: int) -> int:
    """How many values two sketches of `width` share if their sets are linked, but for a chance below 1e-12.

    The sketch that ends first has all of its share in common; at least three quarters of a linked set are common.
    """
    k = np.arange(width + 1)
    choose = np.array([math.lgamma(width + 1) - math.lgamma(i + 1) - math.lgamma(width - i + 1) for i in k])
    return int(np.searchsorted(np.cumsum(np.exp(choose + k * math.log(0.75) + (width - k) * math.log(0.25))), 5e-13, "right"))


def least(n, width: int):
    """How many of its sketch values a set of n shingles shares with any linked one, at least (a column).

    A whole set may meet one a third larger, whose sketch lacks what exceeds the width.
    """
    return F.when(n > width, meet(width)).otherwise(F.least(F.ceil(n * 0.75), F.lit(2 * width // 3)))


def possible(na, ma, nb, mb):
    """Whether sets of na and nb shingles can be linked if the first value they share leaves ma and mb shared ones."""
    met = F.when((na <= WIDE) & (nb <= WIDE), 7 * F.least(ma, mb) >= 3 * (na + nb)).otherwise(F.least(ma, mb) >= meet(WIDE))
    return met & (4 * F.least(na, nb) >= 3 * F.greatest(na, nb))


def shingles(text: pa.Array, k: int = WORDS):
    """Distinct shingle hashes (signed) of each text, sorted within the text, and offsets."""
    raw, offs = flat(text)
    raw = LOWER[raw]
    s, e, d = spans(raw, offs, SPACED)
    h = span_hash(raw, s, e)
    n = np.bincount(d, minlength=len(offs) - 1)
    first = np.cumsum(n) - n
    run = run_hash(h, k)
    doc = d[: len(run)]
    ok = doc == d[k - 1 :] if len(run) else np.zeros(0, bool)
    run, doc = run[ok], doc[ok]
    for size in range(1, k):  # fewer words: the whole sequence is one shingle
        short = np.flatnonzero(n == size)
        if len(short):
            hs = run_hash(h, size)[first[short]]
            run, doc = np.concatenate([run, mix(hs + np.uint64(size))]), np.concatenate([doc, short])
    run = run.view(np.int64)
    o = np.argsort(run)
    o = o[np.argsort(doc[o], kind="stable")]
    run, doc = run[o], doc[o]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])
    run, doc = run[new], doc[new]
    return run, np.r_[0, np.cumsum(np.bincount(doc, minlength=len(n)))]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest, sketch of every row."""

    def run(batches):
        for b in pieces(batches, "text", 2 << 20):
            h, offs = shingles(b.column("text"))
            n = np.diff(offs)
            cut = list(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True))
            digest = [hashlib.blake2b(h[x:y].tobytes(), digest_size=16).digest() if y > x else None for x, y in cut]
            kept = np.minimum(n, K)
            sketch = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)], pa.int32()), pa.array(h[ragged(offs[:-1], kept)]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), sketch], names=["doc_id", "n_shingles", "digest", "sketch"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketch array<long>")


def suspects(classes: DataFrame) -> DataFrame:
    """id of the classes that share enough sketch values with others to have a link."""
    rows = classes.select("id", "n", F.explode("sketch").alias("v"))
    shared = rows.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    met = rows.join(shared, "v").groupBy("id", "n").agg(F.count("*").alias("met"))
    return met.filter(F.col("met") >= least(F.col("n"), K)).select("id").distinct()


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, n, full (sorted) of each different text of these ids."""

    def run(batches):
        for b in pieces(batches, "text", 2 << 20):
            h, offs = shingles(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(offs), pa.int64()), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(h))], names=["id", "n", "full"])

    rows = _texts(docs).withColumnRenamed("doc_id", "id").filter("id is not null").join(ids, "id", "left_semi")
    return rows.dropDuplicates(["id", "text"]).mapInArrow(run, "id long, n long, full array<long>")


def lists(sets: DataFrame) -> DataFrame:
    """v, id, n, most: the rarest shared values of each class (of n shingles); most: its values that are not rarer."""
    rows = sets.select("id", "n", F.explode(F.slice("full", 1, WIDE)).alias("v"))
    shared = rows.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    # of a class's values, all but (least overlap - 1) must be looked at; values of one class are the rarest and meet nobody
    w = Window.partitionBy("id").orderBy(F.desc("df"), "v")
    met = rows.join(shared, "v").withColumn("most", F.row_number().over(w))
    return met.filter(F.col("most") >= least(F.col("n"), WIDE)).select("v", "id", "n", "most")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of pairs(a, b, ...) whose full sets have 100 * intersection >= 75 * union."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias("n" + x), F.col("full").alias("f" + x))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter("4 * least(na, nb) >= 3 * greatest(na, nb)")
    # the union sketch: its values that both sets have are nearly always enough if the sets are linked
    sa, sb = F.slice("fa", 1, K), F.slice("fb", 1, K)
    last = F.element_at(F.slice(F.array_sort(F.array_union(sa, sb)), 1, K), -1)
    near = F.when(F.greatest("na", "nb") <= K, True).otherwise(F.size(F.filter(F.array_intersect(sa, sb), lambda x: x <= last)) >= meet(K))
    common = F.size(F.array_intersect("fa", "fb"))
    return both.filter(near).filter(100 * common >= 75 * (F.col("na") + F.col("nb") - common)).select(*pairs.columns).distinct()


def _pairs(x: str, y: str) -> list:
    """Columns a, b (the smaller id first) and their components ca, cb of two structs or prefixes."""
    flip = F.col(x + "id") > F.col(y + "id")
    pick = lambda c, one, two: F.when(flip, F.col(two + c)).otherwise(F.col(one + c))
    return [pick("id", x, y).alias("a"), pick("id", y, x).alias("b"), pick("comp", x, y).alias("ca"), pick("comp", y, x).alias("cb")]


def _short_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b, ca, cb) of each short list's members in different components that can be linked."""
    full = rows.select("v", "id", "n", "most", "comp").repartition("v").sortWithinPartitions("v")

    def compare(t: pa.Table) -> pa.Table:
        v, ids, n, most, comp = (t[c].to_numpy() for c in ("v", "id", "n", "most", "comp"))
        out = [np.zeros((0, 4), np.int64)]
        for gap in range(1, SHORT):  # lists lie together, so partners are less than SHORT rows apart
            x = np.flatnonzero((v[gap:] == v[:-gap]) & (comp[gap:] != comp[:-gap]))
            y = x + gap
            ok = _possible(n[x], most[x], n[y], most[y])
            x, y = x[ok], y[ok]
            x, y = np.where(ids[x] <= ids[y], x, y), np.where(ids[x] <= ids[y], y, x)
            out.append(np.stack([ids[x], ids[y], comp[x], comp[y]], axis=1))
        got = np.unique(np.concatenate(out), axis=0)
        return pa.table({c: pa.array(got[:, k], pa.int64()) for k, c in enumerate(("a", "b", "ca", "cb"))})

    def run(batches):
        kept = None
        for b in batches:
            t = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
            v = t["v"].to_numpy()
            if not len(v):
                continue
            end = int(np.searchsorted(v, v[-1]))  # the last list may go on in the next batch
            if end:
                yield from compare(t.slice(0, end)).to_batches()
            kept = t.slice(end)
        if kept is not None:
            yield from compare(kept).to_batches()

    return full.mapInArrow(run, "a long, b long, ca long, cb long").distinct()


def _possible(na, ma, nb, mb):
    """possible() on arrays."""
    most = np.minimum(ma, mb)
    met = np.where((na <= WIDE) & (nb <= WIDE), 7 * most >= 3 * (na + nb), most >= meet(WIDE))
    return met & (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb))


def join_block(ids, n, most, comp, left, right, value, offs) -> list[tuple[int, int]]:
    """Edges between components (comp, comp) that join what the links of left members with right ones join.

    value, offs: the members' full sets. Links are confirmed by counting the values in common.
    """
    size = np.diff(offs)
    row = np.repeat(np.arange(len(size)), size)
    code, _ = pd.factorize(value)
    holders = np.bincount(code)
    live = holders[code] > 1
    row, code = row[live], code[live]
    cut = np.r_[0, np.cumsum(np.bincount(row, minlength=len(size)))]
    often = holders > COMMON
    dense = np.cumsum(often) - 1
    m = np.zeros((len(size), int(often.sum())), np.float32)
    m[row[often[code]], dense[code[often[code]]]] = 1
    # holders of the other values within the right block, value by value
    place = np.full(len(size), -1)
    place[right] = np.arange(len(right))
    rare = np.flatnonzero(~often[code] & (place[row] >= 0))
    rare = rare[np.argsort(code[rare], kind="stable")]
    many = np.bincount(code[rare], minlength=len(holders))
    first = np.cumsum(many) - many
    holder = place[row[rare]]
    lab = pd.factorize(comp)[0]
    out = []
    for part in np.array_split(left, max(1, len(left) // 64)):
        near = _possible(n[part][:, None], most[part][:, None], n[right][None], most[right][None]) & (lab[part][:, None] != lab[right][None])
        keep = near.any(1)
        part, near = part[keep], near[keep]
        if not len(part):
            continue
        at = ragged(cut[part], np.diff(cut)[part])
        v, x = code[at], np.repeat(np.arange(len(part)), np.diff(cut)[part])
        v, x = v[~often[v]], x[~often[v]]
        met = np.repeat(x, many[v]) * len(right) + holder[ragged(first[v], many[v])]
        common = np.bincount(met, minlength=len(part) * len(right)).reshape(len(part), len(right)) + np.rint(m[part] @ m[right].T).astype(np.int64)
        near &= 7 * common >= 3 * (n[part][:, None] + n[right][None])
        for p, y in zip(part[near.any(1)].tolist(), near[near.any(1)], strict=True):
            partners = right[y]
            while len(partners := partners[lab[partners] != lab[p]]):
                out.append((int(comp[p]), int(comp[partners[0]])))
                lab[lab == lab[partners[0]]] = lab[p]
    return out


def _long_edges(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (ca, cb) between components of the members of long lists, from rows(v, id, n, most, comp).

    Families fill many lists, so lists of one leader (v) come as one, each member once. A list's largest component isn't compared with itself; it and the other members are dealt to blocks, and each block of
    others meets each block. What is replicated is linear in the list as long as the others fit in one block.
    """
    sizes = rows.groupBy("v", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s")).groupBy("v").agg(F.max(F.struct("c", "comp", "s")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    deal = lambda c, s: F.greatest(F.ceil(c / BLOCK), F.ceil(s / VALUES)).cast("int")
    plan = sizes.select("v", F.col("top.comp").alias("major"), deal(F.col("top.c"), F.col("top.s")).alias("majors"), deal(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("minors"))
    of = rows.join(plan, "v").withColumn("own", F.when(F.col("comp") == F.col("major"), F.col("minors") + F.pmod(F.xxhash64("id"), F.col("majors"))).otherwise(F.pmod(F.xxhash64("id"), F.col("minors"))).cast("int"))
    last = F.when(F.col("own") < F.col("minors"), F.col("minors") + F.col("majors")).otherwise(F.col("minors")) - 1
    dealt = of.withColumn("other", F.explode(F.sequence(F.lit(0), last))).select("v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "most", "comp")
    full = dealt.join(sets, "id")  # all texts of an id: one of them may have another n

    def compare(t: pa.Table) -> pa.Table:
        ids, n, most, comp, own = (t[c].to_numpy() for c in ("id", "n", "most", "comp", "own"))
        column = t["full"].combine_chunks()
        offs = np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]
        left, right = np.flatnonzero(own == t["i"][0].as_py()), np.flatnonzero(own == t["j"][0].as_py())
        edges = join_block(ids, n, most, comp, left, right, column.flatten().to_numpy(), offs) if len(left) and len(right) else []
        return pa.table({"ca": pa.array([x for x, _ in edges], pa.int64()), "cb": pa.array([y for _, y in edges], pa.int64())})

    return full.groupBy("v", "i", "j").applyInArrow(releasing(compare), "ca long, cb long")


def _joined(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """comp(id, comp) after the components that edges(ca, cb) connect have become one."""
    up = components(edges.select(F.col("ca").alias("src"), F.col("cb").alias("dst"))).select(F.col("id").alias("comp"), F.col("comp").alias("up"))
    return comp.join(up, "comp", "left").select("id", F.coalesce("up", "comp").alias("comp"))


def links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """id, comp of the classes that can have a link; other classes are alone."""
    sets = materialize(full_sets(docs, materialize(suspects(classes), "suspects")), "sets")
    met = materialize(lists(sets), "lists")
    comp = sets.select("id", F.col("id").alias("comp")).distinct()
    failed = None
    for r in range(ROUNDS):
        rows = met.join(comp, "id")
        first = F.xxhash64("id", F.lit(r)) if r else F.col("id")
        mixed = rows.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("id", "comp", "n", "most"), first).alias("lead")).filter("lo < hi")
        pairs = rows.join(mixed.select("v", "lead"), "v").filter("comp != lead.comp").filter(possible(F.col("n"), F.col("most"), F.col("lead.n"), F.col("lead.most")))
        pairs = pairs.select(*_pairs("", "lead.")).distinct()
        if failed is not None:
            pairs = pairs.join(failed, ["a", "b"], "left_anti")
        pairs = materialize(pairs, f"pairs{r}")
        if pairs.isEmpty():
            continue
        good = materialize(verify(pairs, sets), f"links{r}")
        lost = pairs.select("a", "b").join(good.select("a", "b"), ["a", "b"], "left_anti")
        failed = lost if failed is None else failed.unionByName(lost)
        comp = materialize(_joined(comp, good), f"comp{r}")
    rows = met.join(comp, "id")
    mixed = rows.groupBy("v").agg(F.count("*").alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by("id", F.xxhash64("id")).alias("lead")).filter("lo < hi").select("v", "members", "lead")
    rest = materialize(rows.join(mixed, "v"), "rest")
    pairs = _short_pairs(rest.filter(F.col("members") <= SHORT))
    if failed is not None:
        pairs = pairs.join(failed, ["a", "b"], "left_anti")
    long = rest.filter(F.col("members") > SHORT).groupBy(F.col("lead").alias("v"), "id", "n", "comp").agg(F.max("most").alias("most"))
    edges = verify(pairs, sets).select("ca", "cb").unionByName(_long_edges(materialize(long, "long"), sets))
    return _joined(comp, materialize(edges, "edges"))


def cluster(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    with scratch() as work:
        return work.keep(_cluster(docs), "near_dup")


def _cluster(docs: DataFrame) -> DataFrame:
    sk = materialize(sketches(docs), "sketches")
    # one row a class: its smallest id, with that row's sketch
    some = sk.filter("digest is not null and doc_id is not null")
    classes = materialize(some.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes")
    of = sk.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "id"), "digest", "left")
    # the classes of an id that has several texts
    known = of.filter("doc_id is not null and id is not null").select("doc_id", "id")
    both = known.groupBy("doc_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("doc_id", "lo")
    again = materialize(known.join(both, "doc_id").select(F.col("id").alias("ca"), F.col("lo").alias("cb")).distinct(), "again")
    comp = materialize(links(classes.select("id", "n", "sketch"), docs), "comp")
    if not again.isEmpty():
        known = comp.unionByName(again.select(F.explode(F.array("ca", "cb")).alias("id")).distinct().join(comp, "id", "left_anti").select("id", F.col("id").alias("comp")))
        a, b = known.select(F.col("id").alias("ca"), F.col("comp").alias("x")), known.select(F.col("id").alias("cb"), F.col("comp").alias("y"))
        comp = _joined(known, again.join(a, "ca").join(b, "cb").select(F.col("x").alias("ca"), F.col("y").alias("cb")))
    out = of.join(comp, "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
