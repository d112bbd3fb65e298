"""Order MinHash fingerprints by DataFrame functions alone.

A text's k-mers are its K code points from each place on (a shorter text is one k-mer), numbered by occurrence: the
second `abc` is another k-mer than the first. `KEPT` distinct k-mers of smallest hash stand for the text; a hash of
k-mer and number deals all their occurrences over `SLOTS` slots. Each slot selects its two smallest, puts them in the
order in which the text has them, and hashes the pair, so that texts agree in a slot only if they have the same k-mers
in the same order. The likeness of two fingerprints is the share of agreeing slots among those that either fills.

No k-mer is shuffled. Only k-mers below a bound that lets some three times KEPT pass are looked at closely; where
repetition leaves fewer than KEPT different ones, all k-mers are, with the same result. A text takes some 10 bytes a
code point of memory while it is worked on, one that repeats itself that much some 150.

Defined results: null texts are empty; an empty text has no k-mer, an empty fingerprint, and likeness 1 to another
empty text only; texts are equal if their two 64-bit hashes are. Documents follow falling doc_id, nulls last, then the
hashes of their texts; equal rows of one doc_id have the same next document and the same result; an empty table
gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch

K = 12
KEPT = 128
SLOTS = 32
#: 63-bit hashes: the slot is what their first five bits say.
_SHIFT = 63 - SLOTS.bit_length() + 1
_MOST = (1 << 63) - 1


def _hash(*cols) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 1)


def _let(value: Column, then) -> Column:
    """then(value), with the value worked out once and held by reference."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _heads(a: Column, key) -> Column:
    """Places (from 0) in array a where key(element) differs from the one before."""
    places = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: (i == 0) | (key(F.get(a, i)) != key(F.get(a, i - 1))))


def signature(text: Column) -> Column:
    """An array of one number a slot, null where the slot has no k-mer."""
    return _let(F.encode(F.coalesce(text, F.lit("")), "UTF-32"), lambda code: _let((F.length(code) / 4).cast("int"), lambda n: _of(code, n)))


def _of(code: Column, n: Column) -> Column:
    """The signature of n code points of four bytes each."""
    kmer = lambda i: _hash(F.substring(code, i, F.lit(4 * K)))
    none = F.array().cast("array<int>")
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - K, F.lit(0)) * 4 + 1, F.lit(4))).otherwise(none)
    distinct = lambda places: F.sort_array(F.array_distinct(F.transform(places, kmer)))
    # the bound lets 3 * KEPT of n hashes pass; short texts pass whole
    short = n <= 3 * KEPT
    bound = F.when(short, F.lit(_MOST)).otherwise((F.lit(_MOST) / n).cast("long") * (3 * KEPT))
    some = _let(bound, lambda most: F.filter(starts, lambda i: kmer(i) <= most))
    # repetition can leave too few different ones: then all are looked at
    chosen = _let(some, lambda p: _let(distinct(p), lambda low: F.when(short | (F.size(low) >= KEPT), _kept(p, low, kmer)).otherwise(_kept(starts, distinct(starts), kmer))))
    return _let(F.sort_array(chosen), _slots)


def _kept(places: Column, low: Column, kmer) -> Column:
    """(hash, place) of the k-mers among the KEPT smallest hashes; low are the distinct hashes in order."""
    return _let(F.coalesce(F.get(low, F.least(F.size(low), F.lit(KEPT)) - 1), F.lit(-1)), lambda last: F.transform(F.filter(places, lambda i: kmer(i) <= last), lambda i: F.struct(kmer(i).alias("x"), i.alias("at"))))


def _slots(kmers: Column) -> Column:
    """The slots' numbers, of kept k-mers in groups of equal ones, each in the order of the text."""
    end = lambda heads, q: F.coalesce(F.get(heads, q + 1), F.size(kmers)) - 1
    number = lambda heads: F.transform(heads, lambda a, q: F.transform(F.sequence(a, end(heads, q)), lambda i: F.struct(_hash(F.get(kmers, i).x, i - a).alias("h"), F.get(kmers, i)["at"].alias("at"))))
    numbered = _let(_heads(kmers, lambda e: e.x), lambda heads: F.sort_array(F.flatten(number(heads))))
    slot = lambda e: F.shiftright(e.h, _SHIFT)
    pair = lambda e, f: F.when(f.isNull() | (slot(f) != slot(e)), F.xxhash64(e.h)).when(e["at"] < f["at"], F.xxhash64(e.h, f.h)).otherwise(F.xxhash64(f.h, e.h))
    taken = lambda a: F.transform(_heads(a, slot), lambda i: F.struct(slot(F.get(a, i)).alias("s"), pair(F.get(a, i), F.get(a, i + 1)).alias("v")))
    filled = _let(numbered, taken)
    return _let(F.map_from_entries(filled), lambda m: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SLOTS - 1).cast("long")), lambda s: F.try_element_at(m, s)))


def fingerprint(signature: Column) -> Column:
    """Eight hexadecimal digits a slot, points where it has no k-mer; empty without any k-mer."""
    said = F.array_join(F.transform(signature, lambda h: F.coalesce(F.lpad(F.lower(F.hex(h.bitwiseAND(0xFFFFFFFF))), 8, "0"), F.lit("." * 8))), "")
    return F.when(F.exists(signature, lambda h: h.isNotNull()), said).otherwise("")


def likeness(a: Column, b: Column) -> Column:
    """Share of the slots filled in either signature that agree; 1 if both are empty."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    same = F.size(F.filter(both, lambda p: p.a == p.b))
    filled = F.size(F.filter(both, lambda p: p.a.isNotNull() | p.b.isNotNull()))
    return F.when(filled == 0, F.lit(1.0)).otherwise(same / filled)


def _following(docs: DataFrame) -> DataFrame:
    """Each document's key (none, id, a, b), its length n, and the next one's key in t by falling id; the last has the first as next.

    Documents are put in range partitions, whose borders are few rows."""
    key = ["none", "id", "a", "b"]
    order = [F.asc("none"), F.desc("id"), F.asc("a"), F.asc("b")]
    keys = docs.select(*key, F.char_length("text").alias("n")).distinct()
    ranged = materialize(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "order")
    me = F.struct(*key)
    # one row a partition
    heads = ranged.groupBy("part").agg(F.min(F.struct("none", (-F.col("id")).alias("down"), "a", "b")).alias("h"))
    heads = heads.select("part", F.struct("h.none", (-F.col("h.down")).alias("id"), "h.a", "h.b").alias("h"))
    around = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("h").over(around), F.first("h").over(around)).alias("behind"))
    inside = ranged.withColumn("next", F.lead(me).over(Window.partitionBy("part").orderBy(*order)))
    return inside.join(F.broadcast(heads), "part").select(*key, "n", F.coalesce("next", "behind").alias("t"))


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document.
    """
    key = ["none", "id", "a", "b"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), text.alias("text"))
    rows = rows.withColumns({"a": F.xxhash64("text"), "b": F.xxhash64(F.lit(1), "text")})
    with scratch() as work:
        follow = materialize(_following(rows), "next")
        # each text is shuffled once; the one before gets as much of it as it needs
        before = follow.select(*[F.col(f"t.{c}").alias(c) for c in key], F.struct(*key).alias("to"), F.floor(F.col("n") / 2).cast("int").alias("take"))
        own = rows.join(follow.join(before, key), key)
        sent = own.select(*[F.col(f"to.{c}").alias(c) for c in key], F.substring("text", F.lit(1), F.col("take")).alias("given")).dropDuplicates(key)
        met = own.join(sent, key)
        n = F.col("n")
        d = met.withColumn("changed", F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), "given"))
        d = d.select(*key, "n", "t", "text", "changed", F.sha2("changed", 256).alias("sha"))
        d = materialize(d.select(*key, "n", "t", "sha", signature(F.col("text")).alias("own"), signature(F.col("changed")).alias("new")), "signatures")
        near = d.select(*[F.col(c).alias(f"t_{c}") for c in key], F.col("own").alias("theirs")).dropDuplicates([f"t_{c}" for c in key])
        out = d.join(near, [F.col(f"t.{c}") == F.col(f"t_{c}") for c in key])
        doc_id = F.when(~F.col("none"), F.col("id"))
        return work.keep(out.select(doc_id.alias("doc_id"), F.col("n").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("new")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("theirs")).alias("near_next")), "near")
