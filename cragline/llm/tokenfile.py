"""Token-ID files: bit-plane shuffled, zstandard-compressed id blocks with a chunk index.

A data set is a folder with two Parquet containers, so that any Hadoop file system can hold it:
  blocks  shard, chunk, n_ids, doc_ids, lengths, planes, index - the ids of whole consecutive documents, cut
          into fixed-size blocks; every block is transposed into byte (or bit) planes, each plane compressed on
          its own; `index` holds the end of each plane within `planes`
  shards  shard, n_ids, start - the global position of each shard's first id
Shards hold ascending doc_id ranges. Every document ends with the end id.

Defined results: null or empty texts hold the end id alone; null doc_ids come first; repeated doc_ids stay, in
the order of their texts; an empty table gives no files' rows; columns besides doc_id and text are not looked at.
The library sees each text whole, so a worker needs memory in proportion to its longest text.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .bpe import load_spec, worker_store
from .common import pieces

BLOCK = 1 << 16
#: Texts in a call of the library.
CALL = 64


def shuffle_planes(ids: np.ndarray, planes: str = "byte", level: int = 1) -> tuple[bytes, list[int]]:
    """Compressed planes of each fixed-size block of ids, and where each plane ends."""
    z = zstandard.ZstdCompressor(level=level)
    out, ends, at = [], [], 0
    for k in range(0, len(ids), BLOCK):
        raw = np.ascontiguousarray(ids[k : k + BLOCK].astype("<u4")).view(np.uint8).reshape(-1, 4)
        rows = raw.T if planes == "byte" else np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)
        for row in rows:
            out.append(z.compress(np.ascontiguousarray(row).tobytes()))
            at += len(out[-1])
            ends.append(at)
    return b"".join(out), ends


def join_planes(data: bytes, ends: list[int], n: int, planes: str = "byte") -> np.ndarray:
    """The ids back from their planes."""
    z = zstandard.ZstdDecompressor()
    per = 4 if planes == "byte" else 32
    starts = [0, *ends[:-1]]
    got = []
    for k in range(0, n, BLOCK):
        m = min(BLOCK, n - k)
        b = k // BLOCK * per
        rows = [np.frombuffer(z.decompress(data[starts[b + j] : ends[b + j]]), np.uint8) for j in range(per)]
        if planes == "byte":
            raw = np.stack(rows, axis=1)
        else:
            raw = np.packbits(np.stack([np.unpackbits(r)[:m] for r in rows], axis=1), axis=1, bitorder="little")
        got.append(np.ascontiguousarray(raw).view("<u4").ravel())
    return np.concatenate(got) if got else np.zeros(0, np.uint32)


class Library:
    """Encodes whole texts by the tokenizers library."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and offsets; a call holds few texts, since the library keeps much a token."""
        flat_ids, sizes = array("I"), []
        for k in range(0, len(texts), CALL):
            part = [t or "" for t in texts.slice(k, CALL).to_pylist()]
            for e in self.tok.encode_batch_fast(part, add_special_tokens=False):
                ids = e.ids  # makes a new list
                flat_ids.fromlist(ids)  # numpy takes seven times as long over a list
                sizes.append(len(ids))
        return np.asarray(flat_ids, np.uint32), np.r_[0, np.cumsum(sizes, dtype=np.int64)]


def write(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 1, planes: str = "byte") -> str:
    """Encode every text with the public library and write the files; returns the folder."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/cragline-{uuid.uuid4().hex}/tokens"
    spec = spark.sparkContext.broadcast(load_spec(path))

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        store, shard, chunk = worker_store(("library", path), lambda: Library(spec.value)), TaskContext.get().partitionId(), 0
        for b in pieces(batches, "text"):
            ids, offs = store.encode(b.column("text"))
            n = len(offs) - 1
            ids = np.insert(ids, offs[1:], np.uint32(end_id))
            data, ends = shuffle_planes(ids, planes)
            if not n:
                continue
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()),
                    "chunk": pa.array([chunk], pa.int32()),
                    "n_ids": pa.array([len(ids)], pa.int64()),
                    "doc_ids": pa.array([b.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "lengths": pa.array([np.diff(offs) + 1], pa.list_(pa.int64())),
                    "planes": pa.array([data], pa.binary()),
                    "index": pa.array([ends], pa.list_(pa.int64())),
                }
            )
            chunk += 1

    (
        docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, "shard int, chunk int, n_ids long, doc_ids array<long>, lengths array<long>, planes binary, index array<long>")
        .write.parquet(f"{folder}/blocks")
    )
    # one row a shard: the running sum has as many rows as there are files
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spark.read.parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).select("shard", "n_ids", F.coalesce(F.sum("n_ids").over(w), F.lit(0)).cast("long").alias("start")).coalesce(1).write.parquet(f"{folder}/shards")
    return folder


def read(spark, folder: str, planes: str = "byte") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and nothing else is kept in memory) from the files."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    w = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        blocks.select("shard", "chunk", "n_ids")
        .withColumn("before", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))
        .join(spark.read.parquet(f"{folder}/shards").select("shard", "start"), "shard")
        .select("shard", "chunk", (F.col("start") + F.col("before")).alias("start"))
    )

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = join_planes(r["planes"], r["index"], r["n_ids"], planes)
                raw = memoryview(ids.astype("<u4")).cast("B")
                n = np.array(r["lengths"], np.int64)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(r["doc_ids"], pa.int64()),
                        "start": pa.array(r["start"] + ends - n, pa.int64()),
                        "n_tokens": pa.array(n, pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.int64()),
                    }
                )

    return blocks.join(base, ["shard", "chunk"]).select("start", "n_ids", "doc_ids", "lengths", "planes", "index").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
