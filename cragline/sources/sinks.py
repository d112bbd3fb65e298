"""Several output layers from one pass over their source, with counters taken on the way.

Defined results: a row goes to each layer whose condition holds, a null condition doesn't; a layer without rows has
counters of 0 and null sums; nulls in values stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_layers(df: DataFrame, layers: dict[str, tuple[Column, Column]], path: str, metrics: dict[str, Column] | None = None) -> dict:
    """Write df's rows to layers (name: condition, struct of values), partitioned by layer, in one job; the metrics seen.

    Metrics are aggregates over the written rows, which have `layer` and one struct column named after each layer."""
    names = list(layers)
    out = [F.when(F.lit(n) == F.col("layer"), value).alias(n) for n, (_, value) in layers.items()]
    hit = F.filter(F.array(*[F.when(cond, F.lit(n)) for n, (cond, _) in layers.items()]), lambda x: x.isNotNull())
    rows = df.withColumn("layer", F.explode(hit)).select("layer", *out)
    seen = Observation("layers")
    counts = [F.count(F.when(F.col("layer") == n, 1)).alias(n) for n in names]
    rows.observe(seen, *counts, *[c.alias(k) for k, c in (metrics or {}).items()]).write.partitionBy("layer").parquet(path)
    return seen.get


def read_layer(df: DataFrame, name: str) -> DataFrame:
    """The rows of one layer of the table that write_layers wrote; other layers' files are not read."""
    return df.filter(F.col("layer") == name).select(f"{name}.*")
