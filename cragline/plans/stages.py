"""The staged run: each stage's table is written once, skipped if it exists, and recomputed if it or a stage before it is forced."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Stage:
    """run(spark, {input: DataFrame}, config) -> DataFrame."""

    name: str
    run: Callable[[SparkSession, dict, dict], DataFrame]
    inputs: list[str] = field(default_factory=list)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cascade(stages: list[Stage], force: set[str]) -> set[str]:
    """The forced stages and all that read what they write."""
    out = set(force)
    for s in stages:  # in running order
        if any(i in out for i in s.inputs):
            out.add(s.name)
    return out


def run_stages(spark: SparkSession, stages: list[Stage], folder: str, config: dict | None = None, force: set[str] = frozenset(), skip: set[str] = frozenset(), only: set[str] | None = None) -> list[tuple[str, str]]:
    """(stage, DONE, SKIP or LEFT OUT) in order; tables are folder/stage, so another folder is a region or test of its own.

    skip leaves stages out, only runs no others; a stage whose input was never written raises.
    """
    unknown = (set(force) | set(skip) | set(only or ())) - {s.name for s in stages}
    if unknown:
        raise ValueError(f"no such stages: {', '.join(sorted(unknown))}")
    forced, did = cascade(stages, force) if only is None else set(force), []
    for s in stages:
        path = f"{folder}/{s.name}"
        if s.name in skip or (only is not None and s.name not in only):
            did.append((s.name, "LEFT OUT"))
        elif _exists(spark, path) and s.name not in forced:
            did.append((s.name, "SKIP"))
        else:
            lacking = [i for i in s.inputs if not _exists(spark, f"{folder}/{i}")]
            if lacking:
                raise ValueError(f"{s.name} needs {', '.join(lacking)}")
            read = {i: spark.read.parquet(f"{folder}/{i}") for i in s.inputs}
            s.run(spark, read, config or {}).write.mode("overwrite").parquet(path)
            did.append((s.name, "DONE"))
    return did


def result(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")
