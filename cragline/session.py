"""Session construction, the shared work folder and the tables written there."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local = threading.local()


def get_session(cores: str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cragline")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir.

    Where the setting is absent a temporary folder stands in, in local mode only; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the driver and the executors")
        base = "file://" + tempfile.mkdtemp(prefix="cragline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextlib.contextmanager
def _release(spark: SparkSession):
    """Shuffle files of a finished query go at once: what it wrote needs them no more."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/cragline-{uuid.uuid4().hex}"
    if getattr(_local, "open", None):
        _local.open[-1].append((spark, folder))
    with _release(spark):
        df.write.parquet(f"{folder}/{tag}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{tag}")


def to_arrow(df: DataFrame):
    """The rows on the driver; the query's shuffle files go."""
    with _release(df.sparkSession):
        return df.toArrow()


class Work:
    """The tables written since scratch() was entered."""

    def __init__(self):
        self.tables: list = []

    def keep(self, df: DataFrame, tag: str = "stage") -> DataFrame:
        """Write df as a table that outlives this scope (but not an outer one)."""
        _local.open.pop()
        try:
            return materialize(df, tag)
        finally:
            _local.open.append(self.tables)


@contextlib.contextmanager
def scratch():
    """Tables that materialize() writes inside are deleted at the end, but for those of keep()."""
    if not hasattr(_local, "open"):
        _local.open = []
    work = Work()
    _local.open.append(work.tables)
    try:
        yield work
    finally:
        _local.open.pop()
        for spark, folder in work.tables:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
