"""Session helpers: shared folder for cut lineage, written tables and stream state."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

LOCAL_FALLBACK = "/tmp/hirelake-checkpoints"
# Of a batch that goes to a Python worker in the pipeline.
BATCH_BYTES = 1 << 20
# Blocks of so many bytes that such a worker frees go back to the system at once.
FREED_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session (tests, laptop) may fall back to a folder of its own: on a cluster a machine-local
    folder is lost with the machine, so an unset setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return LOCAL_FALLBACK
    raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result below the shared folder and go on from there.

    Lineage ends at the written table, so a lost executor costs only the tasks it was running. Unlike a checkpoint the
    table is columnar, and its size is known to the planner. The folder is scratch space and may be emptied between jobs. The shuffle
    files that it was made from are removed at once.
    """
    path = shared_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The intermediate tables of one job: one folder below the shared folder, removed by :meth:`drop`.

    A result that is still read lazily from the folder must be written elsewhere before ``drop``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = shared_path(spark, name)
        self.names: list[str] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write and read back; see :func:`stored`."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
        """Write in buckets of ``key``, so that later joins and groupings on it need not move these rows again."""
        table = f"{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, key).option("path", f"{self.path}/{table}").format("parquet").saveAsTable(table)
        self.names.append(table)
        return self.spark.table(table)

    def drop(self) -> None:
        for table in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        drop_path(self.spark, self.path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of each written table go when it is written, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def sorted_aggregates(spark: SparkSession) -> Iterator[None]:
    """Inside, lists are collected group by group from sorted rows, which may be spilled, not for many groups at once."""
    key = "spark.sql.execution.useObjectHashAggregateExec"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tuned(spark: SparkSession) -> SparkSession:
    """Session settings that long parser expressions want.

    The Java compiler does not compile methods above 8000 bytecodes to machine code. With this limit Spark leaves
    such stages to its split-up code instead of running one huge method in the interpreter.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on, tables go to Python workers in batches of so many bytes; a longer row is a batch of its own.

    By default a batch is 10,000 rows, however long, so that most tasks are a single batch. Both the executor and the worker hold
    it, and workers, which serve later stages too, keep what their largest batch took.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def freeing_workers(spark: SparkSession, least: int = FREED_BYTES) -> None:
    """From now on, functions run in Python workers that give blocks of so many bytes back to the system when they are freed.

    By default the C library raises that size to that of freed blocks, up to 32 MB, and pyarrow keeps a pool of its own. A worker
    serves task after task, so each kept for all later stages what its largest task took. The variables are read when a worker
    starts: Spark starts workers of their own for functions made with them.
    """
    spark.sparkContext.environment |= {"MALLOC_MMAP_THRESHOLD_": str(least), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def trimmed() -> None:
    """In a Python worker: small blocks that have been freed go back to the system too, where the C library can do that."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever it lies."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
