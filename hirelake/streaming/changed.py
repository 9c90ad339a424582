"""Files that are new or have changed since they were read, as a stream, and tables that follow them.

The stream source remembers the newest (modification time, path) it has read; a micro-batch holds the files behind that place,
each with its content. A table that follows the files keeps every micro-batch in a folder of its own, together with the list of
files in it; a file's rows are those of the last micro-batch that held it. So the rows of an edited file are replaced, also when
nothing is left in it, and a replayed micro-batch writes the same folder again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from hirelake.sources import archive

SOURCE = "changed_files"
SCHEMA = "path string, modificationTime timestamp, length long, content binary"
# Bytes of files that one task reads, and files at most.
TASK_BYTES, TASK_FILES = 64 << 20, 1000


class Files(InputPartition):
    """Files of one task: paths as the file system names them, with their modification times in nanoseconds."""

    def __init__(self, files: list[tuple[int, str]]):
        super().__init__(len(files))
        self.files = files


class ChangedFilesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.pattern = options["path"], options.get("pathGlobFilter", "*")

    def _open(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.root) if ":/" in self.root else (fs.LocalFileSystem(), self.root)
        return system, root, self.root.split(":/")[0] + ":" if ":/" in self.root else "file:"

    def _found(self) -> list[tuple[int, str, int]]:
        """``(time, path, length)`` of the matching files, in order."""
        from pyarrow import fs

        system, root, _ = self._open()
        listed = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return sorted((f.mtime_ns or 0, f.path, f.size) for f in listed if f.is_file and fnmatch(f.base_name, self.pattern)
                      and not any(p[:1] in ("_", ".") for p in f.path[len(root):].strip("/").split("/")))

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = self._found()
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        """Files behind ``start``, up to ``end``. One that has changed again since ``end`` was taken belongs to a later batch."""
        made, size = [], 0
        for time, path, length in self._found():
            if (start["time"], start["path"]) < (time, path) <= (end["time"], end["path"]):
                if not made or size + length > TASK_BYTES or len(made[-1]) >= TASK_FILES:
                    made.append([])
                    size = 0
                made[-1].append((time, path))
                size += length
        return [Files(files) for files in made]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _, scheme = self._open()
        for time, path in partition.files:
            with system.open_input_stream(path) as stream:
                content = stream.read()
            stamp = datetime.fromtimestamp(time // 10**9, UTC).replace(microsecond=time // 1000 % 10**6)
            yield pa.RecordBatch.from_arrays(
                [pa.array([scheme + path]), pa.array([stamp], pa.timestamp("us", "UTC")), pa.array([len(content)], pa.int64()),
                 pa.array([content], pa.binary())], names=["path", "modificationTime", "length", "content"])

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the checkpoint."""


class ChangedFiles(DataSource):
    """``readStream.format("changed_files")``: options ``path`` and ``pathGlobFilter``.

    The folder is listed by pyarrow, on the driver and without the session, so it must be one that pyarrow reaches (local, or an
    object store by its address). Files that begin with ``_`` or ``.``, or lie in such folders, are left out. A file that turns up
    with an older time than the newest one read is not seen: write files in place, or move them after setting their time.
    """

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> ChangedFilesReader:
        return ChangedFilesReader(self.options)


def changed_files(spark: SparkSession, path: str, pattern: str = archive.BATCH_PATTERN) -> DataFrame:
    """New and changed files below a folder, as a stream."""
    spark.dataSource.register(ChangedFiles)
    return spark.readStream.format(SOURCE).option("pathGlobFilter", pattern).load(path)


def follow(files: DataFrame, target: str, state: str, rows: Callable[[DataFrame], DataFrame] = archive.postings,
           path_col: str = "batch_path") -> StreamingQuery:
    """Reads everything that has changed into the table ``target`` and stops. ``rows`` makes rows of files; its ``path_col`` says
    which file a row is from. Read the table with :func:`current`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows(batch.select("path", "content")).withColumnRenamed(path_col, "__path").write.mode("overwrite").parquet(
            f"{target}/rows/batch_id={batch_id}")
        # A file whose read failed above has failed the micro-batch, so the list names files that were read.
        batch.select("path", "modificationTime", "length").write.mode("overwrite").parquet(f"{target}/files/batch_id={batch_id}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def files_read(spark: SparkSession, target: str) -> DataFrame:
    """``path, modificationTime, length, batch_id`` of every reading of a file."""
    schema = "path string, modificationTime timestamp, length long, batch_id long"
    return spark.read.schema(schema).parquet(f"{target}/files")


def current(spark: SparkSession, target: str, path_col: str = "batch_path") -> DataFrame:
    """The rows of the last reading of each file."""
    last = files_read(spark, target).groupBy("path").agg(F.max("batch_id").alias("batch_id"))
    kept = spark.read.option("mergeSchema", True).parquet(f"{target}/rows")
    joined = kept.join(last.withColumnRenamed("path", "__path"), ["__path", "batch_id"], "left_semi")
    return joined.withColumnRenamed("__path", path_col).drop("batch_id")


def compacted(spark: SparkSession, target: str, root: str, name: str) -> str:
    """Publishes the current rows as a new version of the table ``name``; returns its path."""
    from hirelake.sources import tables

    return tables.publish(current(spark, target), root, name)
