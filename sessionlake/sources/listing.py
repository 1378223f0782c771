"""Log files under a root as a data source, and the first bytes of some of them.

The driver lists the directories of the first two levels; a task lists what is below
each. Names that begin with _ or . count like any other. Roots that Arrow's file
systems don't reach are listed by Spark's own reader, which leaves such names out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SUFFIX = ".jsonl"
HEAD_BYTES = 1 << 16
FILES = "file_path string, mtime long, size long"
LEVELS = 2  #: of directories that the driver lists
MOST_AT_ONCE = 64  #: heads that a task holds together


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class LogFiles(DataSource):
    """file_path, mtime (ms), size of the files of ``root`` whose names end in .jsonl."""

    @classmethod
    def name(cls) -> str:
        return "log_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return LogFilesReader(self.options["root"])


class LogFilesReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        """A partition for the files of each directory of the upper levels, and for all that is under each of the level below."""
        system, top = file_system(self.root)
        out, level = [Folder(top, False)], [top]
        for depth in range(LEVELS):
            below = [x.path for path in level for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.type == fs.FileType.Directory]
            out += [Folder(path, depth == LEVELS - 1) for path in below]
            level = below
        return out

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.root)
        found = system.get_file_info(fs.FileSelector(partition.path, recursive=partition.deep, allow_not_found=True))
        files = [x for x in found if x.type == fs.FileType.File and x.path.endswith(SUFFIX)]
        yield pa.RecordBatch.from_pydict({"file_path": [x.path for x in files], "mtime": [x.mtime_ns // 1_000_000 for x in files], "size": [x.size for x in files]}, schema=pa.schema({"file_path": pa.string(), "mtime": pa.int64(), "size": pa.int64()}))


def log_files(spark: SparkSession, root: str) -> DataFrame:
    """The same as a table; none where there is no root. Paths of the local file system have no scheme."""
    try:
        system, path = file_system(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return _by_spark(spark, root)
    if system.get_file_info(path).type != fs.FileType.Directory:
        return spark.createDataFrame([], FILES)
    spark.dataSource.register(LogFiles)
    files = spark.read.format("log_files").option("root", root).load()
    scheme = "" if isinstance(system, fs.LocalFileSystem) else root.split("://")[0] + "://"
    return files.withColumn("file_path", F.concat(F.lit(scheme), "file_path"))


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path in batch.column("file_path").to_pylist():
            system, at = file_system(path)
            x = system.get_file_info(at)
            if x.type == fs.FileType.File:
                rows.append((path, x.mtime_ns // 1_000_000, x.size))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file_path", "mtime", "size"])


def files_at(paths: DataFrame) -> DataFrame:
    """The same of the paths (file_path) that are there, without listing anything."""
    return paths.select("file_path").mapInArrow(_told, FILES)


def _by_spark(spark: SparkSession, root: str) -> DataFrame:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], FILES)
    files = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=f"*{SUFFIX}", ignoreMissingFiles="true").load(root)
    return files.select(F.col("path").alias("file_path"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"))


def _read_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, MOST_AT_ONCE):
            rows = batch.slice(lo, MOST_AT_ONCE)
            heads = []
            for path, known in zip(rows.column("file_path").to_pylist(), rows.column("known").to_pylist()):
                head = None
                if known is None:
                    try:
                        system, at = file_system(path)
                        with system.open_input_file(at) as f:
                            head = f.read(HEAD_BYTES).decode("utf-8", "replace")
                    except OSError:  # gone, or not to be read: the load will tell
                        pass
                heads.append(head)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(heads, pa.string())], names=[*rows.schema.names, "head"])


def with_heads(files: DataFrame) -> DataFrame:
    """file_path, mtime, size, known and ``head``: the first 64 KiB of the files where ``known`` is null; others aren't opened."""
    return files.select("file_path", "mtime", "size", "known").mapInArrow(_read_heads, f"{FILES}, known string, head string")
