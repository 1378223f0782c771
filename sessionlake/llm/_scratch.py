"""Shared-folder helpers: where intermediate tables go and how they are cut.

Everything written here lands under ``spark.checkpoint.dir`` (a folder that
driver and executors share). Only where the cluster names none, as in tests,
a folder of our own is made and registered.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: While a table is written: shuffle files go at the end of the execution that made them, and Python gets small batches.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, by its conf or its context; set to a fresh one only where unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="sessionlake-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit; the folder is scratch
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: lost executors cost a re-read, not a recomputation.
    So the files of the shuffles that led to the table may go once it is there.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path  # with the frame, so that nothing else keeps its plan alive
    return out


def released(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing will read again."""
    for df in tables:
        path = df.__dict__.pop("_written_to", None)
        if path:
            _remove(df.sparkSession, path)
