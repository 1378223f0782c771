"""Logs as they are written: a stream of messages, activity by time, an index that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.derive import looks_internal
from ..operators.selector import Selector
from ..plans.sync import sync
from ..sources import jsonl


def messages(spark: SparkSession, root: str) -> DataFrame:
    """file_path, line_no, role, content_text, at of the messages in every new file under root.

    A file is one row of the source, so a file that grows should be written
    under a temporary name and renamed.
    """
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").schema("value string").load(root)
    rows = jsonl.fields(files.select(jsonl.plain_path(F.col("_metadata.file_path")).alias("file_path"), "value"))
    said = rows.filter(F.col("kind").isin("user", "assistant") & (F.col("text") != "") & ~looks_internal(F.col("text")))
    return said.select("file_path", "line_no", F.col("kind").alias("role"), F.col("text").alias("content_text"), F.try_to_timestamp("timestamp").alias("at"))


def activity(said: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Messages by role in windows of time; a window is final once ``late`` has passed."""
    by = said.withWatermark("at", late).groupBy(F.window("at", every).alias("w"), "role").agg(F.count("*").alias("n"))
    return by.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "role", "n")


def follow(spark: SparkSession, index: str, selector: Selector, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Load a selector's files into the index whenever new ones arrive; once only without ``every``.

    A batch loads the files that it brought and lists no others.
    """
    changes = messages(spark, selector.root).select("file_path")

    def load(batch: DataFrame, _: int) -> None:
        paths = batch.select("file_path").distinct()
        if not paths.isEmpty():
            sync(batch.sparkSession, index, selector, best_effort=True, paths=paths)

    how = {"processingTime": every} if every else {"availableNow": True}
    return changes.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(**how).start()
