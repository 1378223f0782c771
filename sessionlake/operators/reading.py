"""Progressive reading: windows, pages, listings, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def message_range(messages: DataFrame, session_uuid: str, anchor: int, before: int = 2, after: int = 2) -> DataFrame:
    return messages.filter((F.col("session_uuid") == session_uuid) & F.col("seq").between(max(0, anchor - before), anchor + after)).orderBy("seq")


def message_ranges(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (with session_uuid, first, last) and the messages of each range."""
    m = messages.select("session_uuid", "seq", "role", "timestamp", "content_text")
    return m.join(wanted, "session_uuid").filter(F.col("seq").between(F.col("first"), F.col("last")))


def message_page(messages: DataFrame, session_uuid: str, offset: int = 0, limit: int = 20) -> DataFrame:
    return messages.filter(F.col("session_uuid") == session_uuid).orderBy("seq").offset(offset).limit(limit)


def page_state(sessions: DataFrame, messages: DataFrame, session_uuid: str, offset: int, limit: int) -> DataFrame:
    got = message_page(messages, session_uuid, offset, limit).agg(F.count("*").alias("returned"))
    total = sessions.filter(F.col("session_uuid") == session_uuid).select(F.col("message_count").alias("total_count"))
    return total.join(F.broadcast(got)).withColumn("has_more", F.lit(offset) + F.col("returned") < F.col("total_count"))


LIST_ORDER = {"ended": "ended_at", "started": "started_at", "messages": "message_count"}


def list_sessions(sessions: DataFrame, cwd: str | None = None, since: str | None = None, sort: str = "ended", limit: int = 20) -> DataFrame:
    rows = sessions
    if cwd:
        rows = rows.filter(F.contains(F.lower("cwd"), F.lit(cwd.lower())))
    if since:
        rows = rows.filter(F.col("ended_at") >= since)
    return rows.orderBy(F.col(LIST_ORDER.get(sort, "ended_at")).desc(), "session_uuid").limit(limit)


def stats(sessions: DataFrame) -> DataFrame:
    return sessions.agg(
        F.count("*").alias("session_count"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("message_count"),
        F.min("started_at").alias("earliest"), F.max("ended_at").alias("latest"), F.max("path_date").alias("last_path_date"),
    )


def top_cwds(sessions: DataFrame, limit: int = 10) -> DataFrame:
    return sessions.filter("cwd <> ''").groupBy("cwd").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "cwd").limit(limit)


def inventory(files: DataFrame) -> DataFrame:
    """Per working directory: files and range of path dates."""
    return files.filter("cwd <> ''").groupBy("cwd").agg(F.count("*").alias("n"), F.min("path_date").alias("from_date"), F.max("path_date").alias("to_date"))


def _joined(rows: list[str]) -> Column:
    """The last of the columns of a group's rows, in order, one behind the other."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*rows))), lambda r: r[rows[-1]]), "")


def fingerprint(files: DataFrame, root: str) -> DataFrame:
    """One sha256 over the root and a digest of each directory's files, in path order, and the number of files.

    A directory's digest is over each file's relative path, time, size, date and
    cwd; so no row holds more than the files of one directory or the directories.
    """
    return fingerprints(files.withColumn("root", F.lit(root)), []).select(F.coalesce("fingerprint", F.sha2(F.lit(root), 256)).alias("fingerprint"), "file_count")


def fingerprints(files: DataFrame, keys: list[str]) -> DataFrame:
    """The same of files that hold their ``root`` and keys, for each of the keys' values."""
    below = F.substr(F.col("file_path"), F.length(F.rtrim("root", F.lit("/"))) + 2)
    line = F.concat_ws("\0", F.lit(""), below, F.col("mtime").cast("string"), F.col("size").cast("string"), F.coalesce("path_date", F.lit("")), F.coalesce("cwd", F.lit("")))
    folders = files.withColumns({"folder": F.regexp_replace("file_path", "/[^/]*$", ""), "line": line}).groupBy(*keys, "root", "folder").agg(F.sha2(_joined(["file_path", "line"]), 256).alias("digest"), F.count("*").alias("n"))
    folders = folders.withColumn("line", F.concat_ws("\0", F.lit(""), "folder", "digest"))
    return folders.groupBy(*keys).agg(F.sha2(F.concat(F.max("root"), _joined(["folder", "line"])), 256).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("file_count"))
