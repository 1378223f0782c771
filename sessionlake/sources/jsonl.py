"""Session logs: listing, line-wise JSON, and the sessions and messages in them.

A log is one JSON object per line. Lines that aren't JSON or lack a string
timestamp, a string type or an object payload are ignored; a line that is the
bare literal null makes its file an error. A record that repeats a key is
ignored as well, since the parser takes it for invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trim
from ..operators.derive import joined_distinct, looks_internal, path_date, summary, title, verdict, with_seq
from .listing import files_at, log_files, with_heads

LISTING = "file_path string, mtime long, size long, path_date string, cwd string"
UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def plain_path(c: Column) -> Column:
    """A file URI without its scheme, where that is the local one."""
    return F.regexp_replace(c, r"^file:/+", "/")


def text_at(v: Column, path: str) -> Column:
    """The string at a path of a variant; null where there is something else."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _whole(v: Column) -> Column:
    """Whether a variant is a record: a time, a type and an object for its payload."""
    named = (text_at(v, "$.timestamp") != "") & (text_at(v, "$.type") != "")
    return F.coalesce(named & F.schema_of_variant(F.try_variant_get(v, "$.payload", "variant")).startswith("OBJECT"), F.lit(False))


def _records(lines: DataFrame) -> DataFrame:
    """file_path, line_no, timestamp, type, payload of the lines that are records."""
    v = F.try_parse_json("line")
    rows = lines.withColumn("line", trim(F.col("line"))).filter("line <> ''").withColumn("v", v)
    bare = F.col("line") == "null"
    rows = rows.select(
        "file_path", "line_no", bare.alias("bare_null"), F.when(~bare, text_at(F.col("v"), "$.timestamp")).alias("timestamp"),
        F.when(~bare, text_at(F.col("v"), "$.type")).alias("type"), F.try_variant_get("v", "$.payload", "variant").alias("payload"),
    )
    whole = (F.col("timestamp") != "") & (F.col("type") != "") & F.schema_of_variant("payload").startswith("OBJECT")
    return rows.filter(F.col("bare_null") | F.coalesce(whole, F.lit(False)))


def listing(spark: SparkSession, root: str, known: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """file_path, mtime, size, path_date, cwd of every .jsonl file under root, or of those at ``paths`` (file_path).

    The working directory is that of the first record naming one in the first
    64 KiB, which is all that is read of a file. Files that ``known`` (an earlier
    listing) has with the same time and size aren't opened.
    """
    files = log_files(spark, root) if paths is None else files_at(paths)
    if known is None:
        files = files.withColumn("known", F.lit(None).cast("string"))
    else:
        files = files.join(known.select("file_path", "mtime", "size", F.col("cwd").alias("known")), ["file_path", "mtime", "size"], "left")
    rows = with_heads(files).select("file_path", "mtime", "size", "known", F.posexplode_outer(F.split("head", "\n")).alias("line_no", "line"))
    v = F.try_parse_json(trim(F.col("line")))
    rows = rows.withColumn("v", v).withColumn("cwd", F.when(_whole(F.col("v")) & text_at(F.col("v"), "$.type").isin("session_meta", "turn_context"), text_at(F.col("v"), "$.payload.cwd")))
    out = rows.groupBy("file_path", "mtime", "size", "known").agg(F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line_no"))).alias("cwd"))
    return out.select("file_path", "mtime", "size", path_date(F.col("file_path")).alias("path_date"), F.coalesce("known", "cwd", F.lit("")).alias("cwd"))


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_path, line_no, line of the files, which are read by ranges of bytes.

    A range's lines are numbered by their order in its task, and the lines of the
    file's earlier ranges are counted before them: the counts are one row a range.
    """
    rows = spark.read.option("lineSep", "\n").text(paths)
    rows = rows.select(plain_path(F.col("_metadata.file_path")).alias("file_path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    ranges = rows.groupBy("file_path", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    ranges = ranges.withColumn("before", F.sum("n").over(Window.partitionBy("file_path").orderBy("start")) - F.col("n"))
    place = F.col("at") - F.col("first")
    place = F.when(place.between(0, F.col("n") - 1), place).otherwise(F.raise_error("the files changed while they were read"))
    return rows.join(ranges, ["file_path", "start"]).select("file_path", (F.col("before") + place).cast("int").alias("line_no"), "line")


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of the files as plain columns: file_path, line_no, bare_null, timestamp, kind, text, texts, id, cwd, model."""
    return _fields(lines(spark, paths))


def fields(files: DataFrame) -> DataFrame:
    """The same of files given as rows: file_path, value."""
    return _fields(files.select("file_path", F.posexplode(F.split("value", "\n")).alias("line_no", "line")))


def _fields(rows: DataFrame) -> DataFrame:
    rows = _records(rows)
    p, what = F.col("payload"), text_at(F.col("payload"), "$.type")
    kind = (
        F.when(F.col("bare_null"), "error").when(F.col("type").isin("session_meta", "turn_context", "compacted"), F.col("type"))
        .when((F.col("type") == "response_item") & (what == "reasoning"), "reasoning")
        .when((F.col("type") == "event_msg") & (what == "user_message"), "user").when((F.col("type") == "event_msg") & (what == "agent_message"), "assistant")
    )
    parts = F.transform(F.try_variant_get(p, "$.summary", "array<variant>"), lambda x: trim(text_at(x, "$.text")))
    rows = rows.withColumn("kind", kind).filter("kind IS NOT NULL")
    return rows.select(
        "file_path", "line_no", "bare_null", "timestamp", "kind", trim(text_at(p, "$.message")).alias("text"),
        F.when(F.col("kind") == "reasoning", F.filter(parts, lambda x: x != "")).alias("texts"),
        text_at(p, "$.id").alias("id"), text_at(p, "$.cwd").alias("cwd"), text_at(p, "$.model").alias("model"),
    )


def kept_messages(rows: DataFrame) -> DataFrame:
    """file_path, seq, role, content_text, timestamp, source_kind of the messages that a person or the model wrote."""
    said = rows.filter(F.col("kind").isin("user", "assistant") & (F.col("text") != "") & ~looks_internal(F.col("text")))
    said = with_seq(said.select("file_path", "line_no", F.col("kind").alias("role"), F.col("text").alias("content_text"), "timestamp"), "file_path", "line_no")
    return said.drop("line_no").withColumn("source_kind", F.lit("event_msg"))


def parsed_sessions(files: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per file: its verdict (parsed, filtered, skipped, error) and the session's columns."""
    line = F.col("line_no")
    meta = (F.col("kind") == "session_meta") & F.col("cwd").isNotNull()
    told = rows.groupBy("file_path").agg(
        F.bool_or("bare_null").alias("bad"),
        F.min_by("id", F.when((F.col("kind") == "session_meta") & (F.col("id") != ""), line)).alias("meta_id"),
        F.max_by("cwd", F.when(meta, line)).alias("meta_cwd"), F.max(F.when(meta, line)).alias("meta_line"),
        F.array_sort(F.collect_set(F.when((F.col("kind") == "turn_context") & (F.col("cwd") != ""), F.struct("line_no", "cwd")))).alias("turns"),
        F.max_by("model", F.when((F.col("kind") == "turn_context") & F.col("model").isNotNull(), line)).alias("model"),
        F.count_if(F.col("kind").isin("user", "assistant") & looks_internal(F.col("text"))).alias("internal"),
    )
    compact = rows.filter("kind = 'compacted' AND text <> ''").groupBy("file_path").agg(joined_distinct(F.col("text"), "line_no").alias("compact_text"))
    thought = rows.filter("kind = 'reasoning'").select("file_path", "line_no", F.posexplode("texts").alias("part", "text")).withColumn("place", F.struct("line_no", "part"))
    thought = thought.groupBy("file_path").agg(joined_distinct(F.col("text"), "place").alias("reasoning_summary_text"))
    spoken = kept_messages(rows).groupBy("file_path").agg(title().alias("title"), summary().alias("summary_text"), F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"), F.count("*").alias("message_count"))
    out = files.select("file_path", "mtime", "size", "path_date")
    for part in (told, compact, thought, spoken):
        out = out.join(part, "file_path", "left")
    later = F.filter("turns", lambda t: t["line_no"] > F.coalesce("meta_line", F.lit(-1)))
    cwd = F.coalesce(F.when(F.col("meta_cwd") != "", F.col("meta_cwd")), F.try_element_at(later, F.lit(1))["cwd"], F.lit(""))
    named = F.regexp_extract(F.substring_index("file_path", "/", -1), f"({UUID})", 1)
    uuid = F.coalesce(F.when(named != "", named), F.col("meta_id"), F.lit(""))
    blank = {c: F.coalesce(c, F.lit("")) for c in ("model", "compact_text", "reasoning_summary_text", "path_date")}
    counts = {"internal": F.coalesce("internal", F.lit(0)), "message_count": F.coalesce("message_count", F.lit(0))}
    out = out.withColumns(counts | blank | {"cwd": cwd, "session_uuid": uuid})
    state = F.when(F.coalesce("bad", F.lit(False)), "error").otherwise(verdict(F.col("internal"), F.col("message_count"), F.col("session_uuid")))
    return out.withColumn("verdict", state).drop("bad", "meta_id", "meta_cwd", "meta_line", "turns", "internal")
