"""The conversations table as sessions and messages, and as an index on disk."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dictionary_digest, fts_tokens
from ..operators.derive import joined_distinct, sessions_of, with_seq
from ..sources.scratch import shared_folder
from ..sources.store import EMPTY, INDEX_VERSION, MESSAGES, SESSIONS, SURFACES, Store

ROOT = "/data/sessions"
NOW = "2024-02-01T00:00:00Z"


#: Letters that stand for CJK characters where a query is about those; the tables hold none.
CJK_LETTERS = ("xkj", "法部署")


def _conversations(spark: SparkSession, sf_dir: str, cjk: bool) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.withColumn("text", F.translate("text", *CJK_LETTERS)) if cjk else rows


def messages(spark: SparkSession, sf_dir: str, cjk: bool = False) -> DataFrame:
    """session_uuid, seq, role, content_text, timestamp of user and assistant turns."""
    rows = _conversations(spark, sf_dir, cjk).filter(F.col("role").isin("user", "assistant"))
    rows = with_seq(rows, "conv_id", "turn")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    uuid = F.concat(F.lit("conv-"), F.lpad(F.col("conv_id").cast("string"), 6, "0"))
    return rows.select(uuid.alias("session_uuid"), "conv_id", "seq", "role", F.col("text").alias("content_text"), stamp.alias("timestamp"))


def sessions(spark: SparkSession, sf_dir: str, cjk: bool = False) -> DataFrame:
    """One row per conversation with the columns of the session table."""
    m = messages(spark, sf_dir, cjk)
    notes = _conversations(spark, sf_dir, cjk).filter("role = 'system'").groupBy("conv_id").agg(joined_distinct(F.col("text"), "turn").alias("compact_text"))
    ids = m.groupBy("session_uuid").agg(F.first("conv_id").alias("conv_id"))
    s = sessions_of(m).join(ids, "session_uuid").join(notes, "conv_id", "left").withColumn("compact_text", F.coalesce("compact_text", F.lit(""))).withColumn("reasoning_summary_text", F.lit(""))
    start = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600), "yyyy-MM-dd'T'HH-mm-ss")
    day = F.substring(start, 1, 10)
    path = F.concat(F.lit(f"{ROOT}/"), F.replace(day, F.lit("-"), F.lit("/")), F.lit("/rollout-"), start, F.lit("-"), F.col("session_uuid"), F.lit(".jsonl"))
    return s.withColumns({"cwd": F.concat(F.lit("/work/proj-"), (F.col("conv_id") % 7).cast("string")), "path_date": day, "file_path": path})


def tokenised(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({f"{c}_tokens": fts_tokens(F.col(c)) for c in columns})


def load(spark: SparkSession, sf_dir: str, path: str, cjk: bool = False) -> Store:
    """An index of the conversations at ``path``, where there was none."""
    store = Store(spark, path)
    segment = store.part("segment")
    length = lambda kind: sum((F.size(fts_tokens(F.col(c))) for c in SURFACES[kind][0]), F.lit(0)).cast("long")
    said = messages(spark, sf_dir, cjk).withColumns({"n_tokens": length("messages"), "segment": F.lit(segment), "source_kind": F.lit("table")})
    own = said.groupBy("session_uuid").agg(F.sum("n_tokens").alias("message_tokens"))
    rows = sessions(spark, sf_dir, cjk).join(own, "session_uuid").withColumns({
        "n_tokens": length("sessions"), "segment": F.lit(segment), "source_root": F.lit(ROOT), "model": F.lit(""), "index_version": F.lit(INDEX_VERSION), "updated_at": F.lit(NOW),
        "size": F.col("message_count"), "mtime": F.lit(1704067200000) + F.col("message_count"),
    })
    typed = lambda df, schema: df.to(spark.createDataFrame([], schema).schema)
    with store.writing():
        store.save_segment(segment, typed(said, MESSAGES), typed(rows, SESSIONS))
        state = EMPTY | {"segments": [segment], "synced_at": NOW, "dictionary": dictionary_digest()}
        state["rows"] = {segment: store.messages(state).count()}
        store.publish(state | {"totals": store.totals(store.sessions(state))})
    return store


_stored: dict[tuple[str, str, bool], Store] = {}


def stored(spark: SparkSession, sf_dir: str, cjk: bool = False) -> Store:
    """The same, built once for an application and a folder of tables, in the shared scratch folder."""
    key = (spark.sparkContext.applicationId, sf_dir, cjk)
    if key not in _stored:
        _stored[key] = load(spark, sf_dir, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", cjk)
    return _stored[key]
