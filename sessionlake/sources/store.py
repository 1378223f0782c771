"""The index: immutable Parquet parts behind one pointer file.

A load writes one segment: its sessions and messages, the block postings of both
surfaces (``operators.blocks``) and the postings of their CJK characters, sorted by
token and block so that a query reads the pages of its tokens and blocks only; then
it renames a new pointer over the old one. Readers see the old or the new state,
never a mixture, and nothing of earlier loads is rewritten.

Rows of sessions that are gone stay in their segment. A delete vector names them
(session, segment), so a read leaves out those few instead of looking for the live
ones among all sessions; how often each token still counts them is kept beside, so
document frequencies are those of live rows.

Segments of about one size (a factor of TIER) are merged once there are TIER of
them, so a row is rewritten as often as the logarithm of the index. Entries about
merged segments lapse by themselves, since no such segment is live. Parts that a
pointer no longer names are deleted by the load after the next, when no reader of
that pointer should be left.
"""

from __future__ import annotations

import json
import math
import os
import socket
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dictionary_digest, fts_tokens
from ..operators import blocks, grams, recall
from ..plans.find import Indexed
from .jsonl import LISTING

INDEX_VERSION = "4"
LOCK_WAIT_S, LOCK_POLL_S = 10.0, 0.1
TIER = 8  #: segments of about one size that are merged
SESSIONS = (
    "session_uuid string, file_path string, source_root string, title string, summary_text string, compact_text string, reasoning_summary_text string, "
    "cwd string, model string, started_at string, ended_at string, path_date string, message_count long, mtime long, size long, index_version string, "
    "updated_at string, segment string, n_tokens long, message_tokens long"
)
MESSAGES = "session_uuid string, seq long, role string, content_text string, timestamp string, source_kind string, n_tokens long, segment string"
BLOCKS = (
    "token string, block long, n long, most double, least long, "
    "entries array<struct<session_uuid: string, seq: long, n_tokens: long, fields: array<struct<field: int, places: array<int>>>>>, segment string"
)
GRAMS = "gram string, session_uuid string, seq long, segment string"
DELETED = "session_uuid string, segment string"
DEAD = "surface string, token string, n long, segment string"
EMPTY = {"format": INDEX_VERSION, "coverage": None, "manifest": None, "segments": [], "rows": {}, "deleted": [], "dead": [], "dictionary": ""}
#: Text fields of both surfaces, and their weights.
SURFACES = {"messages": (["content_text"], [1.0]), "sessions": (list(recall.SESSION_WEIGHTS), list(recall.SESSION_WEIGHTS.values()))}
COVERAGE = (
    "selector_key string, kind string, root string, cwd string, from_date string, to_date string, source_fingerprint string, "
    "source_file_count long, indexed_session_count long, completed_at string, index_version string"
)


class IndexUnavailable(RuntimeError):
    pass


class LockTimeout(RuntimeError):
    pass


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jvm, self._conf = jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str, overwrite: bool) -> None:
        stream = self._fs.create(self._at(name), overwrite)
        try:
            stream.write(text.encode())
        finally:
            stream.close()

    def _pointer(self) -> dict | None:
        """What the pointer says; None without one, or where an earlier version wrote it: such an index is built anew."""
        told = json.loads(self._read("CURRENT")) if self._fs.exists(self._at("CURRENT")) else {}
        return told if told.get("format") == INDEX_VERSION else None

    def exists(self) -> bool:
        return self._pointer() is not None

    def state(self) -> dict:
        told = self._pointer()
        if told is None:
            raise IndexUnavailable(f"no index at {self.path}: sync first")
        return told

    def size_bytes(self) -> int:
        return self._fs.getContentSummary(self._at("")).getLength() if self.exists() else 0

    def _table(self, part: str | None, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}") if part else self.spark.createDataFrame([], schema)

    def parts(self, names: list[str], schema: str) -> DataFrame:
        """Rows of some parts; none where there are none."""
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{x}" for x in names)) if names else self.spark.createDataFrame([], schema)

    def coverage(self) -> DataFrame:
        return self._table(self.state()["coverage"], COVERAGE)

    def manifest(self) -> DataFrame:
        """The files that the last load of each root listed."""
        return self._table(self.state().get("manifest"), LISTING)

    def live(self, rows: DataFrame, state: dict | None = None) -> DataFrame:
        """Rows (session_uuid, segment) that no delete vector names."""
        state = state or self.state()
        if not state["deleted"]:
            return rows
        gone = self.parts(state["deleted"], DELETED).filter(F.col("segment").isin(state["segments"])).distinct()
        return rows.join(gone, ["session_uuid", "segment"], "left_anti")

    def _live(self, kind: str, schema: str, state: dict | None = None) -> DataFrame:
        state = state or self.state()
        return self.live(self.parts([f"{s}/{kind}" for s in state["segments"]], schema), state)

    def sessions(self, state: dict | None = None) -> DataFrame:
        return self._live("sessions", SESSIONS, state)

    def messages(self, state: dict | None = None) -> DataFrame:
        return self._live("messages", MESSAGES, state)

    def searched(self) -> Indexed:
        """Both surfaces with their postings; the totals are those of the last load."""
        state = self.state()
        if state["dictionary"] != dictionary_digest():
            raise IndexUnavailable(f"the index at {self.path} was built with another dictionary")
        segments = state["segments"]
        dead = self.parts(state["dead"], DEAD).filter(F.col("segment").isin(segments))
        surfaces = {
            k: blocks.Surface(self.parts([f"{s}/{k}-blocks" for s in segments], BLOCKS), *state["totals"][k], weights, dead.filter(F.col("surface") == k), self.live)
            for k, (_, weights) in SURFACES.items()
        }
        return Indexed(self.messages(state), self.sessions(state), surfaces, {k: self.parts([f"{s}/{k}-grams" for s in segments], GRAMS) for k in SURFACES})

    def save_segment(self, segment: str, messages: DataFrame, sessions: DataFrame) -> None:
        """Sessions by their end, messages by session and place, and what finds both by tokens and characters."""
        at = f"{self.path}/{segment}"
        sessions.repartitionByRange("ended_at").sortWithinPartitions("ended_at").write.parquet(f"{at}/sessions")
        messages.repartitionByRange("session_uuid").sortWithinPartitions("session_uuid", "seq").write.parquet(f"{at}/messages")
        rows = {"messages": messages, "sessions": sessions.withColumn("seq", F.lit(None).cast("long"))}
        for kind, (fields, weights) in SURFACES.items():
            own = rows[kind].select("session_uuid", "seq", "n_tokens", *fields)
            of = blocks.block_postings(blocks.numbered(own, "session_uuid", "seq"), fields, weights)
            self._sorted(of.withColumn("segment", F.lit(segment)), BLOCKS, f"{at}/{kind}-blocks", "token", "block")
            chars = grams.gram_postings(own, ["session_uuid", "seq"], fields, grams.CHARS)
            self._sorted(chars.withColumn("segment", F.lit(segment)), GRAMS, f"{at}/{kind}-grams", "gram", "session_uuid")

    def _sorted(self, rows: DataFrame, schema: str, path: str, *by: str) -> None:
        rows = rows.to(self.spark.createDataFrame([], schema).schema)
        rows.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(path)

    def dead_counts(self, sessions: DataFrame, state: dict) -> DataFrame:
        """How often each token of each segment counts the messages and rows of these sessions."""
        said = self.parts([f"{s}/messages" for s in state["segments"]], MESSAGES)
        said = said.join(sessions.select("session_uuid", "segment"), ["session_uuid", "segment"], "left_semi")
        out = None
        for kind, rows in (("messages", said), ("sessions", sessions)):
            tokens = F.array_distinct(F.flatten(F.array(*[fts_tokens(F.col(c)) for c in SURFACES[kind][0]])))
            own = rows.select("segment", F.explode(tokens).alias("token")).groupBy("segment", "token").agg(F.count("*").alias("n")).select(F.lit(kind).alias("surface"), "token", "n", "segment")
            out = own if out is None else out.union(own)
        return out

    def totals(self, sessions: DataFrame) -> dict[str, list[int]]:
        """Rows and tokens of each surface."""
        r = sessions.agg(*[F.coalesce(x, F.lit(0)).alias(k) for k, x in (("m", F.sum("message_count")), ("mt", F.sum("message_tokens")), ("s", F.count("*")), ("st", F.sum("n_tokens")))]).first()
        return {"messages": [r["m"], r["mt"]], "sessions": [r["s"], r["st"]]}

    def crowded(self, state: dict) -> list[str]:
        """Segments of the smallest size of which there are TIER."""
        by: dict[int, list[str]] = {}
        for s in state["segments"]:
            by.setdefault(int(math.log(state["rows"][s] + 1, TIER)), []).append(s)
        return next((x for _, x in sorted(by.items()) if len(x) >= TIER), [])

    def part(self, kind: str) -> str:
        return f"parts/{kind}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, kind: str) -> str:
        name = self.part(kind)
        df.write.parquet(f"{self.path}/{name}")
        return name

    def drop(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def publish(self, state: dict) -> None:
        """Rename a new pointer over the old one; delete what the one before the old one alone named."""
        named = lambda x: {x["coverage"], x["manifest"], *x["segments"], *x["deleted"], *x["dead"]} - {None}
        before = self.state() if self.exists() else EMPTY
        gone = [x for x in before.get("retired", []) if x not in named(state)]
        state = state | {"retired": sorted(named(before) - named(state))}
        name = f"CURRENT.{uuid.uuid4().hex}"
        self._write(name, json.dumps(state, sort_keys=True), True)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        at = self._at("")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(self._fs.makeQualified(self._jvm.org.apache.hadoop.fs.Path(at, name)), self._fs.makeQualified(self._jvm.org.apache.hadoop.fs.Path(at, "CURRENT")), how)
        for part in gone:
            self.drop(part)

    def _stale(self) -> bool:
        try:
            held = json.loads(self._read("LOCK"))
        except Exception:  # gone or half written
            return False
        if held.get("host") != socket.gethostname():
            return False
        try:
            os.kill(int(held["pid"]), 0)
        except ProcessLookupError:
            return True
        except PermissionError:
            return False
        return False

    @contextmanager
    def writing(self, wait: float = LOCK_WAIT_S) -> Iterator[None]:
        """Exclusive writer: a lock file, taken over from a dead process of this host."""
        mine, until = json.dumps({"pid": os.getpid(), "host": socket.gethostname(), "token": uuid.uuid4().hex}), time.monotonic() + wait
        self._fs.mkdirs(self._at(""))
        while True:
            try:
                self._write("LOCK", mine, False)
                break
            except Exception as e:
                if not self._fs.exists(self._at("LOCK")):
                    if time.monotonic() > until:
                        raise
                elif self._stale():
                    self._fs.delete(self._at("LOCK"), False)
                    continue
                elif time.monotonic() > until:
                    raise LockTimeout(f"another writer holds {self.path}") from e
                time.sleep(LOCK_POLL_S)
        try:
            yield
        finally:
            if self._fs.exists(self._at("LOCK")) and self._read("LOCK") == mine:
                self._fs.delete(self._at("LOCK"), False)
