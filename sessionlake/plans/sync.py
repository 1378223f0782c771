"""Loading logs into the index, and what the index covers."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dictionary_digest, fts_tokens
from ..operators import reading
from ..operators.derive import source_root
from ..operators.selector import Selector, implies
from ..sources import jsonl
from ..sources.store import COVERAGE, EMPTY, INDEX_VERSION, MESSAGES, SURFACES, Store

ACTIONS = ("added", "updated", "skipped", "filtered", "removed", "errors")


class SyncFailed(RuntimeError):
    pass


@dataclass
class SyncResult:
    scanned: int = 0
    added: int = 0
    updated: int = 0
    skipped: int = 0
    filtered: int = 0
    removed: int = 0
    errors: int = 0
    coverage_written: bool = False
    reason: str = ""


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def about(files: DataFrame, selector: Selector) -> DataFrame:
    """The files that a selector is about."""
    return files.filter(F.coalesce(selector.predicate(), F.lit(False)))


def snapshot(spark: SparkSession, selector: Selector, known: DataFrame | None = None) -> DataFrame:
    """The same of the files that are there now; those that are as ``known`` has them aren't opened."""
    return about(jsonl.listing(spark, selector.root, known), selector)


def classify(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """The files with ``known`` (there is a row for the path) and ``unchanged``."""
    old = sessions.select("file_path", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"), F.col("index_version").alias("old_version"))
    same = (F.col("mtime") == F.col("old_mtime")) & (F.col("size") == F.col("old_size")) & (F.col("old_version") == INDEX_VERSION)
    return files.join(old, "file_path", "left").withColumns({"known": F.col("old_version").isNotNull(), "unchanged": F.coalesce(same, F.lit(False))}).drop("old_mtime", "old_size", "old_version")


def actions(seen: DataFrame, found: DataFrame | None) -> DataFrame:
    """file_path, action of every file: unchanged ones are skipped, the others go by their verdict.

    ``found`` holds file_path, verdict and known of the files that were read.
    """
    out = seen.filter("unchanged").select("file_path", F.lit("skipped").alias("action"))
    if found is None:
        return out
    by = F.when(F.col("verdict") == "parsed", F.when(F.col("known"), "updated").otherwise("added")).when(F.col("verdict") == "error", "errors").otherwise(F.col("verdict"))
    return out.union(found.select("file_path", by.alias("action")))


def counters(acted: DataFrame) -> DataFrame:
    return acted.groupBy("action").agg(F.count("*").alias("n"))


def retained(seen: DataFrame, found: DataFrame | None) -> DataFrame:
    """file_path of the files whose sessions stay."""
    out = seen.filter("unchanged").select("file_path")
    return out if found is None else out.union(found.filter("verdict = 'parsed'").select("file_path")).distinct()


def lost(sessions: DataFrame, selector: Selector, stay: DataFrame) -> DataFrame:
    """Sessions of a selector whose files are gone."""
    return sessions.filter(F.coalesce(selector.predicate(), F.lit(False))).join(stay, "file_path", "left_anti")


_PARTS = ("kind", "root", "cwd", "from_date", "to_date")


def answering(coverage: DataFrame, wants: DataFrame, version: str = INDEX_VERSION) -> DataFrame:
    """wants with each entry of this version that answers it: entry columns follow as ``have_*``, null where there is none.

    Both are one row a selector, a handful by nature.
    """
    have = coverage.filter(F.col("index_version") == version).select(*[F.col(c).alias(f"have_{c}") for c in coverage.columns])
    return wants.join(F.broadcast(have), implies({c: F.col(f"have_{c}") for c in _PARTS}, {c: F.col(c) for c in _PARTS}), "left")


def freshness_of(entries: DataFrame, version: str = INDEX_VERSION) -> DataFrame:
    """entries (with the present ``now_fingerprint`` and ``now_file_count``) and their ``freshness``."""
    same = (F.col("now_fingerprint") == F.col("source_fingerprint")) & (F.col("now_file_count") == F.col("source_file_count")) & (F.col("index_version") == version)
    return entries.withColumn("freshness", F.when(F.coalesce(same, F.lit(False)), "fresh").otherwise("stale"))


def requested(coverage: DataFrame, wants: DataFrame, version: str = INDEX_VERSION) -> DataFrame:
    """want, state and recommended_action of every wanted selector; coverage has its ``freshness``."""
    by = answering(coverage, wants, version).groupBy("want").agg(
        F.when(F.bool_or(F.col("have_freshness") == "fresh"), "fresh").when(F.count("have_kind") > 0, "stale").otherwise("missing").alias("state")
    )
    return by.withColumn("recommended_action", F.when(F.col("state") == "fresh", "query").otherwise("sync"))


def about_session(coverage: DataFrame, root: Column, cwd: Column, day: Column) -> Column:
    """Whether a coverage entry includes a session of this root, directory and date."""
    have, none = {c: F.col(c) for c in _PARTS}, F.lit(None).cast("string")
    asked = [("all", none, none), ("cwd", cwd, none), ("date_range", none, day), ("cwd_date_range", cwd, day)]
    hit = F.lit(False)
    for kind, c, d in asked:
        named = (c.isNotNull() if "cwd" in kind else F.lit(True)) & (d.isNotNull() if "date" in kind else F.lit(True))
        hit = hit | (named & F.coalesce(implies(have, {"kind": F.lit(kind), "root": root, "cwd": c, "from_date": d, "to_date": d}), F.lit(False)))
    return hit


def _merge(store: Store, state: dict, segments: list[str]) -> None:
    """One segment of what these hold of live sessions."""
    name, some = store.part("segment"), state | {"segments": segments}
    moved = lambda rows: rows.withColumn("segment", F.lit(name))
    store.save_segment(name, moved(store.messages(some)), moved(store.sessions(some)))
    state["segments"] = [s for s in state["segments"] if s not in segments] + [name]
    state["rows"] = {s: state["rows"].get(s) for s in state["segments"]} | {name: store.parts([f"{name}/messages"], MESSAGES).count()}


def sync(spark: SparkSession, index: str, selector: Selector, best_effort: bool = False, paths: DataFrame | None = None) -> SyncResult:
    """Bring the index up to date with the files of a selector.

    Strict: any file in error, or files that change meanwhile, leave the index
    as it was; rows of files that are gone are removed; coverage is recorded.
    Best effort: files in error are counted and left out; nothing else is
    removed and no coverage is recorded. A best-effort load may be told the
    ``paths`` (file_path) that are new or changed; it then looks at no others.
    """
    if paths is not None and not best_effort:
        raise ValueError("only a best-effort load is of some paths")
    selector, store, staged = selector.canonical(), Store(spark, index), []

    def stage(df: DataFrame, kind: str) -> DataFrame:
        staged.append(store.save(df, f"staging-{kind}"))
        return spark.read.schema(df.schema).parquet(f"{store.path}/{staged[-1]}")

    with store.writing():
        try:
            state = store.state() if store.exists() else EMPTY | {"dictionary": dictionary_digest()}
            if state["dictionary"] != dictionary_digest():
                raise SyncFailed("the index was built with another dictionary, nothing written")
            before = set(state["segments"])
            sessions, coverage = store.sessions(state), store.coverage() if state["coverage"] else None
            known = store.manifest() if store.exists() else None
            listed = stage(jsonl.listing(spark, selector.root, known, paths), "listing")
            files = about(listed, selector)
            seen = stage(classify(files, sessions), "classes")
            print_ = reading.fingerprint(files, selector.root).first()
            # one path per changed file: the driver holds as much to plan any scan of them
            changed = [r["file_path"] for r in seen.filter("NOT unchanged").select("file_path").collect()]
            rows = stage(jsonl.records(spark, changed), "records") if changed else None
            found = stage(jsonl.parsed_sessions(seen.filter("NOT unchanged"), rows).join(seen.select("file_path", "known"), "file_path"), "sessions") if changed else None
            out = SyncResult(scanned=print_["file_count"])
            for r in counters(actions(seen, found)).collect():
                setattr(out, r["action"], r["n"])
            if not best_effort:
                if out.errors:
                    bad = [r["file_path"] for r in found.filter("verdict = 'error'").select("file_path").orderBy("file_path").limit(20).collect()]
                    raise SyncFailed(f"{out.errors} files in error, nothing written: {', '.join(bad)}")
                if reading.fingerprint(snapshot(spark, selector, listed), selector.root).first() != print_:
                    raise SyncFailed("the files changed during the sync, nothing written")

            stamp, dead = now(), None
            if changed:
                parsed = found.filter("verdict = 'parsed'")
                last = parsed.groupBy("session_uuid").agg(F.max("file_path").alias("file_path"))  # a session in two files: the last path wins
                parsed = parsed.join(last, ["session_uuid", "file_path"], "left_semi")
                segment = store.part("segment")
                said = jsonl.kept_messages(rows).join(parsed.select("session_uuid", "file_path"), "file_path")
                said = said.withColumns({"n_tokens": F.size(fts_tokens(F.col("content_text"))).cast("long"), "segment": F.lit(segment)})
                said = stage(said.select(*spark.createDataFrame([], MESSAGES).columns), "messages")
                root = source_root(F.col("file_path")) if best_effort else F.lit(selector.root)
                length = sum((F.size(fts_tokens(F.col(c))) for c in SURFACES["sessions"][0]), F.lit(0)).cast("long")
                spoken = said.groupBy("session_uuid").agg(F.sum("n_tokens").alias("message_tokens"))
                new = parsed.join(spoken, "session_uuid", "left").withColumns({"source_root": root, "index_version": F.lit(INDEX_VERSION), "updated_at": F.lit(stamp), "segment": F.lit(segment), "n_tokens": length, "message_tokens": F.coalesce("message_tokens", F.lit(0).cast("long"))})
                new = stage(new.select(*sessions.columns), "new-sessions")
                # rows of files that were read again, and of sessions that are in other files now
                read = found.filter("verdict IN ('parsed', 'filtered')").select("file_path")
                dead = sessions.join(read, "file_path", "left_semi").unionByName(sessions.join(new.select("session_uuid"), "session_uuid", "left_semi"))
            if not best_effort:
                left = lost(sessions, selector, retained(seen, found))
                left = left if dead is None else left.join(dead.select("session_uuid"), "session_uuid", "left_anti")
                out.removed = left.count()
                dead = left if dead is None else dead.unionByName(left)
            if dead is not None and state["segments"] and not (dead := stage(dead.distinct(), "dead")).isEmpty():
                state["dead"] = [*state["dead"], store.save(store.dead_counts(dead, state), "dead")]
                state["deleted"] = [*state["deleted"], store.save(dead.select("session_uuid", "segment"), "deleted")]
            if changed and (n := said.count()):
                store.save_segment(segment, said, new)
                state["segments"], state["rows"] = [*state["segments"], segment], state["rows"] | {segment: n}
            while some := store.crowded(state):
                _merge(store, state, some)
                staged += [s for s in some if s not in before]  # no pointer ever names it
            if not state["segments"]:
                state["deleted"], state["dead"] = [], []
            if known is not None:  # what this load didn't list stays as it was told
                inside = F.col("file_path").startswith(selector.root.rstrip("/") + "/")
                others = known.filter(~inside) if paths is None else known.join(listed.select("file_path"), "file_path", "left_anti")
                listed = listed.unionByName(others)
            state["manifest"] = store.save(listed, "manifest")
            loaded = store.sessions(state)
            state["totals"] = store.totals(loaded)
            if best_effort:
                out.reason = "best_effort"
            else:
                entry = loaded.filter(F.coalesce(selector.predicate(), F.lit(False))).agg(F.count("*").alias("indexed_session_count")).select(
                    F.lit(selector.key()).alias("selector_key"), *(c.alias(k) for k, c in selector.columns().items()), F.lit(print_["fingerprint"]).alias("source_fingerprint"),
                    F.lit(print_["file_count"]).cast("long").alias("source_file_count"), "indexed_session_count", F.lit(stamp).alias("completed_at"), F.lit(INDEX_VERSION).alias("index_version"),
                )
                others = coverage.filter(F.col("selector_key") != selector.key()) if coverage is not None else None
                state["coverage"] = store.save(others.unionByName(entry) if others is not None else entry, "coverage")
                out.coverage_written = True
            state["synced_at"] = stamp
            store.publish(state)
            return out
        finally:
            for name in staged:
                store.drop(name)


def _one(spark: SparkSession, selector: Selector) -> DataFrame:
    return spark.range(1).select(F.lit(0).alias("want"), *(c.alias(k) for k, c in selector.canonical().columns().items()))


def covering(store: Store, selector: Selector) -> DataFrame:
    """Coverage of this version of the index that answers a selector, newest first."""
    rows = answering(store.coverage(), _one(store.spark, selector)).filter("have_kind IS NOT NULL")
    return rows.select(*[F.col(f"have_{c}").alias(c) for c in store.coverage().columns]).orderBy(F.col("completed_at").desc(), "selector_key")


def session_coverage(store: Store, session: dict) -> list[dict]:
    """Coverage entries that include a session, of any version."""
    rows = store.coverage()
    day, cwd = (F.lit(session[c] or None).cast("string") for c in ("path_date", "cwd"))
    return [r.asDict() for r in rows.filter(about_session(rows, F.lit(session["source_root"]), cwd, day)).orderBy(F.col("completed_at").desc(), "selector_key").collect()]


def freshness(spark: SparkSession, store: Store) -> DataFrame:
    """Each coverage entry with its freshness: every root is listed once, and each entry's files are looked up in one plan."""
    entries = store.coverage()
    roots = [r["root"] for r in entries.select("root").distinct().orderBy("root").collect()]  # a handful
    files = spark.createDataFrame([], f"{jsonl.LISTING}, root string")
    for root in roots:
        files = files.unionByName(jsonl.listing(spark, root, store.manifest()).withColumn("root", F.lit(root)))
    e = entries.select("selector_key", *[F.col(c).alias(f"of_{c}") for c in _PARTS])
    mine = (F.col("root") == F.col("of_root")) & (~F.col("of_kind").contains("cwd") | (F.col("cwd") == F.col("of_cwd"))) & (~F.col("of_kind").contains("date") | F.col("path_date").between(F.col("of_from_date"), F.col("of_to_date")))
    now_ = reading.fingerprints(files.join(F.broadcast(e), mine), ["selector_key"])  # entries are one row a selector
    at = entries.join(now_, "selector_key", "left").withColumns({"now_fingerprint": F.coalesce("fingerprint", F.sha2("root", 256)), "now_file_count": F.coalesce("file_count", F.lit(0))})
    return freshness_of(at).select(*entries.columns, "freshness").orderBy(F.col("completed_at").desc(), "selector_key")


def status(spark: SparkSession, index: str, root: str, selector: Selector | None = None, groups: int = 100) -> dict:
    """Inventory of a root, state of the index, freshness of its coverage and what to do for a selector. Writes nothing.

    The inventory shows the ``groups`` directories of most files, and how many there are in all.
    """
    store = Store(spark, index)
    files = jsonl.listing(spark, root, store.manifest() if store.exists() else None)
    totals = files.agg(F.count("*").alias("file_count"), F.min("path_date").alias("from_date"), F.max("path_date").alias("to_date"), F.count_distinct(F.nullif("cwd", F.lit(""))).alias("cwd_count")).first().asDict()
    shown = [r.asDict() for r in reading.inventory(files).orderBy(F.col("n").desc(), "cwd").limit(groups).collect()]
    out = {"index_version": INDEX_VERSION, "root": root, "inventory": totals | {"cwds": shown}, "index": {"exists": store.exists(), "size_bytes": store.size_bytes()}, "coverage": []}
    if store.exists():
        out["index"] |= reading.stats(store.sessions()).first().asDict() | {"last_sync_at": store.state().get("synced_at")}
        covered = [r.asDict() for r in freshness(spark, store).collect()]
        out["coverage"] = covered
    if selector:
        want = selector.canonical()
        rows = spark.createDataFrame(out["coverage"], f"{COVERAGE}, freshness string")
        r = requested(rows, _one(spark, want)).first()
        out["requested"] = asdict(want) | {"state": r["state"], "recommended_action": r["recommended_action"]}
    return out
