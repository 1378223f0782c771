"""Command line: sync, find, read-range, read-page, list, stats, status."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import printing
from .functions import snippets
from .functions.segment import Dictionary
from .functions.text import query_terms, use_dictionary
from .operators import reading
from .operators.selector import InvalidSelector, Selector
from .plans import sync as loading
from .plans.find import FindOptions, anchor, find
from .sources.store import INDEX_VERSION, IndexUnavailable, LockTimeout, Store

HOME, OLD_HOME = "~/.sessionlake", "~/.cache/sessionlake"


_INNER = ("segment", "n_tokens", "message_tokens")


class NotFound(RuntimeError):
    pass


def move_old_home(old: str, new: str) -> bool:
    """Take over an index from where earlier versions kept it; nothing happens where there is one already."""
    old, new = (os.path.abspath(os.path.expanduser(x)) for x in (old, new))
    if old == new or not os.path.isdir(old) or os.path.exists(new):
        return False
    try:
        os.makedirs(os.path.dirname(new), exist_ok=True)
        os.rename(old, new)
    except OSError:  # another device, or no right to: the next sync builds the index anew
        return False
    return True


def search(store: Store, query: str, o: FindOptions) -> list[dict]:
    """Ranked sessions with a snippet each; at most o.limit of them."""
    terms, shown, on = query_terms(query), [], store.searched()
    for r in find(on, query, o).join(on.sessions.select("session_uuid", "summary_text"), "session_uuid").orderBy("rank").collect():
        row, text = r.asDict(), r["content_text"] or ""
        if not terms:
            row["snippet"] = snippets.raw_snippet(text, query, [])
        elif row["match_source"] == "message":
            row["snippet"] = snippets.token_snippet(snippets.stored_text(text), terms)
        else:
            row["snippet"] = snippets.raw_snippet(text, query, terms)
        shown.append({k: v for k, v in row.items() if k != "content_text"})
    return shown


def _session(store: Store, uuid: str) -> dict:
    r = store.sessions().filter(F.col("session_uuid") == uuid).limit(1).collect()
    if not r:
        raise NotFound(f"no session {uuid}")
    return {k: v for k, v in r[0].asDict().items() if k not in _INNER}


def anchor_of(store: Store, uuid: str, query: str, now: str) -> int:
    """The message of a session that a query meets best: recall of 20, one kept."""
    top = anchor(store.searched(), uuid, query, now).collect()
    if not top:
        raise NotFound(f"nothing in session {uuid} matches")
    return int(top[0]["seq"])


def _rows(df: DataFrame) -> list[dict]:
    return [{k: v for k, v in r.asDict().items() if k not in _INNER} for r in df.collect()]


def run(spark: SparkSession, a: argparse.Namespace) -> object:
    store = Store(spark, a.index)
    selector = Selector.parse(a.selector) if getattr(a, "selector", None) else None
    if a.command == "sync":
        return asdict(loading.sync(spark, a.index, selector, a.best_effort))
    if a.command == "status":
        return loading.status(spark, a.index, os.path.abspath(os.path.expanduser(a.root)), selector)
    if a.command == "find":
        o = FindOptions(limit=a.limit, sort=a.sort, selector=selector, exclude=a.exclude, now=a.now or loading.now())
        out = {"query": a.query, "results": search(store, a.query, o)}
        if selector:
            have = _rows(loading.covering(store, selector))
            out["coverage"] = {"complete": bool(have), "freshness": "not_checked", "entries": have}
        return out
    if a.command == "read-range":
        at = a.seq if a.seq is not None else anchor_of(store, a.session, a.query or "", a.now or loading.now())
        about = _session(store, a.session)
        rows = _rows(reading.message_range(store.messages(), a.session, at, a.before, a.after))
        return {"session": about, "anchor": at, "from": max(0, at - a.before), "to": at + a.after, "messages": rows, "coverage": loading.session_coverage(store, about)}
    if a.command == "read-page":
        about = _session(store, a.session)
        rows = _rows(reading.message_page(store.messages(), a.session, a.offset, a.limit))
        total = about["message_count"]
        return {"session": about, "offset": a.offset, "limit": a.limit, "total_count": total, "has_more": a.offset + len(rows) < total, "messages": rows, "coverage": loading.session_coverage(store, about)}
    if a.command == "list":
        return {"sessions": _rows(reading.list_sessions(store.sessions(), a.cwd, a.since, a.sort, a.limit).select("session_uuid", "title", "summary_text", "cwd", "model", "started_at", "ended_at", "message_count"))}
    return reading.stats(store.sessions()).first().asDict() | {"top_cwds": _rows(reading.top_cwds(store.sessions())), "index": store.path, "index_version": INDEX_VERSION, "size_bytes": store.size_bytes(), "last_sync_at": store.state().get("synced_at"), "coverage": _rows(store.coverage())}


def _counted(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return n


def _position(text: str) -> int:
    n = int(text)
    if n < 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sessionlake")
    p.add_argument("--index", help=f"folder of the index ({HOME})")
    p.add_argument("--json", action="store_true", help="print JSON")
    p.add_argument("--dictionary", help="file of words of scripts without spaces, one a line")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("sync")
    c.add_argument("--selector", required=True)
    c.add_argument("--best-effort", action="store_true")
    c = sub.add_parser("find")
    c.add_argument("query")
    c.add_argument("--limit", type=_counted, default=10)
    c.add_argument("--sort", choices=("relevance", "ended", "started"), default="relevance")
    c.add_argument("--exclude", action="append", default=[])
    c.add_argument("--selector")
    c.add_argument("--now")
    c = sub.add_parser("read-range")
    c.add_argument("session")
    c.add_argument("--seq", type=_position)
    c.add_argument("--query")
    c.add_argument("--before", type=_position, default=2)
    c.add_argument("--after", type=_position, default=2)
    c.add_argument("--now")
    c = sub.add_parser("read-page")
    c.add_argument("session")
    c.add_argument("--offset", type=_position, default=0)
    c.add_argument("--limit", type=_counted, default=20)
    c = sub.add_parser("list")
    c.add_argument("--cwd")
    c.add_argument("--since")
    c.add_argument("--sort", choices=tuple(reading.LIST_ORDER), default="ended")
    c.add_argument("--limit", type=_counted, default=20)
    sub.add_parser("stats")
    c = sub.add_parser("status")
    c.add_argument("--root", required=True)
    c.add_argument("--selector")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.index is None:
        move_old_home(OLD_HOME, HOME)
        a.index = os.path.expanduser(HOME)
    words = None
    if a.dictionary:
        with open(a.dictionary, encoding="utf-8") as f:
            words = Dictionary.read(f)
    use_dictionary(words)
    spark = spark or SparkSession.builder.appName("sessionlake").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        out = run(spark, a)
    except (InvalidSelector, IndexUnavailable, LockTimeout, NotFound, loading.SyncFailed) as e:
        print(json.dumps({"error": type(e).__name__, "message": str(e)}) if a.json else f"error: {e}", file=sys.stderr)
        return 1
    print(json.dumps(out, indent=2, ensure_ascii=False, default=str) if a.json else "\n".join(printing.BY_COMMAND[a.command](out)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
