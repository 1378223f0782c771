"""Runs a list of searches against an index and writes what was found, read and scored.

``golden`` does so for a golden file, whose entries may ask in several ways and expect
words in what is read around a result; ``compare`` tells which searches of two such runs
have another first result.
"""

from __future__ import annotations

import argparse
import json
import os
import re
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import cli, printing
from .operators import evaluation, reading
from .operators.selector import Selector
from .plans.find import FindOptions, named
from .plans.sync import now
from .sources.store import Store

ASKED = "id string, query string, intent string, category string, expected_title_or_summary string, expected_cwd string, expected_snippet string"
FOUND = "id string, rank int, session_uuid string, title string, summary_text string, cwd string, snippet string, match_source string, match_seq long"


def _context(spark: SparkSession, index: str, hit: dict) -> tuple[str, dict]:
    """What is read around a first result: its surroundings, or the session's first page."""
    seq = hit["match_seq"]
    words = ["read-page", hit["session_uuid"], "--offset", "0", "--limit", "20"] if seq is None else ["read-range", hit["session_uuid"], "--seq", str(seq), "--before", "2", "--after", "2"]
    return words[0], cli.run(spark, cli.parser().parse_args(["--index", index, *words]))


def evaluate(spark: SparkSession, index: str, asked: list[dict], out: str, at: str | None = None) -> dict:
    """Searches one after the other (a list written by hand); files in ``out``, and the scoreboard."""
    store, names, files = Store(spark, index), [c.split()[0] for c in ASKED.split(", ")], {}
    os.makedirs(out, exist_ok=True)
    rows = []

    for n, item in enumerate(asked, 1):
        name = f"{n:02d}-{item['id']}"
        found = {"query": item["query"], "results": cli.search(store, item["query"], FindOptions(limit=evaluation.TOP, now=at or now()))}
        _put(out, name, "find", found)
        first = found["results"][0] if found["results"] else None
        if first:
            command, read = _context(spark, index, first)
            _put(out, name, command, read)
        files[item["id"]] = (name, first)
        rows += [tuple([item["id"], *[r[c.split()[0]] for c in FOUND.split(", ")[1:]]]) for r in found["results"]]
    table, results = spark.createDataFrame([tuple(x.get(c) for c in names) for x in asked], ASKED), spark.createDataFrame(rows, FOUND)
    marks = {k: evaluation.manual_marks(table, results, k) for k in (1, evaluation.TOP)}
    board = evaluation.manual_scoreboard(marks[1], marks[evaluation.TOP]).first().asDict()
    by = {k: {r["id"]: r["mark"] for r in m.select("id", "mark").collect()} for k, m in marks.items()}
    scored = [{"id": x["id"], "query": x["query"], "category": x.get("category"), "pass1": by[1][x["id"]], "pass5": by[evaluation.TOP][x["id"]], "top1": (files[x["id"]][1] or {}).get("title")} for x in asked]
    with open(os.path.join(out, "scorecard.json"), "w", encoding="utf-8") as f:
        json.dump({"scoreboard": board, "queries": scored}, f, indent=2, ensure_ascii=False)
    judged = board["total"] - board["skipped"]
    lines = ["# Search evaluation", "", f"- queries: {board['total']}", f"- skipped, nothing expected: {board['skipped']}", f"- pass@1: {board['pass1']} / {judged}", f"- pass@5: {board['pass5']} / {judged}", "", "| id | category | pass@1 | pass@5 | first result |", "|---|---|---|---|---|"]
    lines += [f"| {x['id']} | {x['category'] or ''} | {x['pass1']} | {x['pass5']} | {(x['top1'] or '(none)')[:60].replace('|', '/')} |" for x in scored]
    with open(os.path.join(out, "README.md"), "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return board


MARKED = "id string, rank int, session_uuid string, cwd string, match_source string, match_seq long"


def _options(e: dict, at: str, root: str | None) -> tuple[list[str], FindOptions]:
    """The queries of a golden entry, and how they are asked."""
    find, expected = e["find"] or {}, e["expected"]
    queries = list(dict.fromkeys(find["queries"] or [])) or [e["query"]]
    if find["selector"]:
        selector = Selector.parse(find["selector"])
    elif find["cwd"] and (find["root"] or root):
        selector = Selector("cwd", os.path.abspath(find["root"] or root), find["cwd"])
    else:
        selector = None
    limit = max(expected["top_k"] or evaluation.TOP, find["limit"] or 0, evaluation.TOP)
    return queries, FindOptions(limit, find["sort"] or "relevance", selector, find["exclude"] or [], now=at)


def read_around(store: Store, wanted: list[tuple]) -> dict[str, tuple[str, dict]]:
    """What is read for results (id, command, session_uuid, anchor, first, last): all of them in one plan."""
    if not wanted:
        return {}
    asked = store.spark.createDataFrame(wanted, "id string, command string, session_uuid string, anchor long, first long, last long")
    own = named("session_uuid", sorted({w[2] for w in wanted}))
    about = {r["session_uuid"]: r.asDict() for r in store.sessions().filter(own).select("session_uuid", "title", "cwd", "message_count").collect()}
    said: dict[str, list[dict]] = {}
    for r in reading.message_ranges(store.messages().filter(own), asked.select("id", "session_uuid", "first", "last")).orderBy("id", "seq").collect():  # a page for each result
        said.setdefault(r["id"], []).append({k: r[k] for k in ("seq", "role", "timestamp", "content_text")})
    out = {}
    for id_, command, uuid, anchor, first, last in wanted:
        rows, session = said.get(id_, []), about[uuid]
        if command == "read-range":
            out[id_] = command, {"session": session, "anchor": anchor, "from": first, "to": last, "messages": rows}
        else:
            total = session["message_count"]
            out[id_] = command, {"session": session, "offset": first, "limit": last - first + 1, "total_count": total, "has_more": first + len(rows) < total, "messages": rows}
    return out


def run_golden(spark: SparkSession, index: str, path: str, out: str, at: str | None = None, stale: bool = False, root: str | None = None) -> dict:
    """Every entry's searches, what is read around their selected results, marks, and the scoreboard; files in ``out``.

    An entry's first attempt that passes is its result, else its first one.
    """
    entries = evaluation.golden(spark, path)
    wrong = entries.filter("error IS NOT NULL").orderBy("file", "line_no").collect()
    if wrong:
        raise ValueError("; ".join(f"{r['file']}:{r['line_no']}: {r['error']}" for r in wrong))
    held = [r.asDict(recursive=True) for r in entries.orderBy("file", "line_no").collect()]  # a file written by hand
    held = [e for e in held if stale or e["status"] != "stale"]
    os.makedirs(out, exist_ok=True)
    store, tries, rows, names = Store(spark, index), [], [], {}
    for n, e in enumerate(held, 1):
        queries, o = _options(e, at or now(), root)
        for k, query in enumerate(queries, 1):
            id_ = f"{n}#{k}"
            names[id_] = f"{n:02d}-{re.sub('[^a-zA-Z0-9_.-]+', '-', e['id'])}" + (f".attempt-{k:02d}" if len(queries) > 1 else "")
            found = {"query": query, "results": cli.search(store, query, o)}
            _put(out, names[id_], "find", found)
            tries.append((n, k, id_, query, found["results"][0]["title"] if found["results"] else None))
            rows += [(id_, *[r[c.split()[0]] for c in MARKED.split(", ")[1:]]) for r in found["results"]]
    by_entry = spark.createDataFrame([(n, id_) for n, _, id_, *_ in tries], "n int, attempt string")
    lines = spark.createDataFrame([(n, e["file"], e["line_no"]) for n, e in enumerate(held, 1)], "n int, file string, line_no int")
    asked = entries.join(lines, ["file", "line_no"]).join(by_entry, "n").select(F.col("attempt").alias("id"), "query", "status", "expected")
    results = spark.createDataFrame(rows, MARKED)
    hits = evaluation.golden_marks(asked, results)
    hits = hits.select("id", "hit", evaluation.context_mode(F.col("expected"), F.col("hit.match_seq")).alias("mode"), "expected.context").filter("mode IS NOT NULL AND hit IS NOT NULL").collect()
    wanted = []
    for r in hits:
        c, seq = r["context"], r["hit"]["match_seq"]
        if r["mode"] == "read-page":
            first = c["offset"] or 0
            wanted.append((r["id"], r["mode"], r["hit"]["session_uuid"], None, first, first + (c["limit"] or 20) - 1))
        elif seq is not None:
            wanted.append((r["id"], r["mode"], r["hit"]["session_uuid"], seq, max(0, seq - (c["before"] or 2)), seq + (c["after"] or 2)))
    texts = []
    for id_, (command, value) in read_around(store, wanted).items():
        _put(out, names[id_], command, value)
        texts.append((id_, "\n".join(printing.BY_COMMAND[command](value))))
    marks = {r["id"]: r for r in evaluation.golden_marks(asked, results, spark.createDataFrame(texts, "id string, text string")).collect()}
    scored = []
    for n, e in enumerate(held, 1):
        mine = [t for t in tries if t[0] == n]
        best = next((t for t in mine if marks[t[2]]["mark"] == "pass"), mine[0])
        m = marks[best[2]]
        scored.append({"id": e["id"], "status": e["status"], "mark": m["mark"], "blocking": m["blocking"], "attempts": len(mine), "attempt": best[1], "query": best[3], "first": best[4], "hit": m["hit"].asDict() if m["hit"] else None})
    told = spark.createDataFrame([(x["status"], x["mark"]) for x in scored], "status string, mark string")
    board = evaluation.golden_scoreboard(told).first().asDict()
    with open(os.path.join(out, "scorecard.json"), "w", encoding="utf-8") as f:
        json.dump({"source": path, "scoreboard": board, "entries": scored}, f, indent=2, ensure_ascii=False)
    lines_ = ["# Golden searches", "", f"- source: `{path}`", *[f"- {k}: {v}" for k, v in board.items()], "", "| id | status | mark | attempt | first result |", "|---|---|---|---|---|"]
    lines_ += [f"| {x['id']} | {x['status']} | {x['mark']} | {x['attempt']} of {x['attempts']} | {(x['first'] or '(none)')[:60].replace('|', '/')} |" for x in scored]
    with open(os.path.join(out, "README.md"), "w", encoding="utf-8") as f:
        f.write("\n".join(lines_) + "\n")
    return board


def compare_runs(spark: SparkSession, before: str, after: str) -> dict:
    """Searches that two runs share, and those whose first results differ."""
    a, b = evaluation.batch(spark, before), evaluation.batch(spark, after)
    changed = [r.asDict() for r in evaluation.compare(a, b).orderBy("id").collect()]
    return {"before": before, "after": after, "shared": evaluation.shared_ids(a, b).count(), "changed": changed}


def _put(out: str, name: str, command: str, value: dict) -> None:
    for kind, body in (("json", json.dumps(value, indent=2, ensure_ascii=False, default=str)), ("txt", "\n".join(printing.BY_COMMAND[command](value)))):
        with open(os.path.join(out, f"{name}.{command}.{kind}"), "w", encoding="utf-8") as f:
            f.write(body + "\n")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    command = argv[0] if argv[:1] in (["golden"], ["compare"]) else "list"
    p = argparse.ArgumentParser(prog="sessionlake.evaluate")
    if command == "compare":
        p.add_argument("before")
        p.add_argument("after")
    else:
        p.add_argument("--index", required=True)
        p.add_argument("--queries", required=True, help="JSON list of what is asked and expected, or a golden file")
        p.add_argument("--out", required=True)
    if command == "golden":
        p.add_argument("--stale", action="store_true", help="run stale entries too; they are not marked")
        p.add_argument("--root", help="root of entries that name a directory only")
    a = p.parse_args(argv[1:] if command != "list" else argv)
    spark = spark or SparkSession.builder.appName("sessionlake").getOrCreate()
    if command == "compare":
        print(json.dumps(compare_runs(spark, a.before, a.after), indent=2, ensure_ascii=False))
        return 0
    if command == "golden":
        try:
            board = run_golden(spark, a.index, a.queries, a.out, stale=a.stale, root=a.root)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        print(json.dumps(board))
        return int(board["hard_failed"] > 0)
    with open(a.queries, encoding="utf-8") as f:
        asked = json.load(f)
    print(json.dumps(evaluate(spark, a.index, asked, a.out)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
