"""Logs into the index and back: parsing, sync, coverage, reading, command line, snippets."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from sessionlake import cli
from sessionlake.functions import snippets
from sessionlake.functions.text import fts_tokens, level1, query_terms, term_tokens
from sessionlake.operators.selector import Selector
from sessionlake.plans import sync as S
from sessionlake.plans.find import Tables
from sessionlake.sources import jsonl
from sessionlake.sources import store as store_module
from sessionlake.sources.store import IndexUnavailable, LockTimeout, Store
from sessionlake.streaming import follow

A, B = "00000000-0000-4000-8000-00000000000a", "00000000-0000-4000-8000-00000000000b"
INTERNAL = ">>> TRANSCRIPT START\nx"


def event(ts, kind, message):
    return {"timestamp": ts, "type": "event_msg", "payload": {"type": kind, "message": message}}


def write(root, day, uuid, cwd, said, extra=()):
    folder = root / day.replace("-", "/")
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"rollout-{day}T10-00-00-{uuid}.jsonl"
    rows = [{"timestamp": f"{day}T10:00:00Z", "type": "session_meta", "payload": {"id": "unused", "cwd": cwd}}, {"timestamp": f"{day}T10:00:01Z", "type": "turn_context", "payload": {"model": "m1", "cwd": "/other"}}, *extra]
    rows += [event(f"{day}T10:00:{i + 10}Z", "user_message" if i % 2 == 0 else "agent_message", t) for i, t in enumerate(said)]
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\nnot json\n[1]\n\r\n")
    return path


@pytest.fixture()
def logs(tmp_path):
    root = tmp_path / "sessions"
    extra = [
        {"timestamp": "t", "type": "compacted", "payload": {"message": " first  note "}}, {"timestamp": "t", "type": "compacted", "payload": {"message": "first note"}}, {"timestamp": "t", "type": "compacted", "payload": {"message": 5}},
        {"timestamp": "t", "type": "response_item", "payload": {"type": "reasoning", "summary": [{"text": "because"}, {"text": " "}, {"text": 3}, 7]}},
        event("t", "user_message", INTERNAL), {"timestamp": 5, "type": "event_msg", "payload": {"type": "user_message", "message": "no string time"}},
    ]
    write(root, "2024-01-02", A, "/work/a", ["deploy the health check", "done, health check is up", "thanks", "bye"], extra)
    write(root, "2024-01-03", B, "/work/b", ["fix the parser", "fixed"])
    return root


def every(root):
    return Selector("all", str(root))


def test_parse(spark, logs):
    files = jsonl.listing(spark, str(logs))
    assert sorted((r["path_date"], r["cwd"]) for r in files.collect()) == [("2024-01-02", "/work/a"), ("2024-01-03", "/work/b")]
    rows = jsonl.records(spark, [r["file_path"] for r in files.collect()])
    assert [r["line_no"] for r in rows.filter(f"file_path LIKE '%{B}%'").orderBy("line_no").collect()] == [0, 1, 2, 3]
    a = {r["session_uuid"]: r for r in jsonl.parsed_sessions(files, rows).collect()}[A]
    assert (a["verdict"], a["title"], a["cwd"], a["model"], a["message_count"]) == ("parsed", "deploy the health check", "/work/a", "m1", 4)
    assert (a["compact_text"], a["reasoning_summary_text"]) == ("first note", "because")
    assert [r["seq"] for r in jsonl.kept_messages(rows).filter(f"file_path LIKE '%{A}%'").orderBy("seq").collect()] == [0, 1, 2, 3]


def test_filtered_skipped_and_empty(spark, tmp_path):
    root = tmp_path / "s"
    write(root, "2024-01-02", A, "/w", [INTERNAL])
    write(root, "2024-01-02", B, "/w", [])
    got = S.sync(spark, str(tmp_path / "ix"), every(root))
    assert (got.scanned, got.added, got.filtered, got.skipped) == (2, 0, 1, 1)
    assert S.sync(spark, str(tmp_path / "ix2"), every(tmp_path / "none")).scanned == 0
    assert Store(spark, str(tmp_path / "ix2")).messages().count() == 0


def test_sync_cycle(spark, logs, tmp_path):
    ix = str(tmp_path / "ix")
    with pytest.raises(IndexUnavailable):
        Store(spark, ix).sessions()
    first = S.sync(spark, ix, every(logs))
    assert (first.scanned, first.added, first.coverage_written) == (2, 2, True)
    again = S.sync(spark, ix, every(logs))
    assert (again.added, again.updated, again.skipped, again.removed) == (0, 0, 2, 0)
    store = Store(spark, ix)
    assert store.messages().count() == 6

    # coverage: the whole root answers any part; freshness follows the files
    assert S.covering(store, Selector("cwd", str(logs), "/work/a")).count() == 1
    assert S.status(spark, ix, str(logs), every(logs))["requested"]["recommended_action"] == "query"
    path = write(logs, "2024-01-03", B, "/work/b", ["fix the parser", "fixed", "more"])
    assert S.status(spark, ix, str(logs), every(logs))["requested"]["state"] == "stale"
    assert S.sync(spark, ix, every(logs)).updated == 1
    assert store.messages().filter(f"session_uuid = '{B}'").count() == 3

    # best effort removes nothing; strict reconciles
    path.unlink()
    assert S.sync(spark, ix, every(logs), best_effort=True).removed == 0
    assert S.sync(spark, ix, every(logs)).removed == 1
    assert [r["session_uuid"] for r in store.sessions().collect()] == [A]
    assert store.messages().filter(f"session_uuid = '{B}'").count() == 0


def test_bare_null_fails_strict_only(spark, logs, tmp_path):
    ix = str(tmp_path / "ix")
    with open(write(logs, "2024-01-04", "00000000-0000-4000-8000-00000000000c", "/w", ["x"]), "a") as f:
        f.write("null\n")
    with pytest.raises(S.SyncFailed):
        S.sync(spark, ix, every(logs))
    assert not Store(spark, ix).exists()
    got = S.sync(spark, ix, every(logs), best_effort=True)
    assert (got.added, got.errors, got.coverage_written, got.reason) == (2, 1, False, "best_effort")


def test_lock(spark, tmp_path):
    store = Store(spark, str(tmp_path / "ix"))
    with store.writing():
        with pytest.raises(LockTimeout):
            with Store(spark, store.path).writing(wait=0.2):
                pass
    store._write("LOCK", json.dumps({"pid": 2**22 + 1, "host": __import__("socket").gethostname()}), True)
    with store.writing(wait=0.2):  # the holder is dead
        pass


def test_command_line(spark, logs, tmp_path, capsys):
    def call(*words):
        code = cli.main(["--index", str(tmp_path / "ix"), "--json", *words], spark)
        return code, capsys.readouterr()

    code, out = call("stats")
    assert code == 1 and "IndexUnavailable" in out.err
    assert call("sync", "--selector", every(logs).key())[0] == 0
    found = json.loads(call("find", "health check", "--now", "2024-02-01T00:00:00Z", "--selector", every(logs).key())[1].out)
    assert [r["session_uuid"] for r in found["results"]] == [A] and found["coverage"]["complete"]
    assert "<mark>health check</mark>" in found["results"][0]["snippet"] or "<mark>health</mark> <mark>check</mark>" in found["results"][0]["snippet"]
    around = json.loads(call("read-range", A, "--query", "bye", "--before", "1", "--after", "1")[1].out)
    assert around["anchor"] == 3 and [m["seq"] for m in around["messages"]] == [2, 3] and len(around["coverage"]) == 1
    page = json.loads(call("read-page", A, "--offset", "2", "--limit", "2")[1].out)
    assert page["has_more"] is False and [m["seq"] for m in page["messages"]] == [2, 3]
    assert [s["session_uuid"] for s in json.loads(call("list", "--cwd", "WORK/B")[1].out)["sessions"]] == [B]
    assert json.loads(call("stats")[1].out)["session_count"] == 2
    assert call("read-page", "nope")[0] == 1 and call("sync", "--selector", "{}")[0] == 1


TEXTS = ["the cat sat", " ".join(f"w{i}" for i in range(60)) + " needle here and needle there " + " ".join(f"v{i}" for i in range(30)) + " needle other", "can't stop " * 12 + "other end", "alpha " * 20 + "needle", "needle", "部署 检查 " * 9 + "needle other thing"]


@pytest.mark.parametrize("query", ["needle", "needle other", "can't", "other needle here", "cat"])
def test_token_snippet_agrees_with_fts5(query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61 remove_diacritics 1')")
    stored = [snippets.stored_text(t) for t in TEXTS]
    con.executemany("INSERT INTO t VALUES (?)", [(t,) for t in stored])
    terms = query_terms(query)
    match = " AND ".join(f'"{t}"' for t in terms)
    want = con.execute("SELECT rowid, snippet(t, 0, '<mark>', '</mark>', '…', 16) FROM t WHERE t MATCH ?", (match,)).fetchall()
    assert want
    for rowid, text in want:
        assert snippets.token_snippet(stored[rowid - 1], terms) == text


SCRIPTS = ["Éclair ÀÉÎõü ế Ế Ǆ", "한국어 검색 데이터", "サーバー データ 人々 カナ", "naïve cafe\u0301 e\u0301\u0323", "οδος ΟΔΟΣ ǅ ſtop µ", "😀 emoji x²³ ½", "й ё Ий", "snake_case a.b c'd", "ελληνικά άλφα"]


def test_index_tokens_agree_with_fts5(spark):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61 remove_diacritics 1')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", [(i, snippets.stored_text(t)) for i, t in enumerate(SCRIPTS)])
    want = {}
    for term, doc in con.execute("SELECT term, doc FROM v ORDER BY doc, offset"):
        want.setdefault(doc, []).append(term)
    df = spark.createDataFrame(list(enumerate(SCRIPTS)), "id int, t string").select("id", fts_tokens(F.col("t")).alias("x"))
    got = {r["id"]: r["x"] for r in df.collect()}
    assert got == {i: want.get(i, []) for i in got}
    assert got == {i: [w for term in level1(t) for w in term_tokens(term)] for i, t in enumerate(SCRIPTS)}


def test_segments_merge_and_old_parts_go(spark, logs, tmp_path, monkeypatch):
    ix = str(tmp_path / "ix")
    monkeypatch.setattr(store_module, "TIER", 3)
    S.sync(spark, ix, every(logs))
    store, sizes = Store(spark, ix), []
    for i in range(5):  # each load changes one session and adds another
        write(logs, "2024-01-03", B, "/work/b", ["fix the parser", "fixed"] + ["deploy again"] * (i + 1))
        write(logs, "2024-01-05", f"00000000-0000-4000-8000-00000000001{i}", "/work/e", ["deploy once more", "deployed"])
        S.sync(spark, ix, every(logs))
        sizes.append(len(store.state()["segments"]))
        want = {A: 4, B: 3 + i} | {f"00000000-0000-4000-8000-00000000001{j}": 2 for j in range(i + 1)}
        assert {r["session_uuid"]: r["n"] for r in store.messages().groupBy("session_uuid").agg(F.count("*").alias("n")).collect()} == want
        assert {r["session_uuid"]: r["message_count"] for r in store.sessions().collect()} == want
        on = store.searched()
        tables = Tables(on.messages.withColumn("content_text_tokens", fts_tokens(F.col("content_text"))), on.sessions)
        score = lambda x: sorted((r["session_uuid"], r["seq"], round(r["score"], 9)) for r in x.message_scores(["deploy"]).collect())
        assert score(on) == score(tables) and len(score(on)) == 1 + (i + 1) + (i + 1)
    assert max(sizes) <= 4 and min(sizes) < max(sizes)
    S.sync(spark, ix, every(logs))
    S.sync(spark, ix, every(logs))
    live = {p.name for p in (tmp_path / "ix" / "parts").iterdir()}
    state = store.state()
    assert live == {x.split("/")[1] for x in [state["coverage"], state["manifest"], *state["segments"], *state["deleted"], *state["dead"], *state["retired"]]}


def test_text_output(spark, logs, tmp_path, capsys):
    ix = str(tmp_path / "ix")
    call = lambda *words: (cli.main(["--index", ix, *words], spark), capsys.readouterr().out)[1]
    assert "added:    2" in call("sync", "--selector", every(logs).key())
    assert f"next: read-range {A} --seq" in call("find", "health check") and "no results" in call("find", "absent")
    assert ">> [3] A bye" in call("read-range", A, "--query", "bye") and "total=4" in call("read-page", A)
    assert "msgs=4" in call("list") and "coverage_count" in call("stats") and "recommended_action" in call("status", "--root", str(logs), "--selector", every(logs).key())


def test_old_home_moves_once(tmp_path):
    old, new = tmp_path / "cache" / "x", tmp_path / "home" / "x"
    assert not cli.move_old_home(str(old), str(new))
    old.mkdir(parents=True)
    (old / "CURRENT").write_text("{}")
    assert cli.move_old_home(str(old), str(new)) and (new / "CURRENT").exists()
    old.mkdir(parents=True)
    assert not cli.move_old_home(str(old), str(new)) and not cli.move_old_home(str(new), str(new))


def test_streams(spark, logs, tmp_path):
    said = follow.messages(spark, str(logs))
    q = follow.activity(said).writeStream.outputMode("complete").format("memory").queryName("activity").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert sum(r["n"] for r in spark.table("activity").collect()) == 6
    ix = str(tmp_path / "ix")
    for n in (6, 7):
        q = follow.follow(spark, ix, every(logs), str(tmp_path / "c2"))
        q.awaitTermination(120)
        assert Store(spark, ix).messages().count() == n
        write(logs, "2024-01-06", "00000000-0000-4000-8000-00000000000f", "/work/f", ["new"])


def test_raw_snippet():
    far = "term alone " + "x" * 300 + " term and other close " + "y" * 300
    assert "<mark>term</mark> and <mark>other</mark>" in snippets.raw_snippet(far, "term other", ["term", "other"])
    assert snippets.raw_snippet("z" * 400, "q", ["q"]) == "z" * 160
    assert snippets.raw_snippet("", "q", ["q"]) == ""
    # a phrase hit marks the phrase only; every hit of a term counts
    assert snippets.raw_snippet("a term other and term", "term other", ["term", "other"]) == "a <mark>term other</mark> and term"
    many = "aa bb " + "x" * 300 + " aa aa aa bb " + "y" * 200
    assert "<mark>aa</mark> <mark>aa</mark> <mark>aa</mark> <mark>bb</mark>" in snippets.raw_snippet(many, "aa, bb", ["aa", "bb"])
