"""Golden files, saved batches, marks, and the artefacts of an evaluation."""

import gzip
import json

from test_sync import A, every, logs  # noqa: F401

from sessionlake import evaluate
from sessionlake.operators import evaluation as E
from sessionlake.plans import sync as S

GOOD = {"id": "g1", "query": "q", "intent": "i", "status": "hard", "expected": {"topK": 3, "acceptableSessionUuids": [" a ", "", 5], "context": {"mustContain": ["Needle"], "before": 0, "offset": 0}}}


def test_golden(spark, tmp_path):
    bad = [
        "{", "[1]", {**GOOD, "id": " "}, {**GOOD, "status": "new"}, {**GOOD, "expected": {"topK": 3}}, {**GOOD, "expected": 4}, {**GOOD, "find": {"sort": "up"}}, {**GOOD, "find": []},
        {**GOOD, "find": {"selector": {"kind": "cwd", "root": "/r"}}}, {**GOOD, "origin": {"kind": "else"}}, {**GOOD, "origin": "manual"},
    ]
    fine = [GOOD, {**GOOD, "id": "g2", "status": "stale", "find": {"queries": ["x"], "limit": 1.5, "sort": "ended", "selector": {"kind": "all", "root": "/r"}}, "origin": {"kind": "manual"}, "expected": {"cwdContains": "w", "matchSource": "else"}}]
    lines = ["# comment", "", *[x if isinstance(x, str) else json.dumps(x) for x in [*fine, *bad]]]
    (tmp_path / "g.jsonl").write_text("\r\n".join(lines))
    rows = {r["line_no"]: r for r in E.golden(spark, str(tmp_path / "g.jsonl")).collect()}
    assert sorted(rows) == list(range(3, 3 + len(fine) + len(bad)))
    assert [rows[i]["error"] for i in (3, 4)] == [None, None] and all(rows[i]["error"] for i in range(5, 5 + len(bad)))
    one, two = rows[3], rows[4]
    assert (one["expected"]["top_k"], one["expected"]["acceptable"], one["expected"]["context"]["before"], one["expected"]["context"]["offset"]) == (3, ["a"], None, 0)
    assert (two["find"]["queries"], two["find"]["limit"], two["find"]["sort"], two["expected"]["cwd_contains"], two["expected"]["match_source"]) == (["x"], None, "ended", "w", None)


def test_golden_lines_are_parsed_once(spark, tmp_path):
    lines = ["", " # note", json.dumps(GOOD), "  " + json.dumps({**GOOD, "id": "g2"}) + "\u00a0", "{"]
    (tmp_path / "g.jsonl").write_text("\n".join(lines))
    rows = E.golden(spark, str(tmp_path / "g.jsonl"))
    assert [(r["line_no"], r["id"], r["error"]) for r in rows.orderBy("line_no").collect()] == [(3, "g1", None), (4, "g2", None), (5, None, "not JSON")]
    valid = rows.filter("error IS NULL").select("id", "expected")
    assert str(valid._jdf.queryExecution().optimizedPlan()).count("parseJson") == 1
    results = spark.createDataFrame([("g1", 1, "a", "/w", "message", 1)], "id string, rank int, session_uuid string, cwd string, match_source string, match_seq long")
    marks = E.golden_marks(rows.filter("error IS NULL"), results)
    assert "leftHint=(strategy=merge)" in str(marks._jdf.queryExecution().optimizedPlan())
    assert {r["id"]: r["mark"] for r in marks.collect()} == {"g1": "fail", "g2": "fail"}  # no text was read


def test_golden_marks(spark, tmp_path):
    entries = [
        {**GOOD, "id": "found"}, {**GOOD, "id": "late", "expected": {"topK": 1, "acceptableSessionUuids": ["b"]}}, {**GOOD, "id": "old", "status": "stale"},
        {**GOOD, "id": "cwd", "status": "candidate", "expected": {"cwdContains": "WORK", "matchSource": "message"}}, {**GOOD, "id": "none", "status": "candidate", "expected": {"cwdContains": "w"}},
    ]
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, entries)))
    golden = E.golden(spark, str(tmp_path / "g.jsonl"))
    results = spark.createDataFrame([(i, n, u, "/work/x", s, q) for i in ("found", "late", "old", "cwd") for n, u, s, q in ((1, "z", "message", 2), (2, "a", "session", None), (3, "b", "message", 1))], "id string, rank int, session_uuid string, cwd string, match_source string, match_seq long")
    contexts = spark.createDataFrame([("found", "the NEEDLE is here")], "id string, text string")
    marks = E.golden_marks(golden, results, contexts)
    got = {r["id"]: (r["mark"], r["blocking"], r["hit"] and r["hit"]["session_uuid"]) for r in marks.collect()}
    assert got == {"found": ("pass", False, "a"), "late": ("fail", True, "z"), "old": ("skip", False, "a"), "cwd": ("pass", False, "z"), "none": ("fail", False, None)}
    assert E.golden_scoreboard(marks).first().asDict() == {"total": 5, "passed": 2, "failed": 2, "skipped": 1, "hard_failed": 1, "candidate_failed": 1}
    modes = {r["id"]: r["m"] for r in marks.select("id", E.context_mode(marks["expected"], marks["hit.match_seq"]).alias("m")).collect()}
    assert modes["found"] == "read-page" and modes["cwd"] is None
    assert E.golden_marks(golden, results.limit(0)).filter("mark = 'pass'").isEmpty()


def test_batches(spark, tmp_path):
    for side, firsts in (("b", {"q1": ["a"], "q2": ["b", "c"], "q3": []}), ("a", {"q1": ["a"], "q2": ["c"], "q3": ["x"], "q4": ["y"]})):
        (tmp_path / side).mkdir()
        (tmp_path / side / "notes.json").write_text("{}")
        for i, r in firsts.items():
            (tmp_path / side / f"{i}.find.json").write_text(json.dumps({"query": i, "results": [{"rank": n + 1, "sessionUuid": u, "title": u} for n, u in enumerate(r)]}, indent=2))
    before, after = E.batch(spark, str(tmp_path / "b")), E.batch(spark, str(tmp_path / "a"))
    assert sorted(r["id"] for r in E.shared_ids(before, after).collect()) == ["q1", "q2", "q3"]
    assert [(r["id"], r["before"], r["after"]) for r in E.compare(before, after).collect()] == [("q2", "b", "c")]


def test_batches_may_be_compressed(spark, tmp_path):
    saved = lambda *found: json.dumps({"query": "q", "results": list(found)}, indent=2).encode()
    (tmp_path / "a.find.json.gz").write_bytes(gzip.compress(saved({"rank": 1, "sessionUuid": "x", "title": "t"}, {"rank": 2, "sessionUuid": "y", "title": "u"})))
    (tmp_path / "b.find.json").write_bytes(saved({"rank": 1, "session_uuid": "z", "title": "t"}))
    (tmp_path / "c.find.json").write_bytes(saved())
    (tmp_path / "d.find.json.old").write_bytes(saved())
    assert {r["id"]: [(x["rank"], x["sessionUuid"], x["title"]) for x in r["results"]] for r in E.batch(spark, str(tmp_path)).collect()} == {"a": [(1, "x", "t"), (2, "y", "u")], "b": [(1, "z", "t")], "c": []}
    assert {r["id"]: (r["query"], r["n"], r["first"]) for r in E.first_results(spark, str(tmp_path)).collect()} == {"a": ("q", 2, "x"), "b": ("q", 1, "z"), "c": ("q", 0, None)}


def test_artefacts(spark, logs, tmp_path):  # noqa: F811
    ix, out = str(tmp_path / "ix"), tmp_path / "out"
    S.sync(spark, ix, every(logs))
    asked = [{"id": "a", "query": "health check", "expected_cwd": "/WORK/A"}, {"id": "b", "query": "nothing like it", "expected_snippet": "x"}, {"id": "c", "query": "parser"}]
    (tmp_path / "q.json").write_text(json.dumps(asked))
    assert evaluate.main(["--index", ix, "--queries", str(tmp_path / "q.json"), "--out", str(out)], spark) == 0
    card = json.loads((out / "scorecard.json").read_text())
    assert card["scoreboard"] == {"total": 3, "skipped": 1, "pass1": 1, "pass5": 1}
    assert {p.name for p in out.iterdir()} >= {"README.md", "01-a.find.json", "01-a.find.txt", "01-a.read-range.json", "02-b.find.json"}
    assert json.loads((out / "01-a.find.json").read_text())["results"][0]["session_uuid"] == A


def test_golden_run_and_comparison(spark, logs, tmp_path, capsys):  # noqa: F811
    ix = str(tmp_path / "ix")
    S.sync(spark, ix, every(logs))
    say = lambda id_, query, expected, status="hard", **find: json.dumps({"id": id_, "query": query, "intent": "i", "status": status, "expected": expected, "find": find})
    lines = [
        "# by hand", say("around it", "health check", {"acceptableSessionUuids": [A], "context": {"mustContain": ["thanks", "DONE,"], "mode": "read-range", "after": 3}}),
        say("page", "fix the parser", {"context": {"mustContain": ["fixed"], "mode": "read-page"}, "cwdContains": "WORK/B"}, queries=["absent words", "parser", "parser"]),
        say("narrow", "health check", {"cwdContains": "/work/a"}, "candidate", cwd="/work/b", root=str(logs)),
        say("old", "x", {"cwdContains": "y"}, "stale"), say("page far", "bye", {"context": {"mustContain": ["bye"], "mode": "read-page", "offset": 4}}, "candidate"),
    ]
    (tmp_path / "g.jsonl").write_text("\n".join(lines))
    one, two = tmp_path / "one", tmp_path / "two"
    assert evaluate.main(["golden", "--index", ix, "--queries", str(tmp_path / "g.jsonl"), "--out", str(one)], spark) == 0
    card = json.loads((one / "scorecard.json").read_text())
    assert [(x["id"], x["mark"], x["attempt"], x["attempts"]) for x in card["entries"]] == [("around it", "pass", 1, 1), ("page", "pass", 2, 2), ("narrow", "fail", 1, 1), ("page far", "fail", 1, 1)]
    assert card["scoreboard"] == {"total": 4, "passed": 2, "failed": 2, "skipped": 0, "hard_failed": 0, "candidate_failed": 2}
    read = json.loads((one / "01-around-it.read-range.json").read_text())
    assert [m["seq"] for m in read["messages"]] == [m for m in range(read["from"], read["to"] + 1) if m < 4]
    assert (one / "02-page.attempt-02.read-page.txt").exists() and (one / "02-page.attempt-01.find.json").exists()
    assert evaluate.main(["golden", "--stale", "--index", ix, "--queries", str(tmp_path / "g.jsonl"), "--out", str(two)], spark) == 0
    assert json.loads((two / "scorecard.json").read_text())["scoreboard"]["skipped"] == 1

    # the later run finds something else first for one search, and has one more
    changed = json.loads((two / "01-around-it.find.json").read_text())
    changed["results"][0]["session_uuid"] = "else"
    (two / "01-around-it.find.json").write_text(json.dumps(changed))
    capsys.readouterr()
    assert evaluate.main(["compare", str(one), str(two)], spark) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["shared"] == 4 and [(x["id"], x["before"], x["after"]) for x in told["changed"]] == [("01-around-it", A, "else")]

    (tmp_path / "bad.jsonl").write_text(lines[1] + "\n{")
    assert evaluate.main(["golden", "--index", ix, "--queries", str(tmp_path / "bad.jsonl"), "--out", str(one)], spark) == 1
    assert "bad.jsonl:2: not JSON" in capsys.readouterr().err
    (tmp_path / "hard.jsonl").write_text(say("h", "absent", {"cwdContains": "y"}))
    assert evaluate.main(["golden", "--index", ix, "--queries", str(tmp_path / "hard.jsonl"), "--out", str(one)], spark) == 1
