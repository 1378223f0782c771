"""Log files: listing, first bytes, lines by ranges of bytes."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sessionlake.operators.selector import Selector
from sessionlake.plans import sync as S
from sessionlake.sources import jsonl, listing
from sessionlake.sources.store import IndexUnavailable, Store

META = {"timestamp": "t", "type": "session_meta", "payload": {"id": "x", "cwd": "/first"}}


def put(path, *rows, raw=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(raw if raw is not None else "\n".join(map(json.dumps, rows)))
    return path


def listed(spark, root, known=None):
    return {os.path.relpath(r["file_path"], root): (r["size"], r["path_date"], r["cwd"]) for r in jsonl.listing(spark, str(root), known).collect()}


def test_listing_has_every_log_at_every_depth(spark, tmp_path):
    turn = {"timestamp": "t", "type": "turn_context", "payload": {"model": "m", "cwd": "/turn"}}
    put(tmp_path / "top.jsonl", META)
    put(tmp_path / ".hidden.jsonl", turn)
    put(tmp_path / "_a" / ".b" / "_deep" / "x" / "y.jsonl", {"timestamp": "", **META, "type": ""}, turn, META)
    put(tmp_path / "2024" / "01" / "02" / "z.jsonl", raw="null\nnot json\n" + json.dumps(META))
    put(tmp_path / "2024" / "01" / "no.json", META)
    put(tmp_path / "2024" / "empty.jsonl", raw="")
    put(tmp_path / "late.jsonl", raw=" " * listing.HEAD_BYTES + "\n" + json.dumps(META))
    put(tmp_path / "cut.jsonl", raw=json.dumps({**META, "pad": "é" * listing.HEAD_BYTES}))
    put(tmp_path / "twice.jsonl", raw='{"timestamp": "t", "type": "session_meta", "type": "session_meta", "payload": {"cwd": "/no"}}\n' + json.dumps(turn))
    got = listed(spark, tmp_path)
    assert {k: v[2] for k, v in got.items()} == {
        "top.jsonl": "/first", ".hidden.jsonl": "/turn", "_a/.b/_deep/x/y.jsonl": "/turn", "2024/01/02/z.jsonl": "/first",
        "2024/empty.jsonl": "", "late.jsonl": "", "cut.jsonl": "", "twice.jsonl": "/turn",
    }
    assert got["2024/01/02/z.jsonl"][1] == "2024-01-02"
    for k, (size, *_) in got.items():
        assert size == (tmp_path / k).stat().st_size
    assert listed(spark, tmp_path / "none") == {} and jsonl.listing(spark, f"file://{tmp_path}").count() == len(got)


def test_at_most_the_first_bytes_are_read_and_known_files_stay_closed(spark, tmp_path):
    big = put(tmp_path / "a" / "big.jsonl", raw=json.dumps(META) + "\n" + "x" * 10 * listing.HEAD_BYTES)
    small = put(tmp_path / "b" / "small.jsonl", META)
    rows = listing.with_heads(listing.log_files(spark, str(tmp_path)).withColumn("known", F.lit(None).cast("string")))
    assert {os.path.basename(r["file_path"]): r["n"] for r in rows.select("file_path", F.length("head").alias("n")).collect()} == {"big.jsonl": listing.HEAD_BYTES, "small.jsonl": len(small.read_text())}
    known = spark.createDataFrame(jsonl.listing(spark, str(tmp_path)).collect(), jsonl.LISTING)
    # other contents of the same size and time: an unchanged file isn't opened, so nobody can tell
    for path, keep in ((big, True), (small, False)):
        was = path.stat()
        path.write_text(path.read_text().replace("/first", "/other"))
        os.utime(path, ns=(was.st_atime_ns, was.st_mtime_ns + (0 if keep else 5_000_000)))
    assert {k: v[2] for k, v in listed(spark, tmp_path, known).items()} == {"a/big.jsonl": "/first", "b/small.jsonl": "/other"}


def test_index_keeps_a_manifest(spark, tmp_path):
    root, ix = tmp_path / "sessions", str(tmp_path / "ix")
    say = lambda t: {"timestamp": "2024-01-02T00:00:00Z", "type": "event_msg", "payload": {"type": "user_message", "message": t}}
    path = put(root / "2024/01/02/rollout-2024-01-02T00-00-00-00000000-0000-4000-8000-000000000001.jsonl", META, say("hello"))
    S.sync(spark, ix, Selector("all", str(root)))
    store = Store(spark, ix)
    assert [(r["file_path"], r["cwd"]) for r in store.manifest().collect()] == [(str(path), "/first")]
    other = put(tmp_path / "other" / "rollout-2024-01-02T00-00-00-00000000-0000-4000-8000-000000000002.jsonl", META, say("there"))
    S.sync(spark, ix, Selector("all", str(tmp_path / "other")))
    assert sorted(r["file_path"] for r in store.manifest().collect()) == sorted([str(path), str(other)])
    path.unlink()
    S.sync(spark, ix, Selector("cwd", str(root), "/none"))
    assert [r["file_path"] for r in store.manifest().collect()] == [str(other)]
    # an index of an earlier form is as good as none
    store._write("CURRENT", json.dumps({"sessions": "parts/x", "segments": []}), True)
    with pytest.raises(IndexUnavailable):
        store.sessions()
    assert S.sync(spark, ix, Selector("all", str(tmp_path / "other"))).added == 1


@pytest.mark.parametrize("size", ["64b", "1k", "128m"])
def test_lines_of_a_file_in_many_ranges(spark, tmp_path, size):
    texts = {
        "a.jsonl": "\n".join(f"{i} " + "é" * (i % 40) for i in range(200)), "b.jsonl": "\n\nx\r\ny\rz\n" + "long" * 900 + "\n\n", "c.jsonl": "", "d.jsonl": "\n", "e.jsonl": "one",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = jsonl.lines(spark, [str(tmp_path / k) for k in texts])
        got = sorted((os.path.basename(r["file_path"]), r["line_no"], r["line"]) for r in rows.collect())
        tasks = spark.read.text(str(tmp_path / "a.jsonl")).rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = [(k, i, line) for k, t in texts.items() for i, line in enumerate((t[:-1] if t.endswith("\n") else t).split("\n")) if t]
    assert got == sorted(want) and (tasks > 20) == (size == "64b")
