"""Search over the index: block bounds against full scans, texts read late, character grams."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.functions.text import fts_tokens
from sessionlake.operators import blocks, grams, recall
from sessionlake.operators.selector import Selector
from sessionlake.plans import adapter
from sessionlake.plans import sync as S
from sessionlake.plans.find import FindOptions, Tables, find
from sessionlake.sources.store import Store

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """3,000 rows of words of very different frequency, in two segments, as tables and in blocks of 8."""
    rng = np.random.default_rng(1)
    vocab = np.array([f"w{i}" for i in range(400)])
    p = 1 / np.arange(1, 401)
    rows = []
    for i in range(3000):
        words = list(rng.choice(vocab, int(rng.integers(1, 60)), p=p / p.sum()))
        rows.append((f"s{i // 6:04d}", i % 6, " ".join(words + ["w350"] * int(i % 500 == 0) * 9), f"s{i % 100}", "ab"[i % 2]))
    df = spark.createDataFrame(rows, "session_uuid string, seq long, content_text string, title string, part string")
    df = df.withColumn("n_tokens", F.size(fts_tokens(F.col("content_text"))).cast("long"))
    old, blocks.BITS = blocks.BITS, 3
    parts = []
    for part in "ab":
        path = str(tmp_path_factory.mktemp("blocks") / part)
        own = blocks.numbered(df.filter(F.col("part") == part), "session_uuid", "seq")
        blocks.block_postings(own, ["content_text", "title"], [1.0, 4.0]).withColumn("segment", F.lit(part)).write.parquet(path)
        parts.append(path)
    blocks.BITS = old
    total = df.agg(F.sum("n_tokens")).first()[0]
    tables = df.withColumns({"content_text_tokens": fts_tokens(F.col("content_text")), "title_tokens": fts_tokens(F.col("title"))}).cache()
    # lengths of both fields together
    length = tables.agg(F.sum(F.size("content_text_tokens") + F.size("title_tokens"))).first()[0]
    assert length == total + 3000
    return tables, parts


def everything(spark, corpus, dead=None):
    tables, parts = corpus
    total = tables.agg(F.sum("n_tokens")).first()[0]
    return blocks.Surface(spark.read.parquet(*parts), 3000, total, [1.0, 4.0], dead)


def by_hand(tables, phrases, n, keep=lambda uuid: True):
    """BM25 of every row with every phrase, row by row."""
    import math

    rows = [(r["session_uuid"], r["seq"], r["content_text_tokens"], r["title_tokens"], r["n_tokens"]) for r in tables.collect()]
    occurs = lambda t, p: sum(t[i : i + len(p)] == p for i in range(len(t) - len(p) + 1))
    counts = [[(occurs(a, p), occurs(b, p)) for p in phrases] for _, _, a, b, _ in rows]
    average = sum(r[4] for r in rows) / len(rows)
    d = [sum(sum(c[i]) > 0 for c in counts) for i in range(len(phrases))]
    idf = [max(math.log((len(rows) - x + 0.5) / (x + 0.5)), 0) or 1e-6 for x in d]
    out = []
    for (uuid, seq, *_, size), c in zip(rows, counts):
        if all(sum(x) for x in c) and keep(uuid):
            f = [a + 4 * b for a, b in c]
            out.append((round(-sum(w * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * size / average)) for w, x in zip(idf, f)), 9), uuid, seq))
    return sorted(out)[:n]


@pytest.mark.parametrize("terms, fewer", [(["w350"], True), (["w0"], False), (["w3", "w9"], True), (["w20"], True), (["w1'w2"], False), (["w0", "w1'w0", "w5"], False), (["w350", "s7"], False), (["absent"], False), (["w0'w0"], False)])
def test_bounds_lose_nothing(spark, corpus, monkeypatch, terms, fewer):
    monkeypatch.setattr(blocks, "FIRST", 16)
    on = everything(spark, corpus)
    phrases = recall.phrases_of(terms)
    order = [F.col("score"), F.col("session_uuid"), F.col("seq")]
    for n, keep in ((10, lambda uuid: True), (5, lambda uuid: uuid[-1] in "37")):
        scope = (lambda rows: rows) if n == 10 else (lambda rows: rows.filter(F.col("session_uuid").rlike("[37]$")))
        got = blocks.best(on, terms, scope, order, n)
        rows = [(round(r["score"], 9), r["session_uuid"], r["seq"]) for r in got.rows.collect()]
        assert rows == by_hand(corpus[0], phrases, n, keep)
        if fewer and n == 10:
            assert got.read < got.of()


def test_first_blocks_grow_until_enough_rows_are_in_scope(spark, corpus, monkeypatch):
    monkeypatch.setattr(blocks, "FIRST", 1)
    scope = lambda rows: rows.filter("session_uuid >= 's0480'")
    order = [F.col("score"), F.col("session_uuid"), F.col("seq")]
    want = by_hand(corpus[0], [["w3"]], 20, lambda uuid: uuid >= "s0480")
    assert [(round(r["score"], 9), r["session_uuid"], r["seq"]) for r in blocks.best(everything(spark, corpus), ["w3"], scope, order, 20).rows.collect()] == want
    monkeypatch.setattr(blocks, "LISTED", 4)  # more blocks than are named: they are joined
    got = blocks.best(everything(spark, corpus), ["w3"], scope, order, 20)
    assert got.read is None and [(round(r["score"], 9), r["session_uuid"], r["seq"]) for r in got.rows.collect()] == want


def test_find_reads_no_text_before_the_limit(spark, tmp_path):
    store = adapter.load(spark, DATA, str(tmp_path / "ix"))
    on = store.searched()
    out = find(on, "reti of", FindOptions(limit=3))
    for kind in ("messages", "sessions"):
        plan = on.found[kind].rows._jdf.queryExecution().executedPlan().toString()
        assert "content_text" not in plan and "compact_text" not in plan and "summary_text" not in plan
    plan = out._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan parquet" in x and "content_text" in x]
    assert scans and all("EqualTo(session_uuid" in x for x in scans)
    tables = Tables(adapter.tokenised(adapter.messages(spark, DATA), "content_text"), adapter.tokenised(adapter.sessions(spark, DATA), *recall.SESSION_WEIGHTS))
    assert out.collect() == find(tables, "reti of", FindOptions(limit=3)).collect()


def log(path, uuid, said, day="2024-01-02"):
    folder = path / day.replace("-", "/")
    folder.mkdir(parents=True, exist_ok=True)
    rows = [{"timestamp": f"{day}T10:00:00Z", "type": "session_meta", "payload": {"id": "x", "cwd": "/w"}}]
    rows += [{"timestamp": f"{day}T10:00:{i:02d}Z", "type": "event_msg", "payload": {"type": "user_message" if i % 2 == 0 else "agent_message", "message": t}} for i, t in enumerate(said)]
    (folder / f"rollout-{day}T10-00-00-{uuid}.jsonl").write_text("\n".join(map(json.dumps, rows)))


def test_frequencies_are_those_of_live_rows(spark, tmp_path):
    root, ix = tmp_path / "sessions", str(tmp_path / "ix")
    ids = [f"00000000-0000-4000-8000-00000000000{i}" for i in range(6)]
    for i, uuid in enumerate(ids):
        log(root, uuid, ["alpha beta", "beta gamma " * (i + 1), "法 alpha"])
    S.sync(spark, ix, Selector("all", str(root)))
    log(root, ids[0], ["delta"])
    log(root, ids[1], ["alpha", "beta beta"])
    next((root / "2024/01/02").glob(f"*{ids[2]}*")).unlink()
    S.sync(spark, ix, Selector("all", str(root)))
    store = Store(spark, ix)
    assert len(store.state()["segments"]) == 2 and store.state()["dead"]
    on = store.searched()
    tables = Tables(store.messages().withColumn("content_text_tokens", fts_tokens(F.col("content_text"))), adapter.tokenised(store.sessions(), *recall.SESSION_WEIGHTS))
    for terms in (["alpha"], ["beta"], ["beta", "gamma"], ["beta'gamma"], ["delta"], ["none"]):
        key = lambda rows, *c: sorted((*[r[x] for x in c], round(r["score"], 9)) for r in rows.collect())
        assert key(on.message_scores(terms), "session_uuid", "seq") == key(tables.message_scores(terms), "session_uuid", "seq")
        assert key(on.session_scores(terms), "session_uuid") == key(tables.session_scores(terms), "session_uuid")
    for query in ("法", "法 ", "beta gamma", "  ", "!?"):
        got, want = (find(x, query, FindOptions()).drop("score").collect() for x in (on, tables))
        assert got == want and bool(got) == (query.strip() in ("法", "beta gamma"))


def test_substrings_by_grams(spark, tmp_path):
    rng = np.random.default_rng(4)
    alphabet = list("abcABC é_%.\n") + ["法", "律", "한", "😀"]
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 60)))) for _ in range(300)] + [None, "", "ab", "法"]
    rows = spark.createDataFrame([(i, t, texts[-1 - i]) for i, t in enumerate(texts)], "id int, text string, other string")
    found = grams.gram_postings(rows, ["id"], ["text", "other"])
    for needle in ("abc", "ABCa", "c é", "法", "法律", "a法", "律한b", "😀a_", "%", "b", "zzz", "法\n", "a.c"):
        got = sorted(r["id"] for r in grams.like(rows, found, ["id"], ["text", "other"], needle).collect())
        hit = lambda t: t is not None and needle.lower() in t.lower()
        assert got == [i for i, t in enumerate(texts) if hit(t) or hit(texts[-1 - i])], needle
    assert grams.grams_of("Ab法") == ["ab法", "法"] and grams.decides("法") and not grams.decides("法律") and not grams.grams_of("b")
    only = grams.gram_postings(rows, ["id"], ["text"], grams.CHARS)
    want = [i for i, t in enumerate(texts) if t and "法" in t]
    assert sorted(r["id"] for r in grams.holding(only, "法", ["id"], grams.CHARS).collect()) == want
    assert re.search("法", "".join(t or "" for t in texts))
