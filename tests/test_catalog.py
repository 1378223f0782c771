"""Catalogue queries against their DuckDB oracles, and behaviours that need none."""

import gzip
import json
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sessionlake import catalog_logs
from sessionlake import catalog_queries as c
from sessionlake.functions import text as X
from sessionlake.operators import evaluation
from sessionlake.operators.selector import InvalidSelector, Selector

DATA = "/root/testdata/sf0.001"
NAMES = ["message_seq", "derive_summary", "derive_compact", "selector_cwd_date_range", "stats_top_cwds", "read_page", "fts_tokens", "bm25_messages", "bm25_sessions_weighted", "find_relevance", "find_sort_ended", "coverage_implies", "command_bonus", "ordered_span", "source_fingerprint", "fts_scripts", "fts_query_terms", "bm25_postings_phrase", "find_postings", "sync_counters", "sync_reconcile_anti", "coverage_requested", "eval_manual", "scan_records", "scan_sessions", "find_tables", "find_like_messages", "find_like_compared_messages", "find_like_sessions", "like_substring", "like_one_character", "query_profile", "coverage_status", "eval_compare", "tokenize_cjk_bigrams"]
LOGS = ["sync_steps", "log_listing", "log_lines", "log_snapshot", "store_sessions", "store_messages", "store_token_counts", "store_coverage", "store_freshness", "store_covering", "store_session_coverage", "golden_entries", "golden_marks", "eval_batch_files", "read_ranges"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("conversations", "documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES + LOGS)
def test_oracle(spark, duck, name):
    of = c if name in NAMES else catalog_logs
    got = of.QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(of.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
    key = lambda df: sorted(map(str, (tuple(map(plain, r)) for r in df[cols].astype(object).itertuples(index=False))))
    assert key(got) == key(want)


def test_every_query_has_an_oracle():
    assert set(c.QUERIES) - set(c.ORACLES) == {"snippet_tokens", "snippet_raw"}
    assert set(catalog_logs.QUERIES) == set(catalog_logs.ORACLES) and not set(c.QUERIES) & set(catalog_logs.QUERIES)


def test_selector_rejects():
    for bad in ("nope", "[]", '{"kind": "x", "root": "/"}', '{"kind": "cwd", "root": "/a"}', '{"kind": "date_range", "root": "/a", "fromDate": "2024-02-01", "toDate": "2024-01-01"}'):
        with pytest.raises(InvalidSelector):
            Selector.parse(bad)
    assert Selector.parse('{"kind": "cwd", "root": "/a", "cwd": " /b "}').key() == '{"kind":"cwd","root":"/a","cwd":"/b"}'


def test_tokens_fold_accents_and_split_cjk(spark):
    df = spark.createDataFrame([("Éclair can't 部署検",)], "t string").select(X.fts_tokens(F.col("t")).alias("x"))
    assert df.first()["x"] == ["eclair", "can", "t", "部署", "署検"]


def test_empty_query_finds_nothing(spark):
    assert c.find(c._on(spark, DATA), "  ").count() == 0


def test_golden_searches_give_the_results_that_marks_read(spark, tmp_path):
    turns = [(i, t, "user", f"text {i} {t}") for i in range(90) for t in range(1 + i % 4)] + [(200, t, "user", "long") for t in range(12)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    held = spark.read.parquet(f"{tmp_path}/conversations.parquet").groupBy("conv_id").agg(F.count("*").alias("n")).select(F.concat(F.lit("g"), F.col("conv_id").cast("string")).alias("id"), "n")
    top, every = catalog_logs._found_top(spark, str(tmp_path)), catalog_logs._found(spark, str(tmp_path))
    want = every.join(held, "id").filter("rank <= n").select(*top.columns)
    assert top.count() <= len(turns) < every.count()
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, want.collect()))
    # entries are dealt to several files
    assert catalog_logs._entries(spark, str(tmp_path)).select("file").distinct().count() > 1


def test_golden_searches_are_not_sent_to_their_results(spark, tmp_path, monkeypatch):
    turns = [(i, t, "user", "text") for i in range(60) for t in range(1 + i % 5)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {}
    for most in (catalog_logs.SENT_PLACES, 0):  # first results sent, or sorted
        monkeypatch.setattr(catalog_logs, "SENT_PLACES", most)
        top = catalog_logs._found_top(spark, str(tmp_path))
        got[most] = str(top._jdf.queryExecution().optimizedPlan()), sorted(map(tuple, top.collect()))
    (sent, rows), (merged, same) = got.values()
    assert "rightHint=(strategy=broadcast)" in sent and "rightHint=(strategy=merge)" in merged and "leftHint" not in sent + merged
    assert rows == same and 0 < len(rows) <= len(turns)


@pytest.mark.parametrize("most", [10_000, 300])
def test_saved_files_are_whole_and_few_lie_on_disk_together(spark, tmp_path, monkeypatch, most):
    spark.createDataFrame([(i, t) for i in [*range(80), 200, 3_000_000_000] for t in range(1 + i % 3)] + [(None, 0)], "conv_id long, turn long").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(catalog_logs, "RESULTS_AT_ONCE", most, raising=False)
    want: dict[str, list] = {}
    for r in catalog_logs._found(spark, str(tmp_path)).orderBy("rank").collect():
        want.setdefault(r["id"], []).append({"rank": r["rank"], "sessionUuid": r["session_uuid"], "title": r["cwd"]})
    rounds, folders, read = [], [], getattr(evaluation, "first_results", None)

    def watched(spark, folder):
        files = list(Path(folder.removeprefix("file://")).glob("*"))
        rounds.append({f.name.removesuffix(".find.json.gz"): gzip.decompress(f.read_bytes()).decode() for f in files})
        folders.append(files[0].parent)
        return read(spark, folder)

    monkeypatch.setattr(evaluation, "first_results", watched, raising=False)
    got = catalog_logs.QUERIES["eval_batch_files"](spark, str(tmp_path))
    assert sum(map(len, rounds)) == len(want) and len(rounds) >= sum(map(len, want.values())) / most
    assert {k: v for r in rounds for k, v in r.items()} == {k: json.dumps({"query": f"query {k}", "results": v}, indent=2) for k, v in want.items()}
    assert max(sum(len(want[k]) for k in r) for r in rounds) <= 2 * most and not any(f.exists() for f in folders)
    assert sorted(map(tuple, got.collect())) == sorted((k, f"query {k}", len(v), v[0]["sessionUuid"]) for k, v in want.items())


def test_query_tokens_are_those_of_its_terms():
    for text in ("A can't 3.5 _ __a_ ._. x_y", "Éclair 部署検 a部b ΣΑΣ _é_ ́", "", "部", "İstanbul ſ ²½ fi"):
        assert X.query_tokens(text) == [w for t in X.level1(text) for w in X.term_tokens(t)]
        assert [t for t in X.level1(text) if t.strip("_.'") == ""] == []
    assert X.query_tokens("A can't __a_ 部署検 Éa") == ["a", "can", "t", "a", "部署", "署検", "ea"]
