"""Empty tables, long lists of the similarity join, and the pipeline stage by stage."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessionlake.llm import jaccard
from sessionlake.llm._scratch import written
from sessionlake.llm.fmindex import find_leaks
from sessionlake.llm.hmm import score_texts
from sessionlake.llm.mixing import mix
from sessionlake.llm.parsing import remove_repeated_bytes
from sessionlake.llm.phrases import remove_repeated
from sessionlake.llm.pii import replace_entities

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, label long, key long, rep long"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def classes_of(texts, k, percent):
    """Brute force: doc_id to the least doc_id reachable by links."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(lowered(t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                lo, hi = sorted((top(a), top(b)))
                label[hi] = lo
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("few, dense, hot, star", [(4, 4, 4096, 1024), (2, 0, 5, 7)])
def test_jaccard_lists_of_near_copies_that_do_not_link(spark, monkeypatch, few, dense, hot, star):
    for name, value in (("FEW", few), ("DENSE", dense), ("HOT", hot), ("STAR", star)):
        monkeypatch.setattr(jaccard, name, value)
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 400, 150)]
    texts = {}
    for i in range(60):
        t = list(base)
        for at in rng.choice(150, int(rng.integers(0, 12)), replace=False):
            t[at] = f"e{i}-{at}"
        texts[i] = " ".join(t)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similarity_classes(d).collect()}
    want = classes_of(texts, 4, 85)
    assert got == want and 1 < len(set(want.values())) < 60


def test_jaccard_light_sets_and_edits_of_other_kinds(spark):
    rng = np.random.default_rng(9)
    texts = {}
    for n, copies, most in ((8, 20, 2), (13, 30, 2), (60, 40, 4), (200, 20, 15)):
        base = [f"w{x}" for x in rng.integers(0, 900, n)]
        for _ in range(copies):
            t = list(base)
            for _ in range(int(rng.integers(0, most + 1))):
                at, kind = int(rng.integers(0, len(t))), rng.random()
                t[at : at + (kind < 0.7)] = [f"w{rng.integers(0, 900)}"] if kind > 0.3 else []
            texts[int(rng.integers(0, 1 << 40))] = " ".join(t)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for k, percent in ((4, 85), (5, 80)):
        got = {r["doc_id"]: r["component_id"] for r in jaccard.similarity_classes(d, k, percent).collect()}
        assert got == classes_of(texts, k, percent)


def test_jaccard_repeated_ids_are_one_vertex(spark):
    a, b, c = ("a b c d e f", "p q r s t u", "p q r s t u v w x y z")
    rows = [(5, a, 1), (5, b, 2), (3, a, 3), (9, b, 4), (9, b, 5), (None, a, 6), (7, c, 7), (8, "", 8), (8, None, 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, key long").withColumn("label", F.lit(0)).withColumn("rep", F.lit("x"))
    got = sorted(tuple(r) for r in jaccard.similarity_classes(d).collect() if r["doc_id"] is not None)
    assert got == [(3, 3, 3), (5, 3, 3), (5, 3, 3), (7, 8, 7), (8, 0, 8), (8, 0, 8), (9, 3, 3), (9, 3, 3)]


@pytest.mark.parametrize("name, apply", [
    ("join", jaccard.similarity_classes), ("bytes", remove_repeated_bytes), ("phrases", remove_repeated), ("surrogates", replace_entities), ("mix", mix),
    ("leaks", lambda d: find_leaks(d, d.select(F.lit("i").alias("item_id"), "text"))), ("lm", lambda d: score_texts(d, F.col("doc_id") > 0)),
])
def test_empty_table(spark, name, apply):
    assert apply(spark.createDataFrame([], DOCS)).count() == 0


def test_pipeline_stages(spark):
    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, DATA)
        if i + 1 < len(corpus_pipeline.STAGES):
            docs = written(docs, f"test-{name}")
            assert docs.columns == columns
        seen[name] = (before.toPandas(), docs.toPandas())
    before, after = seen["quality"]
    bad = set(spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 0").toPandas()["doc_id"])
    good = set(spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1").toPandas()["doc_id"])
    assert not bad & set(after["doc_id"]) and good & set(before["doc_id"]) <= set(after["doc_id"])
    before, after = seen["near_duplicates"]
    want = {i for i, c in classes_of(dict(zip(before["doc_id"], before["text"])), 5, 80).items() if i == c}
    assert set(after["doc_id"]) == want and len(after) == len(want)
    before, after = seen["decontamination"]
    windows = set()
    item_words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t or ""))
    for t in spark.read.parquet(f"{DATA}/benchmark.parquet").toPandas()["text"]:
        w = item_words(t)
        windows |= {tuple(w[j : j + 10]) for j in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    assert set(after["doc_id"]) == set(before["doc_id"])
    text_after = dict(zip(after["doc_id"], after["text"]))
    for i, t in zip(before["doc_id"], before["text"]):
        w = item_words(t)
        if not any(tuple(w[j : j + n]) in windows for n in sizes for j in range(len(w) - n + 1)):
            assert text_after[i] == t
        else:
            assert len(item_words(text_after[i])) < len(w)
    before, after = seen["surrogates"]
    assert set(after["doc_id"]) == set(before["doc_id"]) and (after["n_chars"] == after["text"].fillna("").str.len()).all()
    before, after = seen["mixing"]
    assert set(after["doc_id"]) <= set(before["doc_id"]) and after.groupby("doc_id")["copy"].max().max() <= 3
    assert (after.groupby("doc_id")["copy"].nunique() == after.groupby("doc_id").size()).all()


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    a, b, c, long = text(60), text(60), text(60), text(30_000)
    rows = [(1, a, "s"), (2, a + " more", "s"), (5, b, None), (5, c, "s"), (5, c, "s"), (None, a, "t"), (None, a, "t"), (7, None, "s"), (8, "", None), (9, long, "t"), (None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], schema)
    item = " ".join(b.split()[10:25])
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    run = lambda name, d: written(dict(corpus_pipeline.STAGES)[name](spark, d, str(tmp_path)), "odd")
    assert run("quality", docs).count() == 0  # without labels every score is 0.5
    kept = run("near_duplicates", docs)
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(1, a), (5, b), (5, c), (None, a), (None, a), (7, None), (8, ""), (9, long), (None, None)], key=str)
    clean = run("decontamination", kept)
    assert clean.columns == docs.columns and clean.count() == 9
    assert {r["text"] for r in clean.filter("doc_id = 5").collect()} == {" ".join([*b.split()[:10], "", *b.split()[25:]]), c}
    safe = run("surrogates", clean)
    assert safe.columns == docs.columns and safe.count() == 9
    mixed = run("mixing", safe)
    assert {r["doc_id"] for r in mixed.collect()} <= {1, 5, 7, 8, 9, None} and mixed.columns == [*docs.columns, "copy"]
    for name, _ in corpus_pipeline.STAGES:
        assert run(name, docs.limit(0)).count() == 0


def test_copies_with_deletions_give_few_differences(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(80):
        gone = set(rng.choice(400, int(rng.integers(5, 20)), replace=False).tolist())
        texts[i] = " ".join(w for j, w in enumerate(base) if j not in gone)
    rows = {"jaccard-split": 0, "jaccard-stars": 0, "jaccard-differences": 0}

    def counted(df, name):
        out = written(df, name)
        if name in rows:
            rows[name] += out.count()
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similarity_classes(docs).collect()}
    assert got == classes_of(texts, 4, 85)
    assert 0 < 2 * rows["jaccard-stars"] < rows["jaccard-split"]
    assert rows["jaccard-differences"] < 100 * rows["jaccard-stars"]
