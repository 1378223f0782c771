"""The llm operators on small fixtures: brute force, edge cases, round trips."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.llm.chat import as_events, fold, masked_texts, parse, render
from sessionlake.llm.components import components
from sessionlake.llm.fmindex import FMIndex, find_leaks
from sessionlake.llm.gam import fit, quality_model, score
from sessionlake.llm import gam
from sessionlake.llm.hmm import Chain, expected, forward, score_texts, segments
from sessionlake.llm.jaccard import similarity_classes
from sessionlake.llm.mixing import mix
from sessionlake.llm.phrases import remove_repeated
from sessionlake.llm.pii import FEMALE, FEMALE_CYRILLIC, MALE, MALE_CYRILLIC, SURNAMES, replace_entities
from sessionlake.llm.topk import top_k

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, score double, items string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefg"), 3))
    base = " ".join(word() for _ in range(120))
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), None, "", "  \n\t ", "one two", "one two", "x " * 5000, " ".join(word() for _ in range(200)), "éß 部署 " * 20, base[:180], " ".join(base.split()[20:70]) + " tail", "A" * 100_000]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, 0.0, "z") for i, t in enumerate(texts)] + [(None, base, None, None, None, None), (1, base, "en", "s1", 0.0, "z")]
    return spark.createDataFrame(rows, DOCS)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).round(3)
    v[40:60] = v[3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [None] * 8), (902, [float("nan")] * 8), (None, [1.0] * 8), (903, []), (5, v[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rows_of(top_k(df, F.col("vec_id") % 50 == 0), "query_id", "rank", "vec_id", "score")
    ints = {i: np.floor(1024 * x).astype(int) for i, x in enumerate(v)} | {903: np.zeros(8, int)}
    want = []
    for q in range(0, 300, 50):
        best = sorted(((-int(ints[q] @ ints[j]), j) for j in ints if j != q))[:10]
        want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want, key=str)
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_phrases_match_brute_force(spark, docs):
    def brute(texts, w):
        seen = Counter(tuple(t[i : i + w]) for t in texts for i in range(len(t) - w + 1))
        for t in texts:
            hit = {i + j for i in range(len(t) - w + 1) if seen[tuple(t[i : i + w])] > 1 for j in range(w)}
            kept = [x for i, x in enumerate(t) if i not in hit]
            yield len(t), len(hit), hashlib.sha256(" ".join(kept).encode()).hexdigest()

    rows = docs.collect()
    want = [(r["doc_id"], *x) for r, x in zip(rows, brute([WORD.findall(r["text"] or "") for r in rows], 35))]
    assert rows_of(remove_repeated(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=str)
    assert remove_repeated(docs.limit(0)).count() == 0


def test_jaccard_matches_brute_force(spark, docs):
    plain = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    sets = {}
    for r in plain.collect():
        w = WORD.findall((r["text"] or "").lower())
        sets[r["doc_id"]] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similarity_classes(plain).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}
    assert similarity_classes(docs).count() == docs.count()
    assert similarity_classes(docs.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (7, 8), (5, 5)], "a long, b long")
    assert rows_of(components(edges), "v", "label") == [(1, 1), (2, 1), (3, 1), (5, 5), (7, 7), (8, 7), (9, 1)]


def test_components_of_a_shuffled_chain(spark):
    ids = np.random.default_rng(6).permutation(3000).tolist()
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    assert rows_of(components(edges), "v", "label") == sorted(((i, 0) for i in range(3000)), key=str)


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(5)
    t = np.r_[rng.integers(1, 4, 500), 0]
    index = FMIndex(t)
    for p in ([1, 2], [3, 3, 1], [2], [9]):
        lo, hi = index.search(np.array([p]))
        want = [i for i in range(len(t) - len(p) + 1) if t[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(lo[0], hi[0]))) == want


def test_leaks(spark):
    item = "the quick brown fox jumps over the lazy dog near a river bank"
    d = spark.createDataFrame([(1, "Some. " + item.upper() + "! end", "x"), (2, None, "x"), (3, "tiny words here", "x"), (4, "", "x"), (5, " ".join(item.split()[:9]), "x")], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame([(7, item), (10, item), (8, None), (9, "tiny words"), (11, "...")], "item_id long, text string")
    got = {r["doc_id"]: r for r in find_leaks(d, b, keep_text=True).collect()}
    assert got[1]["n_hit"] == 13 and got[1]["items"] == ["10", "7"] and got[1]["kept_text"] == "Some. ! end"
    assert got[3]["items"] == ["9"] and got[3]["spans"] == [0, 2] and got[2]["n_words"] == 0 and got[5]["n_hit"] == 0
    assert find_leaks(d, b.limit(0)).agg(F.sum("n_hit")).first()[0] == 0 and find_leaks(d.limit(0), b).count() == 0


def test_mixing(spark, docs):
    out = [r.asDict() for r in mix(docs).collect()]
    assert len(out) == docs.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    by = defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
    assert math.isclose(sum(x[0]["target"] for x in by.values()), sum(r["size"] for r in out))
    for x in by.values():
        assert x[0]["target"] <= 3 * x[0]["source_size"] + 1e-6 and sum(r["taken"] for r in x) <= x[0]["target"] + 1e-6
    assert mix(docs.limit(0)).count() == 0


def test_chat_round_trip_and_folding(spark):
    odd = ["\\### Assistant: </turn> ok", "<turn>\\l\\b<text>", "", None]
    table = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(odd)], "conv_id long, turn long, role string, text string")
    out = render(fold(as_events(table))).withColumns({"t": parse(F.col("formatted")), "m": masked_texts(F.col("formatted"), F.col("loss_spans"))}).first()
    assert [(x["role"], x["text"]) for x in out["t"]] == [("user", odd[0]), ("assistant", odd[1]), ("user", ""), ("assistant", "")]
    assert out["m"] == odd[1]
    log = [(1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", "he"), (1, 3, 2, "delta", "assistant", "llo"), (1, 4, 3, "message", "user", "gone"), (1, 5, 2, "regenerate", "assistant", "new"), (1, 6, 2, "delta", "assistant", "er"), (1, 7, 1, "edit", "user", "hey")]
    events = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string")
    assert rows_of(fold(events), "turn", "role", "text") == [(1, "user", "hey"), (2, "assistant", "newer")]


def test_forward_is_the_exact_likelihood():
    rng = np.random.default_rng(2)
    emit = rng.random((5, 2))
    chain = Chain(np.array([0.3, 0.7]), np.array([[0.9, 0.1], [0.4, 0.6]]), emit / emit.sum(0))
    sym = np.array([0, 3, 1, 4, 2])
    total = 0.0
    for path in range(2**5):
        s = [(path >> i) & 1 for i in range(5)]
        p = chain.start[s[0]] * chain.emit[sym[0], s[0]]
        for a, b, x in zip(s, s[1:], sym[1:]):
            p *= chain.move[a, b] * chain.emit[x, b]
        total += p
    assert math.isclose(forward(chain, sym, np.array([0]), np.array([5]))[0], math.log10(total))


@pytest.mark.parametrize("most", [2, 3, 100])
def test_expected_counts_are_those_of_all_paths(most):
    rng = np.random.default_rng(4)
    k, m = 3, 5
    emit, move = rng.random((m, k)), rng.random((k, k))
    chain = Chain(np.array([0.2, 0.5, 0.3]), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    n = np.array([5, 1, 4, 7])
    sym, train = rng.integers(0, m, n.sum()), np.array([True, True, False, True])
    first, moves, emitted = np.zeros(k), np.zeros((k, k)), np.zeros((m, k))
    for b, length, used in zip(np.cumsum(n) - n, n, train):
        if not used:
            continue
        x, paths = sym[b : b + length], list(itertools.product(range(k), repeat=int(length)))
        p = np.array([chain.start[s[0]] * np.prod([chain.emit[x[t], s[t]] for t in range(length)]) * np.prod([chain.move[s[t], s[t + 1]] for t in range(length - 1)]) for s in paths])
        for w, s in zip(p / p.sum(), paths):
            first[s[0]] += w
            for t in range(length):
                emitted[x[t], s[t]] += w
                if t:
                    moves[s[t - 1], s[t]] += w
    s = segments(chain, sym, n, train, most)
    got = expected(chain, sym, s.begin, s.length, s.enter, s.leave)
    assert np.allclose(got[0], first) and np.allclose(got[1], moves)
    assert np.allclose(np.column_stack([np.bincount(sym[got[2]], got[3][:, j], m) for j in range(k)]), emitted)


def test_hmm_base_score(spark, docs):
    out = score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, rounds=2)
    rows = docs.collect()
    tokens = [[*WORD.findall((r["text"] or "").translate({c: c + 32 for c in range(65, 91)})), None] for r in rows]
    c = Counter(w for r, t in zip(rows, tokens) if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 10 for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(r["doc_id"]), len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for r, t in zip(rows, tokens))
    got = out.collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)


def test_quality_learns_and_scores_all(spark, docs):
    x = np.random.default_rng(0).random((500, 15))
    model = fit(x, (x[:, 5] > 0.6).astype(float), rounds=40)
    assert ((model.score(x) > 0.5) == (x[:, 5] > 0.6)).mean() > 0.97
    empty = spark.createDataFrame([], "doc_id long, quality int")
    out = score(docs, quality_model(docs, empty)).collect()
    assert len(out) == docs.count() and {r["score"] for r in out} == {0.5}


def test_surrogates(spark):
    t = "Mail bob.1@mail2.example.com or +1 (415) 555-0134, card 4111111111111111 from 10.1.2.3; password=abcdef123456 by John Smith. Later Mr. Smith paid with 4111111111111111."
    d = spark.createDataFrame([(1, t, 1), (2, None, 2), (3, "version 3. CC BY-NC 4.0.", 3), (4, "", 4), (1, t, 1)], "doc_id long, text string, n_entities int")
    out = {r["doc_id"]: r for r in replace_entities(d).collect()}
    new = out[1]["text"]
    assert out[1]["n_entities"] == 8 and not any(x in new for x in ("bob.1", "555-0134", "4111111111111111", "10.1.2.3", "abcdef123456", "John", "Smith"))
    card = re.findall(r"\d{16}", new)
    digits = [int(x) for x in card[0][::-1]]
    assert len(card) == 2 and card[0] == card[1] and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(digits)) % 10 == 0
    surname = re.search(r"Mr\. (\w+)", new)[1]
    assert re.search(rf"\w+ {surname}\. Later", new)
    assert out[2]["text"] is None and out[3]["text"] == "version 3. CC BY-NC 4.0." and out[4]["text"] == ""


def test_surrogates_stay_apart(spark):
    values = [f"{a} {b}" for a in MALE[:6] + FEMALE[:3] for b in SURNAMES] + [f"Mr. {b}" for b in SURNAMES]
    values += [f"Иван {a}{b}ский" for a in ("Бел", "Гор", "Дуб", "Зел", "Вер") for b in ("ов", "ен", "ин", "ан", "ев")] + ["Иван ПЕТРОВ", "Иван СИДОРОВ", "Анна Белова"]
    values += [f"{i}@x.com" for i in range(10)] + ["_@x1.com", "_@y2.com", "_@z3.com", "password=--------", "password=++++++++", "password=+------1"]
    d = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    new = {values[r["doc_id"]]: r["text"] for r in replace_entities(d).collect()}
    assert len(set(new.values())) == len(values) and not set(new.values()) & set(values)
    assert all(new[f"James {b}"].split()[1] == new[f"Mary {b}"].split()[1] == new[f"Mr. {b}"].split()[1] for b in SURNAMES)


def test_surrogates_keep_gender_script_and_check_digits(spark):
    male, female = "John Smith met Robert Quellington", "Иван Петров и Мария Иванова, Mary-Ann no, Mary Jones"
    iban, bad = "DE89 3704 0044 0532 0130 00", "DE00 3704 0044 0532 0130 00"
    d = spark.createDataFrame([(1, male), (2, female), (3, f"{iban} and GB29NWBK60161331926819 and {bad}")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in replace_entities(d).collect()}
    first = [x.split()[0] for x in out[1].split(" met ")]
    assert all(x in MALE for x in first) and len(set(first)) == 2
    a, b = re.match(r"(\w+ \w+) и (\w+ \w+),", out[2]).groups()
    assert all(re.fullmatch("[а-яА-ЯёЁ ]+", x) for x in (a, b)) and a.split()[0] in MALE_CYRILLIC and b.split()[0] in FEMALE_CYRILLIC
    assert out[2].split()[-2] in FEMALE and not {"Петров", "Мария", "Jones"} & set(re.split(r"\W+", out[2]))
    rest = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97
    found = [x.replace(" ", "") for x in out[3].split(" and ")]
    assert [rest(x) == 1 for x in found[:2]] == [True, True] and out[3].split(" and ")[0][4] == " " and [x[:2] for x in found] == ["DE", "GB", "DE"]
    assert found[0] != iban.replace(" ", "") and len(set(found)) == 3


def test_surrogates_depend_on_the_key(spark):
    d = spark.createDataFrame([(1, "bob@mail.example.net"), (2, "bob@mail.example.net"), (3, "BOB@mail.example.net")], "doc_id long, text string")
    of = lambda **k: [r["text"] for r in replace_entities(d, **k).orderBy("doc_id").collect()]
    a, b = of(key="one"), of(key="two")
    assert a[0] == a[1] and a[0] != b[0] and a[0].lower() == a[2].lower()
    spark.conf.set("sessionlake.surrogates.key", "two")
    try:
        assert of() == b
    finally:
        spark.conf.unset("sessionlake.surrogates.key")


def test_topk_keeps_rows_of_one_id(spark):
    rows = [(100, [2.0, 2.0]), (7, [1.0, 1.0]), (7, [3.0, 3.0]), (5, [0.0, 1.0]), (7, [3.0, 3.0]), (200, [1.0, 0.0]), (200, [0.0, -1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = top_k(d, F.col("vec_id") % 100 == 0, k=4).collect()
    by = lambda q: [(r["vec_id"], r["score"] // 1048576) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
    assert by(100) == [(7, 12), (7, 12), (7, 4), (5, 2)]
    assert by(200) == [(7, 3), (7, 3), (100, 2), (7, 1)]


def test_mixing_meets_targets_of_equal_ids(spark):
    rng = np.random.default_rng(0)
    rows = [(None if i % 2 else 3, "w " * int(rng.integers(1, 20)), s) for s in ("a", "b", "c") for i in range(300)]
    out = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in ("a", "b", "c"):
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 25
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    # the tilt is exponential in size: rates of one source lie on one curve
    a = [(r["size"], math.log(r["rate"])) for r in out if r["source"] == "b" and r["size"] and 0 < r["rate"] < 3]
    slope = {round(y / x, 5) for x, y in a if x > 3}
    assert max(slope) - min(slope) < 1e-4


def test_quality_matches_a_plain_boosting(spark):
    """The fitted tables against a direct version of cyclic boosting that splits by trying every cut."""
    rng = np.random.default_rng(2)
    x = np.zeros((300, len(gam.FEATURES)))
    x[:, :3] = rng.random((300, 3)).round(1)
    y = ((x[:, 0] > 0.5) ^ (rng.random(300) < 0.1)).astype(float)
    model = gam.fit(x, y, rounds=5)
    bins = [np.searchsorted(model.cuts[f], x[:, f], side="right") for f in range(x.shape[1])]
    z = np.full(300, math.log(y.mean() / (1 - y.mean())))
    tables = [np.zeros(len(c) + 1) for c in model.cuts]
    for _ in range(5):
        for f in range(x.shape[1]):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            gain = lambda m: (g[m].sum() ** 2) / (h[m].sum() + 1)
            parts = [np.arange(len(tables[f]))]
            while len(parts) < gam.LEAVES:
                best = max(((gain(np.isin(bins[f], q[:c])) + gain(np.isin(bins[f], q[c:])) - gain(np.isin(bins[f], q)), -i, -c) for i, q in enumerate(parts) for c in range(1, len(q))), default=(0, 0, 0))
                if best[0] <= 1e-9:
                    break
                q = parts.pop(-best[1])
                parts += [q[: -best[2]], q[-best[2] :]]
            for q in parts:
                m = np.isin(bins[f], q)
                step = gam.RATE * g[m].sum() / (h[m].sum() + 1)
                tables[f][q] += step
                z[m] += step
    assert all(np.allclose(a, b) for a, b in zip(model.tables, tables))
    full = model.intercept + sum(t[b] for t, b in zip(model.tables, bins))
    full += sum(t[np.searchsorted(model.coarse[a], x[:, a], side="right"), np.searchsorted(model.coarse[b], x[:, b], side="right")] for a, b, t in model.pairs)
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-full)))


def test_quality_of_odd_texts(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(14)] + [(2, None), (None, 1), (3, 0)], "doc_id long, quality int")
    out = score(docs, quality_model(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    same = {r["score"] for r in out if r["doc_id"] in (0, 1)}
    assert len(same) == 1 and score(docs.limit(0), quality_model(docs, labels)).count() == 0


def test_chat_odd_logs(spark):
    kinds = "conv_id long, seq long, turn long, kind string, role string, text string, loss string"
    empty = spark.createDataFrame([], kinds)
    assert render(fold(empty)).count() == 0
    rows = [(None, 1, 1, "message", "user", "a", "x"), (None, 1, 1, "message", "user", "a", "x"), (None, None, None, None, None, None, None), (2, 1, 1, "delta", "assistant", "b", ""), (2, 1, 1, "delta", "assistant", "a", ""), (3, 5, 1, "odd", "assistant", "t" * 50_000, "")]
    got = {r["conv_id"]: r for r in render(fold(spark.createDataFrame(rows, kinds))).collect()}
    assert set(got) == {None, 2, 3} and "ab" in got[2]["formatted"] and len(got[3]["formatted"]) > 50_000
