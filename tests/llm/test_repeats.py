"""Phrase collocations, periodic runs and line dedup against brute force, and their odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from sessionlake.llm import collocations as C
from sessionlake.llm import jaccard, phrases
from sessionlake.llm import runs as R
from sessionlake.llm.lines import keep_bitmaps, without_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
lowered = lambda s: re.sub("[A-Z]", lambda m: m.group().lower(), s)


# line dedup


def lines_by_hand(rows, least_docs, least_chars):
    key = lambda line: lowered(line.strip(" \t\n\v\f\r"))
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(doc)
    for doc, text in rows:
        kept, lines = [], (text or "").split("\n")
        for line in lines:
            docs = held[key(line)]
            last = max((d for d in docs if d is not None), default=None)
            if len(key(line)) < least_chars or len(docs) < least_docs or doc is not None and doc == last:
                kept.append(line)
        yield doc, len(lines), len(lines) - len(kept), "\n".join(kept)


def test_line_dedup(spark):
    rng = np.random.default_rng(3)
    pool = ["Terms of Service apply here", " terms of service APPLY here\t", "short", "Ünïcode Überschrift läuft ÄÖ", "Ünïcode Überschrift läuft äö", "\x85" + "wide line of text here\r", "", "x" * 5000, "an own line of this number"]
    rows = [(int(i), "\n".join(pool[x] + (str(i) if x == 8 else "") for x in rng.integers(0, len(pool), int(rng.integers(1, 9))))) for i in rng.permutation(40)]
    rows += [(None, pool[0] + "\n" + pool[3]), (None, pool[0]), (7, pool[0]), (7, pool[0]), (99, None), (98, ""), (97, "\n"), (96, "\n".join([pool[0]] * 3000 + ["end"] * 2))]
    docs = spark.createDataFrame([(d, t, "k", 1, "p") for d, t in rows], "doc_id long, text string, keep string, place int, h1 string")
    for least_docs, least_chars in ((3, 20), (1, 1), (30, 20)):
        got = [tuple(r) for r in without_lines(docs, keep_bitmaps(docs, least_docs, least_chars)).collect()]
        assert Counter(got) == Counter(lines_by_hand(rows, least_docs, least_chars))
    assert without_lines(docs.limit(0), keep_bitmaps(docs.limit(0))).count() == 0


def test_line_bitmaps_are_runs_of_kept_lines(spark):
    line = "this line stands in all documents"
    docs = spark.createDataFrame([(i, f"a\n{line}\n{line}\nb\nc\n{line}") for i in range(4)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["keep"]] for r in keep_bitmaps(docs).collect()}
    assert got == {i: [(0, 1), (3, 2)] for i in range(3)}


# periodic runs


def runs_by_hand(w):
    n, found = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def reported(doc, text, plant):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if plant and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = runs_by_hand(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    shown = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc, len(runs), *shown, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def some_texts():
    rng = np.random.default_rng(8)
    thue = [bin(i).count("1") % 2 for i in range(300)]
    yield " ".join("ab"[x] for x in thue)  # no cube at all
    yield " ".join("abc"[x] for x in thue[:40] * 5 + thue[3:90] * 4)
    for size in (1, 5, 6, 7, 40, 150):
        yield " ".join(["x"] * size)
        yield "\t".join(rng.choice(["a", "b"], size))
        part = list(rng.choice(["é", "b", "c"], max(1, size // 5)))
        yield "\n".join((["q"] + part * 5 + ["b"] + part * 6)[: 3 * size])
    yield from (None, "", " \n ", "a b a b a b a b a", "a b a b a b a c", "a a a a a b b b b b b a a a a a a")


def test_periodic_runs(spark):
    rows = [(i, t) for i, t in enumerate(some_texts())] + [(None, "a a a a a a a"), (3, "y " * 9), (3, "y " * 9)]
    rows += [(1000 + i, " ".join(f"w{x}" for x in np.random.default_rng(i).integers(0, 9, 60))) for i in range(60)]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, start int")
    for plant in (False, True):
        assert Counter(map(tuple, R.periodic_runs(docs, plant).collect())) == Counter(reported(d, t, plant) for d, t in rows)
    assert R.periodic_runs(docs.limit(0)).count() == 0


def test_pairs_in_many_blocks_and_hashes_that_fail(monkeypatch):
    rng = np.random.default_rng(2)
    w = rng.integers(0, 3, 700).astype(np.uint64)
    w[100:400] = np.tile(w[100:125], 12)
    first = np.array([0, 300, 300, 700])
    monkeypatch.setattr(R, "BLOCK", 13)
    got = R.find_runs(w, first)
    want = [(s + o, s + o + n, p) for o, e in ((0, 300), (300, 700)) for s, n, p in runs_by_hand(w[o:e].tolist())]
    assert [*zip(*(x.tolist() for x in got))] == want

    batch = __import__("pyarrow").RecordBatch.from_pydict({"doc_id": [1], "text": ["a b c d e f g a b c d e f h"]})
    right, seeds = R.find_runs, []

    def wrong_once(values, first, seed):
        seeds.append(seed)
        return (np.array([0]), np.array([12]), np.array([3])) if seed == 0 else right(values, first, seed)

    monkeypatch.setattr(R, "find_runs", wrong_once)
    assert next(R._scan(iter([batch]), False)).column("n_runs").to_pylist() == [0] and seeds == [0, 1]


def test_one_word_a_hundred_thousand_times():
    n = 100_000
    got = R.find_runs(np.full(n, 7, np.uint64), np.array([0, n]))
    assert [x.tolist() for x in got] == [[0], [n], [1]]


# collocations


def collocations_by_hand(rows, longest, least, most):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    for lang, counts in f.items():
        known = {s: a for s, a in counts.items() if len(s) > 1 and a >= least}
        rows = []
        for s, a in known.items():
            inside = [b for t, b in known.items() if len(t) > len(s) and any(t[i : i + len(s)] == s for i in range(len(t)))]
            if all(100 * b < 50 * a for b in inside):
                score, _, left, right = min((10**6 * a * a // (counts[s[:k]] * counts[s[k:]]), k, counts[s[:k]], counts[s[k:]]) for k in range(1, len(s)))
                rows.append((-score, -a, " ".join(s).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:most], 1):
            yield lang, rank, phrase.decode(), -a, left, right, n[lang], -score


@pytest.mark.parametrize("longest, least, most, size", [(3, 10, 2000, C.SLICE), (3, 2, 5, 64), (5, 3, 2000, 300)])
def test_collocations(spark, monkeypatch, longest, least, most, size):
    monkeypatch.setattr(C, "SLICE", size)
    monkeypatch.setattr(C, "INSERT", 50)
    rng = np.random.default_rng(6)
    vocab = ["New", "york", "City", "Ünder", "É", "日本", "a", "of", "the", "x" * 300, " "]
    rows = []
    for i in range(120):
        w = rng.choice(vocab, int(rng.integers(0, 40)), p=[0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.1, 0.1, 0.1, 0.05, 0.05])
        rows.append((["en", "de", None, "und", ""][i % 5], "".join(x + str(rng.choice([" ", "  ", "\t", ", ", ".", "\n", "\x0b", " "])) for x in w)))
    rows += [("en", "New York City. " * 40), ("en", None), ("fr", ""), ("fr", ". ,;"), ("en", rows[0][1]), ("en", "one very long piece of words " * 2000)]
    docs = spark.createDataFrame([(i % 7, t, lang, "p", 1, 2) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, piece string, f int, words int")
    got = sorted(map(tuple, C.collocations(docs, longest, least, most).collect()))
    assert got == sorted(collocations_by_hand(rows, longest, least, most))
    assert C.collocations(docs.limit(0)).count() == 0


def test_scores_stay_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_000_001, 3_000_000_000_007, 9_999_999_999_999
    counts = spark.createDataFrame([("en", "a b", 2, a), ("en", "a", 1, left), ("en", "b", 1, right)], "lang string, phrase string, words int, f long")
    assert [tuple(r) for r in C.scored(counts).collect()] == [("en", "a b", a, left, right, 10**6 * a * a // (left * right))]


def test_parity_refuses_sets_that_are_too_far_apart_and_none_that_link():
    rng = np.random.default_rng(3)
    bits = lambda a, b: int(np.bitwise_count((jaccard.parity(a) ^ jaccard.parity(b)).view(np.uint64)).sum())
    refused = 0
    for _ in range(200):
        base = rng.integers(0, 2**64, 150, np.uint64)
        a, b = (np.unique(np.concatenate([base[rng.random(150) > 0.12], rng.integers(0, 2**64, 12, np.uint64)])) for _ in range(2))
        apart = len(np.setxor1d(a, b))
        assert bits(a, b) <= apart
        most = jaccard.most_apart(len(a), len(b), jaccard.PERCENT)
        assert apart > most
        refused += bits(a, b) > most
    assert refused >= 190  # all of them were candidates before, where they share a first element
    assert bits(a, a) == 0 and not jaccard.parity(np.zeros(0, np.uint64)).any()


def test_texts_of_a_split_are_hashed_together_and_stay_apart(monkeypatch):
    texts = pd.Series(["a b a", "", " \t ", "b" * (1 << 20), "ä b", "a"])
    calls = []
    monkeypatch.setattr(phrases, "words", lambda *x, real=phrases.words: calls.append(1) or real(*x))
    got = [x.tolist() for x in phrases._hashes(texts)]
    a, b = got[0][:2]
    assert [len(x) for x in got] == [3, 0, 0, 1, 2, 1] and got[0] == [a, b, a] and got[4][1] == b and got[5] == [a]
    assert len(calls) < len(texts)
    # a split's texts take longer to scan than a few copies of its automaton would
    assert phrases.SPLIT_BYTES >= 8 * phrases.SHARD_WORDS
