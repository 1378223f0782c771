"""Byte-level dedup against brute force."""

import hashlib

import numpy as np
import pytest

from sessionlake.llm import parsing
from sessionlake.llm.parsing import remove_repeated_bytes


def brute(rows, size):
    first = {}
    for doc, raw in rows:
        for i in range(len(raw) - size + 1):
            s = raw[i : i + size]
            first[s] = min(first.get(s, doc), doc)
    for doc, raw in rows:
        hit = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - size + 1):
            if first[raw[i : i + size]] < doc:
                hit[i : i + size] = 1
        kept = bytes(b for b, h in zip(raw, hit) if not h)
        yield doc, len(raw), int(hit.sum()), int((np.diff(np.r_[0, hit]) == 1).sum()), hashlib.sha256(kept).hexdigest()


def test_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    text = lambda n: "".join(rng.choice(list("abcé "), n))
    a, b = text(400), text(300)
    texts = [a, b, a, a[:150] + "X" + a[151:], text(60) + b[100:180] + text(60) + a[200:260], None, "", "z" * 300, "z" * 120, a[10:59], b[::-1], a[120:180] + b[50:99] + a[30:90]]
    rows = [(i * 3 % 37, t, "q") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(tuple(r)[:5] for r in remove_repeated_bytes(df).collect())
    assert got == sorted(brute([(i, (t or "").encode()) for i, t, _ in rows], 50))
    assert remove_repeated_bytes(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot, wide, part", [(2, 20_000, 1 << 18), (2, 1, 64), (4096, 1, 1 << 18)])
def test_hot_and_wide_triggers(spark, monkeypatch, hot, wide, part):
    for name, value in (("HOT", hot), ("WIDE", wide), ("PART", part)):
        monkeypatch.setattr(parsing, name, value)
    rng = np.random.default_rng(12)
    text = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    shared, other = text(70), text(200)
    rows = [(int(i), text(int(rng.integers(0, 80))) + (shared if i % 3 else other[: 40 + i]) + text(20) + shared[: 50 + i % 9]) for i in rng.permutation(40)]
    rows += [(5, other), (41, other + shared)]
    got = sorted(tuple(r)[:5] for r in remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute([(i, t.encode()) for i, t in rows], 50))


def test_passage_repeated_in_its_smallest_document(spark):
    rng = np.random.default_rng(8)
    text = lambda n: "".join(rng.choice(list("abcdef"), n))
    a, b, c, d, e = (text(100) for _ in range(5))
    s, long = text(60), text(150)
    rows = [(1, a + s + b + long), (2, c + s + d + c + s + d), (3, e + long + d + e + long + d), (3, "x" + e + long + d), (4, c + s + d)]
    got = sorted(tuple(r)[:5] for r in remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute([(i, t.encode()) for i, t in rows], 50))
