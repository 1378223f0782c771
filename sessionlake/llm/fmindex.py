"""Benchmark decontamination with an FM-index per shard of training documents.

A shard is a run of documents as a task reads them, SHARD_BYTES of text or
SHARD_SYMBOLS symbols. Words are numbered by the benchmark's vocabulary; any
other word parts segments, and segments shorter than the shortest window are
left out, since no window fits in them. Over the rest the shard builds a suffix
array, its Burrows-Wheeler transform and a wavelet matrix. All windows of the
benchmark are searched backward at once; occurrences are located by walking to
the next sampled suffix position, and their word ranges merge to the spans to
be removed. Documents are never shuffled.

The benchmark goes through in blocks of BLOCK_BYTES, so what is broadcast has a
fixed bound whatever the benchmark's size.

Defined results: null texts have no words; items without words have no window;
an item with a null id hits words but isn't listed; repeated items count once
per id; repeated documents are rows of their own; an empty benchmark hits
nothing; columns other than those named are passed through, unless they are
called as a result column, then the result takes the name.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import NON_ALNUM, Texts, chunks, words

WINDOW = 10
SHARD_BYTES = 1 << 26
SHARD_SYMBOLS = 1 << 20
CHUNK_BYTES = 1 << 22
BLOCK_BYTES = 1 << 22
SAMPLE = 8


def suffix_array(t: np.ndarray) -> np.ndarray:
    """By prefix doubling; t must end with its unique smallest symbol."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        key = rank * np.int64(n + 1)
        key[: n - k] += rank[k:] + 1
        sa = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        ordered = key[sa]
        fresh[sa] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        rank = fresh
        if rank[sa[-1]] == n - 1:
            return sa
        k *= 2


class WaveletMatrix:
    """Ranks in a sequence of small integers, for many queries at once."""

    def __init__(self, seq: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for b in range(self.bits - 1, -1, -1):
            bit = (seq >> b) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[j] occurs before position i[j]."""
        lo, hi = np.zeros(len(c), np.int64), i.astype(np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            one = (c >> b) & 1 == 1
            ones, zeros = self.ones[level], self.zeros[level]
            a, z = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + z, hi - z)
        return hi - lo


class FMIndex:
    """Over t, whose last symbol is 0 and occurs nowhere else."""

    def __init__(self, t: np.ndarray):
        sa = suffix_array(t)
        self.n, self.top = len(t), int(t.max())
        self.bwt = t[sa - 1]
        self.tree = WaveletMatrix(self.bwt, self.top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=self.top + 1))])
        self.sampled = sa % SAMPLE == 0
        self.place = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of patterns (one a row, symbols >= 1, 0 pads on the left)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for col in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, col]
            known = c <= self.top
            lo[live[~known]] = hi[live[~known]] = 0
            go = live[known & (c > 0)]
            c = patterns[go, col]
            base = self.before[c]
            lo[go], hi[go] = base + self.tree.rank(c, lo[go]), base + self.tree.rank(c, hi[go])
            live = live[hi[live] > lo[live]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        out, step, row, todo = np.zeros(len(rows), np.int64), 0, rows.copy(), np.arange(len(rows))
        while len(todo):
            hit = self.sampled[row]
            out[todo[hit]] = self.samples[self.place[row[hit]]] + step
            todo, row = todo[~hit], row[~hit]
            c = self.bwt[row]
            row = self.before[c] + self.tree.rank(c, row)
            step += 1
        return out


class _Block:
    """The windows of some benchmark items: symbols, patterns and whose they are."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        text = pa.RecordBatch.from_arrays([pa.array([x[1] or "" for x in items], pa.large_string())], names=["text"])
        found: dict[tuple[int, ...], set[str]] = defaultdict(set)
        vocabulary: list[np.ndarray] = []
        at = 0
        for part in chunks(iter([text]), most=CHUNK_BYTES):
            w = words(part, NON_ALNUM, lower=True)
            vocabulary.append(w.hash)
            for i in range(part.rows.num_rows):
                own = w.hash[w.first[i] : w.first[i + 1]]
                for j in range(max(1, len(own) - window + 1)) if len(own) else ():
                    found[tuple(own[j : j + window].tolist())] |= {items[at + i][0]} - {None}
            at += part.rows.num_rows
        self.vocabulary = np.unique(np.concatenate(vocabulary)) if vocabulary else np.zeros(0, np.uint64)
        self.items = [sorted(x) for x in found.values()]
        self.lengths = np.array([len(x) for x in found], np.int64)
        self.patterns = np.zeros((len(found), window), np.int64)
        for i, x in enumerate(found):
            self.patterns[i, window - len(x) :] = np.searchsorted(self.vocabulary, np.array(x, np.uint64)) + 2
        self.shortest = int(self.lengths.min()) if len(found) else 0

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """2 and up for words of the vocabulary, 1 for any other."""
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == h, at + 2, 1) if len(self.vocabulary) else np.ones(len(h), np.int64)


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("kept_text", T.StringType()),
])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of [start, end) ranges as disjoint ranges that don't touch."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


class _Shard:
    """Documents gathered until their index is worth building."""

    def __init__(self, block: _Block):
        self.block, self.parts, self.held, self.size, self.n_symbols = block, [], [], 0, 0

    def add(self, part: Texts) -> None:
        w = words(part, NON_ALNUM, lower=True)
        sym = self.block.symbols(w.hash)
        row = np.repeat(np.arange(part.rows.num_rows), np.diff(w.first))
        good = sym > 1
        edge = np.r_[True, (good[1:] != good[:-1]) | (row[1:] != row[:-1])] if len(good) else np.zeros(0, bool)
        begin = np.flatnonzero(edge)
        length = np.diff(np.r_[begin, len(good)])
        use = good[begin] & (length >= max(1, self.block.shortest))
        begin, length = begin[use], length[use]
        if len(begin):
            # each segment is followed by one separator
            total = int(length.sum()) + len(length)
            starts = np.cumsum(length + 1) - length - 1
            word = np.ones(total, np.int64)
            word[0] = begin[0]
            word[starts[1:]] = begin[1:] - (begin[:-1] + length[:-1])
            word = np.cumsum(word)
            text = sym[np.minimum(word, len(sym) - 1)]
            text[starts + length] = 1
            self.held.append((len(self.parts), text, word))
            self.n_symbols += total
        self.parts.append((part, w))
        self.size += len(part.data)

    def full(self) -> bool:
        return self.size >= SHARD_BYTES or self.n_symbols >= SHARD_SYMBOLS

    def hits(self) -> dict[tuple[int, int], tuple[list[tuple[int, int]], set[str]]]:
        """(part, row) -> word ranges and items, for the rows that have any."""
        out: dict[tuple[int, int], tuple[list[tuple[int, int]], set[str]]] = {}
        if not self.held:
            return out
        index = FMIndex(np.concatenate([*[x[1] for x in self.held], [0]]))
        lo, hi = index.search(self.block.patterns)
        which = np.repeat(np.arange(len(lo)), hi - lo)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which]
        at = index.locate(rows)
        ends = np.cumsum([len(x[1]) for x in self.held])
        for p, pos in zip(which.tolist(), at.tolist()):
            k = int(np.searchsorted(ends, pos, side="right"))
            part, _, word = self.held[k]
            first = int(word[pos - (ends[k - 1] if k else 0)])
            starts = self.parts[part][1].first
            row = int(np.searchsorted(starts, first, side="right")) - 1
            spans, items = out.setdefault((part, row), ([], set()))
            spans.append((first - int(starts[row]), first - int(starts[row]) + int(self.block.lengths[p])))
            items.update(self.block.items[p])
        return out

    def flush(self, keep_text: bool, passed: list[str]) -> Iterator[pa.RecordBatch]:
        found = self.hits()
        for k, (part, w) in enumerate(self.parts):
            n = part.rows.num_rows
            n_words = np.diff(w.first)
            before = {x: part.rows.column(x).to_pylist() for x in ("spans", "items") if x in part.rows.schema.names}
            spans_out, items_out, n_hit, texts = [], [], np.zeros(n, np.int64), []
            raw = part.rows.column("text") if keep_text else None
            for i in range(n):
                spans, items = found.get((k, i), ([], set()))
                if before:
                    spans = spans + list(zip(before["spans"][i][::2], before["spans"][i][1::2]))
                    items = items | set(before["items"][i])
                spans = merged(spans)
                spans_out.append([x for span in spans for x in span])
                items_out.append(sorted(items))
                n_hit[i] = sum(e - s for s, e in spans)
                if keep_text:
                    texts.append(self._cut(part, w, i, spans) if spans else raw[i].as_py())
            cols = [part.rows.column(c) for c in passed]
            cols += [pa.array(n_words, pa.int64()), pa.array(n_hit), pa.array(spans_out, pa.list_(pa.int32())), pa.array(items_out, pa.list_(pa.string())), pa.array(texts if keep_text else [None] * n, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*passed, *RESULT.names])
        self.parts, self.held, self.size, self.n_symbols = [], [], 0, 0

    @staticmethod
    def _cut(part: Texts, w, i: int, spans: list[tuple[int, int]]) -> str:
        """The row's text without the bytes from a span's first word to its last."""
        base, at, kept = int(w.first[i]), int(part.offsets[i]), []
        for s, e in spans:
            kept.append(part.data[at : w.start[base + s]].tobytes())
            at = int(w.end[base + e - 1])
        kept.append(part.data[at : part.offsets[i + 1]].tobytes())
        return b"".join(kept).decode()


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str | None, str | None]]]:
    """Items in lists of at most BLOCK_BYTES of text (or one item)."""
    rows = benchmark.select(F.col("item_id").cast("string"), "text").filter(F.col("text").isNotNull())
    held, size = [], 0
    for item, text in rows.toLocalIterator():
        held.append((item, text))
        size += len(text)
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """docs' columns but text, and n_words, n_hit, spans, items, kept_text.

    ``spans`` lists the hit word ranges as start, end, start, end, ...;
    ``items`` the ids, as strings, of items with an occurring window;
    ``kept_text`` (with ``keep_text``) is the text without its hit ranges.
    """
    spark: SparkSession = docs.sparkSession
    passed = [c for c in docs.columns if c != "text" and c not in RESULT.names]
    out, many = docs.select(*passed, "text"), None
    blocks = _blocks(benchmark)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        shared = spark.sparkContext.broadcast(_Block(block, window))
        last = following is None
        carried = passed if last else [*passed, "text"]
        schema = T.StructType([docs.schema[c] for c in carried] + RESULT.fields)

        def scan(batches, shared=shared, carried=carried, cut=keep_text and last):
            shard = _Shard(shared.value)
            for part in chunks(batches, most=CHUNK_BYTES):
                shard.add(part)
                if shard.full():
                    yield from shard.flush(cut, carried)
            yield from shard.flush(cut, carried)

        out = out.select(*passed, "text", *(many or [])).mapInArrow(scan, schema)
        block, many = following, ["spans", "items"]
    return out


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
o AS (SELECT dw.r, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
h AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM o) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM o GROUP BY r)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.s, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
