"""Quality classifier: a generalised additive model with pairwise interactions.

Per-feature lookup tables over quantile bins are learned by cyclic boosting:
each round fits, feature by feature, a tree of at most LEAVES leaves to the
logistic gradients' histogram and adds a small step of it to the table. The
PAIRS pairs of features whose residual histograms gain most then get
two-dimensional tables, boosted likewise with trees of two cuts. Scoring looks
up one number per table and adds them, whole batches at a time.

The model is fitted on at most MAX_TRAIN labelled rows, those first in a hash
order of doc_id; that bound is the parameter ``max_train``. Features come from
the whole text alone.

Defined results: a null text counts as empty; an empty text has a score as any
other; with no usable label every score is 0.5; labels of a repeated doc_id are
averaged; null labels and labels of a null doc_id aren't used; repeated
documents are scored row by row; an empty table gives no rows; other columns
are passed through.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import SPACES, Texts, chunks, words

MAX_TRAIN = 20_000
BINS = 32
COARSE = 8
ROUNDS = 150
RATE = 0.1
LEAVES = 3
PAIRS = 6
THRESHOLD = 0.7

FEATURES = (
    "log_words", "mean_word", "log_longest", "upper", "digits", "symbols", "main_symbol", "non_ascii", "stops",
    "line_words", "repeated_lines", "distinct_words", "main_word", "adjacent_repeats", "marked_words",
)

_LINES = np.zeros(256, bool)
_LINES[[10, 13]] = True
_UPPER, _DIGIT, _SYMBOL, _HIGH, _STOP = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = _DIGIT[48:58] = _HIGH[128:] = True
_SYMBOL[[x for x in range(33, 127) if not chr(x).isalnum()]] = True
_STOP[[ord(x) for x in ".?!"]] = True


def _runs(h: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: distinct values, and how often the commonest occurs."""
    distinct, most = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
    if len(h):
        order = np.lexsort((h, row))
        a, r = h[order], row[order]
        begin = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (r[1:] != r[:-1])])
        length, owner = np.diff(np.r_[begin, len(a)]), r[begin]
        distinct = np.bincount(owner, minlength=n_rows)
        edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        most[owner[edge]] = np.maximum.reduceat(length, edge)
    return distinct, most


def features(part: Texts) -> np.ndarray:
    """One row of FEATURES per text."""
    n = part.rows.num_rows
    data, off = part.data, part.offsets

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[off]).astype(float)

    w, lines = words(part, SPACES), words(part, _LINES)
    n_words, n_lines = np.diff(w.first), np.diff(lines.first)
    row = np.repeat(np.arange(n), n_words)
    line_row = np.repeat(np.arange(n), n_lines)
    size = np.maximum(1, np.diff(off)).astype(float)
    some = np.maximum(1, n_words).astype(float)
    length = w.end - w.start
    longest = np.zeros(n)
    if len(length):
        at = np.flatnonzero(n_words)
        longest[at] = np.maximum.reduceat(length, w.first[at])
    symbol = per_row(_SYMBOL[data])
    where = np.flatnonzero(_SYMBOL[data])
    main = _runs(data[where], np.searchsorted(off, where, side="right") - 1, n)[1]
    distinct, common = _runs(w.hash, row, n)
    line_kinds = _runs(lines.hash, line_row, n)[0]
    again = np.zeros(len(row), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])
    marked = _SYMBOL[data[w.end - 1]] & (data[w.end - 1] != 46) & (data[w.end - 1] != 44) if len(row) else again
    return np.column_stack([
        np.log1p(n_words), np.bincount(row, length, n) / some, np.log1p(longest), per_row(_UPPER[data]) / size, per_row(_DIGIT[data]) / size,
        symbol / size, main / size, per_row(_HIGH[data]) / size, per_row(_STOP[data]) / some, n_words / np.maximum(1, n_lines),
        1 - line_kinds / np.maximum(1, n_lines), distinct / some, common / some, np.bincount(row, again, n) / some, np.bincount(row, marked, n) / some,
    ])


class Model(NamedTuple):
    cuts: list[np.ndarray]  #: per feature, ascending inner bin edges
    coarse: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            z += table[np.searchsorted(self.cuts[f], x[:, f], side="right")]
        for a, b, table in self.pairs:
            z += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf value per bin: greedy cuts of the histogram that gain most."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for i, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gt, ht = g[a:b].sum(), h[a:b].sum()
            gain = _gain(gl, hl) + _gain(gt - gl, ht - hl) - _gain(gt, ht)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), i, a + k + 1)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best tree of one cut in each direction: its gain and the value per cell."""
    G, H = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    r, c = G.shape
    best = (0.0, np.zeros_like(g))
    if r < 2 or c < 2:
        return best

    def four(m):
        ul = m[:-1, :-1]
        top, left = m[:-1, -1:], m[-1:, :-1]
        return ul, top - ul, left - ul, m[-1, -1] - top - left + ul

    quarters = list(zip(four(G), four(H)))
    gain = sum(_gain(x, y) for x, y in quarters) - _gain(G[-1, -1], H[-1, -1])
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros_like(g)
    v = [x[i, j] / (y[i, j] + 1.0) for x, y in quarters]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Model:
    """x: rows of features; y: labels from 0 to 1."""
    n, d = len(x), len(FEATURES)
    if not n:
        return Model([np.zeros(0)] * d, [np.zeros(0)] * d, 0.0, [np.zeros(1)] * d, [])
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(d)]
    # rare junk sits in the tails: finer cuts there
    cuts = [np.unique(np.r_[c, np.quantile(x[:, f], [0.002, 0.005, 0.01, 0.99, 0.995, 0.998])]) for f, c in enumerate(cuts)]
    coarse = [np.unique(np.quantile(x[:, f], np.r_[np.linspace(0, 1, COARSE + 1)[1:-1], 0.02, 0.98])) for f in range(d)]
    bins = [np.searchsorted(cuts[f], x[:, f], side="right") for f in range(d)]
    rough = [np.searchsorted(coarse[f], x[:, f], side="right") for f in range(d)]
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    intercept = float(np.log(mean / (1 - mean)))
    z = np.full(n, intercept)
    tables = [np.zeros(len(c) + 1) for c in cuts]

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(d):
            g, h = residual()
            m = len(tables[f])
            step = RATE * _tree(np.bincount(bins[f], g, m), np.bincount(bins[f], h, m), LEAVES)
            tables[f] += step
            z += step[bins[f]]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        ra, rb = len(coarse[a]) + 1, len(coarse[b]) + 1
        return np.bincount(rough[a] * rb + rough[b], v, ra * rb).reshape(ra, rb)

    g, h = residual()
    ranked = sorted(combinations(range(d), 2), key=lambda ab: -_cross(grid(*ab, g), grid(*ab, h))[0])[:PAIRS]
    pairs = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for a, b in ranked]
    for _ in range(rounds // 2):
        for a, b, table in pairs:
            g, h = residual()
            step = RATE * _cross(grid(a, b, g), grid(a, b, h))[1]
            table += step
            z += step[rough[a], rough[b]]
    return Model(cuts, coarse, intercept, tables, pairs)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """labels: doc_id, y. Fits on the max_train labelled rows first in hash order."""
    picked = labels.filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("y").alias("y"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def measure(batches):
        for part in chunks(batches):
            cols = features(part)
            yield pa.RecordBatch.from_arrays([part.rows.column("y"), pa.array(list(cols), pa.list_(pa.float64()))], names=["y", "x"])

    # at most max_train rows of two numbers are broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("y", "text")
    # rows of one doc_id may be many: the first max_train by their features count
    got = found.mapInArrow(measure, "y double, x array<double>").orderBy("x", "y").limit(max_train).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    order = np.lexsort([*x.T, got["y"].to_numpy()])  # rows arrive in any order; the sums must not
    return fit(x[order], got["y"].to_numpy()[order])


def score(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """docs' columns (text only with keep_text) and score."""
    passed = [c for c in docs.columns if c != "score" and (keep_text or c != "text")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some tables of a few hundred numbers

    def run(batches):
        for part in chunks(batches):
            cols = [part.rows.column(c) for c in passed]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(shared.value.score(features(part)))], names=[*passed, "score"])

    asked = passed if "text" in passed else [*passed, "text"]
    return docs.select(*asked).mapInArrow(run, T.StructType([*[docs.schema[c] for c in passed], T.StructField("score", T.DoubleType())]))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def quality_model(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns labels.quality from all folds but number 2 of 4."""
    return train(docs, labels.filter(fold_of(F.col("doc_id"), 4) != 2).select("doc_id", F.col("quality").cast("double").alias("y")))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
