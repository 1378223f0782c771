"""Language model scoring with a hidden Markov model over words.

1. Texts become blocks: documents of about BLOCK_BYTES of text with their words
   numbered inside the block. A row per block and distinct word goes through a
   window by word, which adds up the training counts of the whole corpus; the
   counts go back to the blocks.
2. A word's symbol is the word itself (counts above the TOP-th largest), its
   suffix class (rarer words), RARE (seen once or never) or END. Within a class
   or RARE, words share the symbol's probability by fixed shares that don't
   depend on the state, so every state has a proper distribution over all known
   words, one unknown word and END.
3. Baum-Welch: every task runs scaled forward-backward over its training
   documents and gives expected counts of (state, symbol) and of transitions; these
   are summed across partitions, and only the K * (M + K) sums, a fixed number,
   reach the driver for the next round. Long texts are cut into segments that are
   run side by side; what enters a segment from the left and from the right
   follows from the products of the segments' transition matrices, so the counts
   are those of the whole text.
4. The scaled forward recursion over each whole text gives its likelihood.

Defined results: a null text is empty and has the one token END; a null doc_id
is never held out; repeated rows count and are scored each; without training
tokens the base score is 0; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import SPACES, chunks, mixed, words
from ._scratch import released, written
from .gam import fold_of

STATES = 6
ROUNDS = 4
TOP = 4096
CLASSES = 64
BLOCK_BYTES = 1 << 24
CHUNK_BYTES = 1 << 21
SEGMENT = 1024  #: tokens of a training text that are run together
BATCH_TOKENS = 400_000
END, RARE, FIRST_CLASS, FIRST_TOP = 0, 1, 2, 2 + CLASSES
UNKNOWN_SHARE = 0.5  #: of RARE's probability, for the unknown word
SMOOTHING = 10.0


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, train, text -> blocks (see BLOCK_SCHEMA)."""
    held: list[tuple] = []
    size = seq = 0

    def block() -> pa.RecordBatch:
        nonlocal held, size, seq
        h = np.concatenate([x[0] for x in held])
        kinds = np.concatenate([x[1] for x in held])
        n_words = np.concatenate([x[2] for x in held])
        train = np.concatenate([x[4] for x in held])
        vocab, first, codes = np.unique(h, return_index=True, return_inverse=True)
        used = np.repeat(train, n_words)
        counts = np.bincount(codes[used], minlength=len(vocab))
        number = (TaskContext.get().partitionId() << 24) + seq
        row = [number, pa.concat_arrays([x[3] for x in held]), train.tobytes(), n_words.astype(np.int32).tobytes(), codes.astype(np.int32).tobytes(), vocab.tobytes(), kinds[first].tobytes(), counts.astype(np.int32).tobytes()]
        ids = pa.ListArray.from_arrays(pa.array([0, len(row[1])], pa.int32()), row[1])
        held, size, seq = [], 0, seq + 1
        return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), ids, *[pa.array([x], pa.binary()) for x in row[2:]]], names=BLOCK_NAMES)

    for part in chunks(batches, most=CHUNK_BYTES):
        w = words(part, SPACES, lower=True)
        last = part.data[w.end - 1].astype(np.uint64)
        tail = last * np.uint64(256) + np.where(w.end - w.start > 1, part.data[np.maximum(w.end - 2, 0)], 0).astype(np.uint64)
        kinds = (mixed(tail) % np.uint64(CLASSES)).astype(np.uint8)
        train = part.rows.column("train").to_numpy(zero_copy_only=False).astype(bool)
        held.append((w.hash, kinds, np.diff(w.first), part.rows.column("doc_id").cast(pa.int64()), train))
        size += len(part.data)
        if size >= BLOCK_BYTES:
            yield block()
    if held:
        yield block()


BLOCK_NAMES = ["block", "doc_ids", "train", "n_words", "codes", "vocab", "kinds", "counts"]
BLOCK_SCHEMA = "block long, doc_ids array<long>, train binary, n_words binary, codes binary, vocab binary, kinds binary, counts binary"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block and distinct word: word, block, idx, kind, n."""
    for batch in batches:
        for r in batch.to_pylist():
            vocab = np.frombuffer(r["vocab"], np.int64)
            if len(vocab):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(vocab), pa.array(np.full(len(vocab), r["block"])), pa.array(np.arange(len(vocab), dtype=np.int32)), pa.array(np.frombuffer(r["kinds"], np.uint8).astype(np.int16)), pa.array(np.frombuffer(r["counts"], np.int32).astype(np.int64))],
                    names=["word", "block", "idx", "kind", "n"],
                )


class Vocabulary(NamedTuple):
    """What the whole corpus says about words: at most TOP words and a few sums."""

    n_tokens: int
    n_kinds: int
    n_ends: int
    n_once: int
    cut: int
    top: np.ndarray  #: hashes, ascending
    class_sums: np.ndarray

    def symbols(self, vocab: np.ndarray, c: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each word, and log10 of its share of the symbol."""
        sym, share = FIRST_CLASS + kinds.astype(np.int64), np.ones(len(c))
        middle = (c > 1) & (c <= self.cut)
        share[middle] = c[middle] / self.class_sums[kinds[middle]]
        rare = c <= 1
        sym[rare] = RARE
        unknown = UNKNOWN_SHARE if self.n_once else 1.0
        share[c == 0] = unknown
        share[c == 1] = (1 - unknown) / max(1, self.n_once)
        often = (c > self.cut) & (c > 1)
        sym[often] = FIRST_TOP + np.searchsorted(self.top, vocab[often])
        return sym, np.log10(share)


class Chain(NamedTuple):
    """start[k], move[k, k'], emit[symbol, k]."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def forward(chain: Chain, sym: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """log10 likelihood of each sequence sym[begin : begin + length], all at once."""
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    out = np.zeros(len(begin))
    live = len(begin) - np.searchsorted(length[::-1], np.arange(int(length.max(initial=0))), side="right")
    a = None
    for t, n in enumerate(live):
        a = (chain.start if t == 0 else a[:n] @ chain.move) * chain.emit[sym[begin[:n] + t]]
        total = a.sum(1)
        out[:n] += np.log10(total)
        a /= total[:, None]
    back = np.empty(len(out))
    back[order] = out
    return back


def expected(chain: Chain, sym: np.ndarray, begin: np.ndarray, length: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves, and for every token (its place and) its states.

    ``enter``: the state distribution just before each sequence, of a sum of 0
    where it starts its text; ``leave``: the backward values at its last token.
    """
    k = chain.emit.shape[1]
    order = np.argsort(-length, kind="stable")
    begin, length, enter, leave = begin[order], length[order], enter[order], leave[order]
    fresh = enter.sum(1) == 0
    steps = int(length.max(initial=0))
    live = len(begin) - np.searchsorted(length[::-1], np.arange(steps), side="right")
    alphas, emits, scales = [], [], []
    for t, n in enumerate(live):
        e = chain.emit[sym[begin[:n] + t]]
        a = (np.where(fresh[:, None], chain.start, enter @ chain.move) if t == 0 else alphas[-1][:n] @ chain.move) * e
        total = a.sum(1, keepdims=True)
        a /= total
        alphas.append(a)
        emits.append(e)
        scales.append(total)
    moves = np.zeros((k, k))
    gammas = [None] * steps
    beta = leave.copy()
    for t in range(steps - 1, -1, -1):
        n = live[t]
        more = live[t + 1] if t + 1 < steps else 0
        if more:
            x = emits[t + 1] * beta[:more] / scales[t + 1]
            moves += alphas[t][:more].T @ x
            beta[:more] = x @ chain.move.T
        if more < n:  # those that end here: alpha and beta are to have the product 1
            beta[more:n] /= (alphas[t][more:] * beta[more:n]).sum(1, keepdims=True)
        gammas[t] = alphas[t] * beta[:n]
    if steps:
        moves += (enter[~fresh].T @ (emits[0] * beta / scales[0])[~fresh])
    moves *= chain.move
    first = gammas[0][fresh].sum(0) if steps else np.zeros(k)
    places = np.concatenate([begin[:n] + t for t, n in enumerate(live)]) if steps else np.zeros(0, np.int64)
    return first, moves, places, np.concatenate(gammas) if steps else np.zeros((0, k))


def _products(chain: Chain, sym: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of each segment: the product of its emissions and the moves between them, up to a factor."""
    k = chain.emit.shape[1]
    order = np.argsort(-length, kind="stable")
    b, n_ = begin[order], length[order]
    live = len(b) - np.searchsorted(n_[::-1], np.arange(int(n_.max(initial=0))), side="right")
    m = np.zeros((len(b), k, k))
    for t, n in enumerate(live):
        e = chain.emit[sym[b[:n] + t]][:, None, :]
        m[:n] = np.eye(k) * e if t == 0 else (m[:n] @ chain.move) * e
        m[:n] /= m[:n].sum((1, 2), keepdims=True)
    back = np.empty_like(m)
    back[order] = m
    return back


class Segments(NamedTuple):
    """Pieces of at most SEGMENT tokens of the training texts, with what reaches them from outside."""

    begin: np.ndarray
    length: np.ndarray
    enter: np.ndarray
    leave: np.ndarray


def segments(chain: Chain, sym: np.ndarray, n_tokens: np.ndarray, train: np.ndarray, most: int = SEGMENT) -> Segments:
    begin = np.cumsum(n_tokens) - n_tokens
    b, n = begin[train], n_tokens[train]
    pieces = -(-n // most)
    which = np.repeat(np.arange(len(n)), pieces)
    step = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    out_b, out_n = b[which] + step * most, np.minimum(most, n[which] - step * most)
    k = chain.emit.shape[1]
    enter, leave = np.zeros((len(which), k)), np.ones((len(which), k))
    long = np.flatnonzero(pieces[which] > 1)
    if len(long):
        m = _products(chain, sym, out_b[long], out_n[long])
        at = dict(zip(long.tolist(), m))
        last = np.cumsum(pieces) - 1
        for i in np.flatnonzero(pieces > 1).tolist():
            lo, hi = int(last[i] - pieces[i] + 1), int(last[i])
            a = chain.start
            for j in range(lo, hi):
                a = a @ at[j]
                a = a / a.sum()
                enter[j + 1] = a
                a = a @ chain.move
            v = np.ones(k)
            for j in range(hi, lo, -1):
                v = chain.move @ (at[j] @ v)
                v = v / v.sum()
                leave[j - 1] = v
    return Segments(out_b, out_n, enter, leave)


def _batches(begin: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of sequences, BATCH_TOKENS at a time, like lengths together."""
    order = np.argsort(length, kind="stable")
    part = np.cumsum(length[order]) // BATCH_TOKENS
    for x in np.split(order, np.flatnonzero(np.diff(part)) + 1):
        if len(x):
            yield x


CODED = "doc_ids array<long>, train binary, n_tokens binary, sym binary, n_known binary, base binary, share binary"


def _coder(vocabulary, end_known: bool):
    def code(found: pa.Table, block: pa.Table) -> pa.Table:
        v: Vocabulary = vocabulary.value
        rows = []
        for r in block.to_pylist():
            vocab, kinds = np.frombuffer(r["vocab"], np.int64), np.frombuffer(r["kinds"], np.uint8)
            c = np.zeros(len(vocab), np.int64)
            c[found.column("idx").to_numpy()] = found.column("c").to_numpy()
            sym, share = v.symbols(vocab, c, kinds)
            n_words, codes = np.frombuffer(r["n_words"], np.int32).astype(np.int64), np.frombuffer(r["codes"], np.int32)
            n_tokens = n_words + 1
            ends = np.cumsum(n_tokens) - 1
            out = np.full(int(n_tokens.sum()), END, np.uint16)
            at = np.ones(len(out), bool)
            at[ends] = False
            out[at] = sym[codes]
            row = np.repeat(np.arange(len(n_words)), n_words)
            lower = 0.1 * (v.n_kinds + 1) + v.n_tokens
            base = np.log10((c + 0.1) / lower)
            per = [np.bincount(row, x[codes], len(n_words)) for x in ((c > 0).astype(float), base, share)]
            rows.append({"doc_ids": r["doc_ids"], "train": r["train"], "n_tokens": n_tokens.tobytes(), "sym": out.tobytes(), "n_known": (per[0].astype(np.int64) + int(end_known)).tobytes(), "base": (per[1] + np.log10((v.n_ends + 0.1) / lower)).tobytes(), "share": per[2].tobytes()})
        return pa.Table.from_pylist(rows, schema=_CODED_ARROW)

    return code


_CODED_ARROW = pa.schema([("doc_ids", pa.list_(pa.int64())), *[(x, pa.binary()) for x in ("train", "n_tokens", "sym", "n_known", "base", "share")]])


def _counter(chain):
    """Expected counts of a task's blocks as rows kind, i, j, v."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Chain = chain.value
        m, k = c.emit.shape
        total = [np.zeros((1, k)), np.zeros((k, k)), np.zeros((m, k))]
        for batch in batches:
            for r in batch.select(["train", "n_tokens", "sym"]).to_pylist():
                sym = np.frombuffer(r["sym"], np.uint16).astype(np.int64)
                s = segments(c, sym, np.frombuffer(r["n_tokens"], np.int64), np.frombuffer(r["train"], bool))
                for x in _batches(s.begin, s.length):
                    first, moves, places, gamma = expected(c, sym, s.begin[x], s.length[x], s.enter[x], s.leave[x])
                    total[0] += first
                    total[1] += moves
                    total[2] += np.column_stack([np.bincount(sym[places], gamma[:, j], m) for j in range(k)])
        for kind, x in enumerate(total):
            i, j = np.nonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), kind, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(x[i, j])], names=["kind", "i", "j", "v"])

    return count


def train_chain(coded: DataFrame, n_symbols: int, counts: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Chain:
    """Baum-Welch from a fixed start; counts: occurrences per symbol in training."""
    spark = coded.sparkSession
    overall = counts + 0.5 * np.isin(np.arange(n_symbols), (END, RARE))
    overall = overall / overall.sum()
    rng = np.random.default_rng(7)
    emit = overall[:, None] * (0.5 + rng.random((n_symbols, states)))
    chain = Chain(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(0))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(chain)  # n_symbols * states numbers, at most (TOP + CLASSES + 2) * STATES
        rows = coded.mapInArrow(_counter(shared), "kind int, i int, j int, v double").groupBy("kind", "i", "j").agg(F.sum("v").alias("v"))
        first, moves, emitted = np.zeros((1, states)), np.zeros((states, states)), np.zeros((n_symbols, states))
        got = rows.toPandas()
        for kind, m in enumerate((first, moves, emitted)):
            own = got[got["kind"] == kind]
            m[own["i"].to_numpy(), own["j"].to_numpy()] = own["v"].to_numpy()
        emitted += SMOOTHING * overall[:, None]
        moves += 1.0 / states
        first += 1.0 / states
        chain = Chain(first[0] / first.sum(), moves / moves.sum(1, keepdims=True), emitted / emitted.sum(0))
        shared.unpersist()
    return chain


def score_texts(docs: DataFrame, is_train, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score per row of docs (doc_id, text).

    ``is_train`` is a condition that marks the training documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(is_train, F.lit(True)).alias("train"), F.col("text"))
    blocks = written(rows.mapInArrow(_blocks, BLOCK_SCHEMA), "hmm-blocks")
    entries = blocks.select("block", "vocab", "kinds", "counts").mapInArrow(_entries, "word long, block long, idx int, kind short, n long")
    same = Window.partitionBy("word")
    counted = entries.withColumn("c", F.sum("n").over(same)).withColumn("lead", F.col("block") == F.min("block").over(same))
    counted = written(counted.select("word", "block", "idx", "kind", "c", "lead"), "hmm-counts")
    kinds = counted.filter(F.col("lead") & (F.col("c") > 0))
    largest = kinds.filter(F.col("c") > 1).orderBy(F.col("c").desc(), "word").limit(TOP).select("word", "c").toPandas()
    cut = int(largest["c"].min()) if len(largest) == TOP else 1
    top = np.sort(largest["word"][largest["c"] > cut].to_numpy(np.int64))
    per = kinds.withColumn("part", F.when(F.col("c") == 1, -1).when(F.col("c") > cut, -2).otherwise(F.col("kind"))).groupBy("part").agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()
    sums = np.zeros(CLASSES)
    for r in per:
        if r["part"] >= 0:
            sums[r["part"]] = r["c"]
    n_ends = rows.filter("train").count()
    once = sum(r["n"] for r in per if r["part"] == -1)
    v = Vocabulary(sum(r["c"] for r in per) + n_ends, sum(r["n"] for r in per) + (n_ends > 0), n_ends, once, cut, top, sums)
    counts = np.concatenate([[n_ends, once], sums, largest.set_index("word")["c"].reindex(top).to_numpy(float) if len(top) else np.zeros(0)])
    shared = spark.sparkContext.broadcast(v)  # at most TOP hashes and CLASSES sums
    coded = counted.select("block", "idx", "c").groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(_coder(shared, n_ends > 0), CODED)
    coded = written(coded, "hmm-coded")
    released(blocks, counted)
    chain = train_chain(coded, len(counts), counts, states, rounds)
    model = spark.sparkContext.broadcast(chain)
    train_tokens = int(v.n_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sym = np.frombuffer(r["sym"], np.uint16).astype(np.int64)
                length = np.frombuffer(r["n_tokens"], np.int64)
                begin = np.cumsum(length) - length
                n = len(length)
                total = forward(model.value, sym, begin, length) + np.frombuffer(r["share"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(length), pa.array(np.frombuffer(r["n_known"], np.int64)), pa.array(np.full(n, train_tokens)), pa.array(np.frombuffer(r["base"])), pa.array(total)],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return coded.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_hmm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_texts(docs, fold_of(F.col("doc_id"), 10) != 0)
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
