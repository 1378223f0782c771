"""Substring dedup by automata of repeated phrases.

A passage is ``window`` consecutive words; the words of every passage that
occurs twice or more, anywhere, are to go.

1. Anchors. Of the ANCHOR-word runs inside a window, the one of least hash is
   its anchor. Equal windows have equal anchors, so only anchors that occur
   twice can belong to a recurring window. An anchor's context is the stretch
   of text that its windows cover.
2. Confirmation. A context that occurs twice is recurring as a whole. Where an
   anchor also has contexts that occur once (the edges of a copy), the single
   windows of all its contexts are counted.
3. Automata. Each confirmed phrase, a context or a maximal run of confirmed
   windows in a single context, is a pattern of words. Patterns are dealt into
   shards by the text that they are cut from; a shard's pyahocorasick automaton
   reads words as symbols, and a match is compared by a 64-bit hash of its words.
4. Location. Every text that holds a recurring anchor streams through the shards
   that its anchors name, other texts can't hold a phrase; the matches' words
   are what is removed.

Counts are partial sums before any shuffle. A shard whose texts hold many bytes
is split by text, with a copy of its patterns for each split, so that a passage in
a third of all documents fills no task.

Defined results: a null text has no words; texts shorter than a window lose
nothing; null and repeated doc_ids are rows of their own, since texts are
known by their content; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import SPACES, _powers, chunks, mixed, rolling, window_min, words
from ._scratch import released, written
from .fmindex import merged

WINDOW = 35
CHUNK = 1 << 21  #: text bytes whose anchors are counted together before the shuffle
ANCHOR = 8
SHARD_WORDS = 400_000  #: pattern words of a shard, about
SPLIT_BYTES = 1 << 23  #: text of a split of a shard, about; it takes about as long to scan as the shard's automaton to build


def _anchored(h: np.ndarray, row: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and last window of every run of windows with one anchor.

    ``row`` says which text a word is of; windows never leave their text.
    """
    n = len(h) - window + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    run = rolling(h, k)
    low = np.uint64(0xFFFFFFFF)
    # the leftmost of the least hashes: places break ties
    least = window_min((run & ~low) | np.arange(len(run), dtype=np.uint64), window - k + 1)
    at = (least & low).astype(np.int64)
    inside = row[:n] == row[window - 1 :]
    fresh = np.r_[True, (at[1:] != at[:-1]) | (row[1:n] != row[: n - 1])]
    begin = np.flatnonzero(fresh & inside)
    count = np.add.reduceat(inside, np.flatnonzero(fresh))[inside[np.flatnonzero(fresh)]]
    return at[begin], begin, begin + count - 1


def _profile(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    """One row per document: its key, word count, kept digest and anchors."""
    for part in chunks(batches, most=CHUNK):
        w = words(part, SPACES)
        n_words = np.diff(w.first)
        row = np.repeat(np.arange(len(n_words)), n_words)
        at, begin, end = _anchored(w.hash, row, window, k)
        fp = rolling(w.hash, k)[at] if len(at) else np.zeros(0, np.uint64)
        ctx = _span_hash(w.hash, begin, end + window)
        base = w.first[row[begin]] if len(at) else begin
        cols = {"fp": fp, "ctx": ctx, "start": (begin - base).astype(np.int32), "stop": (end + window - base).astype(np.int32)}
        edges = np.searchsorted(begin, w.first)
        out: dict[str, list] = {x: [] for x in ("tk", "digest", *cols)}
        for i in range(len(n_words)):
            raw = part.data[part.offsets[i] : part.offsets[i + 1]].tobytes()
            out["tk"].append(xxhash.xxh3_128_digest(raw))
            out["digest"].append(hashlib.sha256(b" ".join(raw.split())).digest())
            for x, v in cols.items():
                out[x].append(v[edges[i] : edges[i + 1]].tobytes())
        yield pa.RecordBatch.from_arrays([part.rows.column("doc_id"), pa.array(n_words, pa.int64()), *[pa.array(x, pa.binary()) for x in out.values()]], names=["doc_id", "n_words", *out])


def _span_hash(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64 bits of the values h[start:stop], for each pair."""
    power, inverse = _powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=total[1:])
    return mixed((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64))


def _flat(batches: Iterator[pa.RecordBatch], full: bool) -> Iterator[pa.RecordBatch]:
    """The anchors of the profiles as rows: fp, n, or fp, ctx, tk, start, stop."""
    for batch in batches:
        blobs = {x: batch.column(x).to_pylist() for x in batch.schema.names if x != "tk"}
        fp = np.frombuffer(b"".join(blobs["fp"]), np.int64)
        if not full:
            value, n = np.unique(fp, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n.astype(np.int64))], names=["fp", "n"])
            continue
        each = np.array([len(x) // 8 for x in blobs["fp"]], np.int64)
        tk = batch.column("tk").take(pa.array(np.repeat(np.arange(len(each)), each)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(fp), pa.array(np.frombuffer(b"".join(blobs["ctx"]), np.int64)), tk, *[pa.array(np.frombuffer(b"".join(blobs[x]), np.int32)) for x in ("start", "stop")]],
            names=["fp", "ctx", "tk", "start", "stop"],
        )


def _single_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Windows of the contexts asked for: wh, wh2 (128 bits of each), n, sure, tk, start."""
    for part in chunks(batches, most=CHUNK):
        w = words(part, SPACES)
        rows = part.rows.select(["tk", "asked"]).to_pylist()
        wh, wh2, n, sure, tk, start = [], [], [], [], [], []
        for i, r in enumerate(rows):
            if not r["asked"]:
                continue
            own = w.hash[w.first[i] : w.first[i + 1]]
            all_, other = rolling(own, window).view(np.int64), rolling(mixed(own), window).view(np.int64)
            for x in r["asked"]:
                at = np.arange(x["start"], x["stop"] - window + 1)
                wh.append(all_[at])
                wh2.append(other[at])
                start.append(at)
                n += [x["n"]] * len(at)
                tk += [r["tk"]] * len(at)
        sure = [x > 1 for x in n]
        if wh:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(wh)), pa.array(np.concatenate(wh2)), pa.array(n, pa.int64()), pa.array(sure), pa.array(tk, pa.binary()), pa.array(np.concatenate(start).astype(np.int32))], names=["wh", "wh2", "n", "sure", "tk", "start"])


_RANGE = 0x110000 - 0x800


def _as_symbols(h: np.ndarray) -> str:
    """One code point per word, by hash, leaving out surrogates."""
    x = (h % np.uint64(_RANGE)).astype(np.uint32)
    x[x >= 0xD800] += 0x800
    return x.astype("<u4").tobytes().decode("utf-32-le")


def _cut_patterns(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """tk, words: the hashes of the words of each phrase, as bytes."""
    for part in chunks(batches, most=CHUNK):
        w = words(part, SPACES)
        tk, out = [], []
        for i, r in enumerate(part.rows.select(["tk", "whole", "starts"]).to_pylist()):
            h = w.hash[w.first[i] : w.first[i + 1]]
            spans = [(x["start"], x["stop"]) for x in r["whole"] or []]
            single = sorted(set(r["starts"] or []))
            j = 0
            while j < len(single):
                last = j
                while last + 1 < len(single) and single[last + 1] == single[last] + 1:
                    last += 1
                spans.append((single[j], single[last] + window))
                j = last + 1
            for s, e in spans:
                tk.append(r["tk"])
                out.append(h[s:e].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(tk, pa.binary()), pa.array(out, pa.binary())], names=["tk", "words"])


def locate(patterns: list[np.ndarray], texts: Iterator[np.ndarray]) -> Iterator[list[tuple[int, int]]]:
    """Merged word ranges of all occurrences of the patterns in each text (word hashes)."""
    automaton = ahocorasick.Automaton()
    for h in patterns:
        key = _as_symbols(h)
        known = automaton.get(key, None)
        value = (len(h), int(_span_hash(h, np.array([0]), np.array([len(h)]))[0]))
        if known is None:
            automaton.add_word(key, [value])
        elif value not in known:
            known.append(value)
    if not len(automaton):
        for _ in texts:
            yield []
        return
    automaton.make_automaton()
    for h in texts:
        hits = [(end + 1, *value) for end, values in automaton.iter(_as_symbols(h)) for value in values]
        if not hits:
            yield []
            continue
        stop, n, digest = (np.array(x, t) for x, t in zip(zip(*hits), (np.int64, np.int64, np.uint64)))
        real = _span_hash(h, stop - n, stop) == digest
        yield merged(list(zip((stop - n)[real].tolist(), stop[real].tolist())))


def _scan(texts: pd.DataFrame, phrases: pd.DataFrame) -> pd.DataFrame:
    """Spans of each text of a split: the texts through the shard's automaton."""
    rows = []
    patterns = [np.frombuffer(x, np.uint64) for x in phrases["words"]]
    for tk, spans in zip(texts["tk"], locate(patterns, _hashes(texts["text"]))):
        if spans:
            rows.append((tk, [x for s in spans for x in s]))
    return pd.DataFrame(rows, columns=["tk", "spans"])


def _hashes(texts: pd.Series) -> Iterator[np.ndarray]:
    """The hashes of each text's words; many texts are cut into words at once."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
    for part in chunks(iter([batch])):
        w = words(part, SPACES)
        yield from (w.hash[a:b] for a, b in zip(w.first, w.first[1:]))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tk, n_removed, digest of what is left."""
    for part in chunks(batches, most=CHUNK):
        removed, digest = [], []
        for i, r in enumerate(part.rows.select(["tk", "spans"]).to_pylist()):
            own = part.data[part.offsets[i] : part.offsets[i + 1]].tobytes().split()
            spans = merged([x for flat in r["spans"] for x in zip(flat[::2], flat[1::2])])
            kept, at = [], 0
            for s, e in spans:
                kept += own[at:s]
                at = e
            kept += own[at:]
            removed.append(len(own) - len(kept))
            digest.append(hashlib.sha256(b" ".join(kept)).digest())
        yield pa.RecordBatch.from_arrays([part.rows.column("tk"), pa.array(removed, pa.int64()), pa.array(digest, pa.binary())], names=["tk", "n_removed", "digest"])


def remove_repeated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", F.col("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    profile = written(docs.mapInArrow(partial(_profile, window=window, k=anchor), f"doc_id {kind}, n_words long, tk binary, digest binary, fp binary, ctx binary, start binary, stop binary"), "phrase-profile")
    twice = profile.select("fp").mapInArrow(partial(_flat, full=False), "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n")).filter("n > 1").select("fp")
    flat = profile.select("tk", "fp", "ctx", "start", "stop").mapInArrow(partial(_flat, full=True), "fp long, ctx long, tk binary, start int, stop int")
    seen = written(flat.join(twice, "fp", "left_semi"), "phrase-seen")
    heads = written(profile.select("doc_id", "tk", "n_words", "digest"), "phrase-heads")
    released(profile)
    contexts = written(seen.groupBy("fp", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("tk", "start", "stop")).alias("at")), "phrase-contexts")
    unsure = contexts.groupBy("fp").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 AND least = 1").select("fp")

    # the flagged texts, once each
    asked = contexts.join(unsure, "fp", "left_semi").select("at.*", "n")
    wanted = asked.groupBy("tk").agg(F.collect_list(F.struct("start", "stop", "n")).alias("asked"))
    whole = contexts.filter("n > 1").select("at.*").groupBy("tk").agg(F.collect_list(F.struct("start", "stop")).alias("whole"))
    flagged = seen.select("tk").distinct().join(wanted, "tk", "left").join(whole, "tk", "left")
    text_key = docs.filter(F.col("text").isNotNull()).mapInArrow(_keyed, "tk binary, text string")
    texts = written(text_key.join(flagged, "tk").groupBy("tk").agg(*[F.first(x).alias(x) for x in ("text", "asked", "whole")]), "phrase-texts")

    windows = texts.filter("asked IS NOT NULL").select("tk", "text", "asked").mapInArrow(partial(_single_windows, window=window), "wh long, wh2 long, n long, sure boolean, tk binary, start int")
    windows = written(windows, "phrase-windows")
    again = windows.groupBy("wh", "wh2").agg(F.sum("n").alias("total")).filter("total > 1").select("wh", "wh2")
    starts = windows.filter("NOT sure").join(again, ["wh", "wh2"], "left_semi").groupBy("tk").agg(F.collect_list("start").alias("starts"))
    cut = texts.select("tk", "text", "whole").join(starts, "tk", "left").filter("whole IS NOT NULL OR starts IS NOT NULL")
    patterns = written(cut.mapInArrow(partial(_cut_patterns, window=window), "tk binary, words binary"), "phrase-patterns")
    released(windows)

    volume = patterns.agg(F.sum(F.length("words")).alias("v")).first()["v"] or 0
    shards = max(1, -(-volume // (8 * SHARD_WORDS)))
    shard = F.pmod(F.xxhash64("tk"), F.lit(shards)).cast("int")
    sure = seen.join(contexts.select("fp", "ctx", F.col("n").alias("of"), F.col("at.tk").alias("home")), ["fp", "ctx"])
    routes = sure.select("tk", F.pmod(F.xxhash64("home"), F.lit(shards)).cast("int").alias("shard")).distinct()
    routes = written(routes, "phrase-routes")
    released(seen, contexts)
    weighed = routes.join(texts.select("tk", F.octet_length("text").alias("bytes")), "tk")
    splits = written(weighed.groupBy("shard").agg(F.ceil((F.sum("bytes") + 1) / SPLIT_BYTES).cast("int").alias("splits")), "phrase-splits")
    dealt = routes.join(splits, "shard").select("tk", "shard", F.pmod(F.xxhash64("tk", F.lit(3)), "splits").cast("int").alias("split"))
    copies = patterns.select(shard.alias("shard"), "words").distinct().join(splits, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"), "words")
    streams = dealt.join(texts.select("tk", "text"), "tk")
    spans = streams.groupBy("shard", "split").cogroup(copies.groupBy("shard", "split")).applyInPandas(_scan, "tk binary, spans array<int>")
    spans = written(spans, "phrase-spans")
    released(patterns, routes, splits)
    found = spans.groupBy("tk").agg(F.collect_list("spans").alias("spans"))
    left = texts.select("tk", "text").join(found, "tk").mapInArrow(_kept, "tk binary, n_removed long, digest binary")
    out = heads.select("doc_id", "tk", "n_words", F.col("digest").alias("whole")).join(left, "tk", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.lower(F.hex(F.coalesce("digest", "whole"))).alias("kept_sha256"))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, most=CHUNK):
        keys = [xxhash.xxh3_128_digest(part.data[a:b].tobytes()) for a, b in zip(part.offsets, part.offsets[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), part.rows.column("text")], names=["tk", "text"])


def op2_repeated_phrases(spark, sf_dir: str) -> DataFrame:
    return remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
t AS (SELECT r, i FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1)),
x AS (SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS p FROM t),
k AS (SELECT d.r, p, w[p] AS word FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS p FROM d) AS d WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.r = d.r AND x.p = d.p)),
s AS (SELECT r, sha256(string_agg(word, ' ' ORDER BY p)) AS sha, count(*) AS kept FROM k GROUP BY r)
SELECT doc_id, len(w) AS n_words, CAST(len(w) - coalesce(kept, 0) AS BIGINT) AS n_removed, coalesce(sha, sha256('')) AS kept_sha256 FROM d LEFT JOIN s USING (r)
"""
