"""Substring dedup by prefix-free parsing and suffix arrays.

Every byte covered by a ``size``-byte string that also starts in a document of
smaller doc_id is to go.

1. Parsing. A rolling hash over TRIGGER bytes puts a trigger on the least value
   in reach of each ``size``-byte string, so equal strings have equal triggers.
   A phrase is the text that the strings of one trigger cover; phrases overlap
   by less than ``size``, so each string lies in exactly one phrase that it was
   assigned to. The dictionary holds the distinct phrases, the parse is the
   sequence of them in every document.
2. Suffix array of the parse. Since phrases overlap by ``size - 1`` bytes, one
   phrase decides the order of the strings in it; so the parse is sorted to a
   depth of one phrase: by phrase, then document and place. A phrase's first
   document stays open, and the phrase is removed whole in all larger ones.
3. Suffix array of the dictionary. Phrases with the trigger of another phrase are
   dealt by trigger into shards, and a shard sorts all suffixes of its phrases by
   prefix doubling, up to ``size`` bytes.
4. Corpus order. Strings follow the dictionary's order and, within equal ones,
   the documents of the parse's; all but those of the first document are
   removed, wherever the phrase stands in the document it is open in. Only
   neighbours with equal strings matter, so shards need not be put in order.

The parse travels in blocks of PART triggers. Triggers in a single document are
left out by a first count; what of it is broadcast is a Bloom filter of
FILTER_BITS bits, whatever the input (what passes it in error is in one document
and loses nothing). Triggers of over HOT documents go by grouped minima and a
join, which Spark combines before the shuffle and splits where they are skewed; of
triggers of over WIDE phrases the strings are grouped one by one, by 128 bits,
in place of the sort, so that no shard grows with them.

Defined results: a null text is empty; a text shorter than ``size`` loses
nothing; documents of a null doc_id lose nothing and take no part; rows of a
repeated doc_id are one document of several texts: none of them is smaller; an
empty table gives no rows; other columns are ignored. The bytes left are kept
as they are, so a span may end inside a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import Texts, chunks, mixed, rolling
from ._scratch import released, written
from .fmindex import merged
from .phrases import _anchored, _span_hash

SIZE = 50
TRIGGER = 24
FILTER_BITS = 1 << 27
HOT_SHARE = 16  #: the filter of hot triggers is so much smaller
HOT = 4096  #: documents
WIDE = 20_000  #: phrases of one trigger
PART = 1 << 18  #: triggers of a block of the parse, about
MOST_TASKS = 100_000  #: of a shuffle of blocks; beyond that, a task takes several blocks, one after the other
SHARD_BYTES = 1 << 20
CHUNK = 1 << 19

_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _phrases(part: Texts, size: int, k: int) -> tuple[np.ndarray, ...]:
    """Row, trigger hash, start and stop of every phrase, and the bytes' values; places count within the part."""
    h = _VALUE[part.data]
    row = np.repeat(np.arange(part.rows.num_rows, dtype=np.int32), np.diff(part.offsets))
    at, begin, end = _anchored(h, row, size, k)
    return row[begin], rolling(h, k)[at], begin, end + size, h


def _part_of(fp: np.ndarray, parts: int) -> np.ndarray:
    return ((fp >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _triggers(batches: Iterator[pa.RecordBatch], size: int, k: int, parts: int) -> Iterator[pa.RecordBatch]:
    """part, fps, counts: the distinct triggers of a run of documents, ascending, and in how many (255 at most)."""
    held, n = [], 0

    def flushed() -> pa.RecordBatch:
        fp, count = np.unique(np.concatenate(held), return_counts=True)
        count = np.minimum(count, 255).astype(np.uint8)
        of = _part_of(fp, parts)
        edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
        rows = [(int(of[a]), fp[a:b].tobytes(), count[a:b].tobytes()) for a, b in zip(edge, np.r_[edge[1:], len(of)])]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["part", "fps", "counts"])

    for part in chunks(batches, most=CHUNK):
        row, fp, _, _, _ = _phrases(part, size, k)
        ids = part.rows.column("doc_id").to_numpy()[row]
        order = np.lexsort((ids, fp))
        fp, ids = fp[order], ids[order]
        fresh = np.r_[True, (fp[1:] != fp[:-1]) | (ids[1:] != ids[:-1])] if len(fp) else np.zeros(0, bool)
        held.append(fp[fresh])
        n += len(held[-1])
        if n > PART:
            yield flushed()
            held, n = [], 0
    if n:
        yield flushed()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows of equal ``part``, which come together; those of hot parts, below 0, as they come."""
    now, held, ready = None, [], []  # what is ready is popped, so that the reader alone holds it
    for batch in batches:
        part = batch.column("part").to_numpy()
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
        for a, b in zip(edge, np.r_[edge[1:], len(part)]):
            if held and part[a] != now:
                ready.append((now, held))
                held = []
                yield ready.pop()
            now = int(part[a])
            if now < 0:
                yield now, [batch.slice(a, b - a)]
            else:
                held.append(batch.slice(a, b - a))
    batch = None
    if held:
        ready.append((now, held))
        held = []
        yield ready.pop()


def _joined(rows: list[pa.RecordBatch], name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for r in rows for x in r.column(name)])


def _slots(fp: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mixed(fp + np.uint64(s)) % np.uint64(bits)).astype(np.int64) for s in (1, 2)]


def _common(batches: Iterator[pa.RecordBatch], bits: int, hot_bits: int, hot: int) -> Iterator[pa.RecordBatch]:
    """part and its slices of both filters: triggers of several documents, and hot ones."""
    for part, rows in _runs(batches):
        fp, count = _joined(rows, "fps", np.uint64), _joined(rows, "counts", np.uint8)
        order = np.argsort(fp)
        fp, count = fp[order], count[order].astype(np.int64)
        edge = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]])
        total = np.add.reduceat(count, edge)
        out = []
        for n, least in ((bits, 2), (hot_bits, hot)):
            own = np.zeros(n, bool)
            for at in _slots(fp[edge[total >= least]], n):
                own[at] = True
            out.append(np.packbits(own, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *[pa.array([x], pa.binary()) for x in out]], names=["part", "several", "hot"])


def _passes(fp: np.ndarray, of: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Whether a trigger passes its part's slice (a row of the bitmap)."""
    ok = np.ones(len(fp), bool)
    for at in _slots(fp, bitmap.shape[1] * 8):
        ok &= (bitmap[of, at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return ok


PLACE = (("fp", np.uint64), ("ctx", np.uint64), ("doc_id", np.int64), ("text_key", np.int64), ("start", np.int32), ("stop", np.int32))


def _candidates(batches: Iterator[pa.RecordBatch], size: int, k: int, shared, keyed: bool) -> Iterator[pa.RecordBatch]:
    """part and the PLACE arrays of phrases whose trigger passes the filter; hot ones have part -1 and less."""
    several, hot = shared.value
    parts, held, n, seq = len(several), [], 0, 0

    def flushed() -> pa.RecordBatch:
        cols = [np.concatenate([x[i] for x in held]) for i in range(len(PLACE))]
        of = _part_of(cols[0], parts)
        of[_passes(cols[0], of, hot)] = -1 - seq % 97
        order = np.argsort(of, kind="stable")
        of, cols = of[order], [x[order] if len(x) else x for x in cols]
        edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        ranges = list(zip(edge, np.r_[edge[1:], len(of)]))
        return pa.RecordBatch.from_arrays([pa.array(of[edge]), *[pa.array([x[a:b].tobytes() for a, b in ranges], pa.binary()) for x in cols]], names=["part", *[x[0] for x in PLACE]])

    for part in chunks(batches, most=CHUNK):
        row, fp, start, stop, h = _phrases(part, size, k)
        keep = _passes(fp, _part_of(fp, parts), several)
        row, fp, start, stop = row[keep], fp[keep], start[keep], stop[keep]
        if not len(fp):
            continue
        base = part.offsets[row]
        keys = _text_keys(part)[row] if keyed else np.zeros(0, np.int64)
        held.append((fp, _span_hash(h, start, stop), part.rows.column("doc_id").to_numpy()[row], keys, (start - base).astype(np.int32), (stop - base).astype(np.int32)))
        n += len(fp)
        if n > PART:
            yield flushed()
            held, n, seq = [], 0, seq + 1
    if n:
        yield flushed()


RESOLVED = "kind int, fp long, ctx long, doc_id long, text_key long, start int, stop int, lead boolean, kinds int, spans array<int>"
_GONE, _OPEN, _HOT = 0, 1, 2


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parse sorted by phrase, document and place: what goes whole, what stays open, and hot places as they are."""
    names = [x.split()[0] for x in RESOLVED.split(", ")]

    def batch(kind: int, cols: list[np.ndarray], lead: np.ndarray, kinds: np.ndarray) -> pa.RecordBatch:
        n = len(lead)
        of = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in cols]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *of, pa.array(lead), pa.array(kinds.astype(np.int32)), pa.nulls(n, pa.list_(pa.int32()))], names=names)

    for part, rows in _runs(batches):
        cols = [_joined(rows, name, kind) for name, kind in PLACE]
        n = len(cols[0])
        cols[3] = cols[3] if len(cols[3]) else np.zeros(n, np.int64)  # texts are keyed only where ids repeat
        del rows
        if part < 0:
            for a in range(0, n, 1 << 16):
                some = [x[a : a + (1 << 16)] for x in cols]
                yield batch(_HOT, some, np.zeros(len(some[0]), bool), np.zeros(len(some[0]), int))
            continue
        order = np.lexsort((cols[4], cols[3], cols[2], cols[1], cols[0]))
        for i in range(len(cols)):
            cols[i] = cols[i][order]
        fp, ctx, doc, key, start, stop = cols
        of_fp = np.r_[True, fp[1:] != fp[:-1]]
        of_ctx = of_fp | np.r_[True, ctx[1:] != ctx[:-1]]
        head = np.flatnonzero(of_ctx)
        least = np.repeat(doc[head], np.diff(np.r_[head, n]))
        first = np.flatnonzero(of_fp)
        length = np.diff(np.r_[first, n])
        kinds = np.repeat(np.add.reduceat(of_ctx.astype(np.int64), first), length)
        several = np.repeat(np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first), length)
        gone = np.flatnonzero(doc > least)
        gone = gone[np.lexsort((start[gone], key[gone], doc[gone]))]
        if len(gone):
            d, t = doc[gone], key[gone]
            edge = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
            m = len(edge)
            spans = pa.ListArray.from_arrays(pa.array(2 * np.r_[edge, len(gone)], pa.int32()), pa.array(np.column_stack([start[gone], stop[gone]]).ravel()))
            none = [pa.nulls(m, x) for x in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, _GONE, np.int32)), *none[:2], pa.array(d[edge]), pa.array(t[edge]), *none[2:], spans], names=names)
        left = np.flatnonzero((doc == least) & (kinds > 1) & several)
        if len(left):
            yield batch(_OPEN, [x[left] for x in cols], of_ctx[left], kinds[left])


def _text_keys(part: Texts) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(part.data[a:b].tobytes()) for a, b in zip(part.offsets, part.offsets[1:])], np.uint64).view(np.int64)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the phrases asked for in each text: fp, ctx, doc_id, kinds, body."""
    for part in chunks(batches, most=CHUNK):
        out: dict[str, list] = {x: [] for x in ("fp", "ctx", "doc_id", "kinds", "body")}
        for i, r in enumerate(part.rows.select(["doc_id", "asked"]).to_pylist()):
            raw = part.data[part.offsets[i] : part.offsets[i + 1]].tobytes()
            for x in r["asked"]:
                for name, v in (("fp", x["fp"]), ("ctx", x["ctx"]), ("doc_id", r["doc_id"]), ("kinds", x["kinds"]), ("body", raw[x["start"] : x["stop"]])):
                    out[name].append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))


def sorted_strings(bodies: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of the bodies with at least ``size`` bytes, ordered by their first ``size``.

    Returns body, offset and, per suffix in that order, the number of its class
    of equal strings. Bodies end with a terminator that is smaller than any byte.
    """
    lengths = np.array([len(b) for b in bodies], np.int64)
    text = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int64) + 1
    ends = np.cumsum(lengths + 1) - 1
    t = np.zeros(int(lengths.sum()) + len(bodies), np.int64)
    inside = np.ones(len(t), bool)
    inside[ends] = False
    t[inside] = text
    rank, k = t, 1
    while k < size:
        step = min(k, size - k)
        nxt = np.zeros(len(t), np.int64)
        nxt[: len(t) - step] = rank[step:]
        # the second half may overlap the first: both then say more than the first alone
        rank = np.unique(rank * (len(t) + 258) + nxt, return_inverse=True)[1]
        k += step
    owner = np.repeat(np.arange(len(bodies)), lengths + 1)
    offset = np.arange(len(t)) - (ends - lengths)[owner]
    whole = np.flatnonzero(offset + size <= lengths[owner])
    sa = whole[np.argsort(rank[whole], kind="stable")]
    return owner[sa], offset[sa], rank[sa]


def _shard(pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    """Ranges of each phrase, counted from its start, that hold a string of a smaller document of the shard."""
    pdf = pdf.drop_duplicates(["fp", "ctx"]).reset_index(drop=True)
    body, offset, kind = sorted_strings(pdf["body"].tolist(), size)
    if not len(body):
        return pd.DataFrame({"fp": [], "ctx": [], "cuts": []})
    doc = pdf["doc_id"].to_numpy()[body]
    first = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.r_[first, len(kind)]))
    gone = doc > least
    out: dict[int, list[tuple[int, int]]] = {}
    for b, o in zip(body[gone].tolist(), offset[gone].tolist()):
        out.setdefault(b, []).append((o, o + size))
    fps, ctxs = pdf["fp"].tolist(), pdf["ctx"].tolist()
    return pd.DataFrame([(fps[b], ctxs[b], [x for s in merged(v) for x in s]) for b, v in out.items()], columns=["fp", "ctx", "cuts"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, most=CHUNK):
        yield pa.RecordBatch.from_arrays([part.rows.column("doc_id"), pa.array(_text_keys(part)), part.rows.column("text")], names=["doc_id", "text_key", "text"])


def _strings(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """fp, ctx, doc_id, at, one, two: every string of the phrases, as 128 bits."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            for at in range(len(r["body"]) - size + 1):
                digest = xxhash.xxh3_128_intdigest(r["body"][at : at + size])
                rows.append((r["fp"], r["ctx"], r["doc_id"], at, (digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=["fp", "ctx", "doc_id", "at", "one", "two"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, most=CHUNK):
        n_bytes, removed, n_spans, digest, kept_spans = [], [], [], [], []
        for i, flats in enumerate(part.rows.column("spans").to_pylist()):
            raw = part.data[part.offsets[i] : part.offsets[i + 1]].tobytes()
            spans = merged([x for flat in flats or [] for x in zip(flat[::2], flat[1::2])])
            at, left = 0, []
            for s, e in spans:
                left.append(raw[at:s])
                at = e
            left.append(raw[at:])
            n_bytes.append(len(raw))
            removed.append(sum(e - s for s, e in spans))
            n_spans.append(len(spans))
            digest.append(hashlib.sha256(b"".join(left)).hexdigest())
            kept_spans.append([x for s in spans for x in s])
        cols = [part.rows.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n_bytes, removed, n_spans)], pa.array(digest, pa.string()), pa.array(kept_spans, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed_spans"])


def _first_count(named: DataFrame, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Filters of the triggers of several documents and of the hot ones: a row of bytes for each part of the parse."""
    volume = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(max(1, 2 * volume // ((size - k + 2) * PART)), FILTER_BITS // 1024)
    bits = max(1024, FILTER_BITS // parts // 1024 * 1024)
    seen = named.mapInArrow(partial(_triggers, size=size, k=k, parts=parts), "part long, fps binary, counts binary")
    slices = seen.repartition(min(parts, MOST_TASKS), "part").sortWithinPartitions("part").mapInArrow(partial(_common, bits=bits, hot_bits=bits // HOT_SHARE, hot=HOT), "part long, several binary, hot binary")
    several, hot = np.zeros((parts, bits // 8), np.uint8), np.zeros((parts, bits // HOT_SHARE // 8), np.uint8)
    for part, a, b in written(slices, "parse-filter").toLocalIterator():  # FILTER_BITS and a sixteenth of that
        several[part], hot[part] = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    return several, hot


def remove_repeated_bytes(docs: DataFrame, size: int = SIZE, k: int = TRIGGER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed_spans for every row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    named = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    # only where ids repeat do texts need keys of their own
    repeated = not named.groupBy("doc_id").count().filter("count > 1").isEmpty()
    keyed = lambda d: d.mapInArrow(_keyed, "doc_id long, text_key long, text string") if repeated else d.withColumn("text_key", F.lit(0).cast("long"))
    shared = spark.sparkContext.broadcast(_first_count(named, size, k))
    places = named.mapInArrow(partial(_candidates, size=size, k=k, shared=shared, keyed=repeated), "part long, fp binary, ctx binary, doc_id binary, text_key binary, start binary, stop binary")
    parse = written(places.repartition(min(len(shared.value[0]), MOST_TASKS), "part").sortWithinPartitions("part").mapInArrow(_resolved, RESOLVED), "parse-sorted")

    # hot triggers: the same by grouped minima
    hot = parse.filter(F.col("kind") == _HOT).select("fp", "ctx", "doc_id", "text_key", "start", "stop")
    first = written(hot.groupBy("fp", "ctx").agg(F.min(F.struct("doc_id", "text_key", "start", "stop")).alias("at")), "parse-hot")
    kinds = first.groupBy("fp").agg(F.count("*").cast("int").alias("kinds"))
    placed = hot.join(first.select("fp", "ctx", "at"), ["fp", "ctx"])
    hot_gone = placed.filter(F.col("doc_id") > F.col("at.doc_id")).select("doc_id", "text_key", F.array("start", "stop").alias("spans"))
    hot_open = placed.filter(F.col("doc_id") == F.col("at.doc_id")).join(kinds.filter("kinds > 1"), "fp")
    hot_open = hot_open.withColumn("lead", F.struct("doc_id", "text_key", "start", "stop") == F.col("at"))
    columns = ["fp", "ctx", "doc_id", "text_key", "start", "stop", "lead", "kinds"]
    open_ = parse.filter(F.col("kind") == _OPEN).select(columns).union(hot_open.select(columns))
    open_ = written(open_, "parse-open")

    # the dictionary: phrases that share a trigger, in their first document
    asked = open_.filter("lead").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("fp", "ctx", "start", "stop", "kinds")).alias("asked"))
    bodies = keyed(named).join(asked, ["doc_id", "text_key"]).select("doc_id", "text", "asked").mapInArrow(_cut, "fp long, ctx long, doc_id long, kinds int, body binary")
    bodies = written(bodies, "parse-bodies")
    sorted_ = bodies.filter(F.col("kinds") <= WIDE).select("fp", "ctx", "doc_id", "body")
    volume = sorted_.agg(F.sum(F.length("body"))).first()[0] or 0
    shards = max(1, -(-volume // SHARD_BYTES))
    cuts = sorted_.groupBy(F.pmod(F.xxhash64("fp"), F.lit(shards)).alias("shard")).applyInPandas(lambda pdf: _shard(pdf.drop(columns="shard", errors="ignore"), size), "fp long, ctx long, cuts array<int>")
    single = bodies.filter(F.col("kinds") > WIDE).select("fp", "ctx", "doc_id", "body").mapInArrow(partial(_strings, size=size), "fp long, ctx long, doc_id long, at int, one long, two long")
    least = single.groupBy("one", "two").agg(F.min("doc_id").alias("least"))
    wide = single.join(least, ["one", "two"]).filter("doc_id > least").groupBy("fp", "ctx").agg(F.flatten(F.collect_set(F.array(F.col("at"), F.col("at") + size))).alias("cuts"))
    cuts = written(cuts.union(wide), "parse-cuts")
    released(bodies)

    # the corpus order: whole phrases in larger documents, their cuts wherever they stand in the first
    inside = open_.join(cuts, ["fp", "ctx"]).select("doc_id", "text_key", F.transform("cuts", lambda x: x + F.col("start")).alias("spans"))
    gone = parse.filter(F.col("kind") == _GONE).select("doc_id", "text_key", "spans").union(hot_gone).union(inside)
    every = written(gone.groupBy("doc_id", "text_key").agg(F.collect_list("spans").alias("spans")), "parse-spans")
    released(parse, open_, cuts, first)
    rows = keyed(docs).join(every, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed_spans array<int>")


def op8_prefix_free_parse(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP8_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, doc_id, j, substr(h, 1000 * j + 1, 1098) AS c FROM (SELECT r, doc_id, h, unnest(generate_series(0, (length(h) // 2 - 50) // 500)) AS j FROM d WHERE length(h) >= 100 AND doc_id IS NOT NULL)),
g AS (SELECT r, doc_id, 500 * j + i AS i, md5(substr(c, 2 * i + 1, 100)) AS g FROM (SELECT r, doc_id, j, c, unnest(generate_series(0, length(c) // 2 - 50)) AS i FROM c)),
m AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
x AS (SELECT r, i, i > lag(i) OVER (PARTITION BY r ORDER BY i) + 50 AS apart FROM g JOIN m USING (g) WHERE doc_id > least),
n AS (SELECT r, i, sum(coalesce(apart, TRUE)::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM x),
s AS (SELECT r, run, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY r, run),
p AS (SELECT r, run, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY run), 0) AS before FROM s),
k AS (SELECT p.r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY run) || substr(max(h), 2 * max(b) + 1) AS kept,
  sum(b - a) AS n_removed, count(*) AS n_spans FROM p JOIN d ON p.r = d.r GROUP BY p.r)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k ON d.r = k.r
"""
