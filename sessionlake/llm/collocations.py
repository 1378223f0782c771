"""Phrase collocations: which words stand together far more often than apart, per language.

Texts are lower-cased (A-Z) and cut at punctuation and line ends into pieces, and those
into words. A candidate is a phrase of 2 to ``longest`` words that occurs ``least`` times
or more. For each cut of it, score = floor(10^6 * f(phrase)^2 / (f(left) * f(right))); the
lowest counts. A candidate that a longer one holds most occurrences of is dropped.

1. Pieces. Equal pieces of a language become one with a multiplicity, first in each
   slice of texts, then by a grouped sum; a piece in a third of all texts is one row.
2. N-grams. Each slice of pieces counts its n-grams, weighted, and deals them by hash
   into buckets; a bucket's share of a slice is one row, a compressed Arrow table. So a
   phrase has at most one entry per slice and fills no bucket.
3. Counts. Each bucket is one task: duckdb sums the phrases' entries out-of-core, under
   MEMORY and with a task's own spill folder that goes with the task. Only phrases of
   ``least`` occurrences are kept, since no rarer one is part of a candidate. A language's
   number of words is the count of its empty phrase. Buckets are as many as the session's
   shuffle partitions.
4. Lookups. Every candidate sends a request for each of its parts, shuffled to where the
   part's count is, and the answers meet at the candidate. Candidates tell their own count
   to the shorter ones that they hold in the same manner, as a grouped maximum.
5. The best of each language are cut in SALTS shares first, so no task sorts a language.

Equal hashes alone never unite phrases: duckdb groups by their text. Scores are exact
integers (decimals of 38 digits; counts up to 10^13 fit).

Defined results: a null text has no words, a null language is ``und``; every row counts,
repeated rows and null doc_ids too; a language without candidates, and an empty table, give
no rows; other columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import partial

import duckdb
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import Texts, chunks, lowered, mixed, rolling, words
from ._scratch import released, written
from .phrases import _span_hash

LEAST, LONGEST, MOST, HELD_PERCENT = 10, 3, 2000, 50
SLICE = 1 << 22  #: bytes of pieces whose n-grams are counted together
MEMORY = "256MB"
INSERT = 1 << 18  #: rows that duckdb gets at a time
SALTS = 64

#: Bytes that end a piece: . , ; : ! ? and \n \v \f \r.
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SEPARATORS = BREAKS.copy()
SEPARATORS[[0x20, 0x09]] = True
SPACE = np.zeros(256, bool)
SPACE[0x20] = True


def _strings(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The slices data[start:stop], which may overlap, as strings."""
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(stop - start, out=offsets[1:])
    at = np.arange(offsets[-1], dtype=np.int32)
    at += np.repeat((start - offsets[:-1]).astype(np.int32), stop - start)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[at]))


def _languages(part: Texts) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Each row's language, as an index into the first value, and 64 bits of it."""
    lang = part.rows.column("lang").fill_null("und").dictionary_encode()
    code = lang.indices.to_numpy()
    value = np.array([xxhash.xxh3_64_intdigest(x or "") for x in lang.dictionary.to_pylist()], np.uint64)
    return lang.dictionary, code, value[code] if len(value) else np.zeros(0, np.uint64)


def _grouped(h: np.ndarray, h2: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First members and summed weights of equal values (128 bits); a value may come in several groups."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    a, b = h[order], h2[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return order[first], np.add.reduceat(weight[order], first)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, piece (words joined by a space), copies: distinct pieces of each slice of texts."""
    for part in chunks(batches, most=SLICE):
        w = words(part, SEPARATORS, lower=True)
        if not len(w.start):
            continue
        names, code, value = _languages(part)
        row = np.repeat(np.arange(len(code)), np.diff(w.first))
        broken = np.cumsum(BREAKS[part.data])[w.start]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (broken[1:] != broken[:-1])])
        last = np.r_[first[1:], len(row)]
        # the same words with one space behind each
        size = w.end - w.start
        stop = np.cumsum(size + 1) - 1
        even = np.full(stop[-1] + 1, 0x20, np.uint8)
        inside = np.ones(len(even), bool)
        inside[stop] = False
        even[inside] = lowered(part.data[~SEPARATORS[part.data]])
        h, h2 = (mixed(_span_hash(x, first, last) + value[row[first]]) for x in (w.hash, mixed(w.hash)))
        own, copies = _grouped(h, h2, np.ones(len(first), np.int64))
        text = _strings(even, (stop - size)[first[own]], stop[last[own] - 1])
        yield pa.RecordBatch.from_arrays([names.take(pa.array(code[row[first[own]]])), text, pa.array(copies)], names=["lang", "piece", "copies"])


def _joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches, put together up to about ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _first_bytes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A sort key of slices that brings alike ones together: the language's code and seven bytes."""
    at = start[:, None] + np.arange(7)
    some = np.zeros((len(start), 8), np.uint8)
    some[:, 0] = code
    some[:, 1:] = np.where(at < stop[:, None], data[np.minimum(at, len(data) - 1)], 0)
    return some.view(">u8").ravel()


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _ngrams(batches: Iterator[pa.RecordBatch], longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """bucket, grams: the slice's n-grams of a bucket (lang, phrase, words, f)."""
    for part in chunks(_joined(batches, SLICE), "piece", SLICE):
        w = words(part, SPACE)
        names, code, value = _languages(part)
        n_words = np.diff(w.first)
        row = np.repeat(np.arange(len(code)), n_words)
        copies = part.rows.column("copies").to_numpy()
        total = np.zeros(len(names), np.int64)
        np.add.at(total, code, copies * n_words)
        of = np.array([xxhash.xxh3_64_intdigest(x) for x in names.to_pylist()], np.uint64)
        tables = [(names, pa.array([""] * len(names)), np.zeros(len(names), np.int8), total, of, np.zeros(len(names), np.uint64))]
        for n in range(1, longest + 1):
            at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if len(row) >= n else np.zeros(0, np.int64)
            if not len(at):
                continue
            weight, salt = copies[row[at]], value[row[at]]
            h, h2 = (mixed(rolling(x, n)[at] + salt) for x in (w.hash, mixed(w.hash)))
            own, f = _grouped(h, h2, weight)
            i = at[own]
            start, stop, of = w.start[i], w.end[i + n - 1], code[row[i]]
            tables.append((names.take(pa.array(of)), _strings(part.data, start, stop), np.full(len(i), n, np.int8), f, h[own], _first_bytes(part.data, start, stop, of)))
        lang, phrase, n, f, h, key = zip(*tables)
        bucket = (np.concatenate(h) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((np.concatenate(key), bucket))  # phrases in order compress to half
        whole = pa.table({"lang": pa.concat_arrays(lang), "phrase": pa.concat_arrays(phrase), "words": np.concatenate(n), "f": np.concatenate(f)}).take(pa.array(order))
        which, first = np.unique(bucket[order], return_index=True)
        blobs = [_packed(whole.slice(a, b - a)) for a, b in zip(first, [*first[1:], len(order)])]
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(blobs, pa.binary())], names=["bucket", "grams"])


COUNTS = pa.schema({"lang": pa.string(), "phrase": pa.string(), "words": pa.int32(), "f": pa.int64()})


def _counted(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """lang, phrase, words, f of a bucket's phrases that occur often enough, and of the empty ones."""
    with tempfile.TemporaryDirectory(prefix="collocations-") as spill, duckdb.connect() as con:
        con.execute(f"SET memory_limit = '{MEMORY}'; SET threads = 1; SET preserve_insertion_order = false; SET temp_directory = '{spill}'")
        con.execute("CREATE TABLE grams (lang VARCHAR, phrase VARCHAR, words INTEGER, f BIGINT)")
        held: list[pa.Table] = []

        def insert() -> None:
            if held:
                con.register("held", pa.concat_tables(held))
                con.execute("INSERT INTO grams SELECT * FROM held")
                con.unregister("held")
                held.clear()

        for batch in batches:
            for blob in batch.column("grams"):
                held.append(pa.ipc.open_stream(blob.as_buffer()).read_all())
                if sum(map(len, held)) >= INSERT:
                    insert()
        insert()
        rows = con.sql(f"SELECT lang, phrase, words, sum(f)::BIGINT AS f FROM grams GROUP BY ALL HAVING sum(f) >= {least} OR words = 0")
        for batch in rows.to_arrow_reader(1 << 16):
            yield from pa.Table.from_batches([batch]).cast(COUNTS).to_batches()


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, phrase, words, f: all phrases of up to ``longest`` words and ``least`` occurrences; the empty one counts the words."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("lang").cast("string").alias("lang"), "text").filter("text IS NOT NULL")
    pieces = texts.mapInArrow(_pieces, "lang string, piece string, copies long")
    pieces = written(pieces.groupBy("lang", "piece").agg(F.sum("copies").alias("copies")), "phrase-pieces")
    grams = pieces.mapInArrow(partial(_ngrams, longest=longest, buckets=buckets), "bucket int, grams binary")
    counts = grams.repartitionById(buckets, F.col("bucket")).mapInArrow(partial(_counted, least=least), "lang string, phrase string, words int, f long")
    counts = written(counts, "phrase-counts")
    released(pieces)
    return counts


def scored(counts: DataFrame, held_percent: int = HELD_PERCENT) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one holds mostly, from ``phrase_counts``."""
    candidates = counts.filter("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"))
    parts = F.split("phrase", " ")
    text = lambda first, n: F.array_join(F.slice(parts, first, n), " ")
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(0).alias("side"), text(F.lit(1), k).alias("part")), F.struct(k.alias("k"), F.lit(1).alias("side"), text(k + 1, F.col("words") - k).alias("part")))))
    requests = candidates.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    answers = requests.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"]).repartition("lang", "phrase")
    value = F.expr("CAST((CAST(1000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0))) AS BIGINT)")
    both = answers.groupBy("lang", "phrase", "k").agg(F.first("a").alias("a"), F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    lowest = both.withColumn("score", value).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: text(i, m))))
    held = candidates.filter("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    rows = lowest.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < held_percent * F.col("a")))
    return rows.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def best(rows: DataFrame, most: int = MOST) -> DataFrame:
    """The first ``most`` of each language with their rank."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    few = rows.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= most)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, most: int = MOST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    counts = phrase_counts(docs, longest, least)
    words_of = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return best(scored(counts.filter("words > 0")), most).join(words_of, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w, count(*) AS m FROM p GROUP BY ALL),
g AS (SELECT lang, n, w[i:i + n - 1] AS s, CAST(sum(m) AS HUGEINT) AS f FROM (SELECT lang, w, m, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM w, (VALUES (1), (2), (3)) AS t(n) WHERE len(w) >= n) GROUP BY ALL),
c AS (SELECT lang, n, s, f AS a FROM g WHERE n >= 2 AND f >= 10),
k AS (SELECT lang, n, s, a, unnest(generate_series(1, n - 1)) AS k FROM c),
x AS (SELECT k.lang, k.s, k.a, k, l.f AS l, r.f AS r, CAST(1000000 * k.a * k.a // (l.f * r.f) AS BIGINT) AS score FROM k
  JOIN g AS l ON l.lang = k.lang AND l.s = k.s[1:k] JOIN g AS r ON r.lang = k.lang AND r.s = k.s[k + 1:k.n]),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, k) = 1),
h AS (SELECT lang, s, max(a) AS longer FROM (SELECT lang, a, unnest([s[1:2], s[2:3]]) AS s FROM c WHERE n = 3) GROUP BY ALL),
z AS (SELECT y.*, array_to_string(y.s, ' ') AS phrase FROM y LEFT JOIN h ON y.lang = h.lang AND y.s = h.s WHERE longer IS NULL OR 100 * longer < 50 * y.a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT o.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, t.n, score
FROM o JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE n = 1 GROUP BY lang) AS t ON t.lang = o.lang WHERE rank <= 2000
"""
