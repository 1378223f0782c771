"""Line dedup: which lines of each document stay, as run-length compressed bitmaps.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of
``least_chars`` code points or more that ``least_docs`` documents or more hold stay
in the largest doc_id that holds them, and lose all their lines elsewhere.

1. Every line with such a key becomes a row: 128 bits of the key, its document and
   its place. Texts aren't shuffled here.
2. The rows are range-partitioned by hash and document and sorted by hash, document
   (largest first) and place, and so written. Ranges cut a key between documents too,
   so a line that a third of all documents hold fills no task, and equal hashes stand
   together, which makes the table small.
3. Reading that order, the first row of a key is its document to stay, and documents
   are counted: partial counts in every range, sums over ranges. The rows of frequent
   keys in other documents give each document's dropped places.
4. A document's bitmap is kept as its runs of kept lines (first, length). Only
   documents that lose lines have one; ``without_lines`` applies them to the texts.

Defined results: a null or empty text is one empty line. Rows of one doc_id are one
document when documents are counted, and in the largest doc_id all of them keep their
lines; rows without doc_id are one document, less than any other. Equal rows get equal
results. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import released, written

LEAST_DOCS, LEAST_CHARS = 3, 20
WHITE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def occurrences(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """h1, h2 (128 bits of the key), doc_id, text_hash, n_lines, place of every line that is long enough."""
    own = docs.select("doc_id", _text_hash(F.col("text")).alias("text_hash"), _lines(F.col("text")).alias("lines"))
    rows = own.select("doc_id", "text_hash", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("place", "line"))
    rows = rows.select("doc_id", "text_hash", "n_lines", "place", line_key(F.col("line")).alias("key")).filter(F.length("key") >= least_chars)
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_hash", "n_lines", "place")


def _runs(dropped: Column, n_lines: Column) -> Column:
    """Runs (first, length) of the places below n_lines that aren't in the sorted array ``dropped``."""
    last = F.size(dropped) - 1
    begins = F.filter(dropped, lambda x, i: (i == 0) | (F.get(dropped, i - 1) != x - 1))
    ends = F.filter(dropped, lambda x, i: (i == last) | (F.get(dropped, i + 1) != x + 1))
    first = F.concat(F.array(F.lit(0)), F.transform(ends, lambda x: x + 1))
    stop = F.concat(begins, F.array(n_lines))
    runs = F.zip_with(first, stop, lambda a, b: F.struct(a.alias("first"), (b - a).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def keep_bitmaps(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, text_hash, n_dropped and the runs of kept lines of every document that loses lines."""
    ranged = occurrences(docs, least_chars).repartitionByRange("h1", "h2", "doc_id")
    seen = written(ranged.sortWithinPartitions("h1", "h2", F.desc("doc_id"), "text_hash", "place"), "line-occurrences")
    counted = seen.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull().cast("int")).alias("nameless"))
    # a table of its own, so that the join below is between two shuffles and a frequent key's rows can be split
    frequent = written(counted.filter(F.col("docs") + F.col("nameless") >= least_docs).select("h1", "h2", "last"), "line-frequent")
    lost = seen.join(frequent, ["h1", "h2"]).filter(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last")))
    dropped = lost.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("place")).alias("dropped"), F.max("n_lines").alias("n_lines"))
    out = dropped.select("doc_id", "text_hash", F.size("dropped").cast("long").alias("n_dropped"), _runs(F.col("dropped"), F.col("n_lines")).alias("keep"))
    out._scratch = (seen, frequent)
    return out


def without_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left of every row of docs, by its bitmap."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", _text_hash(F.col("text")))
    b = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("n_dropped").alias("_dropped"), "keep")
    # bitmaps grow with the texts, so they are never broadcast
    rows = own.join(b.hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
    rows = rows.select("doc_id", "text", "_dropped", "keep", _lines(F.col("text")).alias("lines"))  # cut once, not for every run
    left = F.flatten(F.transform("keep", lambda r: F.slice("lines", r["first"] + 1, r["length"])))
    return rows.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce("_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("kept_text"),
    )


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bitmaps = keep_bitmaps(docs)
    kept = written(bitmaps, "line-bitmaps")
    released(*bitmaps._scratch)
    return without_lines(docs, kept).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT r, doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
s AS (SELECT r, k.doc_id, i, line, f.key IS NOT NULL AND k.doc_id < last AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM s GROUP BY r
"""
