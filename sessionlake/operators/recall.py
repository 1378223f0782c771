"""Full-text recall: phrase conjunction, BM25, LIKE fallback."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import fts_tokens, phrase_count, term_tokens

K1, B = 1.2, 0.75
#: Weights of a session's fields.
SESSION_WEIGHTS = {"title": 8.0, "summary_text": 3.0, "compact_text": 4.0, "reasoning_summary_text": 1.2}


def recall_limit(n: int, sort: str = "relevance") -> int:
    return max(12 * n, 50) if sort == "relevance" else max(100 * n, 1000)


def phrases_of(terms: list[str]) -> list[list[str]]:
    return [p for p in (term_tokens(t) for t in terms) if p]


def idf_of(n: int, d: int) -> float:
    """Weight of a phrase that d of n rows hold; of frequent ones a little above zero."""
    x = math.log((n - d + 0.5) / (d + 0.5))
    return x if x > 0 else 1e-6


def scored(weighted: list[Column], n: int) -> Column:
    """Minus BM25 of rows with ``_n0``.., ``_len`` and the statistics ``_N``, ``_L``, ``_d0``.. ."""
    score = F.lit(0.0)
    for i in range(n):
        f = weighted[i]
        idf = F.ln((F.col("_N") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / (F.col("_L") / F.col("_N"))))
    return score


def bm25(rows: DataFrame, tokens: dict[str, float], terms: list[str]) -> DataFrame:
    """Rows that hold every term, with ``score`` (negative, less is better), by reading all rows.

    ``tokens`` maps columns of token arrays to weights. Statistics are those of
    all rows: one aggregate row, joined to the rows that match.
    """
    phrases = phrases_of(terms)
    if not phrases:
        return rows.withColumn("score", F.lit(0.0)).limit(0)
    n = len(phrases)
    plain = [sum((phrase_count(F.col(c), p) for c in tokens), F.lit(0)) for p in phrases]
    length = sum((F.size(c) for c in tokens), F.lit(0))
    held = rows.withColumn("_len", length).withColumns({f"_n{i}": c for i, c in enumerate(plain)})
    stats = held.agg(F.count("*").alias("_N"), F.sum("_len").alias("_L"), *[F.count_if(F.col(f"_n{i}") > 0).alias(f"_d{i}") for i in range(n)])
    hits = held.filter(reduce(lambda a, b: a & b, [F.col(f"_n{i}") > 0 for i in range(n)]))
    hits = hits.join(F.broadcast(stats))  # exactly one row
    weighted = [sum((phrase_count(F.col(c), p) * F.lit(w) for c, w in tokens.items()), F.lit(0.0)) for p in phrases]
    return hits.withColumn("score", scored(weighted, n)).select(*rows.columns, "score")


def postings(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """token, keys, field, places: where each token of the fields' texts stands (``field`` is its number)."""
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), fts_tokens(F.col(c)).alias("tokens")) for i, c in enumerate(fields)])).alias("p")
    flat = rows.select(*keys, parts).select(*keys, "p.field", F.posexplode("p.tokens").alias("place", "token"))
    return flat.groupBy("token", *keys, "field").agg(F.array_sort(F.collect_list("place")).alias("places"))


def _occurrences(at: dict[str, str], phrase: list[str]) -> Column:
    """Places where a phrase begins: each further token's places are moved to where its phrase would begin, and shared ones stay."""
    first = F.col(at[phrase[0]])
    back = lambda places, j: F.transform(places, lambda x: x - j)
    for j, t in enumerate(phrase[1:], 1):
        first = F.array_intersect(first, back(at[t], j))
    return F.coalesce(F.size(first), F.lit(0))


def counted(entries: DataFrame, keys: list[str], weights: list[float], phrases: list[list[str]]) -> DataFrame:
    """keys, ``_len`` and how often each phrase occurs in a row of the index: ``_n0``.., and weighted ``_f0``.. ."""
    tokens = sorted({t for p in phrases for t in p})
    at = {t: f"_p{i}" for i, t in enumerate(tokens)}
    own = entries.filter(F.col("token").isin(tokens)).groupBy(*keys, "field").agg(F.first("n_tokens").alias("_len"), *[F.first(F.when(F.col("token") == t, F.col("places")), True).alias(c) for t, c in at.items()])
    n = len(phrases)
    own = own.withColumns({f"_n{i}": F.greatest(_occurrences(at, p), F.lit(0)) for i, p in enumerate(phrases)})
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("field") + 1)
    return own.groupBy(*keys).agg(F.first("_len").alias("_len"), *[F.sum(f"_n{i}").alias(f"_n{i}") for i in range(n)], *[F.sum(F.col(f"_n{i}") * weight).alias(f"_f{i}") for i in range(n)])


def bm25_postings(entries: DataFrame, lengths: DataFrame, keys: list[str], weights: list[float], terms: list[str]) -> DataFrame:
    """keys and ``score`` of the rows that hold every term; reads the postings of the query's tokens only.

    ``entries`` is a table of ``postings``; ``lengths`` has one row: n, total
    (rows of the index and their tokens); ``n_tokens`` of a row is one of the
    entries' columns.
    """
    phrases = phrases_of(terms)
    names = [f for f in entries.schema.fields if f.name in keys]
    if not phrases:
        return entries.sparkSession.createDataFrame([], StructType([*names, StructField("score", DoubleType())]))
    n = len(phrases)
    held = counted(entries, keys, weights, phrases)
    # document frequencies and the totals: one row each
    stats = held.agg(*[F.count_if(F.col(f"_n{i}") > 0).alias(f"_d{i}") for i in range(n)]).join(F.broadcast(lengths.select(F.col("n").alias("_N"), F.col("total").alias("_L"))))
    hits = held.filter(reduce(lambda a, b: a & b, [F.col(f"_n{i}") > 0 for i in range(n)])).join(F.broadcast(stats))
    return hits.withColumn("score", scored([F.col(f"_f{i}") for i in range(n)], n)).select(*keys, "score")


def holds(fields: list[str], needle: str) -> Column:
    """Whether any field contains the needle, whatever the case."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), F.lit(needle.lower())) for c in fields])


def first_of(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows; score is minus the 1-based place in ``order``."""
    return rows.orderBy(*order).limit(limit).withColumn("score", -F.row_number().over(Window.orderBy(*order)).cast("double"))


def like(rows: DataFrame, fields: list[str], needle: str, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows with the needle in any field, by reading all rows."""
    return first_of(rows.filter(holds(fields, needle)), order, limit)


def recall_order(sort: str, *ties: str) -> list[Column]:
    if sort == "relevance":
        return [F.col("score"), F.col("ended_at").desc(), *map(F.col, ties)]
    return [F.col("ended_at" if sort == "ended" else "started_at").desc(), F.col("score"), *map(F.col, ties)]
