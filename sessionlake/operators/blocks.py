"""Postings in blocks with bounds of their scores, and the best rows of a query by them.

The rows of an index stand in one order (session, place), cut into blocks. A row of
the block table is a token's entries in one block, with the block's head: how many rows
of it hold the token, the most (weighted) occurrences in one of them and the least
length. Score bounds follow from heads alone, for any statistics of the index, so a
search

1. sums heads for the tokens' document frequencies,
2. keeps the blocks that hold every token, with a bound of what a row in them can score,
3. scores the blocks of greatest bound until the wanted number of rows is there,
4. and then only the blocks whose bound reaches the last of those rows.

A block left out can't hold a row of the result: its bound is below rows already found.
Heads are columns of their own, so Parquet reads the entries of chosen blocks only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import recall

BITS = 7  #: a block holds 2^BITS rows, fewer at the end of a partition
FIRST = 64  #: blocks that are scored first
LISTED = 1024  #: chosen blocks up to this number are named in the scan's filter, more are joined
SLACK = 1e-9  #: of sums in another order
SCORED = "segment string, session_uuid string, seq long, score double"


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows in order, with the ``block`` of each."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BITS))


def block_postings(rows: DataFrame, fields: list[str], weights: list[float]) -> DataFrame:
    """token, block, n, most, least, entries of numbered rows (session_uuid, seq, n_tokens, block and text fields)."""
    flat = recall.postings(rows, ["session_uuid", "seq", "n_tokens", "block"], fields)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("field") + 1)
    row = flat.groupBy("token", "block", "session_uuid", "seq", "n_tokens").agg(F.collect_list(F.struct("field", "places")).alias("fields"), F.sum(F.size("places") * weight).alias("f"))
    return row.groupBy("token", "block").agg(
        F.count("*").alias("n"), F.max("f").alias("most"), F.min("n_tokens").alias("least"), F.collect_list(F.struct("session_uuid", "seq", "n_tokens", "fields")).alias("entries"),
    )


def flat(blocks: DataFrame) -> DataFrame:
    """One row per token, row of the index and field, as ``recall.postings`` has them."""
    rows = blocks.select("token", "segment", F.inline("entries"))
    return rows.select("token", "segment", "session_uuid", "seq", "n_tokens", F.inline("fields"))


def sharing(blocks: DataFrame, tokens: list[str]) -> DataFrame:
    """segment and block of the blocks that hold every token, with m0.., l0.. (``most`` and ``least`` of each token)."""
    heads = blocks.filter(F.col("token").isin(tokens)).select("segment", "block", "token", "most", "least")
    at = [F.col("token") == t for t in tokens]
    held = heads.groupBy("segment", "block").agg(*[F.max(F.when(a, F.col("most"))).alias(f"m{i}") for i, a in enumerate(at)], *[F.min(F.when(a, F.col("least"))).alias(f"l{i}") for i, a in enumerate(at)])
    return held.filter(reduce(lambda a, b: a & b, [F.col(f"m{i}").isNotNull() for i in range(len(tokens))]))


def bound(phrases: list[list[str]], tokens: list[str], idf: list[float], n: float, total: float) -> Column:
    """The most that a row of a ``sharing`` block can score.

    A phrase occurs no more often than its rarest token, and a row with all tokens
    has at least the greatest of their least lengths.
    """
    least = F.greatest(F.lit(0), *[F.col(f"l{i}") for i in range(len(tokens))])
    out = F.lit(0.0)
    for p, weight in zip(phrases, idf):
        f = F.least(F.lit(float("inf")), *[F.col(f"m{tokens.index(t)}") for t in p])
        out = out + weight * f * (recall.K1 + 1) / (f + recall.K1 * (1 - recall.B + recall.B * least / (total / n)))
    return out


@dataclass
class Surface:
    """What can be searched: its block table, number of rows and tokens, and how often dead rows still count."""

    blocks: DataFrame
    n: int
    total: int
    weights: list[float]
    dead: DataFrame | None = None  #: token, n
    live: Callable[[DataFrame], DataFrame] = lambda rows: rows  #: keeps the live ones of rows with session_uuid, segment

    def frequencies(self, phrases: list[list[str]]) -> list[int]:
        """How many live rows hold each phrase: for single tokens from heads alone."""
        single = sorted({p[0] for p in phrases if len(p) == 1})
        count: dict[tuple, int] = {}
        if single:
            heads = self.blocks.filter(F.col("token").isin(single)).select("token", "n")
            if self.dead is not None:
                heads = heads.unionByName(self.dead.filter(F.col("token").isin(single)).select("token", (-F.col("n")).alias("n")))
            count |= {(r["token"],): r["n"] for r in heads.groupBy("token").agg(F.sum("n").alias("n")).collect()}  # a row per token asked for
        for p in {tuple(p) for p in phrases if len(p) > 1}:
            some = self.chosen(sorted(set(p)), sharing(self.blocks, sorted(set(p))))
            held = recall.counted(self.live(flat(some)), ["session_uuid", "seq"], self.weights, [list(p)])
            count[p] = held.filter("_n0 > 0").count()
        return [count.get(tuple(p), 0) for p in phrases]

    def chosen(self, tokens: list[str], which: DataFrame | list) -> DataFrame:
        """The tokens' entries in some blocks."""
        own = self.blocks.filter(F.col("token").isin(tokens))
        if isinstance(which, DataFrame):
            return own.join(which.select("segment", "block"), ["segment", "block"], "left_semi")
        by: dict[str, list[int]] = {}
        for r in which:
            by.setdefault(r["segment"], []).append(r["block"])
        return own.filter(reduce(lambda a, b: a | b, [(F.col("segment") == s) & F.col("block").isin(x) for s, x in by.items()], F.lit(False)))

    def scored(self, blocks: DataFrame, phrases: list[list[str]], d: list[int]) -> DataFrame:
        """segment, session_uuid, seq, score of the rows of these blocks that hold every phrase."""
        held = recall.counted(flat(blocks), ["segment", "session_uuid", "seq"], self.weights, phrases)
        held = held.filter(reduce(lambda a, b: a & b, [F.col(f"_n{i}") > 0 for i in range(len(phrases))]))
        held = held.withColumns({"_N": F.lit(self.n), "_L": F.lit(self.total), **{f"_d{i}": F.lit(x) for i, x in enumerate(d)}})
        return held.withColumn("score", recall.scored([F.col(f"_f{i}") for i in range(len(phrases))], len(phrases))).select("segment", "session_uuid", "seq", "score")


@dataclass
class Found:
    rows: DataFrame
    read: int | None = None  #: blocks whose entries were chosen; None where they are joined, uncounted
    of: Callable[[], int] = lambda: 0  #: blocks that hold every token


def best(on: Surface, terms: list[str], scope: Callable[[DataFrame], DataFrame], order: list[Column], n: int | None, prune: bool = True) -> Found:
    """The first n rows in ``order`` of those that hold every term and are in scope; all of them, in no order, without n.

    ``scope`` keeps or drops rows (segment, session_uuid, seq, score) and may add columns.
    ``prune`` holds where ``order`` begins with the score, ascending (less is better).
    """
    phrases = recall.phrases_of(terms)
    d = on.frequencies(phrases) if phrases else []
    if not phrases or not all(d):
        return Found(scope(on.blocks.sparkSession.createDataFrame([], SCORED)).limit(0), 0)
    tokens = sorted({t for p in phrases for t in p})

    def top(which: DataFrame | list) -> DataFrame:
        rows = scope(on.scored(on.chosen(tokens, which), phrases, d))
        return rows if n is None else rows.orderBy(*order).limit(n)

    idf = [recall.idf_of(on.n, x) for x in d]
    shared = sharing(on.blocks, tokens).withColumn("bound", bound(phrases, tokens, idf, on.n, on.total)).select("segment", "block", "bound")
    of = shared.count
    some = FIRST if prune else LISTED
    while some <= LISTED:
        first = shared.orderBy(F.desc("bound"), "segment", "block").limit(some + 1).collect()  # heads of at most LISTED blocks
        if len(first) <= some:
            return Found(top(first), len(first), of)
        if not prune:
            break
        got = top(first[:some]).agg(F.count("*").alias("rows"), F.max("score").alias("last")).first()
        if got["rows"] == n:
            reach = shared.filter(F.col("bound") >= -got["last"] - SLACK)
            listed = reach.limit(LISTED + 1).collect()
            return Found(top(listed), len(listed), of) if len(listed) <= LISTED else Found(top(reach), None, of)
        some *= 8
    return Found(top(shared), None, of)
