"""Exact top-k by inner product: Fagin's threshold algorithm on sorted lists.

Vectors are dealt into shards of about SHARD_ROWS; a shard holds, per
dimension, its rows sorted by that component. A query walks all its lists from
the end that its sign prefers, scores each row it meets in full, and stops when
the sum of the components last read, the bound for any row not met, is below
its k-th score. The shards' winners merge to the query's k.

Queries are a stated set: they go in blocks of about BLOCK_QUERIES, and each
block meets each shard by an equi-join on the shard number, so one row of work
has a fixed size whatever the table.

Defined results: a null id, a null vector or one with a null, NaN or infinite
component takes no part; rows that share a vec_id are candidates each, but none
of them is one for a query of that id, and where several of them are queries
their scores are ranked together; shorter vectors are filled up with zeros; an
empty vector scores 0; equal scores rank by smaller vec_id; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import written

SHARD_ROWS = 8192
BLOCK_QUERIES = 256
SCALE = 1024


def _usable(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    return rows.filter(good).select("vec_id", F.transform("embedding", lambda x: F.floor(x * SCALE)).alias("v"))


def _by_id(pdf: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending, and their vectors."""
    m = np.zeros((len(pdf), dim), np.int64)
    for i, v in enumerate(pdf["v"]):
        m[i, : len(v)] = v
    ids = pdf["vec_id"].to_numpy(np.int64)
    order = np.lexsort([*m.T[::-1], ids])
    return ids[order], m[order]


def _packer(dim: int, key: str, lists: bool):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, m = _by_id(pdf, dim)
        row = {key: [pdf[key].iloc[0]], "ids": [ids.tobytes()], "data": [m.tobytes()]}
        if lists:
            row["lists"] = [np.argsort(m.T, axis=1, kind="stable").astype(np.int32).tobytes()]
        return pd.DataFrame(row)

    return pack


def threshold_search(q: np.ndarray, own: int | None, ids: np.ndarray, m: np.ndarray, lists: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of a shard for q, ids ascending, lists[d] the rows by component d."""
    n = len(ids)
    met = np.zeros(n, bool)
    if own is not None:
        met[np.searchsorted(ids, own) : np.searchsorted(ids, own, side="right")] = True
    dims = np.flatnonzero(q)
    exact = q.astype(object) if n and float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * max(1, len(q)) >= 2**62 else q
    best_s, best_i = np.zeros(0, exact.dtype), np.zeros(0, np.int64)
    depth, step = 0, 16
    while depth < n:
        to = min(n, depth + step)
        rows = np.concatenate([lists[d, n - to : n - depth] if q[d] > 0 else lists[d, depth:to] for d in dims]) if len(dims) else np.arange(depth, to)
        rows = np.unique(rows)
        rows = rows[~met[rows]]
        met[rows] = True
        best_s = np.concatenate([best_s, m[rows] @ exact])
        best_i = np.concatenate([best_i, ids[rows]])
        order = np.lexsort([best_i, -best_s])[:k] if best_s.dtype != object else np.array(sorted(range(len(best_i)), key=lambda j: (-best_s[j], best_i[j]))[:k], int)
        best_s, best_i = best_s[order], best_i[order]
        depth, step = to, step * 2
        if len(dims):
            bound = sum(int(q[d]) * int(m[lists[d, n - depth] if q[d] > 0 else lists[d, depth - 1], d]) for d in dims)
            if len(best_s) == k and best_s[-1] > bound:
                break
        elif len(best_s) == k:  # all scores are 0 and ids ascend
            break
    return [(int(s), int(i)) for s, i in zip(best_s, best_i)]


def _searcher(dim: int, k: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple[int, int, int]] = []
            for r in pdf.itertuples(index=False):
                ids, m = np.frombuffer(r.ids, np.int64), np.frombuffer(r.data, np.int64).reshape(-1, dim)
                lists = np.frombuffer(r.lists, np.int32).reshape(dim, -1)
                qids, qs = np.frombuffer(r.query_ids, np.int64), np.frombuffer(r.query_data, np.int64).reshape(-1, dim)
                for qid, q in zip(qids, qs):
                    out += [(int(qid), i, max(-(2**63), min(2**63 - 1, s))) for s, i in threshold_search(q, int(qid), ids, m, lists, k)]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(np.int64)

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows besides itself.

    ``is_query`` is a condition on vec_id.
    """
    rows = _usable(vectors)
    n, n_queries, dim = rows.agg(F.count("*"), F.count_if(is_query), F.max(F.size("v"))).first()
    dim, shards, blocks = max(1, dim or 1), max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil((n_queries or 0) / BLOCK_QUERIES))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    packed = rows.withColumn("shard", shard).groupBy("shard").applyInPandas(_packer(dim, "shard", True), "shard int, ids binary, data binary, lists binary")
    packed = written(packed, "topk-shards")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    asked = rows.filter(is_query).withColumn("block", block).groupBy("block").applyInPandas(_packer(dim, "block", False), "block int, ids binary, data binary")
    asked = asked.select(F.col("ids").alias("query_ids"), F.col("data").alias("query_data"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    work = asked.join(packed, "shard").repartition(max(1, min(shards * blocks, 4096)))
    found = work.mapInPandas(_searcher(dim, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.pmod(F.col("vec_id"), F.lit(100)) == 0)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
