"""Entropy balancing of sources to token targets (DataFrame operators only).

Documents are the units of the reference measure. Among all rates r_i between 0
and ``cap``, the balancing picks those of least relative entropy
``sum r_i ln r_i - r_i + 1`` whose sources meet their token targets,
``sum_s r_i size_i = T_s``. The optimum is an exponential tilt by size,
``r_i = min(cap, exp(lambda_s x_i))`` with x_i = size_i / mean size of the
source, and the multipliers minimise the convex dual. They come from Newton
steps: each sums gradient and Hessian over the documents of all sources (as
counts by source and size, which say all about them), and a step that would leave
the bracket found so far halves it instead.

Rates then become copies: everybody gets floor(r) copies, and a further one goes
to the documents that come first by a keyed hash over the rate's fraction, so
that a fraction twice as large comes first twice as often. The place where a
source's target is reached is found by histogram search, so that no source is
ever gathered in one task.

Defined results: null text has size 0; a document of size 0 has the rate 1 where
its source has a target; a null source is a source of its own, ordered last; a
null doc_id hashes as '', and rows of one doc_id are told apart by their texts and,
within those, by a number; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import released, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
NEWTON_STEPS = 60
PRECISION = 1e-10  #: of a source's target
FILL_ROUNDS = 3
BUCKET_BITS = 10
FEW_ROWS = 200_000  #: tables of at most so many rows (a source and size each) are summed in one task
PLACE_BITS = 62  #: of a document's place in the order of further copies


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-space characters; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEAT) -> DataFrame:
    """One row per source: source, source_size, target.

    Shares go by weight; a target stops at ``cap`` times the source's size and
    the excess is shared again by weight. The fixed point is
    ``min(cap * S, c * w)``, and c comes from the sources sorted by the level
    at which they saturate. The table has one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight)
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = (
        per.withColumn("full_size", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("level", (F.col("total") - cap * F.col("full_size")).cast("double") / F.col("open_weight").cast("double"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.lit(cap) * F.col("source_size"))
    )
    per = per.withColumn("place", F.row_number().over(by_level))
    level = F.min_by("level", F.when(F.col("fits"), F.col("place"))).over(every)
    return per.select("source", "source_size", F.least((F.lit(cap) * F.col("source_size")).cast("double"), level * F.col("weight")).alias("target"))


def balance(sizes: DataFrame, targets: DataFrame, cap: int = MAX_REPEAT) -> DataFrame:
    """targets with the mean size of a source's documents that have words, and its multiplier ``tilt``."""
    held = written(sizes.filter("size > 0").groupBy(F.col("source").alias("of"), "size").agg(F.count("*").alias("n")), "mix-sizes-by-source")
    # a step over a small table is one task and no shuffle
    few = held.count() + targets.count() <= FEW_ROWS
    held, targets = (held.coalesce(1), targets.coalesce(1)) if few else (held, targets)
    means = held.groupBy("of").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-9)
    none = F.lit(None).cast("double")
    state = targets.join(means, targets.source.eqNullSafe(means.of), "left").select(
        "source", "source_size", "target", "mean", F.lit(0.0).alias("tilt"), none.alias("lo"), none.alias("hi"), (full | (F.col("source_size") <= 0) | (F.col("target") <= 0)).alias("done"), full.alias("full")
    )
    state = table = written(state, "mix-tilt")
    for _ in range(NEWTON_STEPS):
        state = table.coalesce(1) if few else table
        if state.filter("NOT done").isEmpty():
            return state.select("source", "source_size", "target", "mean", "tilt", "full")
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(cap)), F.exp(F.col("tilt") * x))
        weight = F.col("n") * F.col("size")
        sums = held.join(state.filter("NOT done"), held.of.eqNullSafe(state.source)).groupBy("of").agg(F.sum(weight * rate).alias("g"), F.sum(F.when(rate < cap, weight * x * rate).otherwise(0.0)).alias("h"))
        after = written(_stepped(state.join(sums, state.source.eqNullSafe(sums.of), "left")), "mix-tilt")
        released(table)
        table = after
    raise RuntimeError(f"balance: no multipliers after {NEWTON_STEPS} steps")


def _stepped(rows: DataFrame) -> DataFrame:
    """One safeguarded Newton step of every source that isn't done (gradient ``g`` less the target, Hessian ``h``)."""
    gap, tilt = F.col("g") - F.col("target"), F.col("tilt")
    lo, hi = F.when(gap < 0, tilt).otherwise(F.col("lo")), F.when(gap >= 0, tilt).otherwise(F.col("hi"))
    newton, far = tilt - gap / F.col("h"), F.greatest(F.lit(1.0), F.abs(tilt))
    inside = (F.col("h") > 0) & F.coalesce(newton > lo, F.lit(True)) & F.coalesce(newton < hi, F.lit(True))
    safe = F.when(hi.isNull(), tilt + far).when(lo.isNull(), tilt - far).otherwise((lo + hi) / 2)
    met = F.abs(gap) <= PRECISION * F.col("target")
    keep = F.col("done") | met
    return rows.select(
        "source", "source_size", "target", "mean", F.when(keep, tilt).when(inside, newton).otherwise(safe).alias("tilt"),
        F.when(keep, F.col("lo")).otherwise(lo).alias("lo"), F.when(keep, F.col("hi")).otherwise(hi).alias("hi"), keep.alias("done"), "full",
    )


def _rated(rows: DataFrame, plan: DataFrame, rounds: int, cap: int) -> DataFrame:
    """rows with rate, copies after that many rounds of further ones, most (copies) and place; ``plan`` has a row a source."""
    of = plan.withColumnRenamed("source", "plan_source")
    rows = rows.join(of, rows.source.eqNullSafe(of.plan_source), "left").drop("plan_source")
    tilted = F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.col("tilt") * F.col("size") / F.col("mean"))))
    rate = F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.round(tilted, 9)).otherwise(0.0)
    rows = rows.withColumn("rate", rate).withColumn("copies", F.floor("rate").cast("long")).withColumn("most", F.least(F.ceil("rate").cast("long"), F.lit(cap)))
    part = F.col("rate") - F.col("copies")
    rows = rows.withColumn("place", F.when(part > 0, F.least(F.floor(F.col("u") / part), F.lit(1 << (PLACE_BITS - 1))).cast("long")))
    for i in range(rounds):
        rows = rows.withColumn("copies", F.col("copies") + F.coalesce((_open(F.col(f"need{i}")) & (F.col("place") <= F.col(f"cut{i}"))).cast("long"), F.lit(0)))
    return rows


def _open(need: Column) -> Column:
    """Documents that may have a further copy of at most ``need`` words."""
    return (F.col("size") > 0) & (F.col("size") <= need) & (F.col("copies") < F.col("most"))


def _cut(rows: DataFrame) -> DataFrame:
    """Per source, the largest place so that all rows (source, place, size, need) up to it hold <= need words.

    Two histogram levels narrow the boundary down to 1 / 2^20 of all places
    before any rows are ordered within a task. A source whose first row is
    already too large has no cut.
    """
    left = rows.select("source", "place", "size", "need", F.lit(0).cast("long").alias("base"))
    for i in range(2):
        shift = PLACE_BITS - BUCKET_BITS * (i + 1)
        left = left.withColumn("bucket", F.shiftright("place", shift))
        hist = left.groupBy("source", "bucket", "need", "base").agg(F.sum("size").alias("held"))
        running = F.col("base") + F.sum("held").over(Window.partitionBy("source").orderBy("bucket"))
        edge = hist.withColumn("upto", running).groupBy("source").agg(
            F.min(F.when(F.col("upto") > F.col("need"), F.col("bucket"))).alias("edge"),
            F.max(F.when(F.col("upto") <= F.col("need"), F.col("upto"))).alias("under"),
            F.max("bucket").alias("last"),
        )
        edge = written(edge.select(F.col("source").alias("edge_source"), F.coalesce("edge", F.col("last")).alias("edge"), F.when(F.col("edge").isNull(), F.lit(None)).otherwise(F.col("under")).alias("under"), F.col("edge").isNull().alias("all")), "mix-edge")
        left = left.join(edge, left.source.eqNullSafe(edge.edge_source) & (left.bucket == edge.edge))
        # where all buckets fit, the last bucket's own rows end the search at its top
        left = left.select("source", "place", "size", F.when(F.col("all"), F.lit(2**62)).otherwise(F.col("need")).cast("long").alias("need"), F.coalesce("under", "base").alias("base"))
    rest = PLACE_BITS - 2 * BUCKET_BITS
    upto = F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy("place").rangeBetween(Window.unboundedPreceding, 0))
    last = left.withColumn("upto", upto).groupBy("source").agg(F.max(F.when(F.col("upto") <= F.col("need"), F.col("place"))).alias("cut"), (F.shiftleft(F.shiftright(F.min("place"), rest), rest) - 1).alias("below"))
    return last.select(F.col("source").alias("cut_source"), F.coalesce("cut", "below").alias("cut"))


_OWN = ("doc_id", "source", "size", "u", "same", "text_hash", "number", "source_size", "target", "mean", "tilt", "full", "rate", "copies", "most", "place", "taken", "plan_source")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEAT, key: str = "mix", carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken, for each row of docs.

    ``copies`` is floor(rate) or one more; ``taken`` is copies * size, at most
    ``cap * size``. The further copies fill each source's remaining words: the
    documents first in order while they fit, then, for what is left, those small
    enough to fit it, FILL_ROUNDS times. With ``carry`` the other columns of docs
    (unless called like one of these) come along; documents meet only a table of
    a row per source, so they aren't shuffled unless rows of one doc_id have equal
    texts.
    """
    extra = [c for c in docs.columns if c not in _OWN and not c.startswith(("need", "cut"))] if carry else []

    def measured(*more: str) -> DataFrame:
        return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"), *more)

    def hashed(rows: DataFrame) -> DataFrame:
        number = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("size")) if repeated else F.lit(1)
        u = F.md5(F.concat_ws(":", F.lit(key), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_hash", number.cast("string")))
        return rows.withColumn("u", F.conv(F.substring(u, 1, 15), 16, 10).cast("long")).drop("text_hash")

    plain = written(measured(), "mix-measured")
    repeated = not plain.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty()
    sizes = written(hashed(plain), "mix-sizes")
    released(plain)
    plan = balance(sizes, written(source_targets(sizes, weights, cap), "mix-targets"), cap)
    for i in range(FILL_ROUNDS):
        rows = _rated(sizes, plan, i, cap)
        per = rows.groupBy(F.col("source").alias("need_source")).agg(F.floor(F.first("target") - F.sum(F.col("copies") * F.col("size"))).cast("long").alias(f"need{i}"))
        plan = written(plan.join(per, plan.source.eqNullSafe(per.need_source), "left").drop("need_source"), "mix-plan")
        open_ = _rated(sizes, plan, i, cap).filter(_open(F.col(f"need{i}")) & F.col("place").isNotNull())
        cut = written(_cut(open_.select("source", "place", "size", F.col(f"need{i}").alias("need"))), "mix-cut")
        plan = written(plan.join(cut, plan.source.eqNullSafe(cut.cut_source), "left").drop("cut_source").withColumnRenamed("cut", f"cut{i}"), "mix-plan")
    rows = _rated(hashed(measured(*extra)) if carry else sizes, plan, FILL_ROUNDS, cap)
    return rows.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), *extra)


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def _fill_sql() -> str:
    """The filling in hash order as window sums, three CTEs a round."""
    parts, before = [], "r0"
    for i in range(1, FILL_ROUNDS + 1):
        parts.append(f"""n{i} AS (SELECT *, CAST(floor(target - sum(copies * size) OVER (PARTITION BY source)) AS BIGINT) AS need FROM {before}),
e{i} AS (SELECT *, size > 0 AND size <= need AND copies < most AND place IS NOT NULL AS ok FROM n{i}),
r{i} AS (SELECT doc_id, source, size, place, source_size, target, rate, most,
  copies + CASE WHEN ok AND sum(CASE WHEN ok THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY place) <= need THEN 1 ELSE 0 END AS copies FROM e{i})""")
        before = f"r{i}"
    return ",\n".join(parts)


OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':' || row_number() OVER (PARTITION BY doc_id, coalesce(text, ''))), 1, 15) AS BIGINT) AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, sum(size) / count(*) FILTER (size > 0) AS mean FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
l AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
  coalesce(sum(source_size) OVER o, 0) AS full_size, coalesce(sum(weight) OVER o, 0) AS full_weight FROM w
  WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / CAST(weight AS DOUBLE), source NULLS LAST) AS place, CAST(total - 3 * full_size AS DOUBLE) / CAST(all_weight - full_weight AS DOUBLE) AS level FROM l),
t AS (SELECT source, source_size, mean, least(CAST(3 * source_size AS DOUBLE), (SELECT arg_min(level, place) FROM c WHERE level * weight <= 3 * source_size) * weight) AS target FROM c),
f AS (SELECT *, target >= 3 * source_size * (1 - 1e-9) AS "full" FROM t),
h AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY source, size),
b AS (SELECT source, target, mean, 0 AS k, CAST(0 AS DOUBLE) AS tilt, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi, "full" OR source_size <= 0 OR target <= 0 AS done FROM f
  UNION ALL
  SELECT source, target, mean, k + 1,
    CASE WHEN abs(gap) <= {PRECISION} * target THEN tilt WHEN hess > 0 AND coalesce(tilt - gap / hess > lo2, TRUE) AND coalesce(tilt - gap / hess < hi2, TRUE) THEN tilt - gap / hess
      WHEN hi2 IS NULL THEN tilt + greatest(1, abs(tilt)) WHEN lo2 IS NULL THEN tilt - greatest(1, abs(tilt)) ELSE (lo2 + hi2) / 2 END,
    lo2, hi2, abs(gap) <= {PRECISION} * target
  FROM (SELECT b.source, target, mean, k, tilt, g - target AS gap, hess, CASE WHEN g < target THEN tilt ELSE lo END AS lo2, CASE WHEN g >= target THEN tilt ELSE hi END AS hi2 FROM
    (SELECT b.source, any_value(target) AS target, any_value(mean) AS mean, any_value(k) AS k, any_value(tilt) AS tilt, any_value(lo) AS lo, any_value(hi) AS hi,
      sum(n * size * least(3, exp(tilt * size / mean))) AS g, sum(CASE WHEN exp(tilt * size / mean) < 3 THEN n * size * size / mean * exp(tilt * size / mean) ELSE 0 END) AS hess
     FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source WHERE NOT done AND k < {NEWTON_STEPS} GROUP BY b.source) AS b)),
m AS (SELECT source, arg_max(tilt, k) AS tilt FROM b GROUP BY source),
q AS (SELECT doc_id, d.source, size, u, f.source_size, f.target, CASE WHEN f.source_size > 0 AND f.target > 0 THEN round(CASE WHEN f."full" THEN 3 ELSE least(3, exp(m.tilt * size / f.mean)) END, 9) ELSE 0 END AS rate
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source JOIN m ON d.source IS NOT DISTINCT FROM m.source),
r0 AS (SELECT doc_id, source, size, source_size, target, rate, CAST(ceil(rate) AS BIGINT) AS most, CAST(floor(rate) AS BIGINT) AS copies,
  CASE WHEN rate > floor(rate) THEN CAST(least(floor(u / (rate - floor(rate))), {1 << (PLACE_BITS - 1)}) AS BIGINT) END AS place FROM q),
{_fill_sql()}
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM r{FILL_ROUNDS}
"""
