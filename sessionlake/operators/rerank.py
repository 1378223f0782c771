"""Session rerank of recalled rows: signals, aggregation, final order."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_terms, words


@dataclass(frozen=True)
class QueryProfile:
    query: str
    is_multi_term: bool
    has_digits: bool
    has_path_chars: bool

    @property
    def kind(self) -> str:
        return "exact" if self.is_multi_term or self.has_digits or self.has_path_chars else "broad"

    @property
    def is_path_like_command(self) -> bool:
        return self.is_multi_term and self.has_path_chars


def classify(query: str) -> QueryProfile:
    q = query.strip().lower()
    return QueryProfile(q, len(q.split()) >= 2, bool(re.search(r"\d", q)), bool(re.search(r"[\\/._:-]", q)))


def profile_columns(q: Column) -> dict[str, Column]:
    """The same classification for a column of queries."""
    low = F.lower(F.regexp_replace(q, r"(?U)^\s+|\s+$", ""))
    multi, digits, path = F.size(F.split(low, r"\s+")) >= 2, low.rlike(r"\d"), low.rlike(r"[\\/._:\-]")
    return {"normalized": low, "is_multi_term": multi, "has_digits": digits, "kind": F.when(multi | digits | path, "exact").otherwise("broad"), "is_path_like_command": multi & path}


_EDGE = r"\p{L}\p{N}_./\-"


def bounded_phrase(c: Column, phrase: str) -> Column:
    """phrase occurs with no letter, digit or _ . / - right before or after it."""
    return c.rlike(f"(?<![{_EDGE}])" + re.sub(r"([^\w\s])", r"\\\1", phrase) + f"(?![{_EDGE}])")


def matched_terms(c: Column, terms: list[str]) -> Column:
    low = F.lower(c)
    return sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))


def ordered_span(tokens: Column, terms: list[str]) -> Column:
    """Fewest tokens skipped by a match of the terms in order, from any place of the first term; null if none.

    The places of the terms, in order, are swept once. The state holds, for every k,
    the latest start of a match of the first k terms: of all matches that end at a
    place, that one skips fewest.
    """
    n, wanted = len(terms), F.array(*map(F.lit, terms))
    which = lambda t: F.array_position(wanted, t).cast("int")
    places = F.transform(tokens, lambda t, i: F.when(F.array_contains(wanted, t), F.struct(which(t).alias("k"), i.alias("i"))))
    places = F.filter(places, lambda p: p.isNotNull())

    def step(state: Column, p: Column) -> Column:
        begun = F.when(p["k"] == 1, p["i"]).otherwise(F.try_element_at(state["starts"], F.when(p["k"] > 1, p["k"] - 1)))
        starts = F.transform(state["starts"], lambda s, j: F.when(j + 1 == p["k"], F.coalesce(begun, s)).otherwise(s))
        done = F.when(p["k"] == n, p["i"] - begun + 1 - n)
        return F.struct(starts.alias("starts"), F.least(state["best"], done).alias("best"))

    none = F.lit(None).cast("int")
    start = F.struct(F.array_repeat(none, n).alias("starts"), none.alias("best"))
    return F.aggregate(places, start, step, lambda s: s["best"])


def bound_once(value: Column, use) -> Column:
    """use(value) with the value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def command_bonus(content: Column, profile: QueryProfile, terms: list[str]) -> Column:
    if not profile.is_path_like_command or len(terms) < 2:
        return F.lit(0.0)
    tail = lambda gap: F.when(gap.isNull(), 0).when(gap == 0, 8).when(gap <= 3, 24 - 2 * gap).when(gap <= len(terms), 10 - gap).otherwise(0)
    return F.when(bounded_phrase(F.lower(content), profile.query), 36).otherwise(bound_once(ordered_span(words(content), terms), tail)).cast("double")


def row_signal(profile: QueryProfile, terms: list[str]) -> Column:
    content = F.col("content_text")
    phrase = bounded_phrase(F.lower(content), profile.query) if profile.is_path_like_command else F.contains(F.lower(content), F.lit(profile.query))
    return (
        -F.col("score") + 8 * phrase.cast("int") + command_bonus(content, profile, terms) + 2 * matched_terms(content, terms)
        + 4 * (F.col("source") == "message").cast("int") + 2 * (F.coalesce(F.col("role"), F.lit("")) == "user").cast("int")
    )


def recency(ended_at: Column, now: str) -> Column:
    days = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.try_to_timestamp(ended_at))) / 86400.0
    return F.coalesce(F.greatest(F.lit(0.0), F.lit(18.0) - 0.15 * F.greatest(F.lit(0.0), days)), F.lit(0.0))


def aggregate_hits(hits: DataFrame, profile: QueryProfile, terms: list[str]) -> DataFrame:
    """One row per session; hits hold ``ord``, their place in the union."""
    title = F.lower("title")
    title_hit = bounded_phrase(title, profile.query) if profile.is_path_like_command else F.contains(title, F.lit(profile.query))
    rows = hits.withColumns({"signal": row_signal(profile, terms), "title_phrase": title_hit, "title_terms": matched_terms(F.col("title"), terms), "cwd_terms": matched_terms(F.col("cwd"), terms)})
    is_message = F.col("source") == "message"
    shown = F.struct("source", "seq", "role", "timestamp", "content_text")
    return rows.groupBy("session_uuid").agg(
        F.count("*").alias("hits"), F.count_if(~is_message).alias("session_hits"), F.count_if(is_message & (F.col("role") == "user")).alias("user_hits"),
        F.bool_or("title_phrase").alias("title_phrase"), F.max("title_terms").alias("title_terms"), F.max("cwd_terms").alias("cwd_terms"), F.max("signal").alias("signal"),
        F.max_by(shown, F.struct(is_message.cast("int").alias("m"), "signal", (-F.col("ord")).alias("o"))).alias("shown"),
        F.min_by(F.struct("ended_at", "started_at", "title", "cwd"), "ord").alias("first"), F.min("ord").alias("first_ord"),
    )


def session_score(now: str) -> Column:
    return (
        F.col("signal") + 30 * F.col("title_phrase").cast("int") + 10 * F.col("title_terms") + 18 * F.col("cwd_terms") + 4 * F.least(F.col("user_hits"), F.lit(3))
        + 2 * F.least(F.col("session_hits"), F.lit(2)) + 1.5 * F.least(F.col("hits"), F.lit(6)) + recency(F.col("first.ended_at"), now)
    )


def ranked(aggregated: DataFrame, now: str, limit: int, sort: str = "relevance") -> DataFrame:
    rows = aggregated.withColumn("session_score", session_score(now))
    order = [F.col("session_score").desc(), F.col("first.ended_at").desc(), F.col("first_ord")]
    if sort != "relevance":
        order = [F.col(f"first.{sort}_at").desc(), F.col("session_score").desc(), F.col("first_ord")]
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
