"""find: recall on messages and sessions, union, rerank, top n.

Over tables it is one lazy plan. Over an index the recall of each surface runs
first (heads, chosen blocks), and the plan that is left reads the texts of its rows.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_cjk, query_terms
from ..operators import blocks, grams, recall, rerank
from ..operators.selector import Selector

HIT = ["source", "session_uuid", "seq", "role", "timestamp", "content_text", "title", "cwd", "started_at", "ended_at", "score"]
ABOUT = ["session_uuid", "title", "cwd", "started_at", "ended_at", "file_path", "path_date"]


@dataclass
class FindOptions:
    limit: int = 10
    sort: str = "relevance"
    selector: Selector | None = None
    exclude: list[str] = field(default_factory=list)
    within: str | None = None
    now: str = "2024-02-01T00:00:00Z"


def _scoped(rows: DataFrame, o: FindOptions) -> DataFrame:
    """Selector, session and exclusions; applied after the statistics of the whole index."""
    if o.selector:
        rows = rows.filter(o.selector.predicate())
    if o.within is not None:
        rows = rows.filter(F.col("session_uuid") == o.within)
    drop = list(dict.fromkeys(x.strip() for x in o.exclude if x.strip()))
    return rows.filter(~F.col("session_uuid").isin(drop)) if drop else rows


class Tables:
    """Two surfaces to search: tables of messages and sessions with their token columns, read in full."""

    def __init__(self, messages: DataFrame, sessions: DataFrame):
        self.messages, self.sessions = messages, sessions

    def message_scores(self, terms: list[str]) -> DataFrame:
        return recall.bm25(self.messages, {"content_text_tokens": 1.0}, terms)

    def session_scores(self, terms: list[str]) -> DataFrame:
        return recall.bm25(self.sessions, {f"{c}_tokens": w for c, w in recall.SESSION_WEIGHTS.items()}, terms)

    def top_messages(self, terms: list[str], o: FindOptions, n: int) -> DataFrame:
        hits = _scoped(self.message_scores(terms).join(self.sessions.select(*ABOUT), "session_uuid"), o)
        return hits.orderBy(*recall.recall_order(o.sort, "seq", "session_uuid")).limit(n)

    def top_sessions(self, terms: list[str], o: FindOptions, n: int) -> DataFrame:
        return _scoped(self.session_scores(terms), o).orderBy(*recall.recall_order(o.sort, "session_uuid")).limit(n)

    def like_messages(self, needle: str, o: FindOptions, n: int) -> DataFrame:
        rows = _scoped(self.messages.join(self.sessions.select(*ABOUT), "session_uuid"), o)
        return recall.like(rows, ["content_text"], needle, _like_order(o, "seq"), n)

    def like_sessions(self, needle: str, o: FindOptions, n: int) -> DataFrame:
        return recall.like(_scoped(self.sessions, o), list(recall.SESSION_WEIGHTS), needle, _like_order(o), n)


class Indexed(Tables):
    """The same over an index on disk: rows are found by postings and sessions' columns, and texts are read of the rows found.

    A recall has at most recall_limit rows; their keys (not their texts) pass
    through the driver and become the filter that reads the messages' pages.
    """

    def __init__(self, messages: DataFrame, sessions: DataFrame, surfaces: dict[str, blocks.Surface], grams: dict[str, DataFrame]):
        super().__init__(messages, sessions)
        self.surfaces, self.grams = surfaces, grams
        self.found: dict[str, blocks.Found] = {}  #: of the last search, by surface

    def _scores(self, kind: str, terms: list[str], scope, order: list, n: int | None, prune: bool) -> DataFrame:
        self.found[kind] = blocks.best(self.surfaces[kind], terms, scope, order, n, prune)
        return self.found[kind].rows

    def message_scores(self, terms: list[str]) -> DataFrame:
        """session_uuid, seq, score of all rows that hold every term."""
        return self._scores("messages", terms, self.surfaces["messages"].live, [], None, False).drop("segment")

    def session_scores(self, terms: list[str]) -> DataFrame:
        return self._scores("sessions", terms, self.surfaces["sessions"].live, [], None, False).drop("segment", "seq")

    def _about(self, o: FindOptions):
        """Scope of a search: rows of live sessions that the options take, with what is told of a session."""
        about = _scoped(self.sessions.select(*ABOUT, "segment"), o)
        return lambda rows: rows.join(about, ["session_uuid", "segment"])

    def _held(self, hits: DataFrame) -> tuple[DataFrame, Column]:
        """The hits as a local table, and a filter that names their sessions."""
        rows = hits.collect()  # a recall limit of rows, without texts
        return hits.sparkSession.createDataFrame(rows, hits.schema), named("session_uuid", sorted({r["session_uuid"] for r in rows}))

    def _messages_of(self, hits: DataFrame) -> DataFrame:
        keys, own = self._held(hits)
        texts = self.messages.filter(own).select("session_uuid", "seq", "role", "timestamp", "content_text")
        return texts.join(F.broadcast(keys), ["session_uuid", "seq"])

    def _sessions_of(self, hits: DataFrame) -> DataFrame:
        keys, own = self._held(hits)
        texts = self.sessions.filter(own).select("session_uuid", *[c for c in recall.SESSION_WEIGHTS if c not in ABOUT])
        return texts.join(F.broadcast(keys), "session_uuid")

    def top_messages(self, terms: list[str], o: FindOptions, n: int) -> DataFrame:
        return self._messages_of(self._scores("messages", terms, self._about(o), recall.recall_order(o.sort, "seq", "session_uuid"), n, o.sort == "relevance"))

    def top_sessions(self, terms: list[str], o: FindOptions, n: int) -> DataFrame:
        return self._sessions_of(self._scores("sessions", terms, self._about(o), recall.recall_order(o.sort, "session_uuid"), n, o.sort == "relevance").drop("seq"))

    def like_messages(self, needle: str, o: FindOptions, n: int) -> DataFrame:
        rows = self._about(o)(grams.holding(self.grams["messages"], needle, ["session_uuid", "seq", "segment"], grams.CHARS))
        if not grams.decides(needle, grams.CHARS):
            texts = self.messages.select("session_uuid", "seq", "content_text")
            rows = rows.join(texts.filter(F.contains(F.lower("content_text"), F.lit(needle.lower()))).drop("content_text"), ["session_uuid", "seq"], "left_semi")
        return self._messages_of(recall.first_of(rows, _like_order(o, "seq"), n))

    def like_sessions(self, needle: str, o: FindOptions, n: int) -> DataFrame:
        rows = self._about(o)(grams.holding(self.grams["sessions"], needle, ["session_uuid", "segment"], grams.CHARS))
        if not grams.decides(needle, grams.CHARS):
            fields = list(recall.SESSION_WEIGHTS)
            texts = self.sessions.filter(recall.holds(fields, needle)).select("session_uuid")
            rows = rows.join(texts, "session_uuid", "left_semi")
        return self._sessions_of(recall.first_of(rows, _like_order(o), n))


def named(column: str, values: list[str]) -> Column:
    """Whether the column is one of the values, as a balanced tree of equalities: unlike a long IN, Parquet prunes pages by those."""
    if not values:
        return F.lit(False)
    quoted = [v.replace("\\", "\\\\").replace("'", "\\'") for v in values]
    tests = [f"{column} = '{v}'" for v in quoted]
    while len(tests) > 1:
        tests = [f"({tests[i]} OR {tests[i + 1]})" if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
    return F.expr(tests[0])  # one call, whatever the number of values


def _like_order(o: FindOptions, *ties: str) -> list[Column]:
    by = [] if o.sort == "relevance" else [F.col("ended_at" if o.sort == "ended" else "started_at").desc()]
    return [*by, F.col("started_at").desc(), *map(F.col, ties), F.col("session_uuid")]


def message_hits(on: Tables, query: str, terms: list[str], o: FindOptions) -> DataFrame:
    n = recall.recall_limit(o.limit, o.sort)
    hits = on.top_messages(terms, o, n) if terms else on.like_messages(query.strip(), o, n)
    return hits.withColumn("source", F.lit("message")).select(*HIT)


def session_hits(on: Tables, query: str, terms: list[str], o: FindOptions) -> DataFrame:
    n = recall.recall_limit(o.limit, o.sort)
    hits = on.top_sessions(terms, o, n) if terms else on.like_sessions(query.strip(), o, n)
    content = F.concat_ws("\n", *recall.SESSION_WEIGHTS)
    return hits.withColumns({"source": F.lit("session"), "seq": F.lit(None).cast("long"), "role": F.lit(None).cast("string"), "timestamp": F.lit(None).cast("string"), "content_text": content}).select(*HIT)


def union_hits(on: Tables, query: str, o: FindOptions) -> DataFrame:
    """Both surfaces, messages first; ``ord`` is a row's place. At most two recall limits of rows."""
    terms = query_terms(query)
    if not terms and not is_cjk(query):
        on = Tables(on.messages.limit(0), on.sessions.limit(0))  # nothing is found, nothing is read
    with ThreadPoolExecutor(2) as pool:  # over an index each of them runs jobs
        m, s = [x.result() for x in [pool.submit(f, on, query, terms, o) for f in (message_hits, session_hits)]]
    both = m.withColumn("surface", F.lit(0)).unionByName(s.withColumn("surface", F.lit(1)))
    first = F.col("score") if terms else -F.col("score")
    times = [] if o.sort == "relevance" else [F.col("ended_at" if o.sort == "ended" else "started_at").desc()]
    order = [F.col("surface"), *times, first, F.col("ended_at").desc(), F.col("seq"), F.col("session_uuid")]
    return both.withColumn("ord", F.row_number().over(Window.orderBy(*order)))


def anchor(on: Tables, session_uuid: str, query: str, now: str) -> DataFrame:
    """seq of the message of a session that a query meets best: recall of 20, one kept."""
    hits = message_hits(on, query, query_terms(query), FindOptions(limit=20, now=now, within=session_uuid))
    first = F.col("score") if query_terms(query) else -F.col("score")
    top = hits.orderBy(first, "seq").limit(20).withColumn("ord", F.row_number().over(Window.orderBy(first, "seq")))
    return rerank.ranked(rerank.aggregate_hits(top, rerank.classify(query), query_terms(query)), now, 1, "relevance").select("session_uuid", F.col("shown.seq").alias("seq"))


def find(on: Tables, query: str, o: FindOptions | None = None) -> DataFrame:
    """The best sessions for a query."""
    o = o or FindOptions()
    hits = union_hits(on, query, o)
    top = rerank.ranked(rerank.aggregate_hits(hits, rerank.classify(query), query_terms(query)), o.now, o.limit, o.sort)
    return top.select(
        "rank", "session_uuid", F.col("first.title").alias("title"), F.col("first.cwd").alias("cwd"), F.col("first.started_at").alias("started_at"), F.col("first.ended_at").alias("ended_at"),
        F.col("shown.source").alias("match_source"), F.col("shown.seq").alias("match_seq"), F.col("shown.role").alias("match_role"), F.col("shown.content_text").alias("content_text"),
        "hits", F.round("session_score", 4).alias("score"),
    )
