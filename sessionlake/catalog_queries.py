"""Query catalogue of the retrieval engine: Spark queries and their SQL oracles.

Oracles are written from the operators' meaning over the same tables; ``_BASE``
holds the conversations as messages and sessions.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import snippets
from .functions import text as X
from .operators import derive, evaluation, grams, reading, recall, rerank
from .operators.selector import Selector, implies
from .plans import adapter, sync
from .plans.adapter import NOW, ROOT
from .plans.find import FindOptions, Tables, anchor, find, message_hits, session_hits, union_hits
from .sources import jsonl

QUERY = "reti of"
TERMS = ["reti", "of"]
PHRASE = ["of", "the"]
NEEDLE = "ing th"
PATHLIKE = "the of. and"
SESSION = "conv-000003"

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _m(spark, d):
    return adapter.messages(spark, d).drop("conv_id")


def _s(spark, d):
    return adapter.sessions(spark, d).drop("conv_id")


def _mt(spark, d):
    return adapter.tokenised(_m(spark, d), "content_text")


def _st(spark, d):
    return adapter.tokenised(_s(spark, d), *recall.SESSION_WEIGHTS)


def _on(spark, d):
    """Both surfaces as tables, read in full."""
    return Tables(_mt(spark, d), _st(spark, d))


def _indexed(spark, d):
    """The same surfaces from the index on disk."""
    return adapter.stored(spark, d).searched()


_BASE = r"""
WITH messages AS (SELECT 'conv-' || lpad(CAST(conv_id AS VARCHAR), 6, '0') AS session_uuid, conv_id,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, role, text AS content_text,
  strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') AS "timestamp"
  FROM conversations WHERE role IN ('user', 'assistant')),
flat AS (SELECT *, trim(regexp_replace(content_text, '\s+', ' ', 'g')) AS t FROM messages),
per AS (SELECT session_uuid, any_value(conv_id) AS conv_id, count(*) AS message_count, min("timestamp") AS started_at, max("timestamp") AS ended_at,
  coalesce(substr(arg_min(content_text, seq) FILTER (role = 'user'), 1, 120), '(no title)') AS title,
  'user: ' || (arg_min(t, seq) FILTER (role = 'user')) AS u1, 'assistant: ' || (arg_min(t, seq) FILTER (role = 'assistant')) AS a1,
  CASE WHEN (max(seq) FILTER (role = 'user')) <> (min(seq) FILTER (role = 'user')) THEN 'follow-up: ' || (arg_max(t, seq) FILTER (role = 'user')) END AS u2,
  CASE WHEN (max(seq) FILTER (role = 'assistant')) <> (min(seq) FILTER (role = 'assistant')) THEN 'latest: ' || (arg_max(t, seq) FILTER (role = 'assistant')) END AS a2
  FROM flat GROUP BY session_uuid),
notes AS (SELECT conv_id, substr(string_agg(t, ' | ' ORDER BY turn), 1, 4000) AS compact_text FROM
  (SELECT conv_id, t, min(turn) AS turn FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'system') WHERE t <> '' GROUP BY conv_id, t) GROUP BY conv_id),
sessions AS (SELECT session_uuid, title, substr(concat_ws(' | ', u1, a1, u2, a2), 1, 480) AS summary_text, coalesce(compact_text, '') AS compact_text, '' AS reasoning_summary_text,
  started_at, ended_at, message_count, '/work/proj-' || CAST(per.conv_id % 7 AS VARCHAR) AS cwd, strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(per.conv_id AS INTEGER)), '%Y-%m-%d') AS path_date,
  '/data/sessions/' || strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(per.conv_id AS INTEGER)), '%Y/%m/%d/rollout-%Y-%m-%dT%H-%M-%S-') || session_uuid || '.jsonl' AS file_path
  FROM per LEFT JOIN notes USING (conv_id))"""


def _toks(c: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower({c})), '[\p{{L}}\p{{M}}\p{{N}}]+')"


def _cnt(tok: str, p: list[str]) -> str:
    """Occurrences of a phrase of one or two words in a list of tokens."""
    if len(p) == 1:
        return f"len(list_filter({tok}, lambda x: x = '{p[0]}'))"
    return f"len(list_filter(list_zip({tok}, {tok}[2:]), lambda z: z[1] = '{p[0]}' AND z[2] = '{p[1]}'))"


def _bm25_sql(table: str, cols: dict[str, float], phrases: list[list[str]], keys: str) -> str:
    """CTEs tok, st and bm: rows of the table with every phrase and their score."""
    toks = ", ".join(f"{_toks(c)} AS t_{i}" for i, c in enumerate(cols))
    size = " + ".join(f"len(t_{i})" for i in range(len(cols)))
    ns = ", ".join(f"{' + '.join(_cnt(f't_{i}', p) for i in range(len(cols)))} AS n{k}" for k, p in enumerate(phrases))
    ws = ", ".join(f"{' + '.join(f'{w} * {_cnt(f't_{i}', p)}' for i, w in enumerate(cols.values()))} AS f{k}" for k, p in enumerate(phrases))
    ds = ", ".join(f"count(*) FILTER (n{k} > 0) AS d{k}" for k in range(len(phrases)))
    score = " ".join(f"- (CASE WHEN ln((N - d{k} + 0.5) / (d{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((N - d{k} + 0.5) / (d{k} + 0.5)) END) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for k in range(len(phrases)))
    every = " AND ".join(f"n{k} > 0" for k in range(len(phrases)))
    return f"""tok_{table} AS (SELECT {keys}, {toks} FROM {table}),
cnt_{table} AS (SELECT {keys}, {size} AS dl, {ns}, {ws} FROM tok_{table}),
st_{table} AS (SELECT count(*) AS N, sum(dl) / count(*) AS avgdl, {ds} FROM cnt_{table}),
bm_{table} AS (SELECT {keys}, {score} AS score FROM cnt_{table}, st_{table} WHERE {every})"""


# --- scan and derive
@query("scan_path_date", _BASE + " SELECT file_path, path_date FROM sessions")
def _(spark, d):
    return _s(spark, d).select("file_path", derive.path_date(F.col("file_path")).alias("path_date"))


@query("scan_source_root", _BASE + " SELECT file_path, '/data/sessions' AS source_root FROM sessions")
def _(spark, d):
    return _s(spark, d).select("file_path", derive.source_root(F.col("file_path")).alias("source_root"))


@query("scan_json_lines", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS ok FROM events")
def _(spark, d):
    v = F.try_parse_json("props")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.try_variant_get(v, "$.k", "string").alias("k"), v.isNotNull().alias("ok"))


def _logs(spark, d):
    """Each conversation as a log: a session_meta record, a line that isn't JSON, then its turns."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    kind = F.when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "agent_message").otherwise("other")
    record = lambda type_, payload: F.to_json(F.struct(F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.lit(type_).alias("type"), payload.alias("payload")))
    turn = record("event_msg", F.struct(kind.alias("type"), F.col("text").alias("message")))
    id_ = F.format_string("%08d-0000-4000-8000-000000000000", "conv_id")
    files = c.withColumn("line", turn).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("body"))
    head = record("session_meta", F.struct(id_.alias("id"), F.lit("/work").alias("cwd")))
    return files.select(F.concat(F.lit("/logs/2024/01/01/rollout-"), id_, F.lit(".jsonl")).alias("file_path"), F.concat(head, F.lit("\nnot json\n"), "body").alias("value"))


_LOG_SQL = """WITH c AS (SELECT *, '/logs/2024/01/01/rollout-' || lpad(CAST(conv_id AS VARCHAR), 8, '0') || '-0000-4000-8000-000000000000.jsonl' AS file_path,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS line_no, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS said FROM conversations)"""


@query("scan_records", _LOG_SQL + """ SELECT file_path, line_no, role AS kind, said AS text FROM c WHERE role IN ('user', 'assistant') UNION ALL SELECT DISTINCT file_path, 0, 'session_meta', NULL FROM c""")
def _(spark, d):
    return jsonl.fields(_logs(spark, d)).select("file_path", F.col("line_no").cast("long").alias("line_no"), "kind", "text")


@query("scan_sessions", _LOG_SQL + """, k AS (SELECT * FROM c WHERE role IN ('user', 'assistant') AND said <> '')
SELECT file_path, substr(file_path, 26, 36) AS session_uuid, '/work' AS cwd, '2024-01-01' AS path_date, count(k.said) AS message_count, CASE WHEN count(k.said) > 0 THEN 'parsed' ELSE 'skipped' END AS verdict
FROM (SELECT DISTINCT file_path FROM c) LEFT JOIN k USING (file_path) GROUP BY file_path""")
def _(spark, d):
    files = _logs(spark, d)
    listed = files.select("file_path", F.lit(0).cast("long").alias("mtime"), F.lit(0).cast("long").alias("size"), derive.path_date(F.col("file_path")).alias("path_date"))
    return jsonl.parsed_sessions(listed, jsonl.fields(files)).select("file_path", "session_uuid", "cwd", "path_date", "message_count", "verdict")


@query("message_seq", _BASE + " SELECT session_uuid, seq, role FROM messages")
def _(spark, d):
    return _m(spark, d).select("session_uuid", "seq", "role")


@query("session_bounds", _BASE + " SELECT session_uuid, started_at, ended_at FROM sessions")
def _(spark, d):
    return _s(spark, d).select("session_uuid", "started_at", "ended_at")


@query("session_verdict", """SELECT conv_id, CASE WHEN count(*) FILTER (role = 'system') > 0 AND count(*) FILTER (role <> 'system') = 0 THEN 'filtered'
  WHEN count(*) FILTER (role <> 'system') = 0 THEN 'skipped' ELSE 'parsed' END AS verdict FROM conversations GROUP BY conv_id""")
def _(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.count_if(F.col("role") == "system").alias("i"), F.count_if(F.col("role") != "system").alias("k"))
    return c.select("conv_id", derive.verdict(F.col("i"), F.col("k"), F.lit("x")).alias("verdict"))


_MARKED = f"CASE doc_id % 4 WHEN 0 THEN '{derive.INTERNAL_MARKERS[2]}' || chr(13) || chr(10) || text WHEN 1 THEN '  {derive.INTERNAL_MARKERS[0]}' || chr(10) || text WHEN 2 THEN '{derive.INTERNAL_MARKERS[2]} ' || text ELSE text END"


@query("filter_internal", "SELECT doc_id, CASE WHEN text IS NULL THEN FALSE ELSE doc_id % 4 < 2 END AS internal FROM documents")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("text", F.expr(_MARKED.replace("chr(", "char(")))
    return docs.select("doc_id", F.coalesce(derive.looks_internal(F.col("text")), F.lit(False)).alias("internal"))


for _name, _col in (("derive_title", "title"), ("derive_summary", "summary_text"), ("derive_compact", "compact_text")):
    query(_name, _BASE + f" SELECT session_uuid, {_col} FROM sessions")(lambda spark, d, c=_col: _s(spark, d).select("session_uuid", c))


@query("trim_text", r"""SELECT doc_id, CASE WHEN length(t) > 220 THEN substr(t, 1, 220) || '…' ELSE t END AS shown FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", X.trim_text(F.col("text"), 220).alias("shown"))


# --- selectors, lists, statistics
_SEL = {
    "selector_all": (Selector("all", ROOT), "true"),
    "selector_cwd": (Selector("cwd", ROOT, "/work/proj-3"), "cwd = '/work/proj-3'"),
    "selector_date_range": (Selector("date_range", ROOT, None, "2024-01-02", "2024-01-03"), "path_date BETWEEN '2024-01-02' AND '2024-01-03'"),
    "selector_cwd_date_range": (Selector("cwd_date_range", ROOT, "/work/proj-3", "2024-01-02", "2024-01-03"), "cwd = '/work/proj-3' AND path_date BETWEEN '2024-01-02' AND '2024-01-03'"),
}
for _name, (_sel, _where) in _SEL.items():
    query(_name, _BASE + f" SELECT session_uuid, file_path FROM sessions WHERE {_where}")(lambda spark, d, s=_sel: _s(spark, d).filter(s.predicate()).select("session_uuid", "file_path"))


@query("selector_count", _BASE + " SELECT count(*) AS n FROM sessions WHERE cwd = '/work/proj-3'")
def _(spark, d):
    return _s(spark, d).filter(_SEL["selector_cwd"][0].predicate()).agg(F.count("*").alias("n"))


_LIST = {
    "list_cwd_contains": (dict(cwd="PROJ-5", limit=20), "cwd LIKE '%proj-5%'", "ended_at"), "list_since": (dict(since="2024-01-03T00:00:00Z", limit=20), "ended_at >= '2024-01-03T00:00:00Z'", "ended_at"),
    "list_sort_ended": (dict(sort="ended"), "true", "ended_at"), "list_sort_started": (dict(sort="started"), "true", "started_at"), "list_sort_messages": (dict(sort="messages"), "true", "message_count"),
}
for _name, (_args, _where, _by) in _LIST.items():
    query(_name, _BASE + f" SELECT session_uuid, cwd, ended_at, message_count FROM sessions WHERE {_where} ORDER BY {_by} DESC, session_uuid LIMIT 20")(
        lambda spark, d, a=_args: reading.list_sessions(_s(spark, d), **a).select("session_uuid", "cwd", "ended_at", "message_count")
    )

query("stats_counts", _BASE + " SELECT count(*) AS session_count, CAST(coalesce(sum(message_count), 0) AS BIGINT) AS message_count, min(started_at) AS earliest, max(ended_at) AS latest, max(path_date) AS last_path_date FROM sessions")(lambda spark, d: reading.stats(_s(spark, d)))
query("stats_top_cwds", _BASE + " SELECT cwd, count(*) AS n FROM sessions WHERE cwd <> '' GROUP BY cwd ORDER BY n DESC, cwd LIMIT 10")(lambda spark, d: reading.top_cwds(_s(spark, d)))
query("inventory_cwd_groups", _BASE + " SELECT cwd, count(*) AS n, min(path_date) AS from_date, max(path_date) AS to_date FROM sessions WHERE cwd <> '' GROUP BY cwd")(lambda spark, d: reading.inventory(_s(spark, d)))
query("inventory_totals", _BASE + " SELECT count(*) AS files, count(DISTINCT cwd) AS cwds, min(path_date) AS from_date, max(path_date) AS to_date FROM sessions")(
    lambda spark, d: _s(spark, d).agg(F.count("*").alias("files"), F.countDistinct("cwd").alias("cwds"), F.min("path_date").alias("from_date"), F.max("path_date").alias("to_date"))
)

# --- reading
query("read_range", _BASE + f" SELECT seq, role, content_text FROM messages WHERE session_uuid = '{SESSION}' AND seq BETWEEN 0 AND 3")(lambda spark, d: reading.message_range(_m(spark, d), SESSION, 1).select("seq", "role", "content_text"))
query("read_page", _BASE + f" SELECT seq, role, content_text FROM messages WHERE session_uuid = '{SESSION}' ORDER BY seq LIMIT 2 OFFSET 1")(lambda spark, d: reading.message_page(_m(spark, d), SESSION, 1, 2).select("seq", "role", "content_text"))
query("read_page_has_more", _BASE + f" SELECT message_count AS total_count, least(2, greatest(0, message_count - 1)) AS returned, 1 + least(2, greatest(0, message_count - 1)) < message_count AS has_more FROM sessions WHERE session_uuid = '{SESSION}'")(lambda spark, d: reading.page_state(_s(spark, d), _m(spark, d), SESSION, 1, 2))

# --- text
query("tokenize_words", r"""SELECT turn, conv_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+(?:[''.][\p{L}\p{M}\p{N}_]+)*'), ' ') AS words FROM conversations""")(lambda spark, d: spark.read.parquet(f"{d}/conversations.parquet").select("turn", "conv_id", F.array_join(X.words(F.col("text")), " ").alias("words")))

# documents whose letters x, k, q and j stand for CJK characters
_CJK = ("xkqj", "法部署検")
_CJK_SQL = f"SELECT doc_id, translate(text, '{_CJK[0]}', '{_CJK[1]}') AS t FROM documents"
_PAIRS = "list_transform(generate_series(1, len({0}) - 1), lambda i: substr({0}, i, 2))"
_CJK_TOKENS = rf"regexp_extract_all(strip_accents(lower(array_to_string(list_transform(regexp_extract_all(t, '[{_CJK[1]}]+|[^{_CJK[1]}]+'), lambda p: CASE WHEN regexp_matches(p, '[{_CJK[1]}]') THEN ' ' || array_to_string({_PAIRS.format('p')}, ' ') || ' ' ELSE p END), ''))), '[\p{{L}}\p{{M}}\p{{N}}]+')"


def _cjk_docs(spark, d):
    return _docs(spark, d).select("doc_id", F.translate("text", *_CJK).alias("t"))


def _asked(batches):
    """The tokens that a query asks for when it is the whole text: the driver's code for queries."""
    for rows in batches:
        yield rows.assign(tokens=[" ".join(X.query_tokens(text or "")) for text in rows["t"]])[["doc_id", "tokens"]]


query("tokenize_cjk_bigrams", rf"SELECT doc_id, array_to_string(flatten(list_transform(regexp_extract_all(t, '[{_CJK[1]}]+'), lambda p: {_PAIRS.format('p')})), ' ') AS bigrams FROM ({_CJK_SQL})")(lambda spark, d: _cjk_docs(spark, d).select("doc_id", F.array_join(X.cjk_bigrams(F.col("t")), " ").alias("bigrams")))
query("has_cjk", "SELECT doc_id, regexp_matches(text, '[xkqj]') AS cjk FROM documents")(lambda spark, d: _cjk_docs(spark, d).select("doc_id", X.has_cjk(F.col("t")).alias("cjk")))
query("fts_scripts", f"SELECT doc_id, array_to_string({_CJK_TOKENS}, ' ') AS tokens FROM ({_CJK_SQL})")(lambda spark, d: _cjk_docs(spark, d).select("doc_id", F.array_join(X.fts_tokens(F.col("t")), " ").alias("tokens")))
query("fts_query_terms", f"SELECT doc_id, array_to_string({_CJK_TOKENS}, ' ') AS tokens FROM ({_CJK_SQL})")(lambda spark, d: _cjk_docs(spark, d).mapInPandas(_asked, "doc_id long, tokens string"))
query("fts_tokens", f"SELECT doc_id, array_to_string({_toks('text')}, ' ') AS tokens FROM documents")(lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.array_join(X.fts_tokens(F.col("text")), " ").alias("tokens")))
query("phrase_match", f"SELECT doc_id, {_cnt('t', PHRASE)} AS n FROM (SELECT doc_id, {_toks('text')} AS t FROM documents)")(lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", X.phrase_count(X.fts_tokens(F.col("text")), PHRASE).cast("long").alias("n")))
_BM = _bm25_sql("messages", {"content_text": 1.0}, [["reti"], ["of"]], "session_uuid, seq")
_BS = _bm25_sql("sessions", recall.SESSION_WEIGHTS, [["reti"], ["of"]], "session_uuid")
query("bm25_messages", f"{_BASE}, {_BM} SELECT session_uuid, seq, round(score, 6) AS score FROM bm_messages")(lambda spark, d: recall.bm25(_mt(spark, d), {"content_text_tokens": 1.0}, TERMS).select("session_uuid", "seq", F.round("score", 6).alias("score")))
query("bm25_sessions_weighted", f"{_BASE}, {_BS} SELECT session_uuid, round(score, 6) AS score FROM bm_sessions")(lambda spark, d: recall.bm25(_st(spark, d), {f"{c}_tokens": w for c, w in recall.SESSION_WEIGHTS.items()}, TERMS).select("session_uuid", F.round("score", 6).alias("score")))
query("bm25_postings", f"{_BASE}, {_BM} SELECT session_uuid, seq, round(score, 6) AS score FROM bm_messages")(lambda spark, d: _indexed(spark, d).message_scores(TERMS).select("session_uuid", "seq", F.round("score", 6).alias("score")))
query("bm25_postings_weighted", f"{_BASE}, {_BS} SELECT session_uuid, round(score, 6) AS score FROM bm_sessions")(lambda spark, d: _indexed(spark, d).session_scores(TERMS).select("session_uuid", F.round("score", 6).alias("score")))
_BP = _bm25_sql("messages", {"content_text": 1.0}, [PHRASE], "session_uuid, seq")
query("bm25_postings_phrase", f"{_BASE}, {_BP} SELECT session_uuid, seq, round(score, 6) AS score FROM bm_messages")(lambda spark, d: _indexed(spark, d).message_scores(["of'the"]).select("session_uuid", "seq", F.round("score", 6).alias("score")))
query("join_hits_sessions", f"{_BASE}, {_BM} SELECT b.session_uuid, seq, title, cwd FROM bm_messages AS b JOIN sessions USING (session_uuid)")(lambda spark, d: recall.bm25(_mt(spark, d), {"content_text_tokens": 1.0}, TERMS).join(_s(spark, d), "session_uuid").select("session_uuid", "seq", "title", "cwd"))
query("snippet_like", f"""SELECT doc_id, CASE WHEN p > 0 THEN (CASE WHEN p > 41 THEN '…' ELSE '' END) || regexp_replace(substr(text, greatest(1, p - 40), p + {len(NEEDLE)} + 80 - greatest(1, p - 40)), '({NEEDLE})', '<mark>\\1</mark>', 'gi')
  || (CASE WHEN p + {len(NEEDLE)} + 79 < length(text) THEN '…' ELSE '' END) ELSE substr(text, 1, 160) END AS snippet FROM (SELECT doc_id, text, instr(lower(text), '{NEEDLE}') AS p FROM documents)""")(lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", X.like_snippet(F.col("text"), NEEDLE).alias("snippet")))

# --- find
_ABOUT = "title, cwd, started_at, ended_at"
_UNION = f"""{_BASE}, {_BM}, {_BS},
mh AS (SELECT 'message' AS source, session_uuid, seq, role, content_text, {_ABOUT}, score FROM bm_messages JOIN messages USING (session_uuid, seq) JOIN sessions USING (session_uuid) WHERE {{where}} ORDER BY {{morder}} LIMIT {{limit}}),
sh AS (SELECT 'session' AS source, session_uuid, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS role, title || chr(10) || summary_text || chr(10) || compact_text || chr(10) || reasoning_summary_text AS content_text, {_ABOUT}, score FROM bm_sessions JOIN sessions USING (session_uuid) WHERE {{where}} ORDER BY {{sorder}} LIMIT {{limit}}),
un AS (SELECT *, row_number() OVER (ORDER BY source, {{uorder}}) AS ord FROM (SELECT * FROM mh UNION ALL SELECT * FROM sh))"""


def _union_sql(where: str = "true", sort: str = "relevance", n: int = 10) -> str:
    by, limit = ("score, ended_at DESC", max(12 * n, 50)) if sort == "relevance" else (f"{sort}_at DESC, score", max(100 * n, 1000))
    tail = "" if sort == "relevance" else ", ended_at DESC"
    out = _UNION
    for k, v in {"{where}": where, "{morder}": f"{by}, seq, session_uuid", "{sorder}": f"{by}, session_uuid", "{uorder}": f"{by}{tail}, seq, session_uuid", "{limit}": str(limit)}.items():
        out = out.replace(k, v)
    return out


def _rank_sql(order: str = "session_score DESC, f_ended DESC, first_ord", n: int = 10) -> str:
    tc = " + ".join(f"CAST(contains(lower({{0}}), '{t}') AS INTEGER)" for t in TERMS)
    return f""", sg AS (SELECT *, -score + 8 * CAST(contains(lower(content_text), '{QUERY}') AS INTEGER) + 2 * ({tc.format('content_text')}) + 4 * CAST(source = 'message' AS INTEGER) + 2 * CAST(coalesce(role, '') = 'user' AS INTEGER) AS signal,
  contains(lower(title), '{QUERY}') AS tp, {tc.format('title')} AS tt, {tc.format('cwd')} AS ct FROM un),
ag AS (SELECT session_uuid, count(*) AS hits, count(*) FILTER (source = 'session') AS session_hits, count(*) FILTER (source = 'message' AND role = 'user') AS user_hits, bool_or(tp) AS title_phrase, max(tt) AS title_terms, max(ct) AS cwd_terms, max(signal) AS signal,
  arg_min(struct_pack(source, seq, role, content_text), struct_pack(a := source <> 'message', b := -signal, c := ord)) AS shown, arg_min(title, ord) AS f_title, arg_min(cwd, ord) AS f_cwd, arg_min(started_at, ord) AS f_started, arg_min(ended_at, ord) AS f_ended, min(ord) AS first_ord FROM sg GROUP BY session_uuid),
sc AS (SELECT *, signal + 30 * CAST(title_phrase AS INTEGER) + 10 * title_terms + 18 * cwd_terms + 4 * least(user_hits, 3) + 2 * least(session_hits, 2) + 1.5 * least(hits, 6)
  + greatest(0, 18 - 0.15 * greatest(0, (epoch(TIMESTAMP '2024-02-01') - epoch(strptime(f_ended, '%Y-%m-%dT%H:%M:%SZ'))) / 86400.0)) AS session_score FROM ag),
rk AS (SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank FROM sc ORDER BY {order} LIMIT {n})"""


_FIND = " SELECT rank, session_uuid, f_title AS title, f_cwd AS cwd, f_started AS started_at, f_ended AS ended_at, shown.source AS match_source, shown.seq AS match_seq, shown.role AS match_role, shown.content_text AS content_text, hits, round(session_score, 4) AS score FROM rk"


def _hits(spark, d, **o):
    return union_hits(_indexed(spark, d), QUERY, FindOptions(**o))


query("find_recall_limits", _union_sql(n=2) + " SELECT source, count(*) AS n FROM un GROUP BY source")(lambda spark, d: _hits(spark, d, limit=2).groupBy("source").agg(F.count("*").alias("n")))
query("find_union_surfaces", _union_sql() + " SELECT source, session_uuid, seq, CAST(ord AS INTEGER) AS ord, round(score, 6) AS score FROM un")(lambda spark, d: _hits(spark, d).select("source", "session_uuid", "seq", "ord", F.round("score", 6).alias("score")))
query("find_exclude", _union_sql("session_uuid NOT IN ('conv-000003', 'conv-000010')") + " SELECT DISTINCT session_uuid FROM un")(lambda spark, d: _hits(spark, d, exclude=[" conv-000003", "conv-000010", "conv-000003", ""]).select("session_uuid").distinct())
for _name, _o, _sql in (
    ("find_relevance", {}, _union_sql() + _rank_sql()), ("find_selector", {"selector": _SEL["selector_cwd"][0]}, _union_sql("cwd = '/work/proj-3'") + _rank_sql()),
    ("find_sort_ended", {"sort": "ended"}, _union_sql(sort="ended") + _rank_sql("f_ended DESC, session_score DESC, first_ord")), ("find_sort_started", {"sort": "started"}, _union_sql(sort="started") + _rank_sql("f_started DESC, session_score DESC, first_ord")),
):
    query(_name, _sql + _FIND)(lambda spark, d, o=_o: find(_indexed(spark, d), QUERY, FindOptions(**o)))
query("find_tables", _union_sql() + _rank_sql() + _FIND)(lambda spark, d: find(_on(spark, d), QUERY))
query("find_postings", _union_sql() + _rank_sql() + _FIND)(lambda spark, d: find(_indexed(spark, d), QUERY))
query("find_ranked", _union_sql(n=3) + _rank_sql(n=3) + " SELECT rank, session_uuid FROM rk")(lambda spark, d: find(_indexed(spark, d), QUERY, FindOptions(limit=3)).select("rank", "session_uuid"))
query("read_range_by_query", f"{_BASE}, {_BM}, top AS (SELECT b.seq FROM bm_messages AS b JOIN messages AS m USING (session_uuid, seq) WHERE session_uuid = (SELECT min(session_uuid) FROM bm_messages) ORDER BY -score + 8 * CAST(contains(lower(content_text), '{QUERY}') AS INTEGER) + 2 * CAST(role = 'user' AS INTEGER) DESC, b.seq LIMIT 1) SELECT m.session_uuid, m.seq FROM messages AS m, top WHERE session_uuid = (SELECT min(session_uuid) FROM bm_messages) AND m.seq BETWEEN top.seq - 2 AND top.seq + 2")(lambda spark, d: _range_by_query(spark, d))


def _range_by_query(spark, d):
    on = _indexed(spark, d)
    first = on.message_scores(TERMS).agg(F.min("session_uuid")).first()[0]
    at = anchor(on, first, QUERY, NOW).first()["seq"]
    return reading.message_range(on.messages, first, at).select("session_uuid", "seq")



_LIKE_BASE = _BASE.replace("FROM conversations", "FROM (SELECT * REPLACE (translate(text, '%s', '%s') AS text) FROM conversations)" % adapter.CJK_LETTERS)
_CHAR, _CHARS = "法", "部e"  # one character, and one that a search has to compare with texts


def _like_sql(surface: str, needle: str) -> str:
    if surface == "message":
        return f"{_LIKE_BASE} SELECT session_uuid, seq, CAST(-row_number() OVER (ORDER BY started_at DESC, seq, session_uuid) AS DOUBLE) AS score FROM messages JOIN sessions USING (session_uuid) WHERE contains(lower(content_text), '{needle}') ORDER BY started_at DESC, seq, session_uuid LIMIT 120"
    hit = " OR ".join(f"contains(lower({c}), '{needle}')" for c in recall.SESSION_WEIGHTS)
    return f"{_LIKE_BASE} SELECT session_uuid, CAST(-row_number() OVER (ORDER BY started_at DESC, session_uuid) AS DOUBLE) AS score FROM sessions WHERE {hit} ORDER BY started_at DESC, session_uuid LIMIT 120"


for _name, _needle in (("find_like", _CHAR), ("find_like_compared", _CHARS)):
    query(f"{_name}_messages", _like_sql("message", _needle))(lambda spark, d, x=_needle: message_hits(adapter.stored(spark, d, True).searched(), x, [], FindOptions()).select("session_uuid", "seq", "score"))
    query(f"{_name}_sessions", _like_sql("session", _needle))(lambda spark, d, x=_needle: session_hits(adapter.stored(spark, d, True).searched(), x, [], FindOptions()).select("session_uuid", "score"))


def _by_grams(rows, needle):
    return grams.like(rows, grams.gram_postings(rows, ["doc_id"], ["t"]), ["doc_id"], ["t"], needle).select("doc_id")


query("like_substring", f"SELECT doc_id FROM documents WHERE contains(lower(text), '{NEEDLE}')")(lambda spark, d: _by_grams(_docs(spark, d).select("doc_id", F.col("text").alias("t")), NEEDLE.upper()))
query("like_one_character", "SELECT doc_id FROM documents WHERE contains(text, 'q')")(lambda spark, d: _by_grams(_cjk_docs(spark, d), "署"))

# --- rerank
query("query_profile", r"""SELECT doc_id, lower(trim(q)) AS normalized, regexp_matches(trim(q), '\s') AS is_multi_term, regexp_matches(q, '\d') AS has_digits, CASE WHEN regexp_matches(trim(q), '\s') OR regexp_matches(q, '[\d\\/._:-]') THEN 'exact' ELSE 'broad' END AS kind,
  regexp_matches(trim(q), '\s') AND regexp_matches(q, '[\\/._:-]') AS is_path_like_command FROM (SELECT doc_id, substr(text, 1 + doc_id % 50, 1 + doc_id % 11) AS q FROM documents) WHERE NOT regexp_matches(q, '[\n\r\t]')""")(
    lambda spark, d: _docs(spark, d).select("doc_id", F.expr("substr(text, CAST(1 + doc_id % 50 AS INT), CAST(1 + doc_id % 11 AS INT))").alias("q")).filter(~F.col("q").rlike(r"[\n\r\t]")).select("doc_id", *[c.alias(n) for n, c in rerank.profile_columns(F.col("q")).items()])
)
query("term_coverage", "SELECT doc_id, " + " + ".join(f"CAST(contains(lower(text), '{t}') AS INTEGER)" for t in TERMS) + " AS n FROM documents")(lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", rerank.matched_terms(F.col("text"), TERMS).alias("n")))
query("bounded_phrase", r"SELECT doc_id, regexp_matches(lower(text), '(^|[^\p{L}\p{N}_./-])of the($|[^\p{L}\p{N}_./-])') AS hit FROM documents")(lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", rerank.bounded_phrase(F.lower("text"), "of the").alias("hit")))
_SPAN = ["the", "of", "and"]
_SPAN_SQL = r"""SELECT doc_id, text, list_min(list_transform(list_filter(list_transform(a, lambda i: {'i': i, 'k': list_min(list_filter(c, lambda z: z > list_min(list_filter(b, lambda y: y > i))))}), lambda m: m.k IS NOT NULL), lambda m: m.k - m.i - 2)) AS gap FROM (
  SELECT doc_id, text, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'the') AS a, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'of') AS b, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'and') AS c
  FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+(?:[''.][\p{L}\p{M}\p{N}_]+)*') AS w FROM documents))"""


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


query("ordered_span", f"SELECT doc_id, CAST(gap AS INTEGER) AS gaps FROM ({_SPAN_SQL})")(lambda spark, d: _docs(spark, d).select("doc_id", rerank.ordered_span(X.words(F.col("text")), _SPAN).alias("gaps")))
query("command_bonus", rf"""SELECT doc_id, CAST(CASE WHEN regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_./-])the of\. and($|[^\p{{L}}\p{{N}}_./-])') THEN 36 WHEN gap = 0 THEN 8 WHEN gap <= 3 THEN 24 - 2 * gap ELSE 0 END AS DOUBLE) AS bonus FROM ({_SPAN_SQL})""")(
    lambda spark, d: _docs(spark, d).select("doc_id", rerank.command_bonus(F.col("text"), rerank.classify(PATHLIKE), X.query_terms(PATHLIKE)).alias("bonus"))
)
query("score_row", _union_sql() + _rank_sql() + " SELECT session_uuid, seq, source, round(signal, 4) AS signal FROM sg")(lambda spark, d: _hits(spark, d).withColumn("signal", F.round(rerank.row_signal(rerank.classify(QUERY), TERMS), 4)).select("session_uuid", "seq", "source", "signal"))


def _agg(spark, d):
    return rerank.aggregate_hits(_hits(spark, d), rerank.classify(QUERY), TERMS)


query("rerank_aggregate", _union_sql() + _rank_sql() + " SELECT session_uuid, hits, session_hits, user_hits, title_phrase, title_terms, cwd_terms, round(signal, 4) AS signal FROM ag")(lambda spark, d: _agg(spark, d).select("session_uuid", "hits", "session_hits", "user_hits", "title_phrase", "title_terms", "cwd_terms", F.round("signal", 4).alias("signal")))
query("display_row", _union_sql() + _rank_sql() + " SELECT session_uuid, shown.source AS source, shown.seq AS seq FROM ag")(lambda spark, d: _agg(spark, d).select("session_uuid", "shown.source", "shown.seq"))
query("recency_decay", _BASE + " SELECT session_uuid, round(greatest(0, 18 - 0.15 * greatest(0, (epoch(TIMESTAMP '2024-02-01') - epoch(strptime(ended_at, '%Y-%m-%dT%H:%M:%SZ'))) / 86400.0)), 6) AS recency FROM sessions")(lambda spark, d: _s(spark, d).select("session_uuid", F.round(rerank.recency(F.col("ended_at"), NOW), 6).alias("recency")))
query("score_session", _union_sql() + _rank_sql() + " SELECT session_uuid, round(session_score, 4) AS score FROM sc")(lambda spark, d: _agg(spark, d).select("session_uuid", F.round(rerank.session_score(NOW), 4).alias("score")))

# --- sync and coverage: the listing is the sessions' files, the index holds those of even message_count
_FILES = "SELECT file_path, cwd, path_date, message_count AS size, 1704067200000 + message_count AS mtime FROM sessions"


def _files(spark, d):
    return _s(spark, d).select("file_path", "cwd", "path_date", F.col("message_count").alias("size"), (F.lit(1704067200000) + F.col("message_count")).alias("mtime"))


def _seen(spark, d):
    """The listing against an index of the files of even size, those of size 4 with another size."""
    files = _files(spark, d)
    old = files.filter("size % 2 = 0").withColumn("size", F.when(F.col("size") == 4, F.lit(0)).otherwise(F.col("size"))).withColumn("index_version", F.lit(sync.INDEX_VERSION))
    return sync.classify(files, old)


def _found(spark, d):
    """What reading the changed files gave: files of size 3 are in error, those of size 1 hold nothing."""
    verdict = F.when(F.col("size") == 3, "error").when(F.col("size") == 1, "skipped").otherwise("parsed")
    return _seen(spark, d).filter("NOT unchanged").select("file_path", verdict.alias("verdict"), "known")


_ACTED = f"SELECT file_path, CASE WHEN size = 3 THEN 'errors' WHEN size = 1 THEN 'skipped' WHEN size % 2 = 1 THEN 'added' WHEN size = 4 THEN 'updated' ELSE 'skipped' END AS action FROM ({_FILES})"
query("sync_classify", f"{_BASE} SELECT file_path, size % 2 = 0 AS known, size % 2 = 0 AND size <> 4 AS unchanged FROM ({_FILES})")(lambda spark, d: _seen(spark, d).select("file_path", "known", "unchanged"))
query("sync_actions", f"{_BASE} {_ACTED}")(lambda spark, d: sync.actions(_seen(spark, d), _found(spark, d)))
query("sync_counters", f"{_BASE} SELECT action, count(*) AS n FROM ({_ACTED}) GROUP BY 1")(lambda spark, d: sync.counters(sync.actions(_seen(spark, d), _found(spark, d))))
query("sync_retained_union", f"{_BASE} SELECT file_path FROM ({_FILES}) WHERE size NOT IN (1, 3)")(lambda spark, d: sync.retained(_seen(spark, d), _found(spark, d)))
query("sync_reconcile_anti", f"{_BASE} SELECT session_uuid FROM sessions WHERE cwd = '/work/proj-3' AND message_count IN (1, 3)")(
    lambda spark, d: sync.lost(_s(spark, d), _SEL["selector_cwd"][0], sync.retained(_seen(spark, d), _found(spark, d))).select("session_uuid")
)
query("source_fingerprint", f"{_BASE}, f AS (SELECT regexp_replace(file_path, '/[^/]*$', '') AS folder, sha256(string_agg(chr(0) || substr(file_path, {len(ROOT) + 2}) || chr(0) || mtime || chr(0) || size || chr(0) || path_date || chr(0) || cwd, '' ORDER BY file_path)) AS digest, count(*) AS n FROM ({_FILES}) GROUP BY 1) SELECT sha256('{ROOT}' || string_agg(chr(0) || folder || chr(0) || digest, '' ORDER BY folder)) AS fingerprint, CAST(sum(n) AS BIGINT) AS file_count FROM f")(lambda spark, d: reading.fingerprint(_files(spark, d), ROOT))

# coverage as the sessions would leave it: of the root, every directory, every day, every directory's days and every other week
_DAYS = "SELECT cwd, path_date AS day, count(*) AS n FROM sessions GROUP BY ALL"
_ENTRIES = f"""days AS ({_DAYS}), entries AS (
SELECT 'all' AS kind, CAST(NULL AS VARCHAR) AS cwd, CAST(NULL AS VARCHAR) AS from_date, CAST(NULL AS VARCHAR) AS to_date, sum(n) AS files FROM days
UNION ALL SELECT 'cwd', cwd, NULL, NULL, sum(n) FROM days GROUP BY cwd
UNION ALL SELECT 'date_range', NULL, day, day, sum(n) FROM days GROUP BY day
UNION ALL SELECT 'cwd_date_range', cwd, min(day), max(day), sum(n) FROM days GROUP BY cwd),
cover AS (SELECT concat_ws('|', kind, cwd, from_date, to_date) AS want, '{ROOT}' AS root, *, CASE WHEN files % 3 = 0 THEN 'v0' ELSE 'v1' END AS version, files % 2 = 0 AS same FROM entries)"""
_IMPLIES = """(h.kind = 'all' OR h.kind = 'cwd' AND w.kind IN ('cwd', 'cwd_date_range') AND h.cwd = w.cwd
  OR h.kind = 'date_range' AND w.kind IN ('date_range', 'cwd_date_range') AND h.from_date <= w.from_date AND h.to_date >= w.to_date
  OR h.kind = 'cwd_date_range' AND w.kind = 'cwd_date_range' AND h.cwd = w.cwd AND h.from_date <= w.from_date AND h.to_date >= w.to_date)"""


def _cover(spark, d, suffix: str = ""):
    """Coverage entries: a third of an old version, half with the files as they were."""
    days = _s(spark, d).groupBy("cwd", F.col("path_date").alias("day")).agg(F.count("*").alias("n"))
    none, n = F.lit(None).cast("string"), F.sum("n").alias("files")
    own = lambda kind, rows, cwd, first, last: rows.select(F.lit(kind).alias("kind"), cwd.alias("cwd"), first.alias("from_date"), last.alias("to_date"), "files")
    spans = days.groupBy("cwd").agg(n, F.min("day").alias("first"), F.max("day").alias("last"))
    rows = own("all", days.agg(n), none, none, none).union(own("cwd", spans, F.col("cwd"), none, none))
    rows = rows.union(own("date_range", days.groupBy("day").agg(n), none, F.col("day"), F.col("day"))).union(own("cwd_date_range", spans, F.col("cwd"), F.col("first"), F.col("last")))
    rows = rows.withColumns({
        "want": F.concat_ws("|", "kind", "cwd", "from_date", "to_date"), "root": F.lit(ROOT), "index_version": F.when(F.col("files") % 3 == 0, "v0").otherwise("v1"),
        "source_fingerprint": F.lit("f"), "now_fingerprint": F.when(F.col("files") % 2 == 0, "f").otherwise("g"), "source_file_count": F.col("files"), "now_file_count": F.col("files"),
    })
    return rows.select(*[F.col(c).alias(c + suffix) for c in rows.columns])


def _of(suffix: str):
    return {n: F.col(n + suffix) for n in ("kind", "root", "cwd", "from_date", "to_date")}


def _wants(spark, d):
    return _cover(spark, d).select("want", "kind", "root", "cwd", "from_date", "to_date")


query("coverage_implies", f"{_BASE}, {_ENTRIES} SELECT h.want AS have, w.want FROM cover AS h JOIN cover AS w ON {_IMPLIES}")(lambda spark, d: _cover(spark, d, "_h").join(F.broadcast(_cover(spark, d, "_w")), implies(_of("_h"), _of("_w"))).select(F.col("want_h").alias("have"), F.col("want_w").alias("want")))
query("coverage_status", f"{_BASE}, {_ENTRIES} SELECT w.want, count(h.want) > 0 AS complete FROM cover AS w LEFT JOIN (SELECT * FROM cover WHERE version = 'v1') AS h ON {_IMPLIES} GROUP BY w.want")(
    lambda spark, d: sync.answering(_cover(spark, d), _wants(spark, d), "v1").groupBy("want").agg(F.bool_or(F.col("have_kind").isNotNull()).alias("complete"))
)
query("coverage_freshness", f"{_BASE}, {_ENTRIES} SELECT want, CASE WHEN same AND version = 'v1' THEN 'fresh' ELSE 'stale' END AS freshness FROM cover")(lambda spark, d: sync.freshness_of(_cover(spark, d), "v1").select("want", "freshness"))
query("coverage_requested", f"""{_BASE}, {_ENTRIES}, r AS (SELECT w.want, CASE WHEN coalesce(bool_or(h.same), false) THEN 'fresh' WHEN count(h.want) > 0 THEN 'stale' ELSE 'missing' END AS state
  FROM cover AS w LEFT JOIN (SELECT * FROM cover WHERE version = 'v1') AS h ON {_IMPLIES} GROUP BY w.want) SELECT want, state, CASE WHEN state = 'fresh' THEN 'query' ELSE 'sync' END AS recommended_action FROM r""")(
    lambda spark, d: sync.requested(sync.freshness_of(_cover(spark, d), "v1"), _wants(spark, d), "v1")
)
query("coverage_for_session", f"""{_BASE}, {_ENTRIES} SELECT session_uuid, h.want FROM sessions AS s JOIN cover AS h ON h.kind = 'all' OR h.kind = 'cwd' AND h.cwd = s.cwd
  OR h.kind = 'date_range' AND s.path_date BETWEEN h.from_date AND h.to_date OR h.kind = 'cwd_date_range' AND h.cwd = s.cwd AND s.path_date BETWEEN h.from_date AND h.to_date""")(
    lambda spark, d: _s(spark, d).select("session_uuid", F.col("cwd").alias("_c"), F.col("path_date").alias("_d")).join(F.broadcast(_cover(spark, d)), sync.about_session(_cover(spark, d), F.lit(ROOT), F.col("_c"), F.col("_d"))).select("session_uuid", "want")
)

# --- evaluation
def _batch(spark, d, by: str, but: int):
    """A batch of searches: one for every directory, which finds its sessions in an order; one directory is not asked for."""
    rows = _s(spark, d).filter(F.pmod(F.regexp_extract("cwd", r"(\d+)$", 1).cast("int"), F.lit(7)) != but).select("cwd", "title", "session_uuid", F.row_number().over(Window.partitionBy("cwd").orderBy(F.col(by).desc(), "session_uuid")).alias("rank"))
    found = F.array_sort(F.collect_list(F.struct("rank", F.col("session_uuid").alias("sessionUuid"), "title")))
    return rows.groupBy(F.col("cwd").alias("id")).agg(F.concat(F.lit("query "), F.first("cwd")).alias("query"), found.alias("results"))


def _batches(spark, d):
    return _batch(spark, d, "ended_at", 1), _batch(spark, d, "message_count", 2)


_FIRSTS = "SELECT cwd AS id, arg_min(struct_pack(u := session_uuid, t := title), struct_pack(a := n, b := session_uuid)) AS f FROM (SELECT *, {n} AS n FROM sessions) WHERE cwd <> '/work/proj-{but}' GROUP BY cwd"
_BATCH_SQL = _BASE + ", before AS (" + _FIRSTS.format(n="-epoch(strptime(ended_at, '%Y-%m-%dT%H:%M:%SZ'))", but=1) + "), after AS (" + _FIRSTS.format(n="-message_count", but=2) + ")"
query("eval_compare", _BATCH_SQL + " SELECT id, 'query ' || id AS query, b.f.u AS before, a.f.u AS after, b.f.t AS before_title, a.f.t AS after_title FROM before AS b JOIN after AS a USING (id) WHERE b.f.u <> a.f.u")(lambda spark, d: evaluation.compare(*_batches(spark, d)))
query("eval_shared", _BATCH_SQL + " SELECT id FROM before JOIN after USING (id)")(lambda spark, d: evaluation.shared_ids(*_batches(spark, d)))


def _wanted(spark, d):
    """What the first search finds, asked for in three ways, and its results for each."""
    got = find(_on(spark, d), QUERY).join(_s(spark, d).select("session_uuid", "summary_text"), "session_uuid").withColumn("snippet", F.col("content_text"))
    rows = [(1, None, "/WORK/", None), (2, "no such title", None, None), (3, None, None, None), (4, "", "/work/", "reti")]
    asked = spark.createDataFrame(rows, "id int, expected_title_or_summary string, expected_cwd string, expected_snippet string")
    return asked, got.join(F.broadcast(asked.select("id")))


query("eval_manual", "SELECT * FROM (VALUES (1, 'pass'), (2, 'fail'), (3, 'skip'), (4, 'pass')) AS t(id, mark)")(lambda spark, d: evaluation.manual_marks(*_wanted(spark, d), 5).select("id", "mark"))
query("eval_scoreboard", "SELECT CAST(4 AS BIGINT) AS total, CAST(1 AS BIGINT) AS skipped, CAST(2 AS BIGINT) AS pass1, CAST(2 AS BIGINT) AS pass5")(
    lambda spark, d: evaluation.manual_scoreboard(evaluation.manual_marks(*_wanted(spark, d), 1), evaluation.manual_marks(*_wanted(spark, d), 5))
)
query("latency_percentiles", "SELECT event_type, median(value) AS p50, list_sort(list(value))[CAST(floor(0.95 * count(*)) AS BIGINT) + 1] AS p95 FROM events GROUP BY event_type")(
    lambda spark, d: evaluation.latencies(spark.read.parquet(f"{d}/events.parquet"), "event_type", "value")
)


# --- snippets of whole texts: rules of the shown page, without SQL
def _snippets(spark, d, make):
    def run(batches):
        for pdf in batches:
            yield pdf.assign(snippet=[make(t or "") for t in pdf["text"]])[["doc_id", "snippet"]]

    return _docs(spark, d).select("doc_id", "text").mapInPandas(run, "doc_id long, snippet string")


query("snippet_tokens")(lambda spark, d: _snippets(spark, d, lambda t: snippets.token_snippet(snippets.stored_text(t), TERMS)))
query("snippet_raw")(lambda spark, d: _snippets(spark, d, lambda t: snippets.raw_snippet(t, QUERY, TERMS)))
