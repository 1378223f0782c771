"""Chat formatting by event-sourced reconstruction (DataFrame operators only).

A log row is (conv_id, seq, turn, kind, role, text). ``kind`` is one of

* ``message``: the turn's text is this text, with this role;
* ``delta``: this text is appended to the turn's text;
* ``edit``: replaces the turn's text;
* ``regenerate``: replaces the turn's text and drops every later turn as it
  was up to then.

Rows are partitioned by conversation and ordered by seq; folding keeps, per
turn, the last row that resets it and the deltas after that. Messages are then
rendered in turn order.

Template: ``<turn>`` role ``<text>`` text ``</turn>`` + newline. Inside roles
and texts a backslash becomes ``\\b`` and ``<`` becomes ``\\l``, so no control
string can occur in them, and parse() gets both back exactly.

Defined results: null texts and roles are empty strings; an unknown or null
kind counts as ``message``; rows of a null conv_id are one conversation; a null
seq or turn sorts first; exact ties in seq are ordered by text; an empty log
gives no rows; other columns are ignored. A conversation whose turns were all
dropped gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<turn>", "<text>", "</turn>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: the final messages of every conversation."""
    rows = events.select(
        "conv_id", "seq", "turn",
        F.when(F.col("kind").isin("delta", "edit", "regenerate"), F.col("kind")).otherwise("message").alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    earlier = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    by_turn = Window.partitionBy("conv_id", "turn")
    # a regenerate counts for later turns only: its own turn is excluded by the strict comparison below
    cut = F.max(F.when(F.col("kind") == "regenerate", F.struct("seq", "turn"))).over(earlier)
    rows = rows.withColumn("cut", cut)
    rows = rows.filter(F.col("cut").isNull() | ~(F.coalesce(F.col("cut.turn") < F.col("turn"), F.lit(False)) & F.coalesce(F.col("seq") < F.col("cut.seq"), F.lit(False))))
    reset = F.max(F.when(F.col("kind") != "delta", F.struct("seq", "text"))).over(by_turn)
    rows = rows.withColumn("reset", reset)
    is_reset = (F.col("kind") != "delta") & F.struct("seq", "text").eqNullSafe(F.col("reset"))
    kept = rows.filter(F.col("reset").isNull() | is_reset | ((F.col("kind") == "delta") & (F.coalesce(F.col("seq") > F.col("reset.seq"), F.col("reset.seq").isNull()))))
    pieces = F.array_sort(F.collect_list(F.struct("seq", (F.col("kind") == "delta").alias("later"), "text")))
    role = F.max_by("role", F.struct((F.col("role") != "").alias("named"), "seq"))
    return kept.groupBy("conv_id", "turn").agg(role.alias("role"), F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: one row per conversation.

    ``loss_spans`` holds (start, length), in code points of ``formatted`` from
    0, of every text whose role is ``learn``.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = messages.select("conv_id", "turn", "role", "text", escape(F.col("text")).alias("body"), F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END))).withColumn("n", F.row_number().over(order)).withColumn("upto", F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.when(F.col("role") == learn, F.struct((F.col("upto") - F.length(F.lit(END)) - F.length("body")).alias("start"), F.length("body").cast("long").alias("length")))
    turns = F.array_sort(F.collect_list(F.struct("n", "piece", span.alias("span"))))
    return (
        rows.groupBy("conv_id").agg(turns.alias("turns"))
        .select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"))
    )


def parse(formatted: Column) -> Column:
    """The (role, text) turns that a formatted conversation holds."""
    pieces = F.filter(F.split(formatted, TURN), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(p, TEXT, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text"),
    ))


def masked_texts(formatted: Column, spans: Column) -> Column:
    """Text under the loss mask, unescaped, joined in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as a log: each row is one message of its own."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    n = F.row_number().over(order).cast("long")
    return conversations.select("conv_id", n.alias("seq"), n.alias("turn"), F.lit("message").alias("kind"), "role", "text")


PROBE = "\\### Assistant: </turn> ok"


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    out = render(fold(as_events(table.unionByName(probe)))).withColumn("turns", parse(F.col("formatted"))).withColumn("loss", masked_texts(F.col("formatted"), F.col("loss_spans")))
    listing = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listing, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(role) + length(text) + length(replace(role, '<', '')) * 0
  + (length(role) - length(replace(role, '<', ''))) + (length(text) - length(replace(text, '<', '')))
  + (length(role) - length(replace(role, '\', ''))) + (length(text) - length(replace(text, '\', ''))) + 20 AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
