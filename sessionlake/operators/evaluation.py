"""Evaluation of searches: golden files, saved batches, marks, scoreboards, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim
from ..sources.jsonl import text_at

STATUSES = ("candidate", "hard", "stale")
ORIGINS = ("observed-user-ask", "evidence-backed-derived", "manual")
TOP = 5
BATCH = "query string, results array<struct<rank:int,sessionUuid:string,session_uuid:string,title:string>>"
FIRSTS = "query string, results array<struct<sessionUuid:string,session_uuid:string>>"


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _text(v: Column, path: str) -> Column:
    """The trimmed string at a path; null where there is none or it is blank."""
    t = trim(text_at(v, path))
    return F.when(t != "", t)


def _whole(v: Column, path: str, least: int) -> Column:
    """The whole number at a path, if it is ``least`` or more."""
    n = F.when(_kind(v, path).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(v, path, "double"))
    return F.when((n >= least) & (n == F.floor(n)), n.cast("long"))


def _texts(v: Column, path: str) -> Column:
    """The non-blank strings of the array at a path; null where there are none."""
    each = F.transform(F.try_variant_get(v, path, "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", trim(F.try_variant_get(x, "$", "string"))))
    kept = F.filter(each, lambda t: t != "")
    return F.when(F.size(kept) > 0, kept)


def _is_object(v: Column, path: str) -> Column:
    return F.coalesce(_kind(v, path).startswith("OBJECT"), F.lit(False))


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSONL golden file, one per line; blank lines and # comments are left out.

    ``error`` says what is wrong with a line and is null for a valid one.
    """
    # golden files are written by hand: a file is one row for its lines to have numbers
    # a line is parsed where lines are made: a filter on error, which Spark would move below a column, parses it for every mention
    parsed = F.transform(F.split("value", "\r?\n"), lambda x: F.struct(trim(x).alias("line"), F.try_parse_json(trim(x)).alias("v")))
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(parsed).alias("line_no", "of"))
    rows = lines.select("file", (F.col("line_no") + 1).alias("line_no"), "of.line", "of.v").filter("line <> '' AND NOT startswith(line, '#')")
    v = F.col("v")
    context = {
        "mode": F.when(text_at(v, "$.expected.context.mode").isin("auto", "read-range", "read-page"), text_at(v, "$.expected.context.mode")),
        "before": _whole(v, "$.expected.context.before", 1), "after": _whole(v, "$.expected.context.after", 1),
        "offset": _whole(v, "$.expected.context.offset", 0), "limit": _whole(v, "$.expected.context.limit", 1), "must_contain": _texts(v, "$.expected.context.mustContain"),
    }
    source = text_at(v, "$.expected.matchSource")
    expected = {
        "top_k": _whole(v, "$.expected.topK", 1), "acceptable": _texts(v, "$.expected.acceptableSessionUuids"), "cwd_contains": _text(v, "$.expected.cwdContains"),
        "match_source": F.when(source.isin("message", "session"), source), "context": F.struct(*[c.alias(k) for k, c in context.items()]),
    }
    find = {
        "queries": _texts(v, "$.find.queries"), "limit": _whole(v, "$.find.limit", 1), "sort": text_at(v, "$.find.sort"), "selector": F.when(_is_object(v, "$.find.selector"), F.to_json(F.try_variant_get(v, "$.find.selector", "variant"))),
        "cwd": _text(v, "$.find.cwd"), "root": _text(v, "$.find.root"), "exclude": _texts(v, "$.find.excludeSessionUuids"),
    }
    rows = rows.select(
        "file", "line_no", "v", *[_text(v, f"$.{k}").alias(k) for k in ("id", "query", "intent")], text_at(v, "$.status").alias("status"),
        F.struct(*[c.alias(k) for k, c in find.items()]).alias("find"), F.struct(*[c.alias(k) for k, c in expected.items()]).alias("expected"),
    )
    asserts = F.coalesce("expected.acceptable", "expected.context.must_contain").isNotNull() | F.coalesce("expected.cwd_contains", "expected.match_source").isNotNull()
    given = lambda path: F.try_variant_get(v, path, "variant").isNotNull()
    bad_find = given("$.find") & (~_is_object(v, "$.find") | (given("$.find.sort") & ~F.coalesce(F.col("find.sort").isin("relevance", "ended", "started"), F.lit(False))) | (given("$.find.selector") & ~F.coalesce(_selector_ok(v), F.lit(False))))
    bad_origin = given("$.origin") & (~_is_object(v, "$.origin") | ~F.coalesce(text_at(v, "$.origin.kind").isin(*ORIGINS), F.lit(False)))
    error = (
        F.when(v.isNull(), "not JSON").when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "not an object")
        .when(F.col("id").isNull() | F.col("query").isNull() | F.col("intent").isNull(), "id, query and intent must be given").when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "unknown status")
        .when(~_is_object(v, "$.expected") | ~asserts, "nothing is expected").when(bad_find, "find is not valid").when(bad_origin, "origin is not valid")
    )
    return rows.withColumn("error", error).drop("v")


def _selector_ok(v: Column) -> Column:
    """Whether find.selector has a kind and what the kind needs."""
    at = lambda k: F.coalesce(_text(v, f"$.find.selector.{k}"), F.lit(""))
    kind, day = at("kind"), r"^\d{4}-\d{2}-\d{2}$"
    dates = at("fromDate").rlike(day) & at("toDate").rlike(day) & (at("fromDate") <= at("toDate"))
    return kind.isin("all", "cwd", "date_range", "cwd_date_range") & (at("root") != "") & (~kind.contains("cwd") | (at("cwd") != "")) & (~kind.contains("date") | dates)


def _batch_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    rows = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.find.json{,.gz}").json(folder)
    return rows.withColumn("id", F.regexp_replace("_metadata.file_name", r"\.find\.json(\.gz)?$", ""))


def batch(spark: SparkSession, folder: str) -> DataFrame:
    """id, query, results of every ``<id>.find.json`` (or .gz) in a folder, whichever way it spells a session's id."""
    found = F.transform("results", lambda r: F.struct(r["rank"].alias("rank"), F.coalesce(r["sessionUuid"], r["session_uuid"]).alias("sessionUuid"), r["title"].alias("title")))
    return _batch_files(spark, folder, BATCH).select("id", "query", found.alias("results"))


def first_results(spark: SparkSession, folder: str) -> DataFrame:
    """id, query, n (number of results) and ``first`` (the first one's session) of the same files, without the other columns of results."""
    first = F.try_element_at("results", F.lit(1))
    return _batch_files(spark, folder, FIRSTS).select("id", "query", F.size("results").alias("n"), F.coalesce(first["sessionUuid"], first["session_uuid"]).alias("first"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Searches of two batches whose first results differ; those of one batch only are left out."""
    first = lambda side: F.try_element_at("results", F.lit(1)).alias(side)
    both = before.select("id", first("b")).join(after.select("id", "query", first("a")), "id")
    changed = both.filter(F.col("a.sessionUuid") != F.col("b.sessionUuid"))
    return changed.select("id", "query", F.col("b.sessionUuid").alias("before"), F.col("a.sessionUuid").alias("after"), F.col("b.title").alias("before_title"), F.col("a.title").alias("after_title"))


def shared_ids(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("id").intersect(after.select("id"))


def _holds(c: Column, needle: Column) -> Column:
    return F.contains(F.lower(c), F.lower(needle))


def manual_marks(asked: DataFrame, results: DataFrame, top: int) -> DataFrame:
    """asked with ``mark``: pass, fail or skip (nothing is expected) by the first ``top`` results.

    asked: id, expected_title_or_summary, expected_cwd, expected_snippet;
    results: id, rank, title, summary_text, cwd, snippet.
    """
    met = {
        "expected_title_or_summary": _holds(F.col("title"), F.col("expected_title_or_summary")) | _holds(F.col("summary_text"), F.col("expected_title_or_summary")),
        "expected_cwd": _holds(F.col("cwd"), F.col("expected_cwd")), "expected_snippet": _holds(F.col("snippet"), F.col("expected_snippet")),
    }
    given = {k: F.nullif(F.col(k), F.lit("")) for k in met}
    asked = asked.withColumns(given)
    near = asked.select("id", *met).join(results.filter(F.col("rank") <= top), "id").groupBy("id").agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(f"met_{k}") for k, c in met.items()])
    ok, any_ = F.lit(True), F.lit(False)
    for k in met:
        ok = ok & (F.col(k).isNull() | F.coalesce(f"met_{k}", F.lit(False)))
        any_ = any_ | F.col(k).isNotNull()
    return asked.join(near, "id", "left").withColumn("mark", F.when(~any_, "skip").when(ok, "pass").otherwise("fail")).drop(*[f"met_{k}" for k in met])


def manual_scoreboard(first: DataFrame, top: DataFrame) -> DataFrame:
    """total, skipped, pass1, pass5 from the marks by one result and by TOP."""
    both = first.select("id", F.col("mark").alias("m1")).join(top.select("id", F.col("mark").alias("m5")), "id")
    return both.agg(F.count("*").alias("total"), F.count_if(F.col("m1") == "skip").alias("skipped"), F.count_if(F.col("m1") == "pass").alias("pass1"), F.count_if(F.col("m5") == "pass").alias("pass5"))


def golden_marks(entries: DataFrame, results: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """entries with the selected ``hit`` (the first acceptable one in the top, else the first), ``mark`` and ``blocking``.

    results: id, rank, session_uuid, cwd, match_source, match_seq; contexts: id,
    text (what was read around the hit). Stale entries are skipped.
    """
    e = F.col("expected")
    top = F.coalesce(e["top_k"], F.lit(TOP))
    listed = F.coalesce(F.array_contains(e["acceptable"], F.col("r.session_uuid")) & (F.col("r.rank") <= top), F.lit(False))
    # Spark takes parsed entries for a small part of their files' size and would send all of them through the driver
    near = entries.select("id", "expected").hint("merge").join(results.select("id", F.struct(*[c for c in results.columns if c != "id"]).alias("r")), "id")
    hit = near.groupBy("id").agg(F.min_by("r", F.struct((~listed).alias("no"), F.col("r.rank").alias("rank"))).alias("hit"))
    rows = entries.join(hit, "id", "left")
    rows = rows.join(contexts.select("id", F.col("text").alias("context_text")), "id", "left") if contexts is not None else rows.withColumn("context_text", F.lit(None).cast("string"))
    read = F.lower(F.coalesce("context_text", F.lit("")))
    ok = (
        (e["acceptable"].isNull() | F.coalesce(F.array_contains(e["acceptable"], F.col("hit.session_uuid")) & (F.col("hit.rank") <= top), F.lit(False)))
        & (e["cwd_contains"].isNull() | F.coalesce(_holds(F.col("hit.cwd"), e["cwd_contains"]), F.lit(False)))
        & (e["match_source"].isNull() | F.coalesce(F.col("hit.match_source") == e["match_source"], F.lit(False)))
        & (e["context"]["must_contain"].isNull() | F.forall(e["context"]["must_contain"], lambda n: F.contains(read, F.lower(n))))
    )
    mark = F.when(F.col("status") == "stale", "skip").when(ok, "pass").otherwise("fail")
    return rows.withColumn("mark", mark).withColumn("blocking", (F.col("mark") == "fail") & (F.col("status") == "hard"))


def context_mode(expected: Column, match_seq: Column) -> Column:
    """read-range or read-page, as the entry says or as the hit allows; null where no text is expected."""
    mode = F.coalesce(expected["context"]["mode"], F.lit("auto"))
    return F.when(expected["context"]["must_contain"].isNotNull(), F.when(mode != "auto", mode).when(match_seq.isNotNull(), "read-range").otherwise("read-page"))


def golden_scoreboard(marks: DataFrame) -> DataFrame:
    failed = F.col("mark") == "fail"
    return marks.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("mark") == m).alias(n) for m, n in (("pass", "passed"), ("fail", "failed"), ("skip", "skipped"))],
        F.count_if(failed & (F.col("status") == "hard")).alias("hard_failed"), F.count_if(failed & (F.col("status") == "candidate")).alias("candidate_failed"),
    )


def latencies(runs: DataFrame, group: str, value: str) -> DataFrame:
    """group, p50 (median) and p95 (the element at floor(0.95 n) of the ascending values)."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(group).orderBy(value))
    counts = runs.groupBy(group).agg(F.percentile(value, 0.5).alias("p50"), (F.floor(F.lit(0.95) * F.count("*")) + 1).alias("at"))
    return runs.select(group, value, place.alias("place")).join(counts, group).filter(F.col("place") == F.col("at")).select(group, "p50", F.col(value).alias("p95"))
