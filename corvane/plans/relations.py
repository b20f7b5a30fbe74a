"""Relational queries: joins, roll-ups, listings, ordered budgets, scans and evaluation figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import lenses, packing, scanning
from ..session import table

#: Budgets in tokens.
PREFIX_BUDGET, PACK_BUDGET, HISTORY_BUDGET = 600, 800, 60
BLOCK_CHARS, BLOCK_LINES = 120, 50


def repository_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Files, chunks and chunks not yet embedded of every repository."""
    files = lenses.files(spark, sf, "repo_id").groupBy("repo_id").agg(F.count("*").alias("files"))
    chunks = lenses.chunks(spark, sf, "repo_id", "qdrant_point_id").groupBy("repo_id").agg(F.count("*").alias("chunks"), F.count("qdrant_point_id").alias("embedded"))
    out = table(spark, sf, "repositories").select("repo_id", "name", "status").join(files, "repo_id", "left").join(chunks, "repo_id", "left").fillna(0, ["files", "chunks", "embedded"])
    return out.withColumn("pending", F.col("chunks") - F.col("embedded")).withColumn("in_sync", F.col("pending") == 0)


def file_chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = lenses.chunks(spark, sf, "file_id").groupBy("file_id").agg(F.count("*").alias("chunks"))
    return lenses.files(spark, sf).join(counts, "file_id", "left").select("file_id", "repo_id", "relative_path", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def file_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols by type of each file."""
    return lenses.chunks(spark, sf, "file_id", "chunk_type").groupBy("file_id").agg(
        F.count_if(F.col("chunk_type").isin("function", "async_function")).alias("functions"), F.count_if(F.col("chunk_type").isin("method", "async_method")).alias("methods"), F.count_if(F.col("chunk_type") == "class").alias("classes")
    )


def file_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Every directory and file of each repository, with the number of files below it."""
    parts = F.split("relative_path", "/")
    paths = lenses.files(spark, sf, "repo_id", "relative_path").where("relative_path is not null").select("repo_id", "relative_path").distinct()
    each = paths.select("repo_id", F.size(parts).alias("n"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("i", "path"))
    return each.groupBy("repo_id", "path").agg(F.max(F.col("i") + 1 < F.col("n")).alias("is_dir"), F.count("*").alias("files"))


def language_totals(spark: SparkSession, sf: str) -> DataFrame:
    return lenses.files(spark, sf, "language", "line_count", "size_bytes").groupBy("language").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"), F.sum("size_bytes").alias("bytes"))


def chunk_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Display name, number of lines and token estimates of each chunk."""
    c = lenses.chunks(spark, sf, "file_path", "name", "parent_name", "start_line", "end_line", "content")
    return c.select(
        "chunk_id",
        F.when(F.coalesce("parent_name", F.lit("")) != "", F.concat_ws(".", "parent_name", "name")).otherwise(F.col("name")).alias("display_name"),
        (F.col("end_line") - F.col("start_line") + 1).alias("n_lines"),
        t.token_estimate(F.col("content")).alias("tokens"),
        t.file_token_estimate(F.col("content"), F.col("file_path")).alias("file_tokens"),
    )


def embedding_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Digest and length of the text each chunk is embedded by."""
    c = lenses.chunks(spark, sf, "chunk_type", "name", "docstring", "content")
    x = t.embedding_text(F.col("chunk_type"), F.col("name"), F.col("docstring"), F.col("content"))
    return c.select("chunk_id", F.md5(x).alias("digest"), F.length(x).alias("n_chars"))


def text_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in blocks of fixed length."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(t.fixed_blocks(F.col("text"), BLOCK_CHARS)).alias("block", "text"))


def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Files in blocks of BLOCK_LINES lines; blank blocks are left out. The lines stay in their row: no shuffle but that of the rescans."""
    lines = F.split(F.regexp_replace("content", "\r\n", "\n"), "\n")
    block = lambda b: F.array_join(F.slice(F.col("lines"), b * BLOCK_LINES + 1, BLOCK_LINES), "\n")
    f = lenses.files(spark, sf, "content").where("content is not null").withColumn("lines", lines).withColumn("n", F.size("lines"))
    each = f.select("file_id", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK_LINES).cast("int")), block)).alias("b", "text"))
    start = F.col("b") * BLOCK_LINES + 1
    return each.where(F.trim(F.regexp_replace("text", r"\s", "")) != "").select("file_id", F.concat(F.lit("block_"), start).alias("name"), start.alias("start_line"), F.least(start + BLOCK_LINES - 1, "n").alias("end_line"), F.length("text").alias("n_chars"))


def context_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """The first chunks of each file that fit a token budget."""
    c = lenses.chunks(spark, sf, "file_id", "start_line", "content").withColumn("tokens", t.token_estimate(F.col("content")))
    kept = packing.prefix_budget(c, "file_id", [F.coalesce("start_line", F.lit(0)), F.col("chunk_id")], "tokens", PREFIX_BUDGET)
    return kept.select("file_id", "chunk_id", F.col("place").cast("int").alias("place"), F.col("used").cast("long").alias("used"))


def context_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of each file packed by length into a token budget, skipping those that don't fit."""
    c = lenses.chunks(spark, sf, "file_id", "content").withColumn("tokens", t.token_estimate(F.col("content"))).withColumn("priority", F.length("content")).where("file_id is not null and priority is not null")
    return packing.greedy_pack(c, "file_id", "chunk_id", "priority", "tokens", PACK_BUDGET)


def history_window(spark: SparkSession, sf: str) -> DataFrame:
    """The newest turns of each session within a budget, in their order."""
    r = lenses.requests(spark, sf, "session_id", "question", "asked_at").where("session_id is not null").withColumn("tokens", F.greatest(t.token_estimate(F.col("question")), F.lit(1)))
    kept = packing.prefix_budget(r, "session_id", [F.desc("asked_at"), F.desc("request_id")], "tokens", HISTORY_BUDGET)
    order = F.row_number().over(Window.partitionBy("session_id").orderBy("asked_at", "request_id"))
    return kept.select("session_id", "request_id", F.col("used").cast("long").alias("used"), order.alias("turn"))


def session_latency_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Exponentially weighted latency after each request of a session."""
    r = lenses.requests(spark, sf, "session_id", "asked_at", "total_latency_ms").where("session_id is not null and total_latency_ms is not null")
    return packing.running_mean(r, "session_id", ["asked_at", "request_id"], "total_latency_ms", 0.1).select("session_id", "request_id", F.round("mean", 6).alias("mean"))


def security_findings(spark: SparkSession, sf: str) -> DataFrame:
    return scanning.line_findings(lenses.chunks(spark, sf, "content", "start_line"), "chunk_id", "content", "start_line")


def security_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = scanning.line_findings(lenses.chunks(spark, sf, "content", "start_line", "repo_id").select("repo_id", "content", "start_line"), "repo_id", "content", "start_line")
    return found.groupBy("repo_id", "severity").agg(F.count("*").alias("n"))


def bug_findings(spark: SparkSession, sf: str) -> DataFrame:
    return scanning.text_findings(lenses.chunks(spark, sf, "content"), "chunk_id", "content")


def error_signals(spark: SparkSession, sf: str) -> DataFrame:
    """What each issue names: exception, file, line, function."""
    s = t.error_signal(F.trim("text"))
    return table(spark, sf, "documents").where("kind = 'issue' and text is not null").select("doc_id", *(c.alias(k) for k, c in s.items()))


def task_types(spark: SparkSession, sf: str) -> DataFrame:
    return lenses.requests(spark, sf, "question").groupBy(t.task_type(F.col("question")).alias("task")).agg(F.count("*").alias("n"))


def latency_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Interpolated percentiles, mean and deviation of the latency of each provider and model."""
    v, by = F.col("total_latency_ms"), ["provider_used", "model_used"]
    r = lenses.requests(spark, sf, *by, "total_latency_ms", "cached")
    shares = packing.exact_percentiles(r, by, "total_latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    rest = r.groupBy(F.to_json(F.struct(*by)).alias("g"), *by).agg(
        F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("deviation"), F.min(v).alias("least"), F.max(v).alias("most"), F.count_if("cached").alias("hits"), F.round(F.count_if("cached") / F.count("*"), 6).alias("hit_rate")
    )
    out = rest.join(shares.drop(*by), "g", "left")
    return out.select(*by, "n", *(F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")), "mean", "deviation", "least", "most", "hits", "hit_rate")


def latency_lower(spark: SparkSession, sf: str) -> DataFrame:
    """The value at the lower index of the 95th percentile, by provider."""
    r = lenses.requests(spark, sf, "provider_used", "total_latency_ms")
    return packing.exact_percentiles(r, ["provider_used"], "total_latency_ms", {"p95": 0.95}, interpolate=False).select("provider_used", F.round("p95", 6).alias("p95"))


def daily_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Requests and tokens of each provider and day."""
    r = lenses.requests(spark, sf, "provider_used", "estimated_tokens", "asked_at").where("provider_used is not null")
    return r.groupBy(F.date_format("asked_at", "yyyy-MM-dd").alias("day"), F.col("provider_used").alias("provider")).agg(F.count("*").alias("requests"), F.sum(F.coalesce("estimated_tokens", F.lit(0))).cast("long").alias("tokens"))


def repository_names(spark: SparkSession, sf: str) -> DataFrame:
    """Name by URL, newest first, in pages of ten."""
    name = F.regexp_replace(F.element_at(F.split(F.regexp_replace("github_url", "/+$", ""), "/"), -1), r"\.git$", "")
    place = F.row_number().over(Window.orderBy(F.desc("created_at"), "repo_id"))  # a fixed table of few rows
    return table(spark, sf, "repositories").select("repo_id", name.alias("url_name"), F.floor((place - 1) / 10).cast("int").alias("page"))


QUERIES = {
    f.__name__: f
    for f in (
        repository_summary, file_chunk_counts, file_symbols, file_tree, language_totals, chunk_labels, embedding_inputs, text_blocks, line_chunks, context_prefix, context_packing, history_window, session_latency_trend,
        security_findings, security_summary, bug_findings, error_signals, task_types, latency_stats, latency_lower, daily_usage, repository_names,
    )
}

_C, _F, _R = lenses.SQL["chunks"], lenses.SQL["files"], lenses.SQL["requests"]
_EST = "CASE WHEN coalesce(length({0}), 0) = 0 THEN 0 ELSE greatest(1, floor(length({0}) / 4))::INT END"


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_FINDINGS = " UNION ALL ".join(f"SELECT chunk_id, repo_id, line, '{r}' AS rule, '{c}' AS category, '{s}' AS severity FROM code_lines WHERE regexp_matches(t, {_sql(p)}, 'i')" for r, c, s, p in scanning.LINE_RULES)
_LINES = f"WITH {_C}, code_lines AS (SELECT chunk_id, repo_id, (coalesce(start_line, 1) + i - 1)::INT AS line, t FROM (SELECT chunk_id, repo_id, start_line, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM chunks)), found AS ({_FINDINGS})"
_RATE = "CASE lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.CHARS_PER_TOKEN.items()) + " ELSE 4.0 END"
_PLACE = r"(?:at\s+)?([A-Za-z0-9_./\\-]+\.[A-Za-z0-9_]+)[:\s]+(\d+)"
_WORDED = r"\(([A-Za-z0-9_./\\-]+\.[A-Za-z0-9_]+)\s+line\s+(\d+)\)"
_WORDS = {k: "|".join(v) for k, v in t.TASK_WORDS.items()}
ORACLES = {
    "repository_summary": f"""WITH {_C}, {_F}, f AS (SELECT repo_id, count(*) AS files FROM files GROUP BY 1), c AS (SELECT repo_id, count(*) AS chunks, count(qdrant_point_id) AS embedded FROM chunks GROUP BY 1)
SELECT repo_id, name, status, coalesce(files, 0) AS files, coalesce(chunks, 0) AS chunks, coalesce(embedded, 0) AS embedded, coalesce(chunks, 0) - coalesce(embedded, 0) AS pending, coalesce(chunks, 0) = coalesce(embedded, 0) AS in_sync FROM repositories LEFT JOIN f USING (repo_id) LEFT JOIN c USING (repo_id)""",
    "file_chunk_counts": f"WITH {_C}, {_F}, c AS (SELECT file_id, count(*) AS chunks FROM chunks GROUP BY 1) SELECT file_id, repo_id, relative_path, coalesce(chunks, 0) AS chunks FROM files LEFT JOIN c USING (file_id)",
    "file_symbols": f"WITH {_C} SELECT file_id, count(*) FILTER (chunk_type IN ('function', 'async_function')) AS functions, count(*) FILTER (chunk_type IN ('method', 'async_method')) AS methods, count(*) FILTER (chunk_type = 'class') AS classes FROM chunks GROUP BY 1",
    "file_tree": f"""WITH {_F}, p AS (SELECT DISTINCT repo_id, relative_path FROM files WHERE relative_path IS NOT NULL), e AS (SELECT repo_id, string_split(relative_path, '/') AS parts, unnest(range(1, len(string_split(relative_path, '/')) + 1)) AS i FROM p)
SELECT repo_id, array_to_string(parts[1:i], '/') AS path, bool_or(i < len(parts)) AS is_dir, count(*) AS files FROM e GROUP BY 1, 2""",
    "language_totals": f"WITH {_F} SELECT language, count(*) AS files, sum(line_count)::BIGINT AS lines, sum(size_bytes)::BIGINT AS bytes FROM files GROUP BY 1",
    "chunk_labels": f"""WITH {_C} SELECT chunk_id, CASE WHEN coalesce(parent_name, '') <> '' THEN concat_ws('.', parent_name, name) ELSE name END AS display_name, end_line - start_line + 1 AS n_lines, {_EST.format("content")} AS tokens,
CASE WHEN coalesce(length(content), 0) = 0 THEN 0 ELSE (floor(length(content) / ({_RATE})::DOUBLE) + 1)::INT END AS file_tokens FROM chunks""",
    "embedding_inputs": f"""WITH {_C}, x AS (SELECT chunk_id, concat_ws(chr(10), upper(chunk_type[1]) || lower(chunk_type[2:]) || ': ' || name, 'Docstring: ' || nullif(docstring, ''), 'Code:' || chr(10) || nullif(content, '')) AS t FROM chunks)
SELECT chunk_id, md5(t) AS digest, length(t)::INT AS n_chars FROM x""",
    "text_blocks": "SELECT doc_id, i::INT AS block, substring(text, (i * 120 + 1)::BIGINT, 120) AS text FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 120)::BIGINT)) AS i FROM documents WHERE length(text) > 0)",
    "line_chunks": f"""WITH {_F}, l AS (SELECT file_id, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS lines FROM files WHERE content IS NOT NULL),
b AS (SELECT file_id, len(lines) AS n, lines, unnest(range(0, (len(lines) - 1) // 50 + 1)) AS b FROM l), x AS (SELECT *, array_to_string(lines[b * 50 + 1 : b * 50 + 50], chr(10)) AS text FROM b)
SELECT file_id, 'block_' || (b * 50 + 1) AS name, (b * 50 + 1)::INT AS start_line, least(b * 50 + 50, n)::INT AS end_line, length(text)::INT AS n_chars FROM x WHERE trim(regexp_replace(text, '\\s', '', 'g')) <> ''""",
    "context_prefix": f"""WITH {_C}, c AS (SELECT file_id, chunk_id, {_EST.format("content")} AS tokens, coalesce(start_line, 0) AS s FROM chunks),
w AS (SELECT *, sum(tokens) OVER (PARTITION BY file_id ORDER BY s, chunk_id ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY file_id ORDER BY s, chunk_id) AS place FROM c)
SELECT file_id, chunk_id, place::INT AS place, used::BIGINT AS used FROM w WHERE used <= 600 OR place = 1""",
    "context_packing": f"""WITH RECURSIVE {_C}, c AS (SELECT file_id, chunk_id, ({_EST.format("content")})::BIGINT AS tokens, row_number() OVER (PARTITION BY file_id ORDER BY length(content) DESC, chunk_id) AS rn FROM chunks WHERE file_id IS NOT NULL AND content IS NOT NULL),
f AS (SELECT file_id, chunk_id, rn, CASE WHEN tokens <= 800 THEN tokens ELSE 0 END AS used, tokens <= 800 AS taken FROM c WHERE rn = 1
UNION ALL SELECT c.file_id, c.chunk_id, c.rn, CASE WHEN f.used + c.tokens <= 800 THEN f.used + c.tokens ELSE f.used END, f.used + c.tokens <= 800 FROM f JOIN c ON c.file_id = f.file_id AND c.rn = f.rn + 1)
SELECT file_id, chunk_id, used::BIGINT AS used FROM f WHERE taken""",
    "history_window": f"""WITH {_R}, r AS (SELECT session_id, request_id, asked_at, greatest({_EST.format("question")}, 1) AS tokens FROM requests WHERE session_id IS NOT NULL),
w AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY asked_at DESC, request_id DESC ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY session_id ORDER BY asked_at DESC, request_id DESC) AS rn FROM r)
SELECT session_id, request_id, used::BIGINT AS used, row_number() OVER (PARTITION BY session_id ORDER BY asked_at, request_id)::INT AS turn FROM w WHERE used <= 60 OR rn = 1""",
    "session_latency_trend": f"""WITH RECURSIVE {_R}, r AS (SELECT session_id, request_id, total_latency_ms AS v, row_number() OVER (PARTITION BY session_id ORDER BY asked_at, request_id) AS rn FROM requests WHERE session_id IS NOT NULL AND total_latency_ms IS NOT NULL),
e AS (SELECT session_id, request_id, rn, v AS mean FROM r WHERE rn = 1 UNION ALL SELECT r.session_id, r.request_id, r.rn, 0.1::DOUBLE * r.v + 0.9::DOUBLE * e.mean FROM e JOIN r ON r.session_id = e.session_id AND r.rn = e.rn + 1)
SELECT session_id, request_id, round(mean, 6) AS mean FROM e""",
    "security_findings": f"{_LINES} SELECT chunk_id, line, rule, category, severity FROM found",
    "security_summary": f"{_LINES} SELECT repo_id, severity, count(*) AS n FROM found GROUP BY ALL",
    "bug_findings": f"WITH {_C} " + " UNION ALL ".join(f"SELECT chunk_id, {_sql(title)} AS title FROM chunks WHERE regexp_matches(content, {_sql(p)}, 'i')" for title, p in scanning.TEXT_RULES),
    "error_signals": f"""WITH d AS (SELECT doc_id, trim(text) AS t FROM documents WHERE kind = 'issue' AND text IS NOT NULL)
SELECT doc_id, nullif(regexp_extract(t, '\\b([A-Za-z_][A-Za-z0-9_]*(?:Error|Exception))\\b', 1), '') AS exception_type,
replace(coalesce(nullif(regexp_extract(t, '{_PLACE}', 1), ''), nullif(regexp_extract(t, '{_WORDED}', 1), '')), '\\', '/') AS file_path,
TRY_CAST(coalesce(nullif(regexp_extract(t, '{_PLACE}', 2), ''), nullif(regexp_extract(t, '{_WORDED}', 2), '')) AS INT) AS line_number,
nullif(regexp_extract(t, '\\bin\\s+([A-Za-z_][A-Za-z0-9_]*)\\b', 1), '') AS function_name FROM d""",
    "task_types": f"WITH {_R} SELECT CASE "
    + " ".join(f"WHEN regexp_matches(lower(coalesce(question, '')), '{w}') THEN '{k}'" for k, w in _WORDS.items())
    + " ELSE 'code_qa' END AS task, count(*) AS n FROM requests GROUP BY 1",
    "latency_stats": f"""WITH {_R} SELECT provider_used, model_used, count(*) AS n, round(quantile_cont(total_latency_ms, 0.5), 6) AS p50, round(quantile_cont(total_latency_ms, 0.95), 6) AS p95, round(quantile_cont(total_latency_ms, 0.99), 6) AS p99,
round(avg(total_latency_ms), 6) AS mean, round(stddev_pop(total_latency_ms), 6) AS deviation, min(total_latency_ms) AS least, max(total_latency_ms) AS most, count(*) FILTER (cached) AS hits, round(count(*) FILTER (cached) / count(*), 6) AS hit_rate FROM requests GROUP BY 1, 2""",
    "latency_lower": f"""WITH {_R}, r AS (SELECT provider_used, total_latency_ms AS v, row_number() OVER (PARTITION BY provider_used ORDER BY total_latency_ms, request_id) - 1 AS i, floor((count(*) OVER (PARTITION BY provider_used) - 1) * 0.95) AS k FROM requests WHERE total_latency_ms IS NOT NULL)
SELECT provider_used, round(v, 6) AS p95 FROM r WHERE i = k""",
    "daily_usage": f"WITH {_R} SELECT strftime(asked_at, '%Y-%m-%d') AS day, provider_used AS provider, count(*) AS requests, sum(coalesce(estimated_tokens, 0))::BIGINT AS tokens FROM requests WHERE provider_used IS NOT NULL GROUP BY 1, 2",
    "repository_names": "SELECT repo_id, regexp_replace(string_split(regexp_replace(github_url, '/+$', ''), '/')[-1], '\\.git$', '') AS url_name, ((row_number() OVER (ORDER BY created_at DESC, repo_id) - 1) // 10)::INT AS page FROM repositories",
}
