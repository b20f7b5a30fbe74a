"""Queries over file contents, keyed tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunkers, lenses, store
from ..session import table
from ..sources import files as source_files
from ..streaming import jobs


def python_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return chunkers.python_symbols(lenses.files(spark, sf, "language", "content").where("language = 'python'"))


def python_imports(spark: SparkSession, sf: str) -> DataFrame:
    return chunkers.python_imports(lenses.files(spark, sf, "language", "content").where("language = 'python'"))


def declared_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return chunkers.declared_symbols(lenses.files(spark, sf, "language", "content").where("language in ('javascript', 'typescript', 'java', 'go')"))


def path_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Language by extension and whether the path is passed over, beside the stored language."""
    path = F.col("relative_path")
    return lenses.files(spark, sf, "relative_path", "language").select("file_id", source_files.language(path).alias("by_path"), source_files.in_skipped_dir(path).alias("skipped"), "language")


def upserted_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """First versions of the chunks, replaced by their rewritten versions."""
    rows = table(spark, sf, "code_chunks").select("chunk_id", "created_at")
    first = rows.groupBy("chunk_id").agg(F.min("created_at").alias("created_at"))
    return store.upsert(first, rows, "chunk_id")


def known_bases(spark: SparkSession, sf: str) -> DataFrame:
    """References between classes of one repository whose ends are both stored."""
    c = table(spark, sf, "class_hierarchy").select("chunk_id", "repo_id", "class_name").distinct()
    named = lambda name: F.concat_ws("/", "repo_id", name)
    edges = table(spark, sf, "base_class_refs").select("chunk_id", "name").join(c, "chunk_id").select(named("class_name").alias("src"), named("name").alias("dst"), F.lit("INHERITS_FROM").alias("rel_type"))
    return store.merge_edges(edges, c.select(named("class_name").alias("id")))


def stream_daily_usage(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.daily_usage(jobs.run(jobs.first_requests(jobs.stream_table(spark, sf, "ask_pairs")).drop("at"), "append"))


def stream_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.run(jobs.event_counts(jobs.stream_table(spark, sf, "events")), "update", ["day", "event_type"])


def stream_requests(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.run(jobs.first_requests(jobs.stream_table(spark, sf, "ask_pairs")).select("request_id", "repo_id", "cached"), "append")


def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.user_sessions(table(spark, sf, "events"))


QUERIES = {f.__name__: f for f in (python_symbols, python_imports, declared_symbols, path_languages, upserted_chunks, known_bases, stream_daily_usage, stream_event_counts, stream_requests, user_sessions)}

_F = lenses.SQL["files"]
_LANG = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in source_files.LANGUAGES.items()) + " END"
_DECLARED = " UNION ALL ".join(f"SELECT file_id, '{k}' AS kind, regexp_extract(t, '{p}', 1) AS name, i::INT AS line FROM l" for k, p in chunkers.DECLARATIONS)
_D = chunkers.PYTHON_DECLARES
ORACLES = {
    "python_symbols": rf"""WITH {_F}, f AS (SELECT file_id, string_split_regex(content, '\r?\n') AS lines FROM files WHERE language = 'python' AND trim(content) <> ''),
g AS (SELECT file_id, lines, list_transform(lines, lambda x: CASE WHEN regexp_matches(x, '{chunkers.PYTHON_LOOSE}') THEN {chunkers.NO_INDENT} ELSE length(regexp_extract(x, '^[ \t]*')) END) AS indents FROM f),
l AS (SELECT file_id, unnest(lines) AS x, generate_subscripts(lines, 1) AS i FROM f),
d AS (SELECT file_id, i, length(regexp_extract(x, '^[ \t]*')) AS indent, regexp_extract(x, '{_D}', 1) AS a, regexp_extract(x, '{_D}', 2) AS kind, regexp_extract(x, '{_D}', 3) AS name FROM l WHERE regexp_matches(x, '{_D}')),
p AS (SELECT d.file_id, d.i, arg_max(q.kind, q.i) AS pkind, arg_max(q.name, q.i) AS pname FROM d JOIN d q ON q.file_id = d.file_id AND q.i < d.i AND q.indent < d.indent GROUP BY 1, 2),
t AS (SELECT d.*, g.lines, coalesce(nullif(list_position(list_transform(g.indents[d.i + 1 :], lambda x: x <= d.indent), true), 0), len(g.lines) - d.i + 1) AS n FROM d JOIN g ON g.file_id = d.file_id),
b AS (SELECT t.*, regexp_replace(array_to_string(lines[i : i + n - 1], chr(10)), '\s+$', '') AS text FROM t)
SELECT b.file_id, CASE WHEN b.kind = 'class' THEN 'class' ELSE CASE WHEN a <> '' THEN 'async_' ELSE '' END || CASE WHEN pkind = 'class' THEN 'method' ELSE 'function' END END AS kind, b.name, CASE WHEN pkind = 'class' THEN pname END AS parent, b.i::INT AS start_line,
(b.i - 1 + len(string_split(text, chr(10))))::INT AS end_line, regexp_matches(coalesce(lines[b.i + 1], ''), '^[ \t]*[rRuU]?(?:"""+"\"\"\"|'''''')')"+rf""" AS documented, trim(regexp_extract(text, '^[ \t]*class[ \t]+[A-Za-z0-9_]+[ \t]*\(([^()]*)\)', 1)) AS bases,
array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(text, '^[^\n]*', ''), '{chunkers.PYTHON_CALL}', 1))), ',') AS calls, (len(regexp_extract_all(text, '{chunkers.PYTHON_BRANCH}')) + 1)::INT AS branches FROM b LEFT JOIN p ON p.file_id = b.file_id AND p.i = b.i""",
    "python_imports": rf"""WITH {_F}, l AS (SELECT file_id, unnest(string_split_regex(content, '\r?\n')) AS t FROM files WHERE language = 'python' AND contains(content, 'import')),
m AS (SELECT file_id, regexp_replace(trim(unnest(string_split(regexp_extract(t, '^\s*import\s+([\w., ]+?)\s*(?:#.*)?$', 1), ','))), '\s+as\s+\w+$', '') AS module FROM l UNION ALL SELECT file_id, regexp_extract(t, '^\s*from\s+([\w.]+)\s+import\b', 1) FROM l)
SELECT DISTINCT file_id, module FROM m WHERE module <> ''""",
    "declared_symbols": rf"""WITH {_F}, l AS (SELECT file_id, unnest(string_split_regex(content, '\r?\n')) AS t, generate_subscripts(string_split_regex(content, '\r?\n'), 1) AS i FROM files WHERE content IS NOT NULL AND language IN ('javascript', 'typescript', 'java', 'go'))
SELECT * FROM ({_DECLARED}) WHERE name <> ''""",
    "path_languages": f"""WITH {_F}, p AS (SELECT file_id, language, string_split(relative_path, '/') AS parts FROM files)
SELECT file_id, CASE WHEN parts[-1] NOT IN {tuple(source_files.SKIPPED_FILES)} THEN {_LANG.format("lower(regexp_extract(parts[-1], '\\.([^.]+)$', 1))")} END AS by_path, list_has_any(parts[1:len(parts) - 1], {source_files.SKIPPED_DIRS}) AS skipped, language FROM p""",
    "upserted_chunks": "SELECT chunk_id, max(created_at) AS created_at FROM code_chunks GROUP BY 1",
    "known_bases": "SELECT DISTINCT c.repo_id || '/' || c.class_name AS src, c.repo_id || '/' || r.name AS dst, 'INHERITS_FROM' AS rel_type FROM base_class_refs r JOIN class_hierarchy c USING (chunk_id) WHERE EXISTS (SELECT 1 FROM class_hierarchy k WHERE k.repo_id = c.repo_id AND k.class_name = r.name)",
    "stream_daily_usage": "SELECT strftime(asked_at, '%Y-%m-%d') AS day, provider_used AS provider, count(*) AS requests, sum(coalesce(estimated_tokens, 0))::BIGINT AS tokens FROM (SELECT DISTINCT request_id, provider_used, asked_at, estimated_tokens FROM ask_pairs) WHERE provider_used IS NOT NULL AND asked_at IS NOT NULL GROUP BY 1, 2",
    "stream_event_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2",
    "stream_requests": "SELECT DISTINCT request_id, repo_id, cached FROM ask_pairs WHERE asked_at IS NOT NULL",
    "user_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 24 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, count(*) AS events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM s GROUP BY user_id, n""",
}
