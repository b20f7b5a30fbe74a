"""Queries over names, texts, keys, findings, evaluations and stored scopes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import code_graph, lenses, scanning, store
from ..session import ensure_checkpoint_dir, table
from ..sources import files
from . import graph
from .relations import _FINDINGS, _sql

#: What the predicates ask for.
PREFIX, PART, ENDING, RELEVANT = "src/", "Cache", "_key", ["restore_session", "cache", "token_key"]
WORDS, LARGEST, LIKE_DEGREE = 20, 50, 2


def _chunks(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return lenses.chunks(spark, sf, *columns)


def prefixed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of files whose path begins with a prefix, taken literally."""
    return _chunks(spark, sf, "file_path").where(F.startswith("file_path", F.lit(PREFIX))).select("chunk_id", "file_path")


def containing_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks whose name holds a part, whatever the case."""
    return _chunks(spark, sf, "name").where(F.contains(F.lower("name"), F.lit(PART.lower()))).select("chunk_id", "name")


def ending_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks whose name is or ends with a name."""
    return _chunks(spark, sf, "name").where(F.endswith("name", F.lit(ENDING)) | (F.col("name") == ENDING.lstrip("_"))).select("chunk_id", "name")


def relevant_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks whose name holds one of the wanted names or is held by one; an empty name is held by every name."""
    name = F.lower("name")
    wanted = F.array(*map(F.lit, RELEVANT))
    return _chunks(spark, sf, "name").where(F.exists(wanted, lambda r: F.contains(name, r) | F.contains(r, name))).select("chunk_id", "name")


def ranked_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Security findings once for each rule, file, line and function, with a stable key, ranked in each file by severity, line and rule."""
    c = _chunks(spark, sf, "repo_id", "file_path", "name", "content", "start_line")
    at = F.struct("repo_id", "file_path", "name")
    found = scanning.line_findings(c.select(at.alias("at"), "content", "start_line"), "at", "content", "start_line").select("at.*", "line", "rule", "severity").distinct()
    weight = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)
    key = F.sha1(F.concat_ws("|", "rule", F.coalesce("file_path", F.lit("")), F.col("line").cast("string"), F.coalesce("name", F.lit(""))))
    place = F.row_number().over(Window.partitionBy("repo_id", "file_path").orderBy(F.desc(weight), "line", "rule", "name"))
    return found.select("repo_id", "file_path", "line", "rule", "severity", key.alias("key"), place.alias("place"))


def rule_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule with the number of its findings, none included."""
    found = scanning.line_findings(_chunks(spark, sf, "content", "start_line"), "chunk_id", "content", "start_line").groupBy("rule").agg(F.count("*").alias("n"))
    rules = spark.createDataFrame([r[:3] for r in scanning.LINE_RULES], "rule string, category string, severity string")
    return rules.join(found, "rule", "left").select("rule", "category", "severity", F.coalesce("n", F.lit(0)).alias("findings"))


def answer_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Key under which the answer to a question of a repository is stored."""
    text = F.concat_ws(":", F.lit("answer"), F.coalesce("repo_id", F.lit("")), F.lower(F.trim(F.coalesce("question", F.lit("")))))
    return lenses.requests(spark, sf, "repo_id", "question").select("request_id", F.substring(F.sha2(text, 256), 1, 40).alias("key"))


def answer_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each answer, and the answer cut after a number of words, its blanks kept and a full stop put after it."""
    head = F.regexp_extract("answer", rf"^\s*(?:\S+\s+){{0,{WORDS - 1}}}\S+", 0)
    n = F.size(F.regexp_extract_all("answer", F.lit(r"\S+"), F.lit(0)))
    short = F.when(n > WORDS, F.concat(F.regexp_replace(head, r"[.,;:]+$", ""), F.lit("."))).otherwise(F.col("answer"))
    return lenses.requests(spark, sf, "answer").where("answer is not null").select("request_id", n.alias("words"), F.md5(short).alias("digest"), F.length(short).alias("n_chars"))


def prepared_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as they go to a model: without NUL, trimmed, at most 8,000 characters."""
    x = F.substring(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "\x00", "")), 1, 8_000)
    return table(spark, sf, "documents").select("doc_id", F.md5(x).alias("digest"), F.length(x).alias("n_chars"))


def event_properties(spark: SparkSession, sf: str) -> DataFrame:
    """The number in the JSON object of each event, sliced out of whatever stands around it, and whether it is within 0 to 50."""
    body = F.regexp_extract("props", r"(?s)(\{.*\})", 1)
    k = F.get_json_object(body, "$.k").try_cast("int")
    return table(spark, sf, "events").select("event_id", k.alias("k"), F.coalesce(k.between(0, 50), F.lit(False)).alias("in_range"))


def chunk_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """What is stored beside a chunk's vector: the heads of its documentation and content."""
    doc, head = F.substring(F.coalesce("docstring", F.lit("")), 1, 500), F.substring(F.coalesce("content", F.lit("")), 1, 300)
    return _chunks(spark, sf, "name", "docstring", "content").select("chunk_id", F.md5(F.concat_ws("\n", F.coalesce("name", F.lit("")), doc, head)).alias("digest"), F.length(doc).alias("doc_chars"), F.length(head).alias("head_chars"))


def item_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Each keyword of each evaluation item in its place."""
    return table(spark, sf, "eval_items").select("item_id", "category", F.posexplode("keywords").alias("n", "keyword"))


def load_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Busiest hour, share of requests without an answer and mean of the hourly medians of each provider."""
    r = lenses.requests(spark, sf, "provider_used", "answer", "total_latency_ms", "asked_at").where("provider_used is not null and asked_at is not null")
    hour = r.groupBy("provider_used", F.date_trunc("hour", "asked_at").alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.trim("answer"), F.lit("")) == "").alias("failed"), F.percentile("total_latency_ms", 0.5).alias("median"))
    return hour.groupBy("provider_used").agg(F.max("n").alias("busiest"), F.round(F.sum("failed") / F.sum("n"), 6).alias("failure_rate"), F.round(F.avg("median"), 6).alias("mean_median"))


def load_test_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The figures of a load test, written as its CSV by hour from the request log and read from there: best rate, share of failures, mean of
    the medians."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/load-{uuid.uuid4().hex}"
    r = lenses.requests(spark, sf, "answer", "total_latency_ms", "asked_at").where("asked_at is not null")
    hour = r.groupBy(F.date_trunc("hour", "asked_at").alias("Hour")).agg(F.count("*").alias("Request Count"), F.count_if(F.coalesce(F.trim("answer"), F.lit("")) == "").alias("Failure Count"), F.round(F.percentile("total_latency_ms", 0.5), 3).alias("Median Response Time"))
    hour.withColumn("Requests/s", F.round(F.col("Request Count") / 3600, 9)).drop("Hour").write.option("header", True).csv(path)
    rows = files.load_test(spark, path)
    return rows.agg(F.round(F.max("rate"), 6).alias("best_rate"), F.round(F.sum("failures") / F.sum("requests"), 6).alias("failure_rate"), F.round(F.avg("median"), 4).alias("mean_median"))


def evaluation_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Answered, skipped and failed requests of each repository and the mean latency of the answered ones: 0 and null where there are none."""
    r = lenses.requests(spark, sf, "repo_id", "answer", "total_latency_ms")
    done = F.coalesce(F.trim("answer"), F.lit("")) != ""
    mean = F.avg(F.when(done, F.col("total_latency_ms")))
    return r.groupBy("repo_id").agg(F.count_if(done).alias("evaluated"), F.count_if(F.col("answer").isNull()).alias("skipped"), F.count_if(F.col("answer").isNotNull() & ~done).alias("failed"), F.round(F.coalesce(mean, F.lit(0.0)), 6).alias("mean_or_zero"), F.round(mean, 6).alias("mean_or_null"))


def analysis_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks, chunks with security findings, chunks with bug signs of each repository."""
    c = _chunks(spark, sf, "repo_id", "content")
    any_rule = "(?i)" + "|".join(f"(?:{p})" for *_, p in scanning.LINE_RULES)
    unsafe = F.col("content").rlike(any_rule) & F.exists(F.split("content", "\n"), lambda line: line.rlike(any_rule))
    fragile = F.greatest(*(F.col("content").rlike("(?i)" + p) for _, p in scanning.TEXT_RULES))
    return c.groupBy("repo_id").agg(F.count("*").alias("chunks"), F.count_if(unsafe).alias("unsafe"), F.count_if(fragile).alias("fragile"))


def branch_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Branches of each function by its keywords and signs, plus one, and the band of risk from 10 and from 20 on."""
    c = _chunks(spark, sf, "chunk_type", "content").where(F.col("chunk_type").isin(*lenses.FUNCTION_TYPES) & F.col("content").isNotNull())
    n = F.regexp_count("content", F.lit(BRANCHES)) + 1
    return c.select("chunk_id", n.alias("branches"), F.when(n > 20, "high").when(n > 10, "medium").otherwise("low").alias("risk"))


# Fixed value: what a branch of the six languages is written with.
BRANCHES = r"\b(?:if|elif|for|while|except|catch|case|and|or|assert)\b|&&|\|\|"


def largest_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The functions of most branches, a report of fixed length."""
    n = branch_counts(spark, sf)
    return n.orderBy(F.desc("branches"), "chunk_id").limit(LARGEST).select("chunk_id", "branches", "risk")


def first_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk each file begins with."""
    return _chunks(spark, sf, "file_id", "start_line").where("file_id is not null").groupBy("file_id").agg(F.min_by("chunk_id", F.struct(F.coalesce("start_line", F.lit(0)), "chunk_id")).alias("chunk_id"))


def model_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Models by number of requests, then by name, both from the largest on."""
    n = lenses.requests(spark, sf, "model_used").groupBy("model_used").agg(F.count("*").alias("n"))
    return n.select("model_used", "n", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("model_used"))).alias("place"))  # a row for each model


def embedding_work(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that no stored vector belongs to."""
    c = _chunks(spark, sf, "qdrant_point_id")
    return c.select("chunk_id").join(c.where("qdrant_point_id is not null").select("chunk_id"), "chunk_id", "left_anti")


def filtered_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Calls between the functions that are central enough and hold a text in their name or path."""
    calls = graph._calls(spark, sf)
    central = code_graph.degrees(graph._functions(spark, sf), calls).where(F.col("centrality") * 10 >= LIKE_DEGREE).select("id")
    named = graph._chunks(spark, sf).where(F.contains(F.lower(F.concat_ws(" ", "name", "file_path")), F.lit("a"))).select(F.col("chunk_id").alias("id"))
    return code_graph.induced(calls, central.join(named, "id", "left_semi")).select("src", "dst")


def repository_branches(spark: SparkSession, sf: str) -> DataFrame:
    """Branch by its full reference."""
    ref = F.concat(F.lit("refs/heads/"), F.coalesce("branch", F.lit("main")))
    return table(spark, sf, "repositories").select("repo_id", F.regexp_replace(ref, "^refs/(?:heads|tags)/", "").alias("branch"))


def remaining_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of each repository after those of the repositories that aren't completed were removed."""
    gone = table(spark, sf, "repositories").where("status <> 'completed'").select("repo_id")
    return store.without_scope(_chunks(spark, sf, "repo_id"), "repo_id", gone).groupBy("repo_id").agg(F.count("*").alias("chunks"))


def stored_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of each repository, counted in the table they were written to by repository."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    store.write_by_scope(_chunks(spark, sf, "repo_id", "name"), path)
    return spark.read.schema("chunk_id string, name string, repo_id string").parquet(path).groupBy("repo_id").agg(F.count("*").alias("chunks"), F.count_distinct("name").alias("names"))


def vector_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of each label after all were checked to be of one length."""
    v = store.check_dimension(table(spark, sf, "embeddings"), "embedding", 64)
    return v.groupBy("label").agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dimension"))


QUERIES = {
    f.__name__: f
    for f in (
        prefixed_chunks, containing_chunks, ending_chunks, relevant_chunks, ranked_findings, rule_totals, answer_keys, answer_limits, prepared_texts, event_properties, chunk_payloads, item_keywords, load_summary, load_test_totals, evaluation_totals,
        analysis_totals, branch_counts, largest_functions, first_chunks, model_usage, embedding_work, filtered_graph, repository_branches, remaining_chunks, stored_chunks, vector_totals,
    )
}

_C, _R = lenses.SQL["chunks"], lenses.SQL["requests"]
_PLACED = f"""WITH {_C}, code_lines AS (SELECT chunk_id, repo_id, file_path, name, (coalesce(start_line, 1) + i - 1)::INT AS line, t FROM (SELECT chunk_id, repo_id, file_path, name, start_line, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM chunks)),
found AS (SELECT DISTINCT f.repo_id, c.file_path, c.name, f.line, f.rule, f.severity FROM ({_FINDINGS}) f JOIN chunks c ON c.chunk_id = f.chunk_id)"""
_ANY = "|".join(f"(?:{p})" for *_, p in scanning.LINE_RULES)
_BRANCHED = f"WITH {_C}, b AS (SELECT chunk_id, (len(regexp_extract_all(content, {_sql(BRANCHES)})) + 1)::INT AS branches FROM chunks WHERE chunk_type IN {graph._FN} AND content IS NOT NULL), r AS (SELECT chunk_id, branches, CASE WHEN branches > 20 THEN 'high' WHEN branches > 10 THEN 'medium' ELSE 'low' END AS risk FROM b)"
ORACLES = {
    "prefixed_chunks": f"WITH {_C} SELECT chunk_id, file_path FROM chunks WHERE starts_with(file_path, '{PREFIX}')",
    "containing_chunks": f"WITH {_C} SELECT chunk_id, name FROM chunks WHERE name ILIKE '%{PART}%'",
    "ending_chunks": f"WITH {_C} SELECT chunk_id, name FROM chunks WHERE suffix(name, '{ENDING}') OR name = '{ENDING.lstrip('_')}'",
    "relevant_chunks": f"WITH {_C} SELECT chunk_id, name FROM chunks WHERE " + " OR ".join(f"contains(lower(name), '{r}') OR contains('{r}', lower(name))" for r in RELEVANT),
    "ranked_findings": f"""{_PLACED} SELECT repo_id, file_path, line, rule, severity, sha1(concat_ws('|', rule, coalesce(file_path, ''), line::VARCHAR, coalesce(name, ''))) AS key,
row_number() OVER (PARTITION BY repo_id, file_path ORDER BY CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, line, rule, name NULLS FIRST)::INT AS place FROM found""",
    "rule_totals": f"""{_PLACED}, n AS (SELECT rule, count(*) AS n FROM ({_FINDINGS}) GROUP BY 1), rules AS (SELECT * FROM (VALUES {", ".join(f"('{r}', '{c}', '{s}')" for r, c, s, _ in scanning.LINE_RULES)}) v(rule, category, severity))
SELECT rule, category, severity, coalesce(n, 0) AS findings FROM rules LEFT JOIN n USING (rule)""",
    "answer_keys": f"WITH {_R} SELECT request_id, sha256(concat_ws(':', 'answer', coalesce(repo_id, ''), lower(trim(coalesce(question, '')))))[1:40] AS key FROM requests",
    "answer_limits": rf"""WITH {_R}, a AS (SELECT request_id, answer, len(regexp_extract_all(answer, '\S+'))::INT AS words, regexp_replace(regexp_extract(answer, '^\s*(?:\S+\s+){{0,{WORDS - 1}}}\S+'), '[.,;:]+$', '') || '.' AS head FROM requests WHERE answer IS NOT NULL),
s AS (SELECT request_id, words, CASE WHEN words > {WORDS} THEN head ELSE answer END AS x FROM a) SELECT request_id, words, md5(x) AS digest, length(x)::INT AS n_chars FROM s""",
    "prepared_texts": "WITH x AS (SELECT doc_id, substring(trim(replace(coalesce(text, ''), chr(0), '')), 1, 8000) AS x FROM documents) SELECT doc_id, md5(x) AS digest, length(x)::INT AS n_chars FROM x",
    "event_properties": r"WITH e AS (SELECT event_id, TRY_CAST(regexp_extract(props, '(?s)(\{.*\})', 1) AS JSON) ->> '$.k' AS k FROM events) SELECT event_id, TRY_CAST(k AS INT) AS k, coalesce(TRY_CAST(k AS INT) BETWEEN 0 AND 50, false) AS in_range FROM e",
    "chunk_payloads": f"WITH {_C}, p AS (SELECT chunk_id, coalesce(name, '') AS n, substring(coalesce(docstring, ''), 1, 500) AS d, substring(coalesce(content, ''), 1, 300) AS c FROM chunks) SELECT chunk_id, md5(concat_ws(chr(10), n, d, c)) AS digest, length(d)::INT AS doc_chars, length(c)::INT AS head_chars FROM p",
    "item_keywords": "SELECT item_id, category, (generate_subscripts(keywords, 1) - 1)::INT AS n, unnest(keywords) AS keyword FROM eval_items",
    "load_summary": f"""WITH {_R}, h AS (SELECT provider_used, date_trunc('hour', asked_at) AS hour, count(*) AS n, count(*) FILTER (coalesce(trim(answer), '') = '') AS failed, quantile_cont(total_latency_ms, 0.5) AS median FROM requests WHERE provider_used IS NOT NULL AND asked_at IS NOT NULL GROUP BY 1, 2)
SELECT provider_used, max(n) AS busiest, round(sum(failed) / sum(n), 6) AS failure_rate, round(avg(median), 6) AS mean_median FROM h GROUP BY 1""",
    "load_test_totals": f"""WITH {_R}, h AS (SELECT date_trunc('hour', asked_at) AS hour, count(*) AS n, count(*) FILTER (coalesce(trim(answer), '') = '') AS failed, round(quantile_cont(total_latency_ms, 0.5), 3) AS median FROM requests WHERE asked_at IS NOT NULL GROUP BY 1)
SELECT round(max(n / 3600), 6) AS best_rate, round(sum(failed) / sum(n), 6) AS failure_rate, round(avg(median), 4) AS mean_median FROM h""",
    "evaluation_totals": f"""WITH {_R}, r AS (SELECT *, coalesce(trim(answer), '') <> '' AS done FROM requests)
SELECT repo_id, count(*) FILTER (done) AS evaluated, count(*) FILTER (answer IS NULL) AS skipped, count(*) FILTER (answer IS NOT NULL AND NOT done) AS failed, round(coalesce(avg(total_latency_ms) FILTER (done), 0), 6) AS mean_or_zero, round(avg(total_latency_ms) FILTER (done), 6) AS mean_or_null FROM r GROUP BY 1""",
    "analysis_totals": f"""WITH {_C} SELECT repo_id, count(*) AS chunks, count(*) FILTER (len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, {_sql(_ANY)}, 'i'))) > 0) AS unsafe,
count(*) FILTER ({" OR ".join(f"regexp_matches(content, {_sql(p)}, 'i')" for _, p in scanning.TEXT_RULES)}) AS fragile FROM chunks GROUP BY 1""",
    "branch_counts": f"{_BRANCHED} SELECT chunk_id, branches, risk FROM r",
    "largest_functions": f"{_BRANCHED} SELECT chunk_id, branches, risk FROM r ORDER BY branches DESC, chunk_id LIMIT {LARGEST}",
    "first_chunks": f"WITH {_C} SELECT file_id, chunk_id FROM (SELECT file_id, chunk_id, row_number() OVER (PARTITION BY file_id ORDER BY coalesce(start_line, 0), chunk_id) AS rn FROM chunks WHERE file_id IS NOT NULL) WHERE rn = 1",
    "model_usage": f"WITH {_R} SELECT model_used, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, model_used DESC NULLS LAST)::INT AS place FROM requests GROUP BY 1",
    "embedding_work": f"WITH {_C} SELECT chunk_id FROM chunks EXCEPT SELECT chunk_id FROM chunks WHERE qdrant_point_id IS NOT NULL",
    "filtered_graph": f"""WITH {graph._DEGREES}, c AS (SELECT id FROM (SELECT id, round(degree / greatest(max(degree) OVER (PARTITION BY repo_id), 1), 6) AS centrality FROM degrees) WHERE centrality * 10 >= {LIKE_DEGREE}),
k AS (SELECT id FROM c JOIN chunks ON chunk_id = id WHERE contains(lower(concat_ws(' ', name, file_path)), 'a')) SELECT src, dst FROM calls WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""",
    "repository_branches": "SELECT repo_id, regexp_replace('refs/heads/' || coalesce(branch, 'main'), '^refs/(?:heads|tags)/', '') AS branch FROM repositories",
    "remaining_chunks": f"WITH {_C} SELECT repo_id, count(*) AS chunks FROM chunks WHERE repo_id NOT IN (SELECT repo_id FROM repositories WHERE status <> 'completed') GROUP BY 1",
    "stored_chunks": f"WITH {_C} SELECT repo_id, count(*) AS chunks, count(DISTINCT name) AS names FROM chunks GROUP BY 1",
    "vector_totals": "SELECT label, count(*) AS vectors, max(len(embedding))::INT AS dimension FROM embeddings GROUP BY 1",
}
