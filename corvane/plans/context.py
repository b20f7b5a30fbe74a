"""Queries that shape context: imports between files, neighbourhoods, previews, source blocks, hashed vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import chunkers, lenses, packing, retrieval, vectors
from ..operators import code_graph as g
from ..session import cut, table
from .graph import _ALL_ABOVE, _DEGREES, _above, _calls, _functions

PREVIEW_CHARS, BLOCK_BUDGET = 300, 400


def import_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Python files that import a module of their repository by its path."""
    files = cut(lenses.files(spark, sf, "repo_id", "relative_path", "language", "content").where("language = 'python'"))
    named = files.select("repo_id", F.col("file_id").alias("dst"), F.regexp_replace(F.regexp_replace("relative_path", r"\.py$", ""), "/", ".").alias("module"))
    imports = chunkers.python_imports(files).join(files.select("file_id", "repo_id"), "file_id").select("repo_id", F.col("file_id").alias("src"), F.regexp_replace("module", r"^\.+", "").alias("module"))
    return imports.join(named, ["repo_id", "module"]).where("src <> dst").select("src", "dst", "module").distinct()


def busiest_neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    """Edges among the functions within two calls of the most connected function of each repository."""
    calls = _calls(spark, sf)
    d = g.degrees(_functions(spark, sf), calls).where("degree > 0")
    centre = d.groupBy("repo_id").agg(F.max_by("id", F.struct("degree", "id")).alias("id"))
    near = cut(g.reach(centre, calls, 2, undirected=True).select("id").distinct())
    return g.induced(calls, near).select("src", "dst")


def inheritance_reach(spark: SparkSession, sf: str) -> DataFrame:
    """Number of classes above and below each class, direct ones apart."""
    pairs = cut(_above(spark, sf))
    above = pairs.groupBy(F.col("descendant").alias("class_id")).agg(F.count("*").alias("ancestors"))
    below = pairs.groupBy(F.col("ancestor").alias("class_id")).agg(F.count("*").alias("descendants"), F.count_if(F.col("steps") == 1).alias("direct"))
    return above.join(below, "class_id", "full").select("class_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("ancestors", "descendants", "direct")))


def content_previews(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks cut to a number of characters at the end of a line."""
    head = F.substring("content", 1, PREVIEW_CHARS)
    preview = F.when(F.length("content") <= PREVIEW_CHARS, F.col("content")).otherwise(F.coalesce(t.filled(F.regexp_extract(head, r"(?s)^(.*)\n", 1)), head))
    return lenses.chunks(spark, sf, "content").select("chunk_id", F.length(preview).alias("n_chars"), F.md5(preview).alias("digest"), (F.length("content") > PREVIEW_CHARS).alias("cut"))


def source_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The sources of each file that fit a budget, numbered, as one block of text."""
    c = lenses.chunks(spark, sf, "file_id", "file_path", "name", "start_line", "end_line", "content").withColumn("tokens", t.token_estimate(F.col("content")))
    kept = packing.prefix_budget(c, "file_id", [F.coalesce("start_line", F.lit(0)), F.col("chunk_id")], "tokens", BLOCK_BUDGET)
    lines = F.when((F.col("start_line") > 0) & (F.col("start_line") <= F.col("end_line")), F.concat(F.lit(" lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))).otherwise("")
    block = F.concat(F.lit("[Source "), F.col("place").cast("string"), F.lit("] "), F.coalesce("file_path", F.lit("")), lines, F.lit("\n"), F.coalesce("content", F.lit("")))
    # At most as many chunks as fit the budget (and the first one) come together for a file.
    joined = kept.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("place", block.alias("block")))).alias("b"))
    text = F.array_join(F.col("b.block"), "\n\n")
    return joined.select("file_id", F.size("b").alias("sources"), F.length(text).alias("n_chars"), F.md5(text).alias("digest"))


def hashed_search(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest documents by hashed vectors, asked with every document whose id is divisible by 100."""
    v = cut(vectors.hashed_vectors(table(spark, sf, "documents").select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id", "text"))
    return retrieval.nearest(v, v.where("doc_id % 100 = 0"), "doc_id", "vector", 5).select("query_id", "doc_id", "score", "rank")


QUERIES = {f.__name__: f for f in (import_edges, busiest_neighbourhood, inheritance_reach, content_previews, source_blocks, hashed_search)}

_C, _F = lenses.SQL["chunks"], lenses.SQL["files"]
_EST = "CASE WHEN coalesce(length(content), 0) = 0 THEN 0 ELSE greatest(1, floor(length(content) / 4))::INT END"
_UPS = r"""bases AS (SELECT DISTINCT repo_id, chunk_id AS src, regexp_extract(regexp_replace(regexp_replace(name, '\s+', '', 'g'), '[\[<(].*$', ''), '([^.:/$\\]+)$', 1) AS name, is_abstract, is_mixin FROM base_class_refs),
ups AS (SELECT DISTINCT b.src, c.chunk_id AS dst FROM bases b JOIN class_hierarchy c ON c.repo_id = b.repo_id AND c.class_name = b.name WHERE b.name NOT IN ('object', 'type', '') AND (b.is_abstract OR NOT b.is_mixin))"""
ORACLES = {
    "import_edges": rf"""WITH {_F}, py AS (SELECT * FROM files WHERE language = 'python'), l AS (SELECT file_id, repo_id, unnest(string_split_regex(content, '\r?\n')) AS t FROM py WHERE contains(content, 'import')),
m AS (SELECT file_id, repo_id, regexp_replace(trim(unnest(string_split(regexp_extract(t, '^\s*import\s+([\w., ]+?)\s*(?:#.*)?$', 1), ','))), '\s+as\s+\w+$', '') AS module FROM l UNION ALL SELECT file_id, repo_id, regexp_extract(t, '^\s*from\s+([\w.]+)\s+import\b', 1) FROM l),
n AS (SELECT DISTINCT file_id, repo_id, regexp_replace(module, '^\.+', '') AS module FROM m WHERE module <> '')
SELECT DISTINCT n.file_id AS src, p.file_id AS dst, n.module FROM n JOIN py p ON p.repo_id = n.repo_id AND replace(regexp_replace(p.relative_path, '\.py$', ''), '/', '.') = n.module WHERE n.file_id <> p.file_id""",
    "busiest_neighbourhood": f"""WITH RECURSIVE {_DEGREES}, both_ways AS (SELECT src, dst FROM calls UNION SELECT dst, src FROM calls),
centre AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY repo_id ORDER BY degree DESC, id DESC) AS rn FROM degrees WHERE degree > 0) WHERE rn = 1),
walk AS (SELECT id AS start, id, 0 AS depth FROM centre UNION SELECT w.start, e.dst, w.depth + 1 FROM walk w JOIN both_ways e ON e.src = w.id WHERE w.depth < 2)
SELECT src, dst FROM calls WHERE src IN (SELECT id FROM walk) AND dst IN (SELECT id FROM walk)""",
    "inheritance_reach": f"""WITH RECURSIVE {_UPS}, {_ALL_ABOVE}, up AS (SELECT start, id, min(depth) AS depth FROM above GROUP BY 1, 2),
a AS (SELECT start AS class_id, count(*) AS ancestors FROM up GROUP BY 1), d AS (SELECT id AS class_id, count(*) AS descendants, count(*) FILTER (depth = 1) AS direct FROM up GROUP BY 1)
SELECT class_id, coalesce(ancestors, 0) AS ancestors, coalesce(descendants, 0) AS descendants, coalesce(direct, 0) AS direct FROM a FULL JOIN d USING (class_id)""",
    "content_previews": rf"""WITH {_C}, p AS (SELECT chunk_id, content, CASE WHEN length(content) <= 300 THEN content ELSE coalesce(nullif(regexp_extract(substring(content, 1, 300), '(?s)^(.*)\n', 1), ''), substring(content, 1, 300)) END AS preview FROM chunks)
SELECT chunk_id, length(preview)::INT AS n_chars, md5(preview) AS digest, length(content) > 300 AS cut FROM p""",
    "source_blocks": f"""WITH {_C}, c AS (SELECT *, {_EST} AS tokens, coalesce(start_line, 0) AS s FROM chunks),
w AS (SELECT *, sum(tokens) OVER (PARTITION BY file_id ORDER BY s, chunk_id ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY file_id ORDER BY s, chunk_id) AS place FROM c),
k AS (SELECT file_id, place, '[Source ' || place || '] ' || coalesce(file_path, '') || CASE WHEN start_line > 0 AND start_line <= end_line THEN ' lines ' || start_line || '-' || end_line ELSE '' END || chr(10) || coalesce(content, '') AS block FROM w WHERE used <= {BLOCK_BUDGET} OR place = 1),
j AS (SELECT file_id, count(*) AS sources, string_agg(block, chr(10) || chr(10) ORDER BY place) AS t FROM k GROUP BY 1) SELECT file_id, sources::INT AS sources, length(t)::INT AS n_chars, md5(t) AS digest FROM j""",
}
_HEX = "('0x' || md5(w)[{}:{}])::UBIGINT"
ORACLES["hashed_search"] = f"""WITH w AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{vectors.TOKEN}')) AS w FROM documents) GROUP BY 1, 2),
p AS (SELECT doc_id, {_HEX.format(1, 8)} % 64 AS place, sum(CASE WHEN {_HEX.format(9, 9)} % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * (0.5::DOUBLE + {_HEX.format(10, 11)} / 255.0::DOUBLE) * n) AS x FROM w GROUP BY 1, 2),
u AS (SELECT doc_id, place, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM p),
s AS (SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.x * d.x), 6) AS score FROM u q JOIN u d ON d.place = q.place AND d.doc_id <> q.doc_id WHERE q.doc_id % 100 = 0 GROUP BY 1, 2)
SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s) WHERE rank <= 5"""
