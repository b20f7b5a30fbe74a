"""Queries over the code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import code_graph as g
from ..operators import hierarchy, lenses
from ..operators.class_links import latest_classes
from ..session import cut, table


def _chunks(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return lenses.chunks(spark, sf, "repo_id", "file_id", "file_path", "chunk_type", "name", "parent_name", "start_line", *more)


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    names = F.when(F.col("chunk_type").isin(*lenses.FUNCTION_TYPES), g.called_names(F.col("content")))
    raw = table(spark, sf, "code_chunks").select("chunk_id", "repo_id", "file_id", "chunk_type", "name", names.alias("called"), "created_at")
    return cut(g.call_edges(lenses.latest(raw, "chunk_id", "created_at")))


def _functions(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).where(F.col("chunk_type").isin(*lenses.FUNCTION_TYPES)).select(F.col("chunk_id").alias("id"), "repo_id")


def _inherits(spark: SparkSession, sf: str) -> DataFrame:
    return cut(g.inheritance_edges(table(spark, sf, "class_hierarchy"), table(spark, sf, "base_class_refs")))


def graph_node_counts(spark: SparkSession, sf: str) -> DataFrame:
    every = g.nodes(table(spark, sf, "repositories"), lenses.files(spark, sf, "repo_id", "relative_path"), _chunks(spark, sf))
    return every.groupBy("repo_id", "label").agg(F.count("*").alias("n"))


def structural_edge_counts(spark: SparkSession, sf: str) -> DataFrame:
    edges = g.structural_edges(lenses.files(spark, sf, "repo_id", "relative_path"), _chunks(spark, sf))
    return edges.groupBy("repo_id", "rel_type").agg(F.count("*").alias("n"))


def call_graph(spark: SparkSession, sf: str) -> DataFrame:
    return _calls(spark, sf).select("src", "dst", "repo_id")


def function_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return g.degrees(_functions(spark, sf), _calls(spark, sf))


def graph_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Functions, calls, density, entry points, isolated functions and greatest degrees of each repository."""
    d = g.degrees(_functions(spark, sf), _calls(spark, sf))
    n = F.count("*")
    return d.groupBy("repo_id").agg(
        n.alias("functions"),
        F.sum("out_degree").cast("long").alias("calls"),
        F.round(F.when(n > 1, F.sum("out_degree") / (n * (n - 1))).otherwise(0.0), 6).alias("density"),
        F.count_if("entry").alias("entry_points"),
        F.count_if("isolated").alias("isolated"),
        F.max("out_degree").alias("most_calls"),
        F.max("in_degree").alias("most_callers"),
    )


def _entries(spark: SparkSession, sf: str, calls: DataFrame) -> DataFrame:
    """Functions that call and aren't called; the ends of calls are functions, so the table isn't read again."""
    return calls.select(F.col("src").alias("id")).distinct().join(calls.select(F.col("dst").alias("id")), "id", "left_anti")


def call_reach(spark: SparkSession, sf: str) -> DataFrame:
    """Every function reached from an entry point within three calls, with the least number of calls."""
    calls = _calls(spark, sf)
    return g.reach(_entries(spark, sf, calls), calls, 3).where("depth > 0").select("start", "id", "depth")


def call_chains(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each chain of up to three calls from an entry point."""
    calls = _calls(spark, sf)
    return g.trails(_entries(spark, sf, calls), calls, 3).select("start", F.array_join("path", ">").alias("chain"), "depth")


def shortest_call_paths(spark: SparkSession, sf: str) -> DataFrame:
    calls = _calls(spark, sf)
    return g.shortest_paths(_entries(spark, sf, calls), calls, 5).where("depth > 0").select("start", "id", "depth", F.array_join("path", ">").alias("path"))


def context_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes around the entry points, two calls either way, by importance."""
    calls = _calls(spark, sf)
    degree = g.degrees(_functions(spark, sf), calls)
    return g.expand(degree.where("entry").select("id"), calls, degree, 2)


def call_components(spark: SparkSession, sf: str) -> DataFrame:
    """Number of connected components of each repository's calls, isolated functions included."""
    calls = _calls(spark, sf)
    placed = hierarchy.components(calls, "repo_id", "src", "dst").select(F.col("scope").alias("repo_id"), F.col("node").alias("id"), "root")
    every = _functions(spark, sf).join(placed, ["repo_id", "id"], "left").select("repo_id", F.coalesce("root", "id").alias("root"))
    return every.groupBy("repo_id").agg(F.count_distinct("root").alias("components"))


def inheritance_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _inherits(spark, sf).select("src", "dst", "rel_type")


def _above(spark: SparkSession, sf: str) -> DataFrame:
    """scope, ancestor, descendant and least steps over inheriting and implementing, whatever the depth."""
    up = _inherits(spark, sf).where("rel_type <> 'MIXES_IN'")
    return hierarchy.all_descendants(up, "repo_id", "src", "dst")


def class_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    """Each class with every class above it, whether by inheriting or implementing. Classes of a cycle are above each other, none above itself."""
    return _above(spark, sf).select(F.col("descendant").alias("class_id"), F.col("ancestor").alias("ancestor_id"), F.col("steps").alias("depth"))


def class_family(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the direct parents and children of each class."""
    classes = latest_classes(table(spark, sf, "class_hierarchy")).select("chunk_id", "class_name")
    edges = _inherits(spark, sf).select("src", "dst").distinct()
    names = classes.select(F.col("chunk_id").alias("k"), F.col("class_name").alias("n"))
    parents = edges.join(names, F.col("dst") == F.col("k")).groupBy(F.col("src").alias("chunk_id")).agg(F.array_join(F.array_sort(F.collect_set("n")), ",").alias("parents"))
    children = edges.join(names, F.col("src") == F.col("k")).groupBy(F.col("dst").alias("chunk_id")).agg(F.array_join(F.array_sort(F.collect_set("n")), ",").alias("children"))
    return classes.join(parents, "chunk_id", "left").join(children, "chunk_id", "left").select("chunk_id", "class_name", F.coalesce("parents", F.lit("")).alias("parents"), F.coalesce("children", F.lit("")).alias("children"))


QUERIES = {
    f.__name__: f
    for f in (graph_node_counts, structural_edge_counts, call_graph, function_degrees, graph_metrics, call_reach, call_chains, shortest_call_paths, context_expansion, call_components, inheritance_edges, class_ancestors, class_family)
}

_C, _F = lenses.SQL["chunks"], lenses.SQL["files"]
_FN = "('function', 'method', 'async_function', 'async_method')"
_CALLS = rf"""{_C}, fns AS (SELECT chunk_id AS id, repo_id, file_id, name, content FROM chunks WHERE chunk_type IN {_FN}),
sites AS (SELECT DISTINCT id AS src, repo_id, file_id, name FROM (SELECT id, repo_id, file_id, unnest(regexp_extract_all(coalesce(content, ''), '([A-Za-z_][A-Za-z0-9_]*)\(', 1)) AS name FROM fns) WHERE length(name) >= 2),
met AS (SELECT s.src, t.id AS dst, s.repo_id, s.name, s.file_id = t.file_id AS near FROM sites s JOIN fns t ON t.repo_id = s.repo_id AND t.name = s.name WHERE s.src <> t.id),
calls AS (SELECT DISTINCT src, dst, repo_id FROM (SELECT *, bool_or(near) OVER (PARTITION BY src, name) AS any_near FROM met) WHERE near = any_near)"""
_DEGREES = f"""{_CALLS}, outs AS (SELECT src AS id, count(*) AS n FROM calls GROUP BY 1), ins AS (SELECT dst AS id, count(*) AS n FROM calls GROUP BY 1),
deg AS (SELECT f.id, f.repo_id, coalesce(o.n, 0)::INT AS out_degree, coalesce(i.n, 0)::INT AS in_degree FROM fns f LEFT JOIN outs o USING (id) LEFT JOIN ins i USING (id)),
degrees AS (SELECT *, out_degree + in_degree AS degree, in_degree = 0 AND out_degree > 0 AS entry, out_degree + in_degree = 0 AS isolated FROM deg),
entries AS (SELECT id FROM degrees WHERE entry)"""
_INH = r"""bases AS (SELECT DISTINCT repo_id, chunk_id AS src, regexp_extract(regexp_replace(regexp_replace(name, '\s+', '', 'g'), '[\[<(].*$', ''), '([^.:/$\\]+)$', 1) AS name, is_abstract, is_mixin FROM base_class_refs),
inh AS (SELECT DISTINCT b.src, c.chunk_id AS dst, CASE WHEN b.is_abstract THEN 'IMPLEMENTS' WHEN b.is_mixin THEN 'MIXES_IN' ELSE 'INHERITS_FROM' END AS rel_type
  FROM bases b JOIN class_hierarchy c ON c.repo_id = b.repo_id AND c.class_name = b.name WHERE b.name NOT IN ('object', 'type', ''))"""


def _levels(edges: str, start: str, depth: int) -> str:
    return f"walk AS (SELECT id AS start, id, 0 AS depth FROM {start} UNION SELECT w.start, e.dst, w.depth + 1 FROM walk w JOIN {edges} e ON e.src = w.id WHERE w.depth < {depth}), least AS (SELECT start, id, min(depth)::INT AS depth FROM walk GROUP BY 1, 2)"


# All ways up, in no more steps than the largest repository has classes.
_ALL_ABOVE = """most AS (SELECT max(n) AS n FROM (SELECT count(DISTINCT chunk_id) AS n FROM class_hierarchy GROUP BY repo_id)),
above AS (SELECT src AS start, dst AS id, 1 AS depth FROM ups WHERE src <> dst UNION SELECT a.start, u.dst, a.depth + 1 FROM above a JOIN ups u ON u.src = a.id, most WHERE u.dst <> a.start AND a.depth < most.n)"""
ORACLES = {
    "graph_node_counts": f"""WITH {_C}, {_F} SELECT repo_id, label, count(*) AS n FROM (SELECT repo_id, 'Repo' AS label FROM repositories UNION ALL SELECT repo_id, 'File' FROM files
UNION ALL SELECT repo_id, CASE WHEN chunk_type IN {_FN} THEN 'Function' ELSE 'Class' END FROM chunks WHERE chunk_type IN {_FN} OR chunk_type = 'class') GROUP BY ALL""",
    "structural_edge_counts": f"""WITH {_C}, {_F}, held AS (SELECT c.* FROM chunks c WHERE (chunk_type IN {_FN} OR chunk_type = 'class') AND file_id IN (SELECT file_id FROM files))
SELECT repo_id, rel_type, count(*) AS n FROM (SELECT DISTINCT * FROM (SELECT repo_id, repo_id AS src, file_id AS dst, 'CONTAINS_FILE' AS rel_type FROM files UNION ALL SELECT repo_id, file_id, chunk_id, 'CONTAINS' FROM held
UNION ALL SELECT repo_id, chunk_id, file_id, 'DEFINED_IN' FROM held
UNION ALL SELECT m.repo_id, c.chunk_id, m.chunk_id, 'CONTAINS_METHOD' FROM chunks m JOIN chunks c ON c.file_id = m.file_id AND c.name = m.parent_name AND c.chunk_type = 'class' WHERE m.chunk_type IN ('method', 'async_method') AND m.parent_name <> '')) GROUP BY ALL""",
    "call_graph": f"WITH {_CALLS} SELECT src, dst, repo_id FROM calls",
    "function_degrees": f"WITH {_DEGREES} SELECT id, repo_id, out_degree, in_degree, degree, round(degree / greatest(max(degree) OVER (PARTITION BY repo_id), 1), 6) AS centrality, entry, isolated FROM degrees",
    "graph_metrics": f"""WITH {_DEGREES} SELECT repo_id, count(*) AS functions, sum(out_degree)::BIGINT AS calls, round(CASE WHEN count(*) > 1 THEN sum(out_degree) / (count(*) * (count(*) - 1)) ELSE 0 END, 6) AS density,
count(*) FILTER (entry) AS entry_points, count(*) FILTER (isolated) AS isolated, max(out_degree) AS most_calls, max(in_degree) AS most_callers FROM degrees GROUP BY 1""",
    "call_reach": f"WITH RECURSIVE {_DEGREES}, {_levels('calls', 'entries', 3)} SELECT start, id, depth FROM least WHERE depth > 0",
    "call_chains": f"""WITH RECURSIVE {_DEGREES}, trail AS (SELECT id AS start, id AS here, [id] AS path, []::VARCHAR[] AS used, 0 AS depth FROM entries
UNION ALL SELECT t.start, c.dst, list_append(t.path, c.dst), list_append(t.used, c.src || '>' || c.dst), t.depth + 1 FROM trail t JOIN calls c ON c.src = t.here WHERE t.depth < 3 AND NOT list_contains(t.used, c.src || '>' || c.dst))
SELECT start, array_to_string(path, '>') AS chain, depth::INT AS depth FROM trail WHERE depth > 0""",
    "shortest_call_paths": f"""WITH RECURSIVE {_DEGREES}, {_levels("calls", "entries", 5)}, walks AS (SELECT id AS start, id AS here, [id] AS path, 0 AS depth FROM entries
UNION SELECT w.start, c.dst, list_append(w.path, c.dst), w.depth + 1 FROM walks w JOIN calls c ON c.src = w.here JOIN least l ON l.start = w.start AND l.id = c.dst AND l.depth = w.depth + 1)
SELECT start, here AS id, depth::INT AS depth, array_to_string(min(path), '>') AS path FROM walks WHERE depth > 0 GROUP BY start, here, depth""",
    "context_expansion": f"""WITH RECURSIVE {_DEGREES}, both_ways AS (SELECT src, dst FROM calls UNION SELECT dst, src FROM calls), {_levels("both_ways", "entries", 2)},
near AS (SELECT id, min(depth)::INT AS hop FROM least GROUP BY 1), placed AS (SELECT n.*, d.repo_id, d.degree, greatest(max(d.degree) OVER (PARTITION BY d.repo_id), 1) AS md FROM near n JOIN degrees d USING (id))
SELECT repo_id, id, hop, round(0.3 * pow(0.8, hop) + 0.4 * degree / md, 6) AS importance FROM placed""",
    "call_components": f"""WITH RECURSIVE {_CALLS}, both_ways AS (SELECT src, dst FROM calls UNION SELECT dst, src FROM calls), spread AS (SELECT id, id AS here FROM fns UNION SELECT s.id, b.dst FROM spread s JOIN both_ways b ON b.src = s.here),
roots AS (SELECT id, min(here) AS root FROM spread GROUP BY 1) SELECT f.repo_id, count(DISTINCT root) AS components FROM fns f JOIN roots USING (id) GROUP BY 1""",
    "inheritance_edges": f"WITH {_INH} SELECT src, dst, rel_type FROM inh",
    "class_ancestors": f"WITH RECURSIVE {_INH}, ups AS (SELECT DISTINCT src, dst FROM inh WHERE rel_type <> 'MIXES_IN'), {_ALL_ABOVE} SELECT start AS class_id, id AS ancestor_id, min(depth)::INT AS depth FROM above GROUP BY 1, 2",
    "class_family": f"""WITH {lenses.SQL["classes"]}, {_INH}, e AS (SELECT DISTINCT src, dst FROM inh),
p AS (SELECT src AS chunk_id, array_to_string(list_sort(list_distinct(list(c.class_name))), ',') AS parents FROM e JOIN classes c ON c.chunk_id = e.dst GROUP BY 1),
k AS (SELECT dst AS chunk_id, array_to_string(list_sort(list_distinct(list(c.class_name))), ',') AS children FROM e JOIN classes c ON c.chunk_id = e.src GROUP BY 1)
SELECT chunk_id, class_name, coalesce(parents, '') AS parents, coalesce(children, '') AS children FROM classes LEFT JOIN p USING (chunk_id) LEFT JOIN k USING (chunk_id)""",
}
