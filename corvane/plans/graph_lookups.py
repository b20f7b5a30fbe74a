"""Queries that look around in the code graph: callers, siblings, importing files, all metrics, resolution orders, bases by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import class_links, code_graph, hierarchy, lenses
from ..session import cut, table
from . import context, graph
from .hierarchy import _LINKS, _TREE, _links, _tree

CALL_LIMIT, SIBLING_LIMIT, IMPORT_LIMIT, TOP = 5, 200, 300, 5


def _most_called(spark: SparkSession, sf: str, calls: DataFrame) -> DataFrame:
    d = code_graph.degrees(graph._functions(spark, sf), calls).where("in_degree > 0")
    return d.groupBy("repo_id").agg(F.max_by("id", F.struct("in_degree", "id")).alias("id"))


def _backwards(calls: DataFrame) -> DataFrame:
    return calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reverse_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Who reaches the most called function of each repository within five calls, by the shortest chain of calls."""
    calls = graph._calls(spark, sf)
    found = code_graph.shortest_paths(_most_called(spark, sf, calls), _backwards(calls), 5).where("depth > 0")
    return found.select(F.col("start").alias("function"), F.col("id").alias("caller"), "depth", F.array_join(F.reverse("path"), ">").alias("chain"))


def caller_reach(spark: SparkSession, sf: str) -> DataFrame:
    """The callers of every function that calls none, within two calls."""
    calls = graph._calls(spark, sf)
    leaves = code_graph.degrees(graph._functions(spark, sf), calls).where("in_degree > 0 and out_degree = 0").select("id")
    return code_graph.reach(leaves, _backwards(calls), 2).where("depth > 0").select(F.col("start").alias("function"), F.col("id").alias("caller"), "depth")


def call_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The first callers and callees of each function, by id."""
    calls = graph._calls(spark, sf).select("src", "dst")
    sides = calls.select(F.col("src").alias("function"), F.lit("callee").alias("side"), F.col("dst").alias("other")).unionByName(calls.select(F.col("dst").alias("function"), F.lit("caller").alias("side"), F.col("src").alias("other")))
    place = F.row_number().over(Window.partitionBy("function", "side").orderBy("other"))
    return sides.withColumn("place", place).where(F.col("place") <= CALL_LIMIT)


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    return graph._chunks(spark, sf).where(F.col("chunk_type").isin(*lenses.FUNCTION_TYPES)).select(F.col("chunk_id").alias("id"), "repo_id", "file_id")


def _limited(pairs: DataFrame, limit: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("seed").orderBy("id"))
    return pairs.withColumn("place", place).where(F.col("place") <= limit).select("seed", "id")


def sibling_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The first functions beside each entry point in its file."""
    calls, every = graph._calls(spark, sf), cut(_placed(spark, sf))
    seeds = every.join(graph._entries(spark, sf, calls), "id", "left_semi").select(F.col("id").alias("seed"), "file_id")
    return _limited(seeds.join(every.select("id", "file_id"), "file_id").where("id <> seed"), SIBLING_LIMIT)


def imported_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The first functions of the files that each entry point's file imports."""
    calls, every = graph._calls(spark, sf), cut(_placed(spark, sf))
    imports = context.import_edges(spark, sf).select("src", "dst").distinct()
    seeds = every.join(graph._entries(spark, sf, calls), "id", "left_semi").select(F.col("id").alias("seed"), F.col("file_id").alias("src"))
    return _limited(seeds.join(imports, "src").join(every.select("id", F.col("file_id").alias("dst")), "dst").select("seed", "id").distinct(), IMPORT_LIMIT)


def wide_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """The least number of steps from an entry point of the repository to each function within two, where a step is a call either way, to a
    function of the same file or to one of an imported file. Files are stepped through, so pairs within a file are never made."""
    calls, every = graph._calls(spark, sf), cut(_placed(spark, sf))
    both = cut(calls.select("src", "dst").unionByName(_backwards(calls)).distinct())
    imports = context.import_edges(spark, sf).select("src", "dst").distinct()
    reached = cut(imports.unionByName(every.select(F.col("file_id").alias("src"), F.col("file_id").alias("dst")).distinct()))
    seen = front = cut(graph._entries(spark, sf, calls).select("id", F.lit(0).alias("hop")))
    for hop in (1, 2):
        files = front.join(every, "id").select(F.col("file_id").alias("src")).distinct().join(reached, "src").select(F.col("dst").alias("file_id")).distinct()
        step = front.select(F.col("id").alias("src")).join(both, "src").select(F.col("dst").alias("id")).unionByName(files.join(every, "file_id").select("id")).distinct()
        front = cut(step.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen.join(every.select("id", "repo_id"), "id").select("repo_id", "id", "hop")


def _top(counted: DataFrame, name: str) -> DataFrame:
    """repo_id and the TOP ids with most, as text."""
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("n"), "id"))
    top = counted.withColumn("place", place).where(F.col("place") <= TOP).groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", "id", "n").alias("x")))).alias("t"))
    return top.select("repo_id", F.array_join("t.x", " ").alias(name))


def all_graph_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes and edges by kind, density, the functions that call and are called most, the classes inherited most, the longest path of first
    bases, abstract and mixin classes of each repository."""
    files, chunks, calls = lenses.files(spark, sf, "repo_id", "relative_path"), graph._chunks(spark, sf), graph._calls(spark, sf)
    nodes = code_graph.nodes(table(spark, sf, "repositories"), files, chunks).groupBy("repo_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("label") == "File").alias("files"), F.count_if(F.col("label") == "Function").alias("functions"), F.count_if(F.col("label") == "Class").alias("classes"))
    imports = context.import_edges(spark, sf).select("src", "dst").distinct().join(files.select(F.col("file_id").alias("src"), "repo_id"), "src").select("repo_id", F.lit("IMPORTS").alias("rel_type"))
    inherits = graph._inherits(spark, sf)
    edges = code_graph.structural_edges(files, chunks).select("repo_id", "rel_type").unionByName(calls.select("repo_id", "rel_type")).unionByName(inherits.select("repo_id", "rel_type")).unionByName(imports)
    kinds = {"calls": "CALLS", "inherits": "INHERITS_FROM", "implements": "IMPLEMENTS", "mixes_in": "MIXES_IN", "imports": "IMPORTS"}
    counted = edges.groupBy("repo_id").agg(F.count("*").alias("edges"), *(F.count_if(F.col("rel_type") == k).alias(n) for n, k in kinds.items()))
    flags = class_links.latest_classes(table(spark, sf, "class_hierarchy")).groupBy("repo_id").agg(F.count_if("is_abstract").alias("abstract_classes"), F.count_if("is_mixin").alias("mixin_classes"))
    deepest = _tree(spark, sf).groupBy(F.col("scope").alias("repo_id")).agg(F.max("depth").alias("deepest"))
    tops = [
        _top(calls.groupBy("repo_id", F.col("src").alias("id")).agg(F.count("*").alias("n")), "top_callers"),
        _top(calls.groupBy("repo_id", F.col("dst").alias("id")).agg(F.count("*").alias("n")), "top_callees"),
        _top(inherits.where("rel_type = 'INHERITS_FROM'").groupBy("repo_id", F.col("dst").alias("id")).agg(F.count("*").alias("n")), "most_inherited"),
    ]
    out = nodes
    for side in (counted, flags, deepest, *tops):
        out = out.join(side, "repo_id", "left")
    out = out.fillna(0, ["edges", *kinds, "abstract_classes", "mixin_classes", "deepest"]).fillna("", ["top_callers", "top_callees", "most_inherited"])
    return out.withColumn("density", F.round(F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0), 6))


def class_tree_depths(spark: SparkSession, sf: str) -> DataFrame:
    """Each root class with the number of classes below it in the tree of first bases and the longest path to one of them."""
    return _tree(spark, sf).where("not on_cycle").groupBy(F.col("scope").alias("repo_id"), "root").agg((F.count("*") - 1).alias("below"), F.max("depth").alias("deepest"))


def chain_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Every step of the shortest call paths with the one after it."""
    calls = graph._calls(spark, sf)
    paths = code_graph.shortest_paths(graph._entries(spark, sf, calls), calls, 5).where("depth > 0")
    pairs = F.arrays_zip(F.col("path").alias("node"), F.slice("path", 2, F.size("path")).alias("next"))  # no row carries the whole path
    return paths.select("start", F.col("id").alias("target"), F.posexplode(pairs).alias("place", "step")).select("start", "target", "place", "step.node", "step.next")


def typed_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The shortest path of up to eight calls, imports and inheritances from each entry point, importing file and class that nothing inherits
    from, with the type of every step."""
    inherits = graph._inherits(spark, sf).where("rel_type = 'INHERITS_FROM'")
    imports = context.import_edges(spark, sf).select("src", "dst", F.lit("IMPORTS").alias("rel_type")).distinct()
    calls = graph._calls(spark, sf).select("src", "dst", "rel_type")
    edges = cut(calls.unionByName(inherits.select("src", "dst", "rel_type")).unionByName(imports))
    starts = edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    return code_graph.shortest_paths(starts, edges, 8, typed=True).where("depth > 0").select("start", "id", "depth", F.array_join("path", " ").alias("path"))


def file_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The functions and methods of each file in the order of their lines."""
    held = graph._chunks(spark, sf).where(F.col("chunk_type").isin(*lenses.FUNCTION_TYPES) & F.col("file_id").isNotNull())
    return held.select("file_id", "chunk_id", "name", F.row_number().over(Window.partitionBy("file_id").orderBy(F.coalesce("start_line", F.lit(0)), "chunk_id")).alias("place"))


def repository_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Calls and inheritances among the first 500 functions and classes of each repository, by file and line, as a view of fixed size shows."""
    held = graph._chunks(spark, sf).where(F.col("chunk_type").isin(*lenses.FUNCTION_TYPES, "class"))
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.coalesce("file_path", F.lit("")), F.coalesce("start_line", F.lit(0)), "chunk_id"))
    shown = cut(held.select("repo_id", F.col("chunk_id").alias("id"), place.alias("place")).where(F.col("place") <= 500).select("id"))
    edges = graph._calls(spark, sf).select("src", "dst", "rel_type").unionByName(graph._inherits(spark, sf).select("src", "dst", "rel_type"))
    return code_graph.induced(edges, shown).select("src", "dst", "rel_type")


def class_bases(spark: SparkSession, sf: str) -> DataFrame:
    """Number of bases of each kind of each class: all that aren't object or type, parents, mixins, abstract ones."""
    refs = table(spark, sf, "base_class_refs").select("chunk_id", class_links.simple_name(F.col("name")).alias("name"), "is_abstract", "is_mixin", "position").distinct().where("name not in ('object', 'type', '')")
    return refs.groupBy("chunk_id").agg(
        F.count("*").alias("bases"), F.count_if(~F.col("is_abstract") & ~F.col("is_mixin")).alias("parents"), F.count_if("is_mixin").alias("mixins"), F.count_if("is_abstract").alias("abstract")
    )


def external_bases(spark: SparkSession, sf: str) -> DataFrame:
    """Bases outside the repository that each class has itself or by a class above it."""
    refs = table(spark, sf, "base_class_refs").select("repo_id", "chunk_id", class_links.simple_name(F.col("name")).alias("base")).where("base <> ''").distinct()
    known = table(spark, sf, "class_hierarchy").select("repo_id", F.col("class_name").alias("base")).distinct()
    outside = cut(refs.join(known, ["repo_id", "base"], "left_anti"))
    above = hierarchy.all_descendants(_links(spark, sf))
    own = outside.select("chunk_id", "base", F.lit(True).alias("own"))
    inherited = above.join(outside.select(F.col("chunk_id").alias("ancestor"), "base"), "ancestor").select(F.col("descendant").alias("chunk_id"), "base", F.lit(False).alias("own"))
    return own.unionByName(inherited).groupBy("chunk_id", "base").agg(F.max("own").alias("own"))


def resolution_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Depth-first order of every class over its bases in the repository, and its C3 linearisation (null where there is none)."""
    found = hierarchy.linearised(table(spark, sf, "class_hierarchy").select(F.col("repo_id").alias("scope"), F.col("chunk_id").alias("node")), _links(spark, sf))
    return found.select("node", F.array_join("depth_first", ">").alias("depth_first"), F.array_join("c3", ">").alias("c3"))


def script_bases(spark: SparkSession, sf: str) -> DataFrame:
    """Classes and interfaces of JavaScript and TypeScript files with what they extend and implement."""
    return class_links.script_bases(lenses.files(spark, sf, "language", "content").where("language in ('javascript', 'typescript')"))


QUERIES = {
    f.__name__: f
    for f in (reverse_calls, caller_reach, call_neighbours, sibling_functions, imported_functions, wide_expansion, all_graph_metrics, class_tree_depths, chain_steps, typed_paths, file_functions, repository_graph, class_bases, external_bases, resolution_orders, script_bases)
}

_DEG, _FN = graph._DEGREES, graph._FN
_IMPORTS = "imp AS (SELECT DISTINCT src, dst FROM ({}))".format(context.ORACLES["import_edges"])
_BACK = "back AS (SELECT dst AS src, src AS dst FROM calls)"
_TOP_SQL = "SELECT repo_id, string_agg(id || ':' || n, ' ' ORDER BY place) AS {0} FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, id) AS place FROM (SELECT repo_id, {1} AS id, count(*) AS n FROM {2} GROUP BY ALL)) WHERE place <= 5 GROUP BY 1"
_SIMPLE = r"regexp_extract(regexp_replace(regexp_replace({0}, '\s+', '', 'g'), '[\[<(].*$', ''), '([^.:/$\\]+)$', 1)"
_STRUCTURE = graph.ORACLES["structural_edge_counts"]
ORACLES = {
    "reverse_calls": f"""WITH RECURSIVE {_DEG}, {_BACK}, centre AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY repo_id ORDER BY in_degree DESC, id DESC) AS rn FROM degrees WHERE in_degree > 0) WHERE rn = 1),
{graph._levels("back", "centre", 5)}, walks AS (SELECT id AS start, id AS here, [id] AS path, 0 AS depth FROM centre
UNION SELECT w.start, c.dst, list_append(w.path, c.dst), w.depth + 1 FROM walks w JOIN back c ON c.src = w.here JOIN least l ON l.start = w.start AND l.id = c.dst AND l.depth = w.depth + 1)
SELECT start AS function, here AS caller, depth::INT AS depth, array_to_string(list_reverse(min(path)), '>') AS chain FROM walks WHERE depth > 0 GROUP BY start, here, depth""",
    "caller_reach": f"WITH RECURSIVE {_DEG}, {_BACK}, leaves AS (SELECT id FROM degrees WHERE in_degree > 0 AND out_degree = 0), {graph._levels('back', 'leaves', 2)} SELECT start AS function, id AS caller, depth FROM least WHERE depth > 0",
    "call_neighbours": f"""WITH {_DEG}, sides AS (SELECT src AS function, 'callee' AS side, dst AS other FROM calls UNION ALL SELECT dst, 'caller', src FROM calls)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY function, side ORDER BY other)::INT AS place FROM sides) WHERE place <= {CALL_LIMIT}""",
    "sibling_functions": f"""WITH {_DEG}, p AS (SELECT e.id AS seed, o.id FROM entries e JOIN fns f ON f.id = e.id JOIN fns o ON o.file_id = f.file_id AND o.id <> e.id)
SELECT seed, id FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY id) AS place FROM p) WHERE place <= {SIBLING_LIMIT}""",
    "imported_functions": f"""WITH {_DEG}, {_IMPORTS}, p AS (SELECT DISTINCT e.id AS seed, o.id FROM entries e JOIN fns f ON f.id = e.id JOIN imp ON imp.src = f.file_id JOIN fns o ON o.file_id = imp.dst)
SELECT seed, id FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY id) AS place FROM p) WHERE place <= {IMPORT_LIMIT}""",
    "wide_expansion": f"""WITH RECURSIVE {_DEG}, {_IMPORTS}, steps AS (SELECT src, dst FROM calls UNION SELECT dst, src FROM calls UNION SELECT a.id, b.id FROM fns a JOIN fns b ON b.file_id = a.file_id
UNION SELECT a.id, b.id FROM fns a JOIN imp ON imp.src = a.file_id JOIN fns b ON b.file_id = imp.dst), walk AS (SELECT id, 0 AS hop FROM entries UNION SELECT s.dst, w.hop + 1 FROM walk w JOIN steps s ON s.src = w.id WHERE w.hop < 2)
SELECT f.repo_id, w.id, min(w.hop)::INT AS hop FROM walk w JOIN fns f ON f.id = w.id GROUP BY 1, 2""",
    "all_graph_metrics": f"""WITH RECURSIVE {_TREE}, {_DEG}, {_IMPORTS}, {graph._INH}, {graph._F}, kinds AS ({graph.ORACLES["graph_node_counts"]}),
n AS (SELECT repo_id, sum(n)::BIGINT AS nodes, coalesce(sum(n) FILTER (label = 'File'), 0)::BIGINT AS files, coalesce(sum(n) FILTER (label = 'Function'), 0)::BIGINT AS functions, coalesce(sum(n) FILTER (label = 'Class'), 0)::BIGINT AS classes FROM kinds GROUP BY 1),
inherits AS (SELECT DISTINCT c.repo_id, i.src, i.dst, i.rel_type FROM inh i JOIN class_hierarchy c ON c.chunk_id = i.dst),
e AS (SELECT repo_id, rel_type, n FROM ({_STRUCTURE}) UNION ALL SELECT repo_id, 'CALLS', count(*) FROM calls GROUP BY 1 UNION ALL SELECT repo_id, rel_type, count(*) FROM inherits GROUP BY 1, 2
  UNION ALL SELECT f.repo_id, 'IMPORTS', count(*) FROM imp JOIN files f ON f.file_id = imp.src GROUP BY 1),
c AS (SELECT repo_id, sum(n)::BIGINT AS edges, {", ".join(f"coalesce(sum(n) FILTER (rel_type = '{k}'), 0)::BIGINT AS {v}" for v, k in (("calls", "CALLS"), ("inherits", "INHERITS_FROM"), ("implements", "IMPLEMENTS"), ("mixes_in", "MIXES_IN"), ("imports", "IMPORTS")))} FROM e GROUP BY 1),
g AS (SELECT repo_id, count(*) FILTER (is_abstract) AS abstract_classes, count(*) FILTER (is_mixin) AS mixin_classes FROM classes GROUP BY 1),
d AS (SELECT k.repo_id, max(t.depth)::INT AS deepest FROM tree t JOIN classes k ON k.chunk_id = t.id GROUP BY 1),
t1 AS ({_TOP_SQL.format("top_callers", "src", "calls")}), t2 AS ({_TOP_SQL.format("top_callees", "dst", "calls")}), t3 AS ({_TOP_SQL.format("most_inherited", "dst", "(SELECT * FROM inherits WHERE rel_type = 'INHERITS_FROM')")})
SELECT repo_id, nodes, files, functions, classes, coalesce(edges, 0) AS edges, coalesce(calls, 0) AS calls, coalesce(inherits, 0) AS inherits, coalesce(implements, 0) AS implements, coalesce(mixes_in, 0) AS mixes_in, coalesce(imports, 0) AS imports,
coalesce(abstract_classes, 0) AS abstract_classes, coalesce(mixin_classes, 0) AS mixin_classes, coalesce(deepest, 0) AS deepest, coalesce(top_callers, '') AS top_callers, coalesce(top_callees, '') AS top_callees, coalesce(most_inherited, '') AS most_inherited,
round(CASE WHEN nodes > 1 THEN coalesce(edges, 0) / (nodes * (nodes - 1)) ELSE 0 END, 6) AS density FROM n LEFT JOIN c USING (repo_id) LEFT JOIN g USING (repo_id) LEFT JOIN d USING (repo_id) LEFT JOIN t1 USING (repo_id) LEFT JOIN t2 USING (repo_id) LEFT JOIN t3 USING (repo_id)""",
    "class_tree_depths": f"WITH RECURSIVE {_TREE} SELECT c.repo_id, t.root, count(*) - 1 AS below, max(t.depth)::INT AS deepest FROM tree t JOIN classes c ON c.chunk_id = t.id WHERE t.id NOT IN (SELECT a FROM cyc) GROUP BY 1, 2",
    "chain_steps": f"""WITH p AS ({graph.ORACLES["shortest_call_paths"]}), s AS (SELECT start, id AS target, string_split(path, '>') AS path FROM p), u AS (SELECT start, target, path, unnest(range(len(path))) AS place FROM s)
SELECT start, target, place::INT AS place, path[place + 1] AS node, path[place + 2] AS next FROM u""",
    "typed_paths": f"""WITH RECURSIVE {_DEG}, {_IMPORTS}, {graph._INH}, edges AS (SELECT src, dst, 'CALLS' AS rel FROM calls UNION SELECT src, dst, 'IMPORTS' FROM imp UNION SELECT src, dst, rel_type FROM inh WHERE rel_type = 'INHERITS_FROM'),
starts AS (SELECT DISTINCT src AS id FROM edges WHERE src NOT IN (SELECT dst FROM edges)), {graph._levels("edges", "starts", 8)}, walks AS (SELECT id AS start, id AS here, [id] AS path, 0 AS depth FROM starts
UNION SELECT w.start, e.dst, list_append(w.path, e.rel || ':' || e.dst), w.depth + 1 FROM walks w JOIN edges e ON e.src = w.here JOIN least l ON l.start = w.start AND l.id = e.dst AND l.depth = w.depth + 1)
SELECT start, here AS id, depth::INT AS depth, array_to_string(min(path), ' ') AS path FROM walks WHERE depth > 0 GROUP BY start, here, depth""",
    "file_functions": f"WITH {graph._C} SELECT file_id, chunk_id, name, row_number() OVER (PARTITION BY file_id ORDER BY coalesce(start_line, 0), chunk_id)::INT AS place FROM chunks WHERE chunk_type IN {_FN} AND file_id IS NOT NULL",
    "repository_graph": f"""WITH {_DEG}, {graph._INH}, s AS (SELECT chunk_id AS id FROM (SELECT chunk_id, row_number() OVER (PARTITION BY repo_id ORDER BY coalesce(file_path, ''), coalesce(start_line, 0), chunk_id) AS place FROM chunks WHERE chunk_type IN {_FN} OR chunk_type = 'class') WHERE place <= 500),
e AS (SELECT src, dst, 'CALLS' AS rel_type FROM calls UNION ALL SELECT src, dst, rel_type FROM inh) SELECT src, dst, rel_type FROM e WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)""",
    "class_bases": f"""WITH r AS (SELECT DISTINCT chunk_id, {_SIMPLE.format("name")} AS name, is_abstract, is_mixin, position FROM base_class_refs)
SELECT chunk_id, count(*) AS bases, count(*) FILTER (NOT is_abstract AND NOT is_mixin) AS parents, count(*) FILTER (is_mixin) AS mixins, count(*) FILTER (is_abstract) AS abstract FROM r WHERE name NOT IN ('object', 'type', '') GROUP BY 1""",
    "external_bases": f"""WITH RECURSIVE {_LINKS}, r AS (SELECT DISTINCT repo_id, chunk_id, {_SIMPLE.format("name")} AS base FROM base_class_refs),
o AS (SELECT chunk_id, base FROM r WHERE base <> '' AND NOT EXISTS (SELECT 1 FROM class_hierarchy c WHERE c.repo_id = r.repo_id AND c.class_name = r.base))
SELECT chunk_id, base, bool_or(own) AS own FROM (SELECT chunk_id, base, true AS own FROM o UNION ALL SELECT reach.a, o.base, false FROM reach JOIN o ON o.chunk_id = reach.b AND reach.a <> reach.b) GROUP BY 1, 2""",
    "script_bases": rf"""WITH {graph._F}, l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files WHERE language IN ('javascript', 'typescript') AND content IS NOT NULL),
m AS (SELECT file_id, line, regexp_extract(t, '{class_links.SCRIPT_CLASS}', 3) AS name, regexp_extract(t, '{class_links.SCRIPT_CLASS}', 2) AS kind, regexp_extract(t, '{class_links.SCRIPT_CLASS}', 1) LIKE '%abstract%' AS abstract, regexp_extract(t, '{class_links.SCRIPT_EXTENDS}', 1) AS x, regexp_extract(t, '{class_links.SCRIPT_IMPLEMENTS}', 1) AS i FROM l)
SELECT file_id, line::INT AS line, kind, name, abstract, trim(x) AS extends, trim(i) AS implements FROM m WHERE name <> ''""",
}
