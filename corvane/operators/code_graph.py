"""The property graph of code: nodes and edges from the relational tables, and operators over them.

nodes: id, label (Repo, File, Function, Class), repo_id, name, path, start_line. edges: src, dst, rel_type, repo_id. Edges whose ends don't
both exist are dropped. Traversals run as a fixed number of joins; what was reached is kept as a table of (start, node, depth).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import walks
from .class_links import simple_name
from .lenses import FUNCTION_TYPES

# Weights of the importance of an expanded node.
CENTRALITY_WEIGHT, SEMANTIC_WEIGHT, HOP_DECAY = 0.4, 0.3, 0.8


def nodes(repositories: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    none = F.lit(None)
    label = F.when(F.col("chunk_type").isin(*FUNCTION_TYPES), "Function").when(F.col("chunk_type") == "class", "Class")
    return (
        repositories.select(F.col("repo_id").alias("id"), F.lit("Repo").alias("label"), "repo_id", "name", none.cast("string").alias("path"), none.cast("int").alias("start_line"))
        .unionByName(files.select(F.col("file_id").alias("id"), F.lit("File").alias("label"), "repo_id", F.element_at(F.split("relative_path", "/"), -1).alias("name"), F.col("relative_path").alias("path"), none.cast("int").alias("start_line")))
        .unionByName(chunks.select(F.col("chunk_id").alias("id"), label.alias("label"), "repo_id", "name", F.col("file_path").alias("path"), "start_line").where("label is not null"))
    )


def structural_edges(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """CONTAINS_FILE, CONTAINS, DEFINED_IN and CONTAINS_METHOD (a class of the same file by the method's parent name)."""
    held = chunks.where(F.col("chunk_type").isin(*FUNCTION_TYPES, "class"))
    inside = held.join(files.select("file_id"), "file_id", "left_semi")
    classes = chunks.where("chunk_type = 'class'").select("file_id", F.col("name").alias("parent_name"), F.col("chunk_id").alias("src"))
    methods = chunks.where(F.col("chunk_type").isin("method", "async_method") & (F.col("parent_name") != "")).select("file_id", "parent_name", F.col("chunk_id").alias("dst"), "repo_id")
    parts = [
        files.select(F.col("repo_id").alias("src"), F.col("file_id").alias("dst"), F.lit("CONTAINS_FILE").alias("rel_type"), "repo_id"),
        inside.select(F.col("file_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("CONTAINS").alias("rel_type"), "repo_id"),
        inside.select(F.col("chunk_id").alias("src"), F.col("file_id").alias("dst"), F.lit("DEFINED_IN").alias("rel_type"), "repo_id"),
        methods.join(classes, ["file_id", "parent_name"]).select("src", "dst", F.lit("CONTAINS_METHOD").alias("rel_type"), "repo_id"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def called_names(content: Column) -> Column:
    """The names that stand before an opening parenthesis, each once; a text's own shuffle costs several times theirs."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1)))


def call_edges(chunks: DataFrame) -> DataFrame:
    """CALLS: names called in a function resolved in its own file, else anywhere in its repository; all matches count, itself doesn't. chunks
    has the content or, as `called`, its names."""
    called = F.col("called") if "called" in chunks.columns else called_names(F.col("content"))
    functions = cut(chunks.where(F.col("chunk_type").isin(*FUNCTION_TYPES)).select("chunk_id", "repo_id", "file_id", "name", called.alias("called")))
    targets = functions.select("repo_id", "file_id", "name", F.col("chunk_id").alias("dst")).where("name is not null")
    # Only names of a function of the repository other than the caller are looked for.
    known = targets.groupBy("repo_id", "name").agg(F.count("*").alias("n"))
    sites = functions.select(F.col("chunk_id").alias("src"), "repo_id", F.explode("called").alias("site"), F.col("name").alias("own")).where(F.length("site") >= 2).select("src", "repo_id", F.col("site").alias("name"), F.col("own").eqNullSafe(F.col("site")).alias("own"))
    sites = sites.join(known, ["repo_id", "name"]).where("n > 1 or not own").select("src", "name")
    sites = cut(sites.join(functions.select(F.col("chunk_id").alias("src"), "repo_id", "file_id"), "src"))
    # Files first: only names that no function of the caller's file has (other than itself) look for one in the repository.
    near = sites.join(targets.select("file_id", "name", "dst"), ["file_id", "name"]).where("src <> dst").select("src", "dst", "repo_id", "name")
    left = sites.join(near.select("src", "name").distinct(), ["src", "name"], "left_anti")
    far = left.join(targets.select("repo_id", "name", "dst"), ["repo_id", "name"]).where("src <> dst")
    every = near.select("src", "dst", "repo_id").unionByName(far.select("src", "dst", "repo_id")).distinct()
    return every.select("src", "dst", F.lit("CALLS").alias("rel_type"), "repo_id")


def inheritance_edges(classes: DataFrame, refs: DataFrame) -> DataFrame:
    """INHERITS_FROM, IMPLEMENTS or MIXES_IN by the base's flags; object and type give none, and a base is looked up in the repository."""
    base = refs.select("repo_id", F.col("chunk_id").alias("src"), simple_name(F.col("name")).alias("name"), "is_abstract", "is_mixin").where("name not in ('object', 'type', '')").distinct()
    names = classes.select("repo_id", F.col("class_name").alias("name"), F.col("chunk_id").alias("dst")).distinct()
    rel = F.when(F.col("is_abstract"), "IMPLEMENTS").when(F.col("is_mixin"), "MIXES_IN").otherwise("INHERITS_FROM")
    return base.join(names, ["repo_id", "name"]).select("src", "dst", rel.alias("rel_type"), "repo_id").distinct()


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids (a column id)."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def degrees(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree, degree, centrality (degree over the greatest of the repository), entry (only calls), isolated."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    counted = ends.groupBy("id").agg(F.sum("o").cast("int").alias("out_degree"), F.sum("i").cast("int").alias("in_degree"))
    out = nodes_.select("id", "repo_id").join(counted, "id", "left").fillna(0, ["out_degree", "in_degree"]).withColumn("degree", F.col("out_degree") + F.col("in_degree"))
    most = out.groupBy("repo_id").agg(F.greatest(F.max("degree"), F.lit(1)).alias("most"))
    return out.join(most, "repo_id").select(
        "id", "repo_id", "out_degree", "in_degree", "degree", F.round(F.col("degree") / F.col("most"), 6).alias("centrality"), ((F.col("in_degree") == 0) & (F.col("out_degree") > 0)).alias("entry"), (F.col("degree") == 0).alias("isolated")
    )


def reach(starts: DataFrame, edges: DataFrame, depth: int, undirected: bool = False) -> DataFrame:
    """start, id, depth: the least number of steps to each node within `depth`, the start included at 0. One join a level; what a level
    reaches again is dropped against all levels before it."""
    links = edges.select("src", "dst").distinct()
    if undirected:
        links = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    links = cut(links)
    seen = cut(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")).distinct())
    front = seen
    for d in range(1, depth + 1):
        step = front.select("start", F.col("id").alias("src")).join(links, "src").select("start", F.col("dst").alias("id")).distinct()
        front = cut(step.join(seen, ["start", "id"], "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def trails(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """start, path (node ids), depth: one row for each trail of 1 to `depth` edges, in which no edge occurs twice."""
    links = edges.select("src", "dst").distinct()
    level = starts.select(F.col("id").alias("start"), F.array("id").alias("path"), F.array().cast("array<string>").alias("used"))
    found = []
    for d in range(1, depth + 1):
        edge = F.concat_ws(">", "src", "dst")
        level = (
            level.withColumn("src", F.element_at("path", -1))
            .join(links, "src")
            .where(~F.array_contains("used", edge))
            .select("start", F.concat("path", F.array("dst")).alias("path"), F.concat("used", F.array(edge)).alias("used"))
        )
        found.append(level.select("start", "path", F.lit(d).alias("depth")))
    return reduce(DataFrame.unionByName, found)


def shortest_paths(starts: DataFrame, edges: DataFrame, depth: int, typed: bool = False) -> DataFrame:
    """start, id, depth, path: the shortest path to each node; of several, the one with the smallest ids. typed: each node but the first is
    written with the type of the edge that leads to it (rel_type:id). Graphs of up to walks.SENT are walked from each start where it is,
    larger ones by a join a level, whose paths go through shuffles and written tables."""
    name = F.concat_ws(":", "rel_type", "dst") if typed else F.col("dst")
    links = cut(edges.select("src", "dst", name.alias("name")).distinct())
    found = walks.shortest(starts, links, depth, typed)
    return _joined_paths(starts, links, depth) if found is None else found


def _joined_paths(starts: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    seen = cut(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"), F.array("id").alias("path")).distinct())
    front = seen
    for d in range(1, depth + 1):
        step = front.select("start", F.col("id").alias("src"), "path").join(links, "src").select("start", F.col("dst").alias("id"), F.concat("path", F.array("name")).alias("path"))
        best = step.groupBy("start", "id").agg(F.min("path").alias("path"))
        front = cut(best.join(seen.select("start", "id"), ["start", "id"], "left_anti").select("start", "id", F.lit(d).alias("depth"), "path"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def expand(seeds: DataFrame, edges: DataFrame, degree: DataFrame, hops: int = 3, semantic: DataFrame | None = None) -> DataFrame:
    """id, hop and importance of the nodes within `hops` calls (either way) of the seeds of their repository. Importance weighs the decayed
    hop, the degree and the seeds' own score, each against the greatest of the repository. seeds: id."""
    links = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = reach_any(seeds, links, hops)
    scored = near.join(degree.select("id", "repo_id", "degree"), "id")
    scored = scored.join(semantic.select("id", "semantic"), "id", "left") if semantic is not None else scored.withColumn("semantic", F.lit(0.0))
    most = scored.groupBy("repo_id").agg(F.greatest(F.max("degree"), F.lit(1)).alias("md"), F.max(F.coalesce("semantic", F.lit(0.0))).alias("ms"))
    hop_weight = max(0.0, 1 - CENTRALITY_WEIGHT - SEMANTIC_WEIGHT)
    value = hop_weight * F.pow(F.lit(HOP_DECAY), F.col("hop")) + CENTRALITY_WEIGHT * F.col("degree") / F.col("md") + SEMANTIC_WEIGHT * F.when(F.col("ms") > 0, F.coalesce("semantic", F.lit(0.0)) / F.col("ms")).otherwise(0.0)
    return scored.join(most, "repo_id").select("repo_id", "id", "hop", F.round(value, 6).alias("importance"))


def reach_any(seeds: DataFrame, links: DataFrame, hops: int) -> DataFrame:
    """id and hop: the least distance to any seed."""
    links = cut(links)
    seen = cut(seeds.select("id", F.lit(0).alias("hop")).distinct())
    front = seen
    for d in range(1, hops + 1):
        step = front.select(F.col("id").alias("src")).join(links, "src").select(F.col("dst").alias("id")).distinct()
        front = cut(step.join(seen, "id", "left_anti").withColumn("hop", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen
