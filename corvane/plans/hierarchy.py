"""Queries over the class hierarchies of all repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.class_links import base_links, latest_classes
from ..operators.hierarchy import all_descendants, cycles, descendants, paths
from ..session import cut, table


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return cut(base_links(table(spark, sf, "class_hierarchy"), table(spark, sf, "base_class_refs")))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return cycles(_links(spark, sf)).select("cycle_id", F.col("node").alias("chunk_id")).distinct()


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    links = _links(spark, sf)
    classes = table(spark, sf, "class_hierarchy").select(F.col("repo_id").alias("scope"), F.col("chunk_id").alias("node"))
    first = links.groupBy("scope", "child").agg(F.min_by("parent", F.struct("position", "parent")).alias("parent"))
    return paths(classes, first, cycles(links))


def p1_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Path over the first resolved base, depth and root of each class, and whether the stored method resolution order starts as that path does."""
    tree = _tree(spark, sf)
    classes = latest_classes(table(spark, sf, "class_hierarchy")).select(F.col("chunk_id").alias("node"), "class_name", "mro_list")
    first = F.try_element_at("mro_list", F.lit(1)) == F.col("class_name")
    return tree.join(classes, "node").select(F.col("scope").alias("repo_id"), F.col("node").alias("chunk_id"), F.array_join("path", ">").alias("path"), "depth", "root", "on_cycle", F.coalesce(first, F.lit(False)).alias("mro_starts_here"))


def p1_tree_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Every class with each class below it in the tree of p1_paths, which follows the first resolved base of each class."""
    return descendants(_tree(spark, sf)).select(F.col("scope").alias("repo_id"), "ancestor", "descendant", "steps")


def p1_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Every class with each class below it, whatever the position of the base, and the least steps between them. Classes of one cycle are
    below each other and keep their ancestors; no class is below itself."""
    return all_descendants(_links(spark, sf)).select(F.col("scope").alias("repo_id"), "ancestor", "descendant", "steps")


def p1_all_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """The same under its earlier name."""
    return p1_descendants(spark, sf)


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p1_tree_descendants, p1_all_descendants)}

_LINKS = r"""
links AS (
  SELECT DISTINCT r.chunk_id AS child, c.chunk_id AS parent
  FROM base_class_refs r JOIN class_hierarchy c ON c.repo_id = r.repo_id
   AND c.class_name = regexp_extract(regexp_replace(regexp_replace(r.name, '\s+', '', 'g'), '[\[<(].*$', ''), '([^.:/$\\]+)$', 1)
  WHERE r.name IS NOT NULL
), reach AS (
  SELECT child AS a, parent AS b FROM links UNION SELECT reach.a, links.parent FROM reach JOIN links ON reach.b = links.child
)"""
_TREE = rf"""{_LINKS}, cyc AS (SELECT DISTINCT a FROM reach WHERE a = b), placed AS (
  SELECT DISTINCT r.chunk_id AS child, c.chunk_id AS parent, r.position
  FROM base_class_refs r JOIN class_hierarchy c ON c.repo_id = r.repo_id
   AND c.class_name = regexp_extract(regexp_replace(regexp_replace(r.name, '\s+', '', 'g'), '[\[<(].*$', ''), '([^.:/$\\]+)$', 1)
), up AS (SELECT child, arg_min(parent, {{'p': position, 'q': parent}}) AS parent FROM placed WHERE child NOT IN (SELECT a FROM cyc) GROUP BY 1),
classes AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY extracted_at DESC) AS rn FROM class_hierarchy) WHERE rn = 1),
tree AS (SELECT chunk_id AS id, chunk_id AS root, chunk_id AS path, 0 AS depth FROM classes WHERE chunk_id NOT IN (SELECT child FROM up)
  UNION ALL SELECT u.child, t.root, t.path || '>' || u.child, t.depth + 1 FROM tree t JOIN up u ON u.parent = t.id)"""
# A shortest way never has more steps than the largest repository has classes.
_BELOW = f"""WITH RECURSIVE {_LINKS}, most AS (SELECT max(n) AS n FROM (SELECT count(DISTINCT chunk_id) AS n FROM class_hierarchy GROUP BY repo_id)),
walk AS (SELECT parent AS ancestor, child AS descendant, 1 AS steps FROM links WHERE parent <> child
  UNION SELECT w.ancestor, l.child, w.steps + 1 FROM walk w JOIN links l ON l.parent = w.descendant, most WHERE l.child <> w.ancestor AND w.steps < most.n)
SELECT any_value(c.repo_id) AS repo_id, ancestor, descendant, min(steps)::INT AS steps FROM walk JOIN class_hierarchy c ON c.chunk_id = walk.descendant GROUP BY ancestor, descendant"""
ORACLES = {
    "p1_descendants": _BELOW,
    "p1_all_descendants": _BELOW,
    "p1_paths": f"""WITH RECURSIVE {_TREE} SELECT c.repo_id, t.id AS chunk_id, t.path, t.depth::INT AS depth, t.root, t.id IN (SELECT a FROM cyc) AS on_cycle, coalesce(c.mro_list[1] = c.class_name, false) AS mro_starts_here
FROM tree t JOIN classes c ON c.chunk_id = t.id""",
    "p1_tree_descendants": f"""WITH RECURSIVE {_TREE}, walk AS (SELECT parent AS ancestor, child AS descendant, 1 AS steps FROM up UNION ALL SELECT w.ancestor, u.child, w.steps + 1 FROM walk w JOIN up u ON u.parent = w.descendant)
SELECT c.repo_id, ancestor, descendant, steps::INT AS steps FROM walk JOIN classes c ON c.chunk_id = walk.descendant""",
    "p1_found": f"WITH RECURSIVE {_LINKS} SELECT min(y.b) AS cycle_id, x.a AS chunk_id FROM reach x JOIN reach y ON y.a = x.a JOIN reach z ON z.a = y.b AND z.b = x.a WHERE x.a = x.b GROUP BY x.a",
}
