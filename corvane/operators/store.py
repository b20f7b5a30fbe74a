"""Keyed tables: upserts, merged edges, deletion by scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of `new` replace those of `old` with the same key. Within `new` the largest row wins; rows with a null key are kept apart
    from each other and never replace any."""
    once = new.dropDuplicates([key]) if new.columns == [key] else new.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*[c for c in new.columns if c != key])).alias("x")).select(key, "x.*")
    kept = old.join(once.select(key), key, "left_anti")
    return kept.unionByName(once).unionByName(new.where(F.col(key).isNull()))


def check_dimension(vectors: DataFrame, vector: str, dimension: int) -> DataFrame:
    """The vectors, or an error as soon as one of another length is read."""
    size = F.size(vector)
    return vectors.withColumn(vector, F.when(size == dimension, F.col(vector)).otherwise(F.raise_error(F.concat(F.lit("a vector of length "), size.cast("string")))))


def merge_edges(edges: DataFrame, nodes: DataFrame, node_id: str = "id") -> DataFrame:
    """Edges with both ends known, once each."""
    ids = nodes.select(node_id).distinct()
    return edges.join(ids.withColumnRenamed(node_id, "src"), "src", "left_semi").join(ids.withColumnRenamed(node_id, "dst"), "dst", "left_semi").dropDuplicates(["src", "rel_type", "dst"])


def without_scope(df: DataFrame, scope: str, gone: DataFrame) -> DataFrame:
    """Rows of all scopes but those in `gone`."""
    return df.join(gone.select(scope).distinct(), scope, "left_anti")


def write_by_scope(df: DataFrame, path: str, scope: str = "repo_id") -> None:
    """Parquet by scope; only the scopes in df are replaced. Rows are spread within a scope as well, so a hot scope isn't one task."""
    spread = df.repartition(F.col(scope), F.pmod(F.xxhash64(*df.columns), F.lit(8)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(scope).parquet(path)
