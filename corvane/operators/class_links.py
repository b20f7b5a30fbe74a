"""Base references of classes resolved to classes of the same repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def simple_name(name: Column) -> Column:
    """A base's name without blanks, type arguments and module prefixes."""
    bare = F.regexp_replace(F.regexp_replace(name, r"\s+", ""), r"[\[<(].*$", "")
    return F.regexp_extract(bare, r"([^.:/$\\]+)$", 1)


def latest_classes(classes: DataFrame) -> DataFrame:
    """Re-extracted classes once, by the latest extraction."""
    return classes.groupBy("chunk_id").agg(F.max_by(F.struct("repo_id", "class_name", "file_path", "is_abstract", "is_mixin", "mro_list"), F.col("extracted_at")).alias("x")).select("chunk_id", "x.*")


def base_links(classes: DataFrame, refs: DataFrame) -> DataFrame:
    """scope (repo_id), child and parent (chunk ids), position. All positions count; external bases give no link."""
    names = classes.select("repo_id", F.col("class_name").alias("base"), F.col("chunk_id").alias("parent")).where("repo_id is not null and base is not null and parent is not null").distinct()
    wanted = refs.select("repo_id", F.col("chunk_id").alias("child"), simple_name(F.col("name")).alias("base"), "position").where("child is not null and base <> ''").distinct()
    return wanted.join(names, ["repo_id", "base"]).select(F.col("repo_id").alias("scope"), "child", "parent", "position")


# What a line that declares a class or an interface of JavaScript or TypeScript names: modifiers, kind and name; bases; interfaces.
SCRIPT_CLASS = r"^\s*((?:export\s+|default\s+|declare\s+|abstract\s+)*)(class|interface)\s+([A-Za-z_$][A-Za-z0-9_$]*)"
SCRIPT_EXTENDS = r"\bextends\s+([^{]+?)\s*(?:\bimplements\b|\{|$)"
SCRIPT_IMPLEMENTS = r"\bimplements\s+([^{]+?)\s*(?:\{|$)"


def script_bases(files: DataFrame, key: str = "file_id", content: str = "content") -> DataFrame:
    """key, line, kind, name, abstract, extends and implements (as written) of the classes and interfaces; null contents give none."""
    lines = files.where(F.col(content).isNotNull()).select(key, F.posexplode(F.split(content, "\n")).alias("i", "t"))
    pick = lambda p, g: F.regexp_extract("t", p, g)
    return lines.where(pick(SCRIPT_CLASS, 3) != "").select(
        key, (F.col("i") + 1).alias("line"), pick(SCRIPT_CLASS, 2).alias("kind"), pick(SCRIPT_CLASS, 3).alias("name"), pick(SCRIPT_CLASS, 1).contains("abstract").alias("abstract"),
        F.trim(pick(SCRIPT_EXTENDS, 1)).alias("extends"), F.trim(pick(SCRIPT_IMPLEMENTS, 1)).alias("implements"),
    )
