"""Symbols of source files, from their lines; all in the JVM and without a shuffle, so broken files give their symbols as well.

Functions within functions count as functions; methods are those whose nearest line of less indentation that declares something declares a
class. Null and blank contents give none. Files scanned again count once (the caller's lens).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A line of Python that declares something: async, kind, name. What a branch is written with, and a call.
PYTHON_DECLARES = r"^[ \t]*(async[ \t]+)?(def|class)[ \t]+([A-Za-z_][A-Za-z0-9_]*)"
PYTHON_BRANCH = r"\b(?:if|elif|for|while|except|case|and|or|assert)\b"
PYTHON_CALL = r"([A-Za-z_][A-Za-z0-9_]*)\("
# Lines whose indentation ends no block: blank ones, comments, closing brackets.
PYTHON_LOOSE = r"^[ \t\r]*(?:$|[#)\]}])"
NO_INDENT = 9_999

#: Declarations in lines of the brace languages: kind and pattern, whose group is the name.
DECLARATIONS = [
    ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
    ("class", r"^\s*(?:export\s+)?(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+|static\s+)*(?:class|interface|enum)\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
    ("function", r"^func\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("),
    ("method", r"^func\s*\([^)]*\)\s*([A-Za-z_][A-Za-z0-9_]*)\s*\("),
    ("method", r"^\s+(?:public|private|protected)\s+(?:static\s+)?[A-Za-z_][A-Za-z0-9_<>,\[\]]*\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("),
]


def _indent(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^[ \t]*", 0))


def python_symbols(files: DataFrame, key: str = "file_id", content: str = "content") -> DataFrame:
    """key, kind, name, parent, first and last line, documentation (whether the line below opens one), bases as written, called names and
    branches (plus one) of each symbol. A block ends before the next line of no more indentation."""
    lines = F.split(F.col(content), "\r?\n")
    declared = F.filter(
        F.transform(F.col("lines"), lambda x, i: F.struct(i.alias("i"), _indent(x).alias("indent"), F.regexp_extract(x, PYTHON_DECLARES, 1).alias("a"), F.regexp_extract(x, PYTHON_DECLARES, 2).alias("kind"), F.regexp_extract(x, PYTHON_DECLARES, 3).alias("name"))),
        lambda d: d["name"] != "",
    )
    indents = F.transform(F.col("lines"), lambda x: F.when(x.rlike(PYTHON_LOOSE), NO_INDENT).otherwise(_indent(x)))
    each = files.where(F.trim(content) != "").select(key, lines.alias("lines")).select(key, "lines", indents.alias("indents"), declared.alias("ds"))
    each = each.select(key, "lines", "indents", "ds", F.explode("ds").alias("d"))
    i, indent = F.col("d.i"), F.col("d.indent")
    stop = F.array_position(F.transform(F.slice("indents", i + 2, F.size("indents")), lambda x: x <= indent), True)
    last = F.when(stop > 0, i + stop).otherwise(F.size("lines"))
    text = F.regexp_replace(F.array_join(F.slice("lines", i + 1, (last - i).cast("int")), "\n"), r"\s+$", "")
    parent = F.try_element_at(F.filter("ds", lambda d: (d["i"] < i) & (d["indent"] < indent)), F.lit(-1))
    each = each.select(key, "d", text.alias("text"), parent.alias("p"), F.coalesce(F.try_element_at("lines", i + 2), F.lit("")).alias("below"))
    function = F.when(F.col("p.kind") == "class", "method").otherwise("function")
    body = F.regexp_replace("text", r"^[^\n]*", "")
    return each.select(
        key, F.when(F.col("d.kind") == "class", "class").otherwise(F.concat(F.when(F.col("d.a") != "", "async_").otherwise(""), function)).alias("kind"), F.col("d.name").alias("name"), F.when(F.col("p.kind") == "class", F.col("p.name")).alias("parent"),
        (F.col("d.i") + 1).alias("start_line"), (F.col("d.i") + F.size(F.split("text", "\n"))).alias("end_line"), F.col("below").rlike("^[ \t]*[rRuU]?(?:\"\"\"|''')").alias("documented"),
        F.trim(F.regexp_extract("text", r"^[ \t]*class[ \t]+[A-Za-z0-9_]+[ \t]*\(([^()]*)\)", 1)).alias("bases"), F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit(PYTHON_CALL), F.lit(1)))), ",").alias("calls"),
        (F.regexp_count("text", F.lit(PYTHON_BRANCH)) + 1).alias("branches"),
    )


def python_imports(files: DataFrame, key: str = "file_id", content: str = "content") -> DataFrame:
    """key and module of each import, relative ones with their dots. Line patterns, so broken files give their imports as well."""
    lines = files.where(F.col(content).contains("import")).select(key, F.explode(F.split(content, r"\r?\n")).alias("line"))
    plain = F.transform(F.split(F.regexp_extract("line", r"^\s*import\s+([\w., ]+?)\s*(?:#.*)?$", 1), ","), lambda m: F.regexp_replace(F.trim(m), r"\s+as\s+\w+$", ""))
    named = F.array(F.regexp_extract("line", r"^\s*from\s+([\w.]+)\s+import\b", 1))
    return lines.select(key, F.explode(F.concat(plain, named)).alias("module")).where("module <> ''").distinct()


def declared_symbols(files: DataFrame, key: str = "file_id", content: str = "content") -> DataFrame:
    """key, kind, name, line of declarations in the brace languages."""
    lines = files.where(F.col(content).isNotNull()).select(key, F.posexplode(F.split(content, r"\r?\n")).alias("i", "line"))
    found = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_extract("line", p, 1).alias("name")) for k, p in DECLARATIONS))
    return lines.select(key, (F.col("i") + 1).alias("line"), F.explode(F.filter(found, lambda x: x["name"] != "")).alias("s")).select(key, "s.kind", "s.name", "line")
