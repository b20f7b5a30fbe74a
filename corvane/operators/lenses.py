"""The given tables as the engine's relations: chunks, files, graph nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

FUNCTION_TYPES = ("function", "method", "async_function", "async_method")


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """The last written row of each key; of rows written at once, the largest."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), F.col(at)).alias("x")).select(key, "x.*")


def chunks(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Chunks without their rewritten versions; only the columns asked for are read and shuffled."""
    wanted = dict.fromkeys(["chunk_id", *(columns or ("repo_id", "file_id", "file_path", "language", "chunk_type", "name", "content", "start_line", "end_line", "docstring", "parent_name")), "created_at"])
    return latest(table(spark, sf, "code_chunks").select(*wanted), "chunk_id", "created_at")


def files(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    wanted = dict.fromkeys(["file_id", *(columns or ("repo_id", "relative_path", "language", "line_count")), "scanned_at"])
    return latest(table(spark, sf, "scanned_files").select(*wanted), "file_id", "scanned_at")


def requests(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    wanted = dict.fromkeys(["request_id", *columns, "logged_at"])
    return latest(table(spark, sf, "ask_pairs").select(*wanted), "request_id", "logged_at")


#: The same relations in SQL.
SQL = {
    "chunks": "chunks AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC) AS rn FROM code_chunks) WHERE rn = 1)",
    "files": "files AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC) AS rn FROM scanned_files) WHERE rn = 1)",
    "requests": "requests AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY logged_at DESC) AS rn FROM ask_pairs) WHERE rn = 1)",
    "classes": "classes AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY extracted_at DESC) AS rn FROM class_hierarchy) WHERE rn = 1)",
}
