"""Source files read from a directory tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by extension, directories and files that are passed over, and the largest file.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "cpp": "cpp", "cc": "cpp", "c": "c", "h": "c", "cs": "csharp",
    "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "sh": "bash", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "sql": "sql", "md": "markdown", "html": "html", "css": "css",
}
SKIPPED_DIRS = [".git", ".github", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".next", "target", "vendor", ".idea", ".vscode", "coverage", ".pytest_cache"]
SKIPPED_FILES = [".DS_Store", "package-lock.json", "yarn.lock", "poetry.lock", "Pipfile.lock", "Cargo.lock"]
MAX_BYTES = 1 << 20


def language(path):
    """Language of a path's extension; null for unknown ones and passed-over files."""
    names = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    file = F.element_at(F.split(path, "/"), -1)
    return F.when(~file.isin(*SKIPPED_FILES), F.try_element_at(names, F.lower(F.regexp_extract(file, r"\.([^.]+)$", 1))))


def in_skipped_dir(path):
    parents = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.arrays_overlap(parents, F.array(*map(F.lit, SKIPPED_DIRS)))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, language, size_bytes, line_count and content of the source files below root. Paths and sizes are filtered before any
    content is read; bytes that are no UTF-8 are replaced."""
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).where(F.col("length") <= MAX_BYTES)
    relative = F.regexp_replace(F.expr("substring(path, locate('/', path))"), "^/+" + base.strip("/").replace(".", "\\.") + "/", "")
    named = found.withColumn("relative_path", relative).withColumn("language", language(F.col("relative_path"))).where(F.col("language").isNotNull() & ~in_skipped_dir(F.col("relative_path")))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return named.select("relative_path", "language", F.col("length").cast("int").alias("size_bytes"), (F.size(F.split(text, "\n"))).alias("line_count"), text.alias("content"))


#: Columns of a load test's table that are read.
LOAD_COLUMNS = {"Request Count": "requests", "Failure Count": "failures", "Median Response Time": "median", "Requests/s": "rate"}


def load_test(spark: SparkSession, path: str) -> DataFrame:
    """requests, failures, median and rate of each row of a load test's CSV files; what is no number is null."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*(F.col(f"`{k}`").try_cast("double").alias(v) for k, v in LOAD_COLUMNS.items()))
