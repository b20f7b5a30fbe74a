"""Column expressions over text and code; all run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that the capped indexes take of a text.
MAX_TOKENS = 512
# Characters per token by file extension, and for other text.
CHARS_PER_TOKEN = {"py": 3.5, "js": 3.8, "ts": 3.8, "go": 3.8, "java": 3.8, "rs": 3.8, "cpp": 3.8, "c": 3.8, "rb": 3.8, "php": 3.8}
CHARS_PER_TOKEN_TEXT = 4.0
# Words that route a question, the first list that matches wins.
TASK_WORDS = {
    "security": ["security", "vulnerability", "exploit", "sql injection", "command injection", "ldap injection", "prompt injection", "xss", "csrf", "unsafe", "insecure", "attack"],
    "architecture": ["architecture", "design", "pattern", "structure", "high level", "components"],
    "summarize": ["summarise", "summarize", "overview", "what does", "purpose"],
}


def filled(c: Column) -> Column:
    """Null for an empty string: what a falsy default replaces."""
    return F.nullif(c, F.lit(""))


def code_tokens(text: Column, limit: int | None = None) -> Column:
    """Lower-case parts of identifiers and words of two or more ASCII characters, all of them unless a limit is given; an empty array for a
    null text."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    # Runs of two or more; whole-string functions are far cheaper here than a lambda for each token.
    words = F.regexp_extract_all(spaced, F.lit("[a-zA-Z0-9]{2,}"), F.lit(0))
    runs = F.array_join(words if limit is None else F.slice(words, 1, limit), " ")
    return F.when(runs != "", F.split(F.lower(runs), " ")).otherwise(F.array().cast("array<string>"))


def index_text(name: Column, docstring: Column, content: Column) -> Column:
    """What a chunk is indexed by: its name three times, its documentation, its content."""
    return F.concat_ws(" ", filled(name), filled(name), filled(name), filled(docstring), filled(content))


def embedding_text(chunk_type: Column, name: Column, docstring: Column, content: Column) -> Column:
    """What a chunk is embedded by, a line for each part that isn't empty."""
    title = F.concat(F.upper(F.substring(chunk_type, 1, 1)), F.lower(F.substring(chunk_type, 2, 1_000)), F.lit(": "), name)
    return F.concat_ws("\n", title, F.concat(F.lit("Docstring: "), filled(docstring)), F.concat(F.lit("Code:\n"), filled(content)))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least 1, and 0 for nothing."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("int")


def file_token_estimate(text: Column, path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    rate = reduce(lambda w, kv: w.when(ext == kv[0], kv[1]), CHARS_PER_TOKEN.items(), F.when(F.lit(False), CHARS_PER_TOKEN_TEXT)).otherwise(CHARS_PER_TOKEN_TEXT)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.floor(F.length(text) / rate) + 1).cast("int")


def task_type(question: Column) -> Column:
    q = F.lower(F.coalesce(question, F.lit("")))
    out = F.lit("code_qa")
    for task, words in reversed(TASK_WORDS.items()):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(q, F.lit(w)) for w in words]), task).otherwise(out)
    return out


def fixed_blocks(text: Column, size: int) -> Column:
    """The text in blocks of `size` characters."""
    n = F.ceil(F.length(text) / F.lit(size)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


# How a report names an exception, a place (in two ways) and a function.
EXCEPTION = r"\b([A-Za-z_][A-Za-z0-9_]*(?:Error|Exception))\b"
PLACE = r"(?:at\s+)?([A-Za-z0-9_./\\-]+\.[A-Za-z0-9_]+)[:\s]+(\d+)"
PLACE_IN_WORDS = r"\(([A-Za-z0-9_./\\-]+\.[A-Za-z0-9_]+)\s+line\s+(\d+)\)"
IN_FUNCTION = r"\bin\s+([A-Za-z_][A-Za-z0-9_]*)\b"


def error_signal(text: Column) -> dict[str, Column]:
    """Exception, file, line and function that a report names; null where it names none."""
    pick = lambda p, g: filled(F.regexp_extract(text, p, g))
    return {
        "exception_type": pick(EXCEPTION, 1),
        "file_path": F.replace(F.coalesce(pick(PLACE, 1), pick(PLACE_IN_WORDS, 1)), F.lit("\\"), F.lit("/")),
        "line_number": F.coalesce(pick(PLACE, 2), pick(PLACE_IN_WORDS, 2)).try_cast("int"),
        "function_name": pick(IN_FUNCTION, 1),
    }
