"""Rules over the lines and texts of code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rule, category, severity and pattern (without case) of the line rules.
LINE_RULES = [
    ("SEC001", "SQL_INJECTION", "critical", r"(SELECT|INSERT|UPDATE|DELETE).*(\{.+\}|\+\s*\w+|%\s*\w+)"),
    ("SEC002", "HARDCODED_SECRET", "high", r"(password|secret|api[_-]?key|token)\s*=\s*['\"][^'\"]{4,}['\"]"),
    ("SEC003", "UNSAFE_DESERIALIZATION", "high", r"(pickle\.loads|yaml\.load\(|marshal\.loads)"),
    ("SEC004", "COMMAND_INJECTION", "critical", r"subprocess\.(run|Popen|call)\([^\n]*shell\s*=\s*True"),
    ("SEC005", "PATH_TRAVERSAL", "high", r"(open\(|Path\().*(\.\./|request\.|params\[|input\()"),
    ("SEC006", "WEAK_CRYPTOGRAPHY", "high", r"hashlib\.(md5|sha1)\("),
    ("SEC007", "INSECURE_RANDOM", "medium", r"random\.(random|randint|choice|choices)\("),
    ("SEC008", "DEBUG_MODE", "medium", r"(debug\s*=\s*True|FLASK_DEBUG\s*=\s*['\"]?1)"),
    ("SEC009", "JWT_WITHOUT_VERIFY", "critical", r"jwt\.decode\([^\n]*verify_signature\s*=\s*False"),
    ("SEC010", "INSECURE_CORS", "medium", r"allow_origins\s*=\s*\[\s*['\"]\*['\"]\s*\]"),
    ("SEC011", "XSS_RAW_HTML", "high", r"(mark_safe\(|innerHTML\s*=|render_template_string\()"),
    ("SEC012", "SSRF", "high", r"requests\.(get|post|put|delete)\([^\n]*(request\.|input\(|params\[)"),
    ("SEC013", "TEMPLATE_INJECTION", "high", r"(Template\(|Environment\().*(request\.|input\(|params\[)"),
    ("SEC014", "OPEN_REDIRECT", "medium", r"(redirect\(|Response\.redirect).*(request\.|params\[|query_params)"),
    ("SEC015", "XXE", "high", r"(xml\.etree|lxml).*resolve_entities\s*=\s*True"),
]
# Title and pattern (without case, over the whole text) of the text rules.
TEXT_RULES = [
    ("Swallowed exception", r"except\s*:\s*\n\s*pass"),
    ("Generic exception swallowed", r"except\s+Exception\s*:\s*\n\s*pass"),
    ("Assertion used in runtime path", r"assert\s+[^\n]+"),
    ("Pending fragile code marker", r"TODO|FIXME|HACK"),
]


def line_findings(df: DataFrame, key: str, content: str, start_line: str) -> DataFrame:
    """key, line (in the file), rule, category, severity: one row for each line and rule. Texts that no rule could match are dropped before
    their lines are exploded; null texts give none."""
    any_rule = "(?i)" + "|".join(f"(?:{p})" for *_, p in LINE_RULES)
    texts = df.where(F.col(content).rlike(any_rule)).select(key, start_line, F.posexplode(F.split(content, "\n")).alias("i", "line_text"))
    hits = F.filter(F.array(*(F.when(F.col("line_text").rlike("(?i)" + p), F.struct(F.lit(r).alias("rule"), F.lit(c).alias("category"), F.lit(s).alias("severity"))) for r, c, s, p in LINE_RULES)), lambda x: x.isNotNull())
    return texts.select(key, (F.coalesce(start_line, F.lit(1)) + F.col("i")).cast("int").alias("line"), F.explode(hits).alias("h")).select(key, "line", "h.rule", "h.category", "h.severity")


def text_findings(df: DataFrame, key: str, content: str) -> DataFrame:
    """key and title of each text rule that holds somewhere in the text."""
    hits = F.array_compact(F.array(*(F.when(F.col(content).rlike("(?i)" + p), F.lit(t)) for t, p in TEXT_RULES)))
    any_rule = reduce(lambda a, b: a | b, [F.col(content).rlike("(?i)" + p) for _, p in TEXT_RULES])
    return df.where(any_rule).select(key, F.explode(hits).alias("title"))
