"""Source files that nobody wrote by hand: generated, minified, vendored, or bulk data saved as source.

One pass over the files reads what each says of itself (notices in comments, place in the tree), a hash of its text, and features of the
text with every notice line taken out: compression ratio, token entropy, identifier lengths, comment density, line shapes. A random forest
with the classes hand-written, generated, minified and bulk data is trained on these features. It can see none of its labels: notices and
banners are cut out of the text, the path is no feature, and nor is the share of the text that stands in literals, which labels bulk data.
Files without a sign train as hand-written; as some of them are finds without a notice, a first forest puts aside those it doubts, and a second
one is trained on the rest. It judges every file. At most MAX_TRAINING rows of each label are trained on, chosen by hash.

Lock files, vendored directories and upstream banners are known by these alone. Copies of one text in three or more repositories are found by
grouping hashes of whole texts.

Null and empty contents are never found (nothing in them was written by a tool), except by their place or name as a lock file or a
vendored file. Files scanned again give one row. size_bytes and line_count, wrong now and then, are measured anew from the content.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import flat_map
from ..session import cut

#: Rows of each label the forest is trained on at most (chosen by hash, so the same at every run).
MAX_TRAINING = 6_000
#: Files without a sign train as hand-written only if the first forest gives them this probability of it.
RELIABLE = 0.8
#: A file is found if the forest gives it at least this probability of not being hand-written.
THRESHOLD = 0.55
CLASSES = ("hand-written", "generated", "minified", "bulk data")
#: LEAF rows at least in a leaf, so that a tree cannot learn a single unlabelled file by heart.
TREES, DEPTH, LEAF, SEED = 40, 8, 8, 7
#: A text counts as a library copy in this many repositories, from this many lines.
COPY_REPOS, COPY_LINES = 3, 10

# --- what a file says of itself -----------------------------------------------------------------------------------------------------

_NOTICE = re.compile(
    r"(?i)\bcode generated by\b|(?<!\w)@generated\b|\bauto-?generated (?:file|code|by|from|on|using)\b|<auto-generated>|\b(?:was|is) (?:created|generated|produced|written) automatically\b|\b(?:was|is) generated by \S+"
    r"|automatisch (?:erzeugt|generiert|erstellt)|\bgenerated (?:from|by|using|with) \S+ (?:by|with|using|from|version|v\d|\d)|\bgenerated (?:from|by) [\w./-]+\.(?:proto|thrift|graphql|ya?ml|json|xsd|idl|g4)"
    r"|\bdo not (?:edit|modify)\b|\bnicht bearbeiten\b|\b(?:ne pas modifier|no editar|не редактировать)\b|\bany changes? will be (?:lost|overwritten)\b"
)
_UPSTREAM = re.compile(r"(?i)\bvendored from\b|\bthis is a copy of \S+ (?:release|version|v?\d)|\breport bugs to the upstream\b|\bupstream project\b|\bdo not patch locally\b|\(c\) [\d, -]+ \S+ contributors\b|^\W*\S+ v?\d+\.\d+(?:\.\d+)?\s*(?:\|.*)?$")
_LICENSED = re.compile(r"(?i)\breleased under the \w+ license\b|https?://|\(c\) ")
_SHORT_BANNER = re.compile(r"^/\*![^\n]*\bv?\d+\.\d+[^\n]*\*/")
_COMMENT_LINE = re.compile(r"^\s*(?://|#|\*|/\*|<!--|--|;|%)")

_COMMENTS = re.compile(_COMMENT_LINE.pattern, re.M)
# One of these stands in every notice; looking for them first is cheap.
_NOTICE_HINTS = ("generat", "automati", "do not ", "bearbeiten", "modifier", "editar", "редактировать", "any change")
_GENERATED_PATH = re.compile(
    r"(?:^|/)(?:__generated__|generated-sources|generated|gen-src|codegen/out|\.generated)/|\.pb\.(?:go|cc|h)$|_pb2(?:_grpc)?\.pyi?$|\.(?:gen|generated|g|designer)\.\w+$|(?:^|/)zz_generated[\w.]*$|OuterClass\.\w+$"
)
_VENDORED_PATH = re.compile(r"(?:^|/)(?:third_party|third-party|thirdparty|3rdparty|_?vendor(?:ed)?|external|externals|site-packages|dist-packages|node_modules|bower_components|Godeps|jspm_packages|Pods|Carthage|deps)/")
_MINIFIED_PATH = re.compile(r"\.(?:min|bundle|packed)\.(?:js|css|mjs)$|-[0-9a-f]{8,}\.(?:js|css|mjs)$")
_LOCK_NAME = re.compile(r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|Pipfile\.lock|Cargo\.lock|composer\.lock|Gemfile\.lock|go\.sum|uv\.lock|[\w-]+\.lock\.(?:ya?ml|json|toml))$")
_LOCK_TEXT = re.compile(r'^\s*(?:"lockfileVersion"|lockfileVersion|"_meta":\s*\{\s*"hash")', re.M)

# --- features -----------------------------------------------------------------------------------------------------------------------

FEATURES = ("compression", "token_entropy", "identifier_length", "short_identifiers", "comment_density", "line_length", "longest_line", "top_shape", "distinct_shapes", "digit_share", "blank_share", "keyword_share")
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|[^\s\w]")
_SHAPE = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|[A-Za-z_$][\w$]*|\d[\w.]*")
_LITERAL = re.compile(r"\"[^\"\n ]{40,}\"|'[^'\n ]{40,}'")
# Words that hand-written code of the six languages is built from.
_KEYWORDS = frozenset("if else for while return def func function class import from try except catch finally throw raise switch case break continue in not and or with as yield async await new null None nil".split())


def features(text: str) -> tuple[list[float], float]:
    """The features of a text, and the share of it in literals, which is none of them."""
    n = max(1, len(text))
    lines = text.split("\n")
    tokens = Counter(_TOKEN.findall(text))
    total = words = chars = short = keywords = literal = 0
    entropy = 0.0
    for t, c in tokens.items():
        total += c
        entropy += c * math.log2(c)
        if t[0].isalpha() or t[0] in "_$":
            words += c
            chars += len(t) * c
            if len(t) <= 2:
                short += c
            if t in _KEYWORDS:
                keywords += c
        elif t[0].isdigit():
            literal += (len(t) + 1) * c  # with the comma or blank after it
    shapes = Counter(map(str.strip, _SHAPE.sub("w", text).split("\n")))
    shapes.pop("", None)
    count = max(1, sum(shapes.values()))
    raw = text.encode("utf-8", "replace")
    values = [
        len(zlib.compress(raw, 1)) / max(1, len(raw)),
        math.log2(total) - entropy / total if total else 0.0,
        chars / max(1, words),
        short / max(1, words),
        len(_COMMENTS.findall(text)) / count,
        math.log1p(n / count),
        math.log1p(max(map(len, lines))),
        max(shapes.values(), default=0) / count,
        len(shapes) / count,
        sum(map(text.count, "0123456789")) / n,
        max(0.0, 1 - count / len(lines)),
        keywords / max(1, words),
    ]
    return values, (literal + sum(map(len, _LITERAL.findall(text)))) / n


def evidence(path: str, text: str) -> tuple[list[str], str]:
    """What the file says of itself, and its text without the lines that say so."""
    found = []
    if _LOCK_NAME.search(path):
        found.append("lock file")
    if _GENERATED_PATH.search(path):
        found.append("generated by path")
    if _VENDORED_PATH.search(path):
        found.append("vendored by path")
    if _MINIFIED_PATH.search(path):
        found.append("minified by path")
    if not text:
        return found, text
    if _LOCK_TEXT.search(text):
        found.append("lock file")
    if _SHORT_BANNER.match(text):
        found.append("library banner")
        text = text[text.index("*/") + 2 :]
    low = text.lower()
    if any(h in low for h in _NOTICE_HINTS) and _NOTICE.search(text):
        keep = []
        for line in text.split("\n"):
            if _COMMENT_LINE.match(line) and _NOTICE.search(line):
                found.append("notice")
            else:
                keep.append(line)
        text = "\n".join(keep)
    # The comment a file begins with, read whole.
    at = said = 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        line = text[at:end].rstrip("\n")
        if line.strip() and not _COMMENT_LINE.match(line):
            break
        said += bool(_UPSTREAM.search(line)) * 2 + bool(_LICENSED.search(line))
        at = end
    if said >= 2:
        found.append("upstream banner")
        text = text[at:]
    return list(dict.fromkeys(found)), text


def listed(text: str, literal_share: float, top_shape: float) -> bool:
    """The label of bulk data: nearly all of the text is literals in lines of one shape, or in few lines."""
    return len(text) >= 500 and literal_share >= 0.6 and (top_shape >= 0.75 or literal_share >= 0.9 and text.strip().count("\n") < 5)


def judged(files: DataFrame, id_col: str = "file_id", repo_col: str = "repo_id", path_col: str = "relative_path", content_col: str = "content") -> DataFrame:
    """One row for each file: evidence, label of bulk data, hash of the text, features."""

    def make() -> Callable:
        def row(key, repo, path, content) -> Iterable[tuple]:
            text = (content or "").replace("\r\n", "\n").replace("\r", "\n")
            said, bare = evidence(path or "", text)
            f, share = features(bare)
            whole = text.strip()
            lines = whole.count("\n") + 1 if whole else 0
            digest = hashlib.blake2b(whole.encode("utf-8", "replace"), digest_size=16).hexdigest() if lines >= COPY_LINES else None
            return [(key, repo, path, said, listed(bare, share, f[FEATURES.index("top_shape")]), digest, bool(bare.strip()), f)]

        return row

    kinds = files.schema[id_col].dataType.simpleString(), files.schema[repo_col].dataType.simpleString()
    return flat_map(
        files.where(F.col(id_col).isNotNull()), [F.col(id_col).alias("id"), F.col(repo_col).alias("repo"), F.col(path_col).alias("path"), F.col(content_col).alias("content")], make,
        f"id {kinds[0]}, repo {kinds[1]}, path string, said array<string>, listed boolean, digest string, has_text boolean, f array<double>",
    ).dropDuplicates(["id"])


def _fit(rows: DataFrame):
    """A forest of rows with v and label, each label weighing a tenth of the hand-written files at least."""
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if 0.0 not in counts or len(counts) < 2:
        return None
    weight = F.lit(1.0)
    for label, n in counts.items():
        if label:
            weight = F.when(F.col("label") == label, max(1.0, counts[0.0] / n / 10)).otherwise(weight)
    forest = RandomForestClassifier(featuresCol="v", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAF, seed=SEED, subsamplingRate=0.7)
    return forest.fit(rows.withColumn("weight", weight))


def trained(rows: DataFrame):
    """The forest, or None where no file is labelled as found or none as hand-written."""
    says = lambda *signs: F.arrays_overlap("said", F.array(*map(F.lit, signs)))
    label = F.when(says("notice", "generated by path"), 1.0).when(says("library banner", "minified by path"), 2.0).when(F.col("listed"), 3.0).when(F.size("said") == 0, 0.0)
    labelled = rows.where("has_text").select("id", "f", label.alias("label")).where("label is not null")
    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.lit(0.0)
    for k, n in counts.items():
        rate = F.when(F.col("label") == k, MAX_TRAINING / n).otherwise(rate)
    # Rows in a fixed order in fixed partitions, so that the trees are the same at every run.
    sample = cut(labelled.where(share < rate)).withColumn("v", array_to_vector("f")).repartition(4, "id").sortWithinPartitions("id").select("v", "label")
    first = _fit(sample)
    if first is None:
        return None
    sure = first.transform(sample).where((F.col("label") > 0) | (vector_to_array("probability")[0] >= RELIABLE)).select("v", "label")
    return _fit(sure) or first


def not_handwritten(files: DataFrame, id_col: str = "file_id", threshold: float = THRESHOLD, alone: bool = False, **columns: str) -> DataFrame:
    """id, reasons and the forest's probability of each file that wasn't written by hand. alone: the forest's reasons only."""
    rows = cut(judged(files, id_col, **columns))
    copied = rows.where("digest is not null").select("digest", "repo").distinct().groupBy("digest").count().where(f"count >= {COPY_REPOS}").select(F.col("digest").alias("same"), F.lit(True).alias("copied"))
    forest = trained(rows)
    if forest is None:
        scored = rows.withColumn("each", F.array(F.lit(1.0), *[F.lit(0.0)] * (len(CLASSES) - 1)))
    else:
        scored = forest.transform(rows.withColumn("v", array_to_vector("f"))).withColumn("each", vector_to_array("probability")).drop("v", "probability", "rawPrediction", "prediction")
        if forest.numClasses < len(CLASSES):
            scored = scored.withColumn("each", F.concat("each", F.array(*[F.lit(0.0)] * (len(CLASSES) - forest.numClasses))))
    path = F.coalesce("path", F.lit(""))
    # Hand-written settings are as regular as what tools write; only bulk data is told apart from them. Markdown is never found.
    p = F.when(~F.col("has_text") | path.rlike(r"\.md$"), 0.0).when(path.rlike(r"\.(json|ya?ml|toml)$"), F.col("each")[3]).otherwise(1 - F.col("each")[0])
    best = F.when(path.rlike(r"\.(json|ya?ml|toml)$"), 3).otherwise(F.array_position(F.slice("each", 2, 3), F.array_max(F.slice("each", 2, 3))))
    name = F.element_at(F.array(*(F.lit(f"{c} by its text") for c in CLASSES[1:])), best.cast("int"))
    by_forest = F.when(p >= threshold, name)
    # Files without a digest match nothing; their own ids keep them spread.
    joined = scored.withColumn("p", p).withColumn("same", F.coalesce("digest", F.col("id").cast("string"), F.lit(""))).join(copied, "same", "left")
    reasons = F.array_compact(F.array(by_forest)) if alone else F.array_compact(F.concat("said", F.array(by_forest, F.when(F.col("copied") & F.col("digest").isNotNull(), F.lit("copied")))))
    return joined.select(F.col("id").alias(id_col), reasons.alias("reasons"), "p").where(F.size("reasons") > 0)
