"""Functions paired with their documentation.

A text is cut into tokens, and wherever a function may begin a generalised LL recogniser with an ambiguous grammar (comments, annotations,
signature, docstring) reads its head; where none begins the token is skipped, so functions are found in broken files as well. The body is
followed to its end by brackets or indentation, and functions within it are read too; a function whose body never ends is marked as broken.
What the documentation says is reduced to sentences: directives, rulers, tags, placeholders and disabled code say nothing, nor do the words
of the name. Descriptions that the corpus repeats for many names are templates: they are counted by hash over all rows and dropped.

Null and empty contents, and chunks of other types, give no pair. Of rewritten rows the latest created_at counts, whether or not it is
documented. Ties of created_at are broken by the name and the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import flat_map
from ..session import cut
from .gll import GLL

FUNCTION_TYPES = ("function", "method", "async_function", "async_method")
#: A description is a template if it documents this share of all names, and at least so many.
TEMPLATE_SHARE, TEMPLATE_NAMES = 0.002, 25
#: Words beyond the name that a sentence must have to say something.
LEAST_WORDS = 3

# --- parsing ------------------------------------------------------------------------------------------------------------------------

_CURLY = GLL({
    "Unit": [("Doc", "Head"), ("Head",)],
    "Doc": [("C",), ("Doc", "C")],
    "Head": [("Notes", "Words", "Paren", "Tail", "{")],
    "Notes": [(), ("Notes", "A"), ("Notes", "A", "Paren")],
    "Words": [("W",), ("Words", "W"), ("Words", "O"), ("Words", "[", "Items", "]")],
    "Tail": [(), ("Tail", "W"), ("Tail", "O"), ("Tail", "Paren"), ("Tail", "[", "Items", "]"), ("Tail", "S")],
    "Paren": [("(", "Items", ")")],
    "Items": [(), ("Items", "Item")],
    "Item": [("W",), ("O",), ("S",), ("A",), ("C",), ("B",), (":",), ("Paren",), ("[", "Items", "]"), ("{", "Items", "}")],
})
_PYTHON = GLL({
    "Unit": [("Notes", "Words", "Paren", "Tail", ":", "Gap", "Doc"), ("Notes", "Words", "Paren", "Tail", ":")],
    "Notes": [(), ("Notes", "A"), ("Notes", "A", "Paren"), ("Notes", "C"), ("Notes", "B")],
    "Words": [("W",), ("Words", "W")],
    "Tail": [(), ("Tail", "W"), ("Tail", "O"), ("Tail", "S"), ("Tail", "[", "Items", "]"), ("Tail", "Paren")],
    "Gap": [(), ("Gap", "B"), ("Gap", "C")],
    "Doc": [("S",), ("Doc", "S")],
    "Paren": [("(", "Items", ")")],
    "Items": [(), ("Items", "Item")],
    "Item": [("W",), ("O",), ("S",), ("C",), ("B",), (":",), ("Paren",), ("[", "Items", "]"), ("{", "Items", "}")],
})

_CURLY_TOKEN = re.compile(
    r"(?P<C>/\*.*?(?:\*/|\Z)|//[^\n]*)|(?P<B>\n[ \t\r]*\n\s*)|\s+|(?P<S>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|(?<=[(,=:\[!&|?{};\n ])/(?![/*\s])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*(?=\s*[.,;)\]}\n]))|(?P<A>@(?!interface\b)[A-Za-z_][\w.]*)|(?P<P>[()\[\]{}])|(?P<W>[\w$.]+)|(?P<O>:|[^\s\w])", re.S
)
_PYTHON_TOKEN = re.compile(
    r"(?P<C>\#[^\n]*)|(?P<B>\n[ \t\r]*\n\s*)|\s+|\\\n|(?P<S>[rRuUbBfF]{0,2}(?:\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\.)*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'))|(?P<A>@[A-Za-z_][\w.]*)|(?P<P>[()\[\]{}:])|(?P<W>[\w.]+)|(?P<O>->|[^\s\w])", re.S
)


class Unit(NamedTuple):
    """A function: its name, its documentation (start and end; equal if there is none), its end, whether the body is whole."""

    name: str
    start: int
    doc: tuple[int, int]
    end: int
    whole: bool


def _tokens(text: str, python: bool, head_only: bool) -> list[tuple[str, int, int]]:
    """Kind, start and end of the tokens; head_only stops where the first body begins."""
    found = ((k if k != "P" else m.group(), *m.span()) for m in (_PYTHON_TOKEN if python else _CURLY_TOKEN).finditer(text) if (k := m.lastgroup))
    if not head_only:
        return list(found)
    out: list[tuple[str, int, int]] = []
    depth, closed, colon = 0, False, False
    for token in found:
        kind = token[0]
        out.append(token)
        if colon and kind not in "CBS":
            break
        if kind in "([" or kind == "{" and (depth or not closed):
            depth += 1
        elif kind in ")]}":
            depth -= 1
            closed = closed or kind == ")" and depth == 0
        elif kind == "{":
            break
        elif python and kind == ":" and depth == 0 and closed:
            colon = True
    return out


def _head(tokens: list[tuple[str, int, int]], at: int, python: bool) -> int:
    """Place after the head that begins at a token: after the body's bracket, or after the strings that follow the colon. 0 if what begins
    here ends before any parameters do."""
    depth, closed, colon, n = 0, False, False, len(tokens)
    for i in range(at, n):
        kind = tokens[i][0]
        if colon and kind not in "CBS":
            return i
        if kind in "([" or kind == "{" and (depth or not closed):
            depth += 1
        elif kind in ")]}":
            depth -= 1
            if depth < 0:
                return 0
            closed = closed or kind == ")" and depth == 0
        elif kind == "{":
            return i + 1
        elif python and kind == ":" and depth == 0:
            if not closed:
                return 0
            colon = True
    return n


# Words before brackets that begin a statement, not a function.
_CONTROL = frozenset("if for while switch catch return else do try throw new await yield typeof delete in of case assert with elif except print lambda and or not select go defer synchronized super this".split())


def _name(text: str, tokens: list[tuple[str, int, int]]) -> str:
    """The name before the parameters; for a method of Go the one after its receiver."""
    words: list[str] = []
    depth = 0
    for kind, s, e in tokens:
        if kind == "(" and depth == 0 and words and words != ["func"]:
            break
        depth += (kind in ("(", "[", "{")) - (kind in (")", "]", "}"))
        if kind == "W" and depth == 0:
            words.append(text[s:e])
    return words[-1] if words else ""


def _body_end(text: str, tokens: list[tuple[str, int, int]], at: int, indent: int, python: bool) -> tuple[int, bool]:
    """Token after the body, and whether it ends as it should."""
    depth = 0 if python else 1
    some = False
    for i in range(at, len(tokens)):
        kind, s, _ = tokens[i]
        if python and depth == 0 and kind not in "BC":
            line = text.rfind("\n", 0, s) + 1
            if not text[line:s].strip() and s - line <= indent:
                return i, some
            some = True
        if kind in ("(", "[", "{"):
            depth += 1
        elif kind in (")", "]", "}"):
            depth -= 1
            if depth < 0:
                return i, False
            if not python and depth == 0:
                return i + 1, True
    return len(tokens), python and some and depth == 0


def units(text: str, python: bool, first_only: bool = False) -> Iterator[Unit]:
    """The functions of a text in order, those within others too. first_only stops after the first head and doesn't follow its body."""
    tokens = _tokens(text, python, first_only)
    kinds = [t[0] for t in tokens]
    parser = _PYTHON if python else _CURLY
    at, n = 0, len(tokens)
    fresh = True  # whether a statement may begin here
    while at < n:
        kind = kinds[at]
        if not fresh and not first_only or kind not in ("WA" if python else "CWA"):
            fresh = kind in ("{", "}") or kind == "O" and text[tokens[at][1]] == ";" or kind in "BCS" or python
            at += 1
            continue
        if python and not first_only and kind == "W" and text[tokens[at][1] : tokens[at][2]] not in ("def", "async"):
            at += 1
            continue
        stop = _head(tokens, at, python)
        ends, docs = parser.spans(kinds[at:stop], "Unit", 0, "Doc") if stop else (set(), set())
        name = _name(text, [t for t in tokens[at:stop] if t[0] != "A"]) if ends else ""
        opens = next((text[s:e] for k, s, e in tokens[at:stop] if k == "W"), "")
        if not ends or not first_only and (name in _CONTROL or opens in _CONTROL):
            fresh = False if not python else True
            at += 1
            continue
        end = at + max(ends)
        docs = {d for d in docs if at + d[1] <= end} if python else {d for d in docs if d[0] == 0}
        doc = (tokens[at][1],) * 2
        if docs:
            first, last = max(docs, key=lambda d: (d[1], -d[0]))
            doc = tokens[at + first][1], tokens[at + last - 1][2]
        start = tokens[at][1]
        if first_only:
            yield Unit(name, start, doc, tokens[end - 1][2], False)
            return
        body = next((i for i in range(at, end) if kinds[i] == ":" and python), end - 1) + 1 if python else end
        if python:
            # The colon of the head is the last one outside brackets.
            depth = 0
            for i in range(at, end):
                depth += (kinds[i] in ("(", "[", "{")) - (kinds[i] in (")", "]", "}"))
                if kinds[i] == ":" and depth == 0:
                    body = i + 1
        stop, whole = _body_end(text, tokens, body, start - (text.rfind("\n", 0, start) + 1), python)
        while stop > end and kinds[stop - 1] in "BC":
            stop -= 1  # blank lines and comments after the body
        yield Unit(name, start, doc, tokens[stop - 1][2], whole)
        at, fresh = end, True


def extract(text: str, python: bool) -> tuple[str, int, int] | None:
    """(documentation, start and end of it in the text) of the first function in the text; None if it has none."""
    for unit in units(text, python, first_only=True):
        s, e = unit.doc
        return (text[s:e], s, e) if e > s else None
    return None


# --- what it says -------------------------------------------------------------------------------------------------------------------

_DIRECTIVE = re.compile(
    r"(?i)^\W*(?:eslint|prettier|tslint|jshint|jslint|istanbul|c8|v8|ts-(?:ignore|nocheck|check|expect)|@ts-|nolint|noqa|noinspection|pylint|flake8|mypy|type:|pragma|go:|\+build|lint:|checkstyle|clang-format|fmt:|isort:|yapf:|coverage:|sonar|nosonar|@(?:internal|private|public|protected|override|deprecated|ignore|hidden|inheritdoc|api|suppress\w*|nocollapse|generated|test|see|since|author|version|license|module|static|async|readonly|final|abstract|virtual)\b|\{@inheritdoc\})[\w:./,=()\" -]*$"
)
_TAG = re.compile(r"^\s*(?:[@\\](?:param|arg|argument|return|returns|throws|exception|raise|raises|type|typedef|template|yield|yields|property|prop|example|default|rtype)\b|:(?:param|type|return|returns|rtype|raises|raise|var|ivar|keyword|arg|yields?)\b)", re.I)
_SECTION = re.compile(r"(?i)^\s*(?:args|arguments|parameters|params|returns?|yields?|raises|throws|attributes|examples?|keyword args|other parameters|paramètres|parameter|rückgabe|parámetros|parâmetros)\s*:?\s*$")
_RULER = re.compile(r"^[\W_]*$")
_PLACEHOLDER = re.compile(
    r"(?i)^\W*(?:todo|fixme|xxx|tbd|tba|wip|hack)\b.*$|^\W*(?:undocumented|no (?:documentation|description|docs?|docstring|comment)s?(?: available| yet| provided)?|not documented(?: yet)?|documentation (?:missing|pending|to follow|goes here)|missing docs?(?:tring)?|(?:insert|add|write|your) (?:a |the )?(?:description|documentation|docs?|docstring|comment)s?(?: here)?|description(?: goes)?(?: here)?"
    r"|placeholder\b.*|see (?:above|below|elsewhere|code|source|the code)|same as above|helper(?: function| method)?|(?:utility|auxiliary|internal|private|public|main|wrapper|simple|test)(?: helper)? (?:function|method)|self[- ]explanatory|lorem ipsum.*|n/?a|none|nothing|summary|docstring|comment|function|method|constructor|getter|setter|default|empty|stub|dummy|dito|ditto|not implemented(?: yet)?|work in progress|to be (?:done|written|documented|filled in|completed).*)\W*$"
)
# A line of disabled code: it ends or is built as code is and not as prose.
_CODE_LINE = re.compile(r"^\s*(?:.*[;{}]\s*|(?:return|if|for|while|else|elif|const|let|var|import|from|def|class|func|print|throw|raise|try|except|catch|break|continue|switch|case)\b.*[(){}\[\]=:;].*|[\w.$\[\]]+\s*(?:\+|-|\*|/|:)?=[^=].*|[\w.$]+\([^)]*\)[;,]?\s*|[})\]]+[;,)]*|(?:await|yield|new|delete)\s+[\w.$]+\(.*)$")
_SENTENCE_END = re.compile(r"(?<=[.!?…])\s+|\n\s*\n")
_NAME_PART = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
# Fixed value: words that a restatement of the name is filled with.
_FILLER = frozenset("a an the this that these those it its is are was be will does do did function method functions methods helper routine procedure handler wrapper used use uses for to of in on at by with and or from into as we you just simply basically here returns return gets get sets set performs perform executes execute runs run implements implementation called can should class module code file".split())


def _stem(word: str) -> str:
    w = word.lower()
    for end in ("ations", "ation", "ings", "ing", "ies", "ed", "es", "s", "d"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    return w.rstrip("eiy")


def prose(doc: str, python: bool) -> str:
    """The lines of a documentation that are prose."""
    if python:
        body = re.sub(r"^[rRuUbBfF]{0,2}(?:\"\"\"|'''|\"|')|(?:\"\"\"|'''|\"|')\s*$", "", doc.strip())
        lines = body.replace("\r", "").split("\n")
    else:
        lines = []
        for line in doc.replace("\r", "").split("\n"):
            line = re.sub(r"^\s*(?:/\*+|//+!?|\*+(?!/))|\*+/\s*$", "", line)
            lines.append(re.sub(r"\*+/\s*$", "", line))
    keep, section, tag = [], None, False
    for line in lines:
        bare = line.strip()
        indent = len(line) - len(line.lstrip())
        if not bare:
            tag = False
            keep.append("")
            continue
        if section is not None:
            if indent > section or re.match(r"^\s*[\w*]+(?:\s*\([^)]*\))?\s*:\s", line) and indent >= section:
                continue
            section = None
        if _SECTION.match(bare):
            section = indent
            continue
        if _TAG.match(bare):
            tag = True
            continue
        if tag and indent > 1 and not re.match(r"[A-Z]", bare):
            continue  # the rest of a tag
        tag = False
        if _RULER.match(bare) or _DIRECTIVE.match(bare) or _PLACEHOLDER.match(bare) or _CODE_LINE.match(line):
            continue
        keep.append(bare)
    return "\n".join(keep).strip()


def says_more(text: str, name: str | None) -> bool:
    """Whether a sentence has words beyond those of the name."""
    known = {_stem(p) for p in _NAME_PART.findall(name or "")}
    whole = re.sub(r"\W|_", "", (name or "").lower())
    for sentence in _SENTENCE_END.split(text):
        if _PLACEHOLDER.match(sentence.strip()):
            continue
        words = [w for w in _WORD.findall(sentence) if w.lower() not in _FILLER]
        new = [w for w in words if _stem(w) not in known and w.lower() != whole and len(w) > 1]
        if len(new) >= LEAST_WORDS:
            return True
    return False


def template_key(text: str, name: str | None) -> str:
    """Hash of a description without the function's own name, numbers and signs."""
    known = {_stem(p) for p in _NAME_PART.findall(name or "")}
    words = ["@" if _stem(w) in known else w.lower() for w in _WORD.findall(text)]
    return hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=8).hexdigest()


def _python(language: str | None, text: str) -> bool:
    if language:
        return language == "python"
    return re.match(r"\s*(?:@[\w.]+[^\n]*\n\s*)*(?:async\s+)?def\s", text) is not None


def parsed_pairs(chunks: DataFrame, texts: bool, id_col: str, content_col: str, language_col: str, name_col: str, type_col: str, time_col: str | None) -> DataFrame:
    """The latest version of each function: id, name, and, if it is documented, hash of the description and, if asked for, code and description."""

    def make() -> Callable:
        def row(key, at, name, language, content) -> Iterable[tuple]:
            python = _python(language, content)
            found = extract(content, python)
            description = prose(found[0], python) if found else ""
            if not description or not says_more(description, name):
                return [(key, at or "", name or "", None, None, None)]
            code = (content[: found[1]] + content[found[2] :]) if texts else None
            return [(key, at or "", name or "", template_key(description, name), code, description if texts else None)]

        return row

    rows = chunks.where(F.col(type_col).isin(*FUNCTION_TYPES) & F.col(content_col).isNotNull())
    kind = chunks.schema[id_col].dataType.simpleString()
    at = F.col(time_col).cast("string") if time_col else F.lit("")
    columns = [F.col(id_col).alias("id"), at.alias("at"), F.col(name_col).alias("name"), F.col(language_col).alias("language"), F.col(content_col).alias("content")]
    every = flat_map(rows, columns, make, f"id {kind}, at string, name string, template string, code string, description string")
    return every.groupBy("id").agg(F.max(F.struct("at", "name", "template", "code", "description")).alias("x")).select("id", "x.name", "x.template", "x.code", "x.description")


def without_templates(pairs: DataFrame) -> DataFrame:
    """Pairs whose description isn't one that the corpus repeats for many names."""
    per_template = pairs.select("template", "name").distinct().groupBy("template").agg(F.count("*").alias("k"))
    total = per_template.agg(F.sum("k")).first()[0] or 0
    # At most 1 / TEMPLATE_SHARE templates can hold such a share of all, so this side has a bound.
    templates = per_template.where(F.col("k") >= max(TEMPLATE_NAMES, total * TEMPLATE_SHARE)).select("template")
    return pairs.join(F.broadcast(templates), "template", "left_anti")


def documented_functions(
    chunks: DataFrame, texts: bool = True, id_col: str = "chunk_id", content_col: str = "content", language_col: str = "language", name_col: str = "name", type_col: str = "chunk_type", time_col: str | None = "created_at"
) -> DataFrame:
    """Pairs of code (without its documentation) and description; texts=False leaves both out and gives the ids."""
    # The parse is the costly part; its result is written once and read for the counts and for the pairs.
    pairs = cut(parsed_pairs(chunks, texts, id_col, content_col, language_col, name_col, type_col, time_col).where("template is not null"))
    out = without_templates(pairs).select(F.col("id").alias(id_col), "name", "code", "description")
    return out if texts else out.select(id_col)


SOURCES = ("python", "javascript", "typescript", "java", "go")


def file_functions(files: DataFrame, id_col: str = "file_id", content_col: str = "content", language_col: str = "language", time_col: str | None = "scanned_at") -> DataFrame:
    """Every documented function of whole files, broken ones too: id, number of the function, name, lines, whether its body is whole, code and
    description. Null contents and other languages give none. Of files scanned again the latest counts."""

    def make() -> Callable:
        def row(key, at, language, content) -> Iterable[tuple]:
            python, out = language == "python", []
            line, place = 1, 0
            for unit in units(content, python):
                s, e = unit.doc
                description = prose(content[s:e], python) if e > s else ""
                if not description or not says_more(description, unit.name):
                    continue
                line += content.count("\n", place, unit.start)
                place = unit.start
                code = content[unit.start : s] + content[e : unit.end]
                out.append((unit.name, line, line + content.count("\n", unit.start, unit.end), unit.whole, template_key(description, unit.name), code, description))
            return [(key, at or "", out)]

        return row

    kind = files.schema[id_col].dataType.simpleString()
    at = F.col(time_col).cast("string") if time_col else F.lit("")
    rows = files.where(F.col(id_col).isNotNull() & F.col(language_col).isin(*SOURCES) & F.col(content_col).isNotNull())
    item = "struct<name:string,start_line:int,end_line:int,whole:boolean,template:string,code:string,description:string>"
    each = flat_map(rows, [F.col(id_col).alias("id"), at.alias("at"), F.col(language_col).alias("language"), F.col(content_col).alias("content")], make, f"id {kind}, at string, found array<{item}>")
    latest = each.groupBy("id").agg(F.max(F.struct("at", "found")).alias("x"))
    pairs = cut(latest.select("id", F.posexplode("x.found").alias("n", "f")).select("id", "n", "f.*"))
    return without_templates(pairs).select(F.col("id").alias(id_col), "n", "name", "start_line", "end_line", "whole", "code", "description")
