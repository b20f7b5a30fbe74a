"""Source files that are not valid in the language of their extension.

A file is cut at line ends into chunks of some thousand characters. Each chunk is read for every state the lexer may be in when it begins
(lexer_maps.py) and gives, for each of them, the state it ends in, its bracket summary, the faults of the statements that lie wholly in it,
and the masked text before its first and after its last statement end. These maps are joined in order: the text between two statement ends is
judged where it is whole again, a summary of brackets tells at what depth it stands. A statement is the same text wherever the file was cut,
so the size of the chunks never changes a result; files of any length are judged alike, and long ones by all tasks together.

Statements are read by local grammars: for JavaScript, TypeScript, Java and Go which tokens may stand side by side, what a keyword must be
followed by, what a top-level declaration starts with; for Python, JSON and TOML those of statements.py. YAML has no state but its open
indentations, so its lines are read in order when the chunks are joined. Names, types and repeated keys aren't looked at.

Null and empty contents, Markdown and unknown extensions never count. Files scanned again give one row. A blank JSON file holds no value and
is invalid; other blank files are valid.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import flat_map
from .lexer_maps import CODE, S, STATES, join_summaries, masked, summary
from .statements import Indentation, json_shrunk, json_signs, python_shapes, python_statement, toml_statement
from .yaml_lines import yaml_fault

#: Characters of a chunk; it ends with the line in which it gets that long.
CHUNK_CHARS = 8_192
#: The chunks of longer files are spread over the tasks; those of others stay in the task that read the file.
SPREAD_CHARS = 1 << 20

EXTENSIONS = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "java": "java", "go": "go", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
}

_CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7}) \S|^={7}[ \t]*$", re.M)
# Faults from the one that is named first on, if a file has several.
FAULTS = ("merge conflict", "unterminated string or comment", "brackets don't match", "bracket too many", "brackets left open", "no package clause", "misplaced signs", "misplaced keyword", "bad number", "misplaced words", "type syntax", "operands side by side", "statement without end", "no declaration", "indentation", "broken statement", "no value")
_RANK = {f: i for i, f in enumerate(FAULTS)}
#: Stands between statements that are judged together, so that no pattern reaches from one to the next.
END = "\x02"

# --- local grammars -----------------------------------------------------------------------------------------------------------------

_PAIR = re.compile(rf"([\w$]+|[{S})\]])[ \t]+([\w$]+|{S})")
_WORD = re.compile(r"[\w$]+")
_BAD_NUMBER = re.compile(r"(?<![\w$.])\d+(?![xXbBoOeE_]\w|[lLnfFdDi]\b)[A-Za-z_$]\w*")

# Words after which an operand may stand, and words that may stand after an operand.
_PREFIX = {
    "javascript": "return const let var new typeof delete void throw case in of instanceof async await yield function class extends import export default from as static get set else do while if for break continue",
    "typescript": "return const let var new typeof delete void throw case in of instanceof async await yield function class extends implements import export default from as static get set else do while if for break continue"
    " type interface enum namespace module declare abstract public private protected readonly override keyof infer is asserts unique satisfies",
}
_INFIX = {
    "javascript": "in of instanceof from as extends",
    "typescript": "in of instanceof from as extends implements is keyof satisfies",
    "java": "instanceof extends implements throws permits when",
}
_PREFIX = {k: set(v.split()) for k, v in _PREFIX.items()}
_INFIX = {k: set(v.split()) for k, v in _INFIX.items()}

# Runs of signs, read without blanks; the few distinct runs of a corpus are judged once in each worker.
_RUN = re.compile(r"[^\w\s\x01\x02\"'`$]{2,}")
_BAD_RUN = re.compile(r"[=+*/%&|^<,~];|[*/%&|^=,]\)|(?<!\+)\+\)|[(,],|\([;*/%|=?](?![;).])|[*/%&|^=][\]}]|(?<!\+)\+[\]}]|(?<!-)-[\]}]|:=|@\)|\\|#[!\[]|\?\]|\.[;)\]}](?<!\.\.\.[;)\]}])")
# Keywords with what follows them: after one of these signs a keyword is a name or stands right.
_KEYWORD = re.compile(r"(?<![.\w$])(if|while|switch|for|try|catch|else|class|function|const|let|var|import|def|elif|except|func|package|fn)\b\s*([\w$]+|\S)?")
_NAMED = set(":=,.;)")  # as in an object's key or a method's name


def _bad_keyword(word: str, after: str, language: str) -> bool:
    if word in ("if", "while", "switch"):
        return after != "(" and after not in _NAMED
    if word == "for":
        return after not in ("(", "await") and after not in _NAMED
    if word == "try":
        return after not in ("{", "(") and after not in _NAMED
    if word == "catch":
        return after not in ("{", "(") and after not in _NAMED
    if word == "else":
        return after in ("else", ";", ")", "]", "")
    if word == "class":
        return after in (":", ";", "(", ")", "[", "=") and language != "java" or language == "java" and after in (":", "(", "[", "=")
    if language == "java":
        return False
    if word == "function":
        return after in (":", ";", ")", "]", "=", "{")
    if word in ("const", "let", "var"):
        return after in (";", "=", ")", "]", ":", "(", ".", ",", S) or after[:1].isdigit()
    if word == "import":
        return after in (";", ")")
    return after[:1].isalpha() or after[:1] in "_$"  # a declaration of another language


@lru_cache(maxsize=50_000)
def _bad_run(run: str) -> bool:
    return _BAD_RUN.search(run) is not None


_SCRIPT_START = re.compile(r"\s*<[!a-zA-Z]|\s*\{\s*\x01\s*:")
_SCRIPT_LINE = re.compile(r"[;}\n\x02]\s*\{\s*\x01\s*:|[\n\x02]\s*@\w+\s*\n")
_JS_TYPES = re.compile(
    r"\b(?:var|let|const)\s+[\w$]+\s*:|\)\s*:\s*[A-Za-z_$\[{]|(?<![.\w$])(?:interface|enum|namespace|declare|abstract|implements)\s+[\w$]+|(?:^|[\n\x02])\s*(?:public|private|protected|readonly)\s+[\w$]|\bas\s+(?:any|const|unknown|string|number|boolean|[A-Z]\w*\s*[<)\];,])|(?:^|[\n\x02])\s*type\s+[\w$]+\s*="
)
_GO_FAULTS = re.compile(
    r"\belse\s+else\b|\belse\s*[;)\]]|\b(?:if|for|switch|range)\s*[;)\]]|\bif\s*\{|[=+*/%&|^<,!]\s*;|[+*/%&|^=]\s*[)\]}](?<!\+\+\})(?<!--\})|[(,]\s*,|\(\s*[;/%|=]|\bfunc\s*[:;{=]|\b(?:class|def|try|while|throw|new|function|elif|except|public|private|export|async)\s+[\w$(]"
    r"|\btry\s*\{|\?|\\|@|#|\$|\.\s*[;)\]}]|\.\s*\n\s*[)\]}]|=>|===|!==|:\s*=\s*=|;[ \t]*\n"
)
_JAVA_TOP = re.compile(r"(?:package|import|class|interface|enum|record|public|private|protected|abstract|final|static|sealed|non-sealed|strictfp|module|open)\b|@|;|$")
_JAVA_FAULTS = re.compile(r"=>|===|!==|`|\bfunction\b|\b(?:const|let|def|elif|except|func|export|async)\s+[\w$]|(?<![.\w])var\s*[;=]|\$\{")
_JAVA_COLON = re.compile(r"^[ \t]*(?!(?:case|default)\b|\w+[ \t]*:)[^\n?]*:[ \t]*$", re.M)
_JAVA_LINE = re.compile(rf"([\w$\]{S})])[ \t]*\n\s*([\w${S}]+)")
_ANNOTATION = re.compile(r"@(?!interface\b)[A-Za-z_][\w.]*(?:\s*\([^()\x02]*\))?")
_HEAD = re.compile(r"(?:^|[;{}\n\x02])\s*(?:\}\s*)?(?:else\s+)?(?:if|for|while|switch|catch|synchronized|else|do|case|default)\b")


def _pairs(masked: str, language: str) -> bool:
    """Whether two operands stand side by side in a line."""
    prefix, infix = _PREFIX[language], _INFIX[language]
    at = 0
    search = _PAIR.search
    while m := search(masked, at):
        left, right = m.groups()
        at = m.start(2)
        if right in infix or left in prefix:
            continue
        if left == ")":
            # After the head of a statement (if, for, while) any statement may follow.
            continue
        if right in ("async", "get", "set", "static") or left == "]" and right in ("of",):
            continue
        return True
    return False


def _curly(text: str, language: str) -> str | None:
    """The fault of statements of JavaScript, TypeScript or Java."""
    for run in set(_RUN.findall("".join(text.split()))):
        if _bad_run(run) and not _apart(text, run):
            return "misplaced signs"
    for word, after in set(_KEYWORD.findall(text)):
        if _bad_keyword(word, after, language):
            return "misplaced keyword"
    if _BAD_NUMBER.search(text):
        return "bad number"
    if language == "java":
        return _java(text)
    if _SCRIPT_LINE.search(text):
        return "misplaced words"
    if language == "javascript" and _js_types(text):
        return "type syntax"
    if _pairs(text, language):
        return "operands side by side"
    return None


def _apart(masked: str, run: str) -> bool:
    """Whether the run came about only by leaving out line ends, as a decorator's sign or a generic's bracket at the end of a line."""
    bad = _BAD_RUN.search(run).group()
    return re.search(r"[ \t]*".join(re.escape(c) for c in bad), masked) is None and re.search(r"\s*".join(re.escape(c) for c in bad[:1] + bad[-1:]), masked) is not None and bad[-1] not in ";)]},"


_TYPED_GROUP = re.compile(r"\([^(){}?;]*:")


def _js_types(masked: str) -> str | None:
    for m in _JS_TYPES.finditer(masked):
        if m.group().startswith(")") and _ternary(masked, m.start()):
            continue
        return m.group().strip()
    # A name with a colon directly within round brackets is a typed parameter unless a question mark goes before.
    if not _TYPED_GROUP.search(masked):
        return None
    depth: list[list] = []
    for t in re.findall(r"[()\[\]{}?:\x02]", masked):
        if t == END:
            depth = []
        elif t in "([{":
            depth.append([t, 0])
        elif t in ")]}":
            if depth:
                depth.pop()
        elif depth and depth[-1][0] == "(":
            if t == "?":
                depth[-1][1] += 1
            elif depth[-1][1] == 0:
                return "("
            else:
                depth[-1][1] -= 1
    return None


def _ternary(masked: str, at: int) -> bool:
    line = masked.rfind("\n", 0, at) + 1
    start = max(masked.rfind(c, 0, at) for c in ";{}\x02")
    return "?" in masked[max(0, min(line, start + 1)) : at] or re.search(r"\bcase\b", masked[line:at]) is not None


def _java(masked: str) -> str | None:
    if _JAVA_FAULTS.search(masked) or _JAVA_COLON.search(masked):
        return "misplaced words"
    for m in _JAVA_LINE.finditer(masked):
        left, right = m.groups()
        if right in _INFIX["java"] or right == "else":
            continue
        line = masked[masked.rfind("\n", 0, m.start(1)) + 1 : m.end(1)]
        if _HEAD.match("\n" + line) or line.lstrip().startswith(("@", "else")) or left not in (")", "]", S) and _WORD.fullmatch(line.strip().split()[-1]) and line.strip().split()[-1] in ("else", "do", "return", "throws", "extends", "implements", "final", "static", "public", "private", "protected", "abstract", "try", "finally"):
            continue
        return "statement without end"
    # Three operands in a row: a type and a name are two.
    for m in re.finditer(rf"(?<![\w$.])([\w$]+)[ \t]+([\w$]+)[ \t]+([\w$]+|{S})", masked):
        words = set(m.groups())
        if not words & _JAVA_WORDS:
            return "operands side by side"
    if m := re.search(rf"{S}[ \t]+[\w$]|(?<![\w$])\d+[ \t]+[A-Za-z_$]|\breturn[ \t]+[\w$]+[ \t]+(?!instanceof\b)[\w${S}]", masked):
        return "operands side by side"
    return None


# Fixed value: reserved words of Java.
_JAVA_WORDS = set(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import"
    " instanceof int interface long native new package private protected public record return sealed short static strictfp super switch synchronized this throw throws"
    " transient try var void volatile while yield permits".split()
)


def _go(masked: str) -> str | None:
    """The fault of statements of Go."""
    if _GO_FAULTS.search(masked):
        return "misplaced words"
    for line in masked.split("\n"):
        if _PAIR.search(line):
            words = _WORD.findall(line)
            if not _GO_WORDS.intersection(words):
                # A field or parameter is a name and a type; three words in a row, or a string after a word that isn't a field, is no Go.
                if re.search(rf"(?<![\w.])[A-Za-z_]\w*[ \t]+[A-Za-z_]\w*[ \t]+[A-Za-z_]|{S}[ \t]+[\w{S}]|(?<!\w)\d+[ \t]+\w|[=+\-*/(][ \t]*[A-Za-z_][\w.]*[ \t]+[A-Za-z_{S}\d]", line):
                    return "operands side by side"
            elif re.search(rf"\b(?:return|range|go|defer)[ \t]+[\w.]+[ \t]+(?!{S}*\{{)[\w{S}]|:=[ \t]*(?!range\b|func\b|chan\b|map\b|struct\b|interface\b)[\w.]+[ \t]+[\w{S}]", line):
                return "operands side by side"
    return None


# Fixed value: reserved words of Go.
_GO_WORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
# Where a statement ends, in masked text.
_ENDS = {
    "javascript": re.compile(r"(?<!\()[;{}][ \t]*\n"), "typescript": re.compile(r"(?<!\()[;{}][ \t]*\n"), "java": re.compile(r"(?<!\()[;{}][ \t]*\n"),
    "go": re.compile(rf"(?:[\w)\]}}{{;:{S}]|\+\+|--)[ \t]*\n"),
}
_TOPS = {"java": _JAVA_TOP, "go": re.compile(r"(?:package|import|func|type|var|const)\b|$")}
_PACKAGE = re.compile(r"\s*package[ \t]+[A-Za-z_]\w*[ \t]*(?:;|$)", re.M)
_UNFINISHED = re.compile(r"(?:[=+*/%&|^,.?:(\[{]|[-<]|\b(?:function|class|const|let|var|new|import|export|default|typeof|throw|else|extends|async\s+function\s+\w+|function\s+[\w$]+|class\s+[\w$]+|import\s+[\w${}*, ]+|from))\s*$")
_STEP = re.compile(r"[()\[\]{}]")
_STEPS = {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}


def _judged(text: str, language: str) -> str | None:
    """The fault of whole statements, each closed by END."""
    if language == "go":
        return _go(text)
    return _curly(_ANNOTATION.sub("", text) if language == "java" else text, language)


class Loose(NamedTuple):
    """How deep a stretch of masked text goes, and where in it a statement begins that is no declaration: only at levels as low as any
    before, since those alone may be outside all brackets."""

    depth: int
    low: int
    levels: frozenset[int]


def _loose(statements: list[str], language: str) -> Loose:
    depth = low = 0
    levels = set()
    for text in statements:
        rest = (_ANNOTATION.sub("", text) if language == "java" else text).lstrip()
        at = depth
        closer = ""
        while rest[:1] in (")", "]", "}") and rest:
            at, closer, rest = at - 1, rest[0], rest[1:].lstrip()
        if at <= min(low, depth) and rest.strip() and closer in ("", "}") and not (language == "go" and closer) and not _TOPS[language].match(rest):
            levels.add(at)
        for b in _STEP.findall(text):
            depth += 1 if b in "([{" else -1
            low = min(low, depth)
    return Loose(depth, low, frozenset(levels))


# --- chunks -------------------------------------------------------------------------------------------------------------------------


class Piece(NamedTuple):
    """A chunk read in one state."""

    exit: int
    faults: frozenset[str]
    brackets: tuple[str, str] | None
    head: str  # masked text up to the first statement end, or all of it
    ends: bool  # whether there is a statement end; the rest is empty if not
    inner: object = None  # of the statements between the first and the last end: Loose, or indentations
    tail: str = ""
    whole: str = ""  # all of the masked text, where it depends on the brackets before whether there is a statement end


def chunks(text: str, size: int) -> Iterator[str]:
    """The text cut at line ends."""
    text = text.replace("\r\n", "\n")
    at = 0
    while at < len(text):
        end = text.find("\n", min(len(text), at + size - 1)) + 1 or len(text)
        yield text[at:end]
        at = end


def chunk_map(text: str, language: str, first: bool) -> dict[int, Piece] | str | None:
    """What a chunk is for every state it may begin in. A file's first chunk begins in code."""
    if language == "yaml":
        return text
    if language == "json":
        signs = json_signs(text)
        return None if signs is None else json_shrunk(signs)
    return {s: _piece(text, language, s) for s in ((CODE,) if first else STATES[language])}


def _piece(text: str, language: str, state: int) -> Piece:
    m, leaves, broken = masked(text, language, state)
    faults = set()
    if "\n" in text and _CONFLICT.search(m):
        faults.add("merge conflict")
    if broken:
        faults.add("unterminated string or comment")
    brackets = summary(m)
    if faults or brackets is None:
        return Piece(leaves, frozenset(faults), brackets, "", False)
    if language in ("python", "toml"):
        return _by_lines(python_shapes(m) if language == "python" else m, language, leaves, brackets)
    ends = [x.end() for x in _ENDS[language].finditer(m)]
    if not ends:
        return Piece(leaves, frozenset(), brackets, m, False)
    between = [m[a:b] for a, b in zip(ends, ends[1:])]
    if between and (fault := _judged(END + END.join(between) + END, language)):
        faults.add(fault)
    return Piece(leaves, frozenset(faults), brackets, m[: ends[0]], True, _loose(between, language) if language in _TOPS else None, m[ends[-1] :])


def _indent(line: str) -> str:
    return line[: len(line) - len(line.lstrip(" \t\f"))]


def _logical(text: str, depth: int) -> tuple[list[str], str]:
    """Logical lines of text that begins at a depth of brackets, and what follows the last line end outside brackets."""
    out, start, at = [], 0, 0
    for line in text.splitlines(keepends=True) if "\x0b" not in text and "\x0c" not in text else re.findall(r"[^\n]*\n|[^\n]+", text):
        at += len(line)
        if found := _STEP.findall(line):
            depth += sum(map(_STEPS.__getitem__, found))
        if depth == 0 and line.endswith("\n"):
            out.append(text[start:at])
            start = at
    return out, text[start:]


def _by_lines(text: str, language: str, leaves: int, brackets: tuple[str, str]) -> Piece:
    """Python and TOML, where a statement ends with a line outside all brackets. The text is taken to begin as deep as it closes brackets; if
    it begins deeper, all of it lies within brackets and has no statement end."""
    lines, tail = _logical(text, len(brackets[0]))
    if not lines:
        return Piece(leaves, frozenset(), brackets, text, False)
    faults, inner = _read_lines(lines[1:], language)
    return Piece(leaves, frozenset(faults), brackets, lines[0], True, inner, tail, text)


def _read_lines(lines: list[str], language: str) -> tuple[set[str], list]:
    faults, marks = set(), []
    for line in lines:
        if not line.strip():
            continue
        if language == "toml":
            if toml_statement(line):
                faults.add("broken statement")
            continue
        fault, word, opens = python_statement(" ".join(line.split()))
        if fault:
            faults.add("broken statement")
        marks.append((len(_indent(line).expandtabs(8)), word, opens))
    return faults, marks


class Reader:
    """Joins the maps of a file's chunks in order."""

    def __init__(self, language: str):
        self.language, self.state, self.faults = language, CODE, set()
        self.brackets: tuple[str, str] | None = ("", "")
        self.carry, self.start, self.fresh = "", 0, True  # text since the last statement end, the depth it begins at, whether nothing was read
        self.indentation = Indentation()
        self.text: list[str] = []  # of JSON and YAML

    def add(self, m: dict[int, Piece] | str | None) -> None:
        if not isinstance(m, dict):
            if m is None:
                self.faults.add("no value")
            else:
                self.text.append(m)
                if self.language == "json" and len(self.text) > 64:
                    self._shrink()
            return
        p = m[self.state]
        self.state = p.exit
        self.faults |= p.faults
        depth = len(self.brackets[1]) if self.brackets else 0
        if self.brackets is not None:
            self.brackets = join_summaries(self.brackets, p.brackets)
            if self.brackets is None:
                self.faults.add("brackets don't match")
            elif self.brackets[0]:
                self.faults.add("bracket too many")
                self.brackets = None
        if self.faults:
            return  # the file is invalid; what else its chunks say by themselves is still taken down
        if p.ends and self.language in ("python", "toml") and depth > len(p.brackets[0]):
            # It begins deeper than it closes: all of it belongs to one statement.
            self.carry += p.whole
            return
        self.carry += p.head
        if not p.ends:
            return
        self._statement()
        if isinstance(p.inner, Loose):
            at = depth + sum(1 if b in "([{" else -1 for b in _STEP.findall(p.head))
            if -at in p.inner.levels and at >= 0 and p.inner.low >= -at:
                self.faults.add("no declaration")
            self.start = at + p.inner.depth
        elif p.inner:
            self._indented(p.inner)
        self.carry = p.tail

    def _indented(self, marks: list) -> None:
        for x in marks:
            if self.indentation.line(*x):
                self.faults.add("indentation")
                return

    def _statement(self) -> None:
        """Judges the text since the last statement end."""
        text, self.carry = self.carry, ""
        if self.language in ("python", "toml"):
            faults, marks = _read_lines([text], self.language)
            self.faults |= faults
            self._indented(marks)
            return
        if self.fresh and text.strip():
            if self.language == "go" and not _PACKAGE.match(text):
                self.faults.add("no package clause")
            if self.language in ("javascript", "typescript") and _SCRIPT_START.match(text) or self.language == "java" and text.lstrip().startswith("<"):
                self.faults.add("misplaced words")
            self.fresh = False
        if fault := _judged(END + text + END, self.language):
            self.faults.add(fault)
        if self.language in _TOPS and self.start == 0 and _loose([text], self.language).levels & {0}:
            self.faults.add("no declaration")

    def _shrink(self) -> None:
        less = json_shrunk("".join(self.text))
        if less is None:
            self.faults.add("no value")
        self.text = [less or ""]

    def fault(self) -> str | None:
        """After the last chunk."""
        if self.language == "yaml":
            return yaml_fault(self.text)
        if self.language == "json":
            self._shrink()
            return "no value" if self.faults or self.text[0] not in ("S", "V") else None
        if self.state != CODE:
            self.faults.add("unterminated string or comment")
        if self.brackets and self.brackets[1]:
            self.faults.add("brackets left open")
        if not self.faults:
            last = self.carry
            self._statement()
            if self.language in ("javascript", "typescript") and _UNFINISHED.search(last):
                self.faults.add("statement without end")
            if self.language == "python" and self.indentation.end():
                self.faults.add("indentation")
        return min(self.faults, key=_RANK.__getitem__, default=None)


def fault_of(text: str, language: str, chunk_chars: int = CHUNK_CHARS) -> str | None:
    """Why a whole file is invalid; None if it is valid."""
    reader = Reader(language)
    if language != "json":
        text = text.removeprefix("\ufeff")
    for i, chunk in enumerate(chunks(text, chunk_chars)):
        reader.add(chunk_map(chunk, language, i == 0))
    return reader.fault()


# --- Spark --------------------------------------------------------------------------------------------------------------------------


def with_language(files: DataFrame, path_col: str = "relative_path") -> DataFrame:
    """Adds syntax_language by extension; null where none of the grammars applies."""
    ext = F.lower(F.regexp_extract(path_col, r"\.([A-Za-z]+)$", 1))
    names = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return files.withColumn("syntax_language", F.try_element_at(names, ext))


def judged_files(files: DataFrame, id_col: str = "file_id", repo_col: str | None = None, path_col: str = "relative_path", content_col: str = "content", chunk_chars: int = CHUNK_CHARS, spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """id, repo, language and fault (null if valid) of each row that can be judged, in one scan. Rows of more than spread_chars characters are
    cut, their chunks read by all tasks, and their maps joined by row."""
    kinds = files.schema[id_col].dataType.simpleString(), files.schema[repo_col].dataType.simpleString() if repo_col else "string"
    repo = F.col(repo_col) if repo_col else F.lit(None).cast("string")
    rows = with_language(files.where(F.col(content_col).isNotNull() & (F.length(content_col) > 0)).select(F.col(id_col).alias("id"), repo.alias("repo"), F.col(path_col).alias("path"), F.col(content_col).alias("content")), "path").where("syntax_language is not null")
    out = f"id {kinds[0]}, repo {kinds[1]}, language string, fault string"

    def whole() -> Callable:
        return lambda key, at, language, content: [(key, at, language, fault_of(content, language, chunk_chars))]

    def cutter() -> Callable:
        def row(key, at, language, content, n) -> Iterable[tuple]:
            text = content if language == "json" else content.removeprefix("\ufeff")
            return ((key, at, language, n, i, chunk) for i, chunk in enumerate(chunks(text, chunk_chars)))

        return row

    def mapper() -> Callable:
        return lambda key, at, language, n, i, chunk: [(key, at, language, n, i, pickle.dumps(chunk_map(chunk, language, i == 0)))]

    def joiner() -> Callable:
        def row(key, at, language, maps) -> Iterable[tuple]:
            reader = Reader(language)
            for m in maps:
                reader.add(pickle.loads(m["m"]))
            return [(key, at, language, reader.fault())]

        return row

    near = flat_map(rows.where(F.length("content") <= spread_chars), ["id", "repo", "syntax_language", "content"], whole, out)
    far = rows.where(F.length("content") > spread_chars).withColumn("n", F.monotonically_increasing_id())
    cut_ = flat_map(far, ["id", "repo", "syntax_language", "content", "n"], cutter, f"id {kinds[0]}, repo {kinds[1]}, language string, n bigint, i int, chunk string")
    mapped = flat_map(cut_.repartition("n", "i"), ["id", "repo", "language", "n", "i", "chunk"], mapper, f"id {kinds[0]}, repo {kinds[1]}, language string, n bigint, i int, m binary")
    joined = mapped.groupBy("n").agg(F.any_value("id").alias("id"), F.any_value("repo").alias("repo"), F.any_value("language").alias("language"), F.array_sort(F.collect_list(F.struct("i", "m"))).alias("maps"))
    return near.unionByName(flat_map(joined, ["id", "repo", "language", "maps"], joiner, out))


def invalid_files(files: DataFrame, id_col: str = "file_id", **columns) -> DataFrame:
    """id, language and fault of each file that isn't valid; files scanned again give one row."""
    bad = judged_files(files, id_col, **columns).where("fault is not null")
    return bad.select(F.col("id").alias(id_col), "language", "fault").dropDuplicates([id_col])


def invalid_rates(files: DataFrame, repo_col: str = "repo_id", id_col: str = "file_id", **columns) -> DataFrame:
    """Files judged, files invalid and their share for each repository and language."""
    each = judged_files(files, id_col, repo_col, **columns).groupBy("id").agg(F.max(F.struct("repo", "language", F.col("fault").isNotNull().cast("int").alias("bad"))).alias("x"))
    return (
        each.groupBy(F.col("x.repo").alias(repo_col), F.col("x.language").alias("language"))
        .agg(F.count("*").alias("files"), F.sum("x.bad").alias("invalid"), F.round(F.sum("x.bad") / F.count("*"), 6).alias("share"))
    )
