"""Credentials in source code and configuration: where they stand, and the content with each of them redacted.

Token formats, key armor and connection strings are one deterministic automaton: their grammars are joined and made deterministic as the text
needs it, and it is entered where a trie of their first characters (Aho-Corasick) says that one may begin. The same trie knows the names that
credentials go by; the lines with such a name are read by grammars of assignments, calls, headers, options and comments, and there a value
must look like a secret: placeholders, references to an environment or vault, patterns, public keys, checksums, ids and names of secrets
don't count. Long texts are scanned in overlapping windows; absolute spans found twice count once.

Null and empty contents hold nothing. Rows that repeat a key with the same content give the same lines once. Redaction replaces only the
characters of the secret, so quotes, lines and columns before it stay as they were; texts without a finding aren't changed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import flat_map

#: Windows a long text is read in, and their overlap, which exceeds any single line grammar's reach.
WINDOW_CHARS, OVERLAP_CHARS = 1 << 18, 1 << 13
PLACEHOLDER = "<redacted>"

# --- the automaton ------------------------------------------------------------------------------------------------------------------

_DIGITS, _UPPER = frozenset("0123456789"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_ALNUM = _DIGITS | _UPPER | frozenset("abcdefghijklmnopqrstuvwxyz")
_WORD, _DASHED, _BASE64 = _ALNUM | {"_"}, _ALNUM | {"_", "-"}, _ALNUM | frozenset("+/=")


class _Not(frozenset):
    """All characters but these and blanks."""

    def __contains__(self, c: object) -> bool:
        return not (frozenset.__contains__(self, c) or str(c).isspace())


# Public token formats, as literals and runs (characters, least length, whether it may be longer).
_MORE = True
FORMATS: list[tuple[str, list]] = [
    *(("token", [p, (_DIGITS | _UPPER, 16, False)]) for p in ("AKIA", "ASIA")),
    *(("token", [f"gh{c}_", (_ALNUM, 30, _MORE)]) for c in "pousr"),
    ("token", ["github_pat_", (_WORD, 40, _MORE)]),
    ("token", ["glpat-", (_DASHED, 20, _MORE)]),
    *(("token", [f"xox{c}-", (_DIGITS, 6, _MORE), "-", (_ALNUM | {"-"}, 12, _MORE)]) for c in "abprs"),
    *(("token", [p, (_ALNUM, 16, _MORE)]) for p in ("sk_live_", "rk_live_", "lk-prod-", "key_live_", "key_prod_")),
    ("token", ["whsec_", (_BASE64, 20, _MORE)]),
    ("token", ["eyJ", (_DASHED, 8, _MORE), ".", (_DASHED, 8, _MORE), ".", (_DASHED, 8, _MORE)]),
    ("token", ["AIza", (_DASHED, 30, _MORE)]),
    *(("token", [p, (_ALNUM, 30, _MORE)]) for p in ("npm_", "hf_")),
    ("token", ["pypi-", (_DASHED, 40, _MORE)]),
    ("token", ["SG.", (_DASHED, 16, _MORE), ".", (_DASHED, 16, _MORE)]),
    ("token", ["ya29.", (_DASHED, 20, _MORE)]),
    ("token", ["dop_v1_", (_DIGITS | frozenset("abcdef"), 60, _MORE)]),
    ("token", ["tok_", (_ALNUM, 20, _MORE)]),
    # Up to three words may stand before the kind of the key.
    *(("armor", ["-----BEGIN ", *[(_DIGITS | _UPPER, 1, _MORE), " "] * n, "PRIVATE KEY", block, "-----"]) for n in range(4) for block in ("", " BLOCK")),
    ("connection", ["://", (_Not("/:@\"'`<>"), 0, _MORE), ":", (_Not("@/\"'`"), 1, _MORE), "@", (_ALNUM | {"["}, 1, False)]),
]


class Automaton:
    """The formats as one deterministic automaton: a state is the set of places in the formats that the characters so far may have led to.
    States and transitions are made when a text first needs them and kept."""

    def __init__(self, formats: list[tuple[str, list]] = FORMATS):
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.jumps: dict[int, int] = {}  # places that may be left without a character
        self.ends: dict[int, str] = {}
        starts = []
        for kind, parts in formats:
            at = self._place()
            starts.append(at)
            for part in parts:
                for c in part if isinstance(part, str) else ():
                    at = self._step(at, frozenset(c))
                if not isinstance(part, str):
                    chars, least, more = part
                    for _ in range(least):
                        at = self._step(at, chars)
                    if more:
                        self.edges[at].append((chars, at))
            self.ends[at] = kind
        self.sets: dict[frozenset[int], int] = {}
        self.members: list[frozenset[int]] = []
        self.next: list[dict[str, int]] = []
        self.kind: list[str | None] = []
        self.dead = self._state(frozenset())
        self.start = self._state(frozenset(starts))

    def _place(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def _step(self, at: int, chars: frozenset) -> int:
        new = self._place()
        self.edges[at].append((chars, new))
        return new

    def _state(self, places: frozenset[int]) -> int:
        if places not in self.sets:
            self.sets[places] = len(self.members)
            self.members.append(places)
            self.next.append({})
            self.kind.append(next((self.ends[p] for p in sorted(places) if p in self.ends), None))
        return self.sets[places]

    def match(self, text: str, at: int) -> tuple[int, str] | None:
        """End and kind of the longest format that begins at a place of the text."""
        state, found = self.start, None
        for i in range(at, len(text)):
            c = text[i]
            to = self.next[state].get(c)
            if to is None:
                to = self._state(frozenset(t for p in self.members[state] for chars, t in self.edges[p] if c in chars))
                if c < "\x80":
                    self.next[state][c] = to
            if to == self.dead:
                break
            state = to
            if self.kind[state]:
                found = i + 1, self.kind[state]
        return found


# The names that credentials go by; a sign may stand between their words.
NAMES = ("pass", "pwd", "secret", "token", "api key", "access key", "signing key", "private key", "encryption key", "account key", "shared key", "client key", "credential", "auth", "bearer", "webhook", "sentry", "jdbc", "dsn")
# What else a line of the other grammars holds: calls, options, headers, comments, joined literals.
_MARKS = ("login", "connect(", "configure(", "open(", "signin(", "sign_in(", "setdefault(", " -p ", " -p=", "-key", "basic ", "digest ", "pw ", "pw:", "pw=", "key is", "key:", "key ", "key=", "key\"", "key'", '" + "', "' + '", '" .')


@lru_cache(maxsize=1)
def trie() -> ahocorasick.Automaton:
    """Where a format may begin (its length) and where a line is to be read (0), in lower case."""
    a = ahocorasick.Automaton()
    for word in (*(n.replace(" ", sign) for n in NAMES for sign in (("", "_", "-", " ") if " " in n else ("",))), *_MARKS):
        a.add_word(word, 0)
    for _, parts in FORMATS:
        a.add_word(parts[0].lower(), len(parts[0]))
    a.make_automaton()
    return a


# --- grammars -----------------------------------------------------------------------------------------------------------------------

_ARMOR = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_ARMOR_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")

_STRING = r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`"
_QUOTED = re.compile(_STRING)
_NAME = r"(?:[\w.-]*?)(?:" + "|".join(n.replace(" ", "[_-]?") for n in NAMES) + r")(?:[\w.-]*)"
_ASSIGN = re.compile(rf"(?i)(?<![\w$])([\"']?)({_NAME})\1\s*(?::=|=>|=(?!=)|:(?!:))\s*|(?i:\.set|setdefault|putenv|setenv|setProperty|put)\(\s*[\"']({_NAME})[\"']\s*,\s*")
_TYPED = re.compile(rf"(?i)(?<![\w$])({_NAME})\s*:\s*[\w\[\]|<> ]+?=\s*")
_BARE = re.compile(r"[^\s\"'`,;#(){}\[\]][^\s\"'`,;(){}]*")
_CALL = re.compile(r"\.(?:login|connect|configure|open|authenticate|signin|sign_in|auth)\(\s*(?:" + _STRING + r")\s*,\s*(?:" + _STRING + r")", re.I)
_HEADER = re.compile(r"(?i)(?:\b(?:proxy-)?authorization\b|\bx-[\w-]*(?:auth|token|key)[\w-]*|\bapi-?key\b)[\"']?\s*[:=,]\s*[\"']?\s*(?:(?:bearer|basic|token|digest)\s+)?([^\s\"'`<>,;]{6,})")
_SCHEME = re.compile(r"(?i)[\"' ](?:bearer|basic|token)\s+([A-Za-z0-9+/=_.~-]{16,})(?=[\"'\s]|$)")
_OPTION = re.compile(r"(?i)(?<![\w-])(?:-p|--?(?:password|passwd|pass|pwd|token|auth|api-?key|secret|access-?key|client-?secret|credential))[ =]+([^\s\"'`<>;,)]{5,})")
_COMMENT = re.compile(r"(?i)(?://|#|\*|--|<!--|/\*)[^\n]*?\b(?:password|passwd|pwd|pw|token|secret|api[ _-]?key|key|credentials?|login|passphrase)\b((?:[ \t]+[\w-]+){0,4}?)[ \t:=]+([^\s\"'`<>,;]{6,})")

# Words of placeholders and references begin where no letter or digit stands before: random characters may spell them.
_NO_SECRET = re.compile(
    r"(?i)\*{3}|x{5,}|\.{3}|…|<|>|\$\{|\{\{|\}\}|%\(|\$\(|^\$|^%|example(?:key)?$|^(?:none|null|nil|true|false|undefined|yes|no)$|process\.env|os\.environ|getenv|secretsmanager"
    r"|(?<![A-Za-z0-9])(?:your[-_ ]|change[-_ ]?me|set[-_ ]?me|replace|placeholder|example|dummy|fake(?![A-Za-z0-9])|sample[-_]?(?:key|token)|paste|redacted|not[-_ ]?a[-_ ]?real|todo(?![A-Za-z0-9])|fixme|vault(?![A-Z0-9])|keyring)"
)
_NO_KEY = re.compile(r"\*{3}|x{5,}|X{5,}|\.{3}|…|<|>|\$\{|\{\{|(?i:(?<!\w)(?:your|paste|placeholder|example|redacted|replace)(?!\w))")
_PATTERN = re.compile(r"\[[^\]]*\][+*?{]|\\[dwsSWDb]|\(\?|\.\*|\.\+|\(\w+(?:\|\w+)+\)|\^|\[[^\]]+-[^\]]+\]")
# Names that say where or how a secret is kept, not what it is.
_ABOUT = re.compile(r"(?i)(?:[_-](?:name|path|file|url|uri|ref|id|field|pattern|regex|header|kind|type|mode|limit|env|ttl|length|size|count|hash|digest|policy|label|prefix|format|endpoint)|(?:Name|Path|File|Field|Pattern|Regex|Header|Kind|Type|Env|Ttl|Id))$|public[_-]?key|\bauthor")
_HEX = re.compile(r"[0-9a-fA-F]+")
_BASE64_VALUE = re.compile(r"(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])(?=\D*\d)[A-Za-z0-9+/]{30,}={1,2}")
_SIGNS = re.compile(r"[^A-Za-z0-9]")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def _entropy(v: str) -> float:
    return -sum(c / len(v) * math.log2(c / len(v)) for c in Counter(v).values())


def secret_like(value: str, loose: bool = False) -> bool:
    """Whether a literal under a credential's name gives access. loose: the place says little, so the value must say more."""
    if len(value) < 6 or " " in value or _NO_SECRET.search(value) or _PATTERN.search(value) or _UUID.fullmatch(value):
        return False
    if len(set(value)) < 4:
        return False
    digits, signs = any(map(str.isdigit, value)), bool(_SIGNS.search(value))
    lower, upper = any(map(str.islower, value)), any(map(str.isupper, value))
    if not digits:
        # Words, names of variables, paths and addresses; only a mixed line of much disorder is a secret.
        if "://" in value or re.fullmatch(r"[A-Za-z]+(?:[-_./:][A-Za-z]+)*", value) and not (len(value) >= 20 and lower and upper and "_" not in value and "/" not in value and _entropy(value) > 4):
            return False
        return signs and lower and upper and not loose and _entropy(value) > 3
    if re.fullmatch(r"[-+]?\d[\d_.,:eE+%-]*(?:ms|[smhdwkKMGT]i?[bB]?)?", value):
        return False
    if "://" in value or value.startswith(("./", "../", "/", "~/")) and value.count("/") > 1 and not value.endswith("="):
        return False
    if re.fullmatch(r"(?i)(?:sha\d*|md5|crc32)[-:].+", value):
        return False
    if re.fullmatch(r"[a-z]+(?:[_./-][a-z0-9]+)+", value) and not re.search(r"\d[a-z]+\d", value):
        return False  # a name, a path, a version
    if loose:
        return lower and (upper or signs) and (signs or len(value) >= 16) and _entropy(value) >= 2.8
    return _entropy(value) >= 2.3


class Scanner:
    def __init__(self):
        self.trie, self.automaton = trie(), Automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Absolute (start, end, kind) of each secret, in order and without overlaps."""
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found: set[tuple[int, int, str]] = set()
        for at in range(0, max(1, len(text)), WINDOW_CHARS - OVERLAP_CHARS):
            read = -1
            for end, length in self.trie.iter(low, at, min(len(text), at + WINDOW_CHARS)):
                if length:
                    self._format(text, end - length + 1, found)
                elif end >= read:  # or else its line has been read
                    start = text.rfind("\n", 0, end) + 1
                    read = text.find("\n", end)
                    read = len(text) if read < 0 else read
                    self._line(text, start, read, found)
            if at + WINDOW_CHARS >= len(text):
                break
        return _disjoint(found)

    def _format(self, text: str, at: int, found: set) -> None:
        """A token, key or connection string that begins here."""
        if not (m := self.automaton.match(text, at)):
            return
        end, kind = m
        if kind == "connection":
            s = text.index(":", at + 3) + 1
            v = text[s : text.index("@", s)]
            if text[at - 1 : at].isalnum() and not _NO_SECRET.search(v) and len(v) >= 4 and not v.startswith(("$", "%", "{")) and v.lower() not in ("password", "pass", "passwd", "pwd", "secret"):
                found.add((s, s + len(v), "connection string"))
        elif kind == "armor":
            stop = _ARMOR_END.search(text, end)
            last = stop.start() if stop else self._armor_stop(text, end)
            body = text[end:last]
            if re.search(r"[A-Za-z0-9+/=]{16,}", body) and not _NO_KEY.search(body):
                found.add((at, stop.end() if stop else last, "private key"))
        elif not (at and text[at - 1] in _DASHED) and self._token(text[at:end]):
            found.add((at, end, "token"))

    def _token(self, v: str) -> bool:
        return not _NO_SECRET.search(v) and not (v.startswith("tok_") and not any(map(str.isdigit, v)))

    def _is_token(self, v: str) -> bool:
        return (m := self.automaton.match(v, 0)) is not None and m == (len(v), "token") and self._token(v)

    def _line(self, text: str, start: int, end: int, found: set) -> None:
        line = text[start:end]
        add = lambda s, e, kind: found.add((start + s, start + e, kind))
        if '" + "' in line or "' + '" in line or '" .' in line:
            for m in _QUOTED.finditer(line):
                first = next((x for x in m.groups() if x is not None), "")
                self._joined(line, m.end(), first, "", add, m.end() - 1 - len(first), formats=True)
        for m in _ASSIGN.finditer(line):
            self._value(line, m.end(), m.group(2) or m.group(3), add)
        if ":" in line and "=" in line:
            for m in _TYPED.finditer(line):
                self._value(line, m.end(), m.group(1), add)
        if "(" in line:
            for m in _CALL.finditer(line):
                name = next((x for x in m.groups()[:3] if x is not None), "")
                k = next((i for i in (4, 5, 6) if m.group(i) is not None), 4)
                v = m.group(k)
                body = re.match(r"(?i)(?:bearer|basic|token)\s+", v)
                v = v[body.end() :] if body else v
                if secret_like(v, loose=not re.search(f"(?i){_NAME}", name)):
                    add(m.end(k) - len(v), m.end(k), "call")
                self._joined(line, m.end(), v, name, add)
        for pattern, kind, loose in ((_HEADER, "header", False), (_SCHEME, "header", False), (_OPTION, "option", False)):
            for m in pattern.finditer(line):
                if secret_like(m.group(1), loose):
                    add(m.start(1), m.end(1), kind)
        if m := _COMMENT.search(line):
            for w in re.finditer(r"[^\s\"'`<>,;]{6,}", line[m.start(1) :]):
                v = w.group().rstrip(".)")
                if _HEX.fullmatch(v) and len(v) >= 32 and secret_like(v) or secret_like(v, loose=True) and _SIGNS.search(v.strip("_-.")) and re.search(r"\d", v) and not re.search(r"[()\[\]{}=]", v.rstrip("=")) and not re.fullmatch(r"[\w./-]+:\d+|[\w.-]+/[\w./-]+|\w+_\w+", v) or _BASE64_VALUE.fullmatch(v) and secret_like(v, loose=True):
                    add(m.start(1) + w.start(), m.start(1) + w.start() + len(v), "comment")

    def _armor_stop(self, text: str, at: int) -> int:
        """The end of a key that is cut off: its base64 lines."""
        m = re.compile(r"(?:[\s\\n\"'+]*[A-Za-z0-9+/=]{16,})*").match(text, at)
        return m.end() if m else at

    def _value(self, line: str, at: int, name: str, add: Callable) -> None:
        """The literal assigned to a credential's name."""
        m = _QUOTED.match(line, at) or _QUOTED.match(line, at + 1) if line[at : at + 1] in "rRbBuUfF\"'`" else _QUOTED.match(line, at)
        if m:
            k = next(i for i in (1, 2, 3) if m.group(i) is not None)
            v = m.group(k)
            if self._joined(line, m.end(), v, name, add, m.start(k)):
                return
            head = re.match(r"(?i)(?:bearer|basic|token)\s+", v)
            s = m.start(k) + (head.end() if head else 0)
            v = v[head.end() :] if head else v
            about = _ABOUT.search(name)
            if secret_like(v, loose=bool(about)) and not (about and (_HEX.fullmatch(v) or "/" in v)):
                add(s, m.end(k), "assignment")
            return
        # Unquoted values: YAML, TOML, env files and properties.
        m = _BARE.match(line, at)
        if m and line[m.end() :].strip() in ("", ",") or m and line[m.end() :].lstrip().startswith("#"):
            v = m.group()
            if re.fullmatch(r"[A-Za-z_$][\w$]*(?:\.[\w$]+)+", v) and not self._is_token(v) or _ABOUT.search(name):
                return
            if re.fullmatch(r"\w+", v):
                # Perhaps the name of a variable: only hexadecimal or much disorder is a literal.
                good = secret_like(v) and (len(v) >= 20 and _HEX.fullmatch(v) or len(v) >= 16 and "_" not in v and _entropy(v) > 3.5 and re.search("[A-Z]", v) and re.search("[a-z]", v))
            else:
                good = secret_like(v, loose=True)
            if good:
                add(m.start(), m.end(), "assignment")

    def _joined(self, line: str, at: int, first: str, name: str, add: Callable, start: int | None = None, formats: bool = False) -> bool:
        """A literal put together from parts: each part is a span, the whole is judged."""
        parts, end, whole = [], at, first
        more = re.compile(r"\s*(?:\+|\.|~)?\s*(?:" + _STRING + ")")
        while m := more.match(line, end):
            if not m.group().lstrip().startswith(("+", ".")) and not m.group()[:1].isspace():
                break
            if m.group().lstrip()[:1] in "\"'`" and not line[:1]:
                break
            k = next(i for i in (1, 2, 3) if m.group(i) is not None)
            parts.append((m.start(k), m.end(k)))
            whole += m.group(k)
            end = m.end()
        if not parts or not (self._is_token(whole) or secret_like(whole, loose=formats) and (not formats or len(whole) >= 10 and "/" not in whole and _entropy(whole) >= 3.2)):
            return False
        if start is not None:
            add(start, start + len(first), "assignment")
            for s, e in parts:
                add(s, e, "assignment")
            return True
        return False


def _disjoint(found: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for s, e, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if out and s < out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e, out[-1][2])
            continue
        out.append((s, e, kind))
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each secret replaced; a private key keeps its armor and the number of its lines."""
    parts, at = [], 0
    for s, e, kind in spans:
        parts.append(text[at:s])
        old = text[s:e]
        if kind == "private key":
            head = _ARMOR.match(old)
            tail = _ARMOR_END.search(old)
            body = old[head.end() : tail.start() if tail else len(old)]
            parts += [head.group(), re.sub(r"[A-Za-z0-9+/=]{8,}", PLACEHOLDER, body), tail.group() if tail else ""]
        else:
            parts.append(PLACEHOLDER)
        at = e
    return "".join([*parts, text[at:]])


_SCANNERS: list[Scanner] = []


def _scanner() -> Scanner:
    if not _SCANNERS:
        _SCANNERS.append(Scanner())
    return _SCANNERS[0]


def credential_lines(df: DataFrame, id_col: str = "chunk_id", content_col: str = "content") -> DataFrame:
    """One row for each line of a content that holds a credential: id, line_no from 1, kind."""

    def make() -> Callable:
        spans = _scanner().spans

        def row(key, text) -> Iterable[tuple]:
            seen: dict[int, str] = {}
            for s, _, kind in spans(text):
                seen.setdefault(text.count("\n", 0, s) + 1, kind)
            return [(key, n, kind) for n, kind in seen.items()]

        return row

    kind = df.schema[id_col].dataType.simpleString()
    return flat_map(df.where(F.col(content_col).isNotNull() & (F.length(content_col) > 5)), [F.col(id_col).alias("id"), F.col(content_col).alias("content")], make, f"{id_col} {kind}, line_no int, kind string").dropDuplicates([id_col, "line_no"])


def redacted(df: DataFrame, id_col: str = "chunk_id", content_col: str = "content", time_col: str | None = "created_at", found_only: bool = False) -> DataFrame:
    """Each id with its content redacted, and the number of secrets; null contents stay null. A rewritten row counts by its latest version (of
    versions written at once, the largest). found_only leaves out ids without a secret, and only what is found is shuffled."""

    def make() -> Callable:
        spans = _scanner().spans

        def row(key, at, text) -> Iterable[tuple]:
            found = spans(text) if text else []
            return [(key, at or "", None if found_only and not found else redact(text, found) if found else text, len(found))]

        return row

    kind = df.schema[id_col].dataType.simpleString()
    at = F.col(time_col).cast("string") if time_col else F.lit("")
    each = flat_map(df, [F.col(id_col).alias("id"), at.alias("at"), F.col(content_col).alias("content")], make, f"id {kind}, at string, redacted string, secrets int")
    latest = each.groupBy("id").agg(F.max(F.struct("at", F.coalesce("redacted", F.lit("")).alias("order"), "redacted", "secrets")).alias("x"))
    out = latest.select(F.col("id").alias(id_col), "x.redacted", "x.secrets")
    return out.where("secrets > 0") if found_only else out
