"""Local grammars of Python, JSON and TOML, over masked text.

Quotes of the same kind nested in a formatted string aren't understood. Python: a logical line is written as its kinds of tokens, and an automaton that knows whether an operand or an operator comes next reads it,
with a stack of brackets; what a line opens or continues is told by its indentation and first word. JSON: balanced values shrink to one sign,
also within a stretch whose brackets are open on both sides. TOML: tables, keys and values line by line.
"""

from __future__ import annotations

import keyword
import re
from functools import lru_cache

from .lexer_maps import S

# --- Python -------------------------------------------------------------------------------------------------------------------------

_KEYWORDS = frozenset(keyword.kwlist)
_NAME = re.compile(rf"\b(?!(?:{'|'.join(keyword.kwlist)}|match|case|type|print)\b)[^\W\d]\w*")
_NUMBER = re.compile(r"(?<![\w.])(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*[jJ]?|[jJ])|(?:0(?:_?0)*|[1-9](?:_?\d)*))(?!\w)")
_TOKEN = re.compile(rf"[^\W\d]\w*|\d[\w.]*|{S}|\*\*=|//=|>>=|<<=|\.\.\.|\*\*|//|>>|<<|->|:=|[-+*/%&|^@]=|[=!<>]=|[-+*/%&|^~@=<>.,:;()\[\]{{}}]|\S")
_UNARY = frozenset("+ - ~ not await".split())
_BINARY = frozenset("+ - * / // % ** @ & | ^ << >> < > <= >= == != and or in is".split())
_AUGMENTED = frozenset("+= -= *= /= //= %= **= @= &= |= ^= <<= >>=".split())
_OPERAND_WORDS = frozenset("None True False match case type print".split())
_PAIR = {")": "(", "]": "[", "}": "{"}
NEED, HAVE, MAYBE = range(3)  # an operand must come, has come, may come


def python_shapes(masked: str) -> str:
    """Names and numbers as one sign each; keywords and blanks stay."""
    return _NUMBER.sub("0", _NAME.sub("n", masked))


def _expression(tokens: list[str], params: bool = False, target: bool = False) -> str | None:
    """Why the tokens are no expression list; None if they are. Brackets within match. params: the outermost brackets hold parameters."""
    state, stack = NEED, []  # of [bracket, holds parameters, open ternaries, is a comprehension, open lambdas]
    top = ["", False, 0, target, 0]
    i, n = 0, len(tokens)
    while i < n:
        t = tokens[i]
        if t in "([{":
            if state == HAVE and t == "{":
                return "operands side by side"
            call = state == HAVE
            stack.append(top)
            top = [t + ("f" if call else ""), params and len(stack) == 1 and t == "(" and call, 0, False, 0]
            state = MAYBE
        elif t in _PAIR:
            if not stack or top[0][0] != _PAIR[t] or state == NEED or top[2] or top[4]:
                return "operand missing"
            top = stack.pop()
            state = HAVE
        elif t == ",":
            if state != HAVE and not (top[1] and tokens[i - 1] in ("*", "/")) and not (top[0] == "[f" and i and tokens[i - 1] == ":") or top[2]:
                return "operand missing"
            state = MAYBE
        elif t == "lambda":
            if state == HAVE:
                return "operands side by side"
            depth, i = 0, i + 1
            while i < n and (depth or tokens[i] != ":"):
                depth += (tokens[i] in "([{") - (tokens[i] in _PAIR)
                i += 1
            if i >= n:
                return "lambda without body"
            state = NEED
        elif state != HAVE:
            if t in _UNARY or t in ("*", "**"):
                if top[1] and t == "*" and i + 1 < n and tokens[i + 1] == ",":
                    state = HAVE
                else:
                    state = NEED
            elif t == "/" and top[1]:
                state = HAVE
            elif t == "yield":
                state = MAYBE
                if i + 1 < n and tokens[i + 1] == "from":
                    i, state = i + 1, NEED
            elif t == ":" and top[0] == "[f":
                state = MAYBE
            elif t == S or t == "..." or t in _OPERAND_WORDS or t[0].isdigit() and t == "0" or t[0].isidentifier() and t not in _KEYWORDS:
                state = HAVE
                if t == S:
                    while i + 1 < n and tokens[i + 1] == S:
                        i += 1
            elif t == "in" and i and tokens[i - 1] == "," and (top[3] or target):
                state = NEED  # a comma after the last target
            else:
                return f"misplaced {t[:20]!r}"
        elif t == ".":
            if i + 1 >= n or not tokens[i + 1][0].isidentifier() or tokens[i + 1] in _KEYWORDS:
                return "name missing after a dot"
            i += 1
        elif t == "not":
            if i + 1 >= n or tokens[i + 1] != "in":
                return "operands side by side"
            i, state = i + 1, NEED
        elif t == "is":
            if i + 1 < n and tokens[i + 1] == "not":
                i += 1
            state = NEED
        elif t in _BINARY:
            state = NEED
        elif t == "if":
            if not top[3]:
                top[2] += 1
            elif "else" in tokens[i:]:
                top[2] += _ternary(tokens, i)
            state = NEED
        elif t == "else":
            if not top[2]:
                return "misplaced 'else'"
            top[2] -= 1
            state = NEED
        elif t == "async" and i + 1 < n and tokens[i + 1] == "for":
            pass
        elif t == "for":
            if not top[0] or top[2]:
                return "misplaced 'for'"
            top[3], state = True, NEED
        elif t == ":":
            if top[0] == "{" or top[1] or target and not top[0]:
                state = NEED
            elif top[0] == "[f":
                state = MAYBE
            else:
                return "misplaced ':'"
        elif t == ":=":
            state = NEED
        elif t == "=":
            if top[0] != "(f" and not top[1]:
                return "misplaced '='"
            state = NEED
        elif t == "->":
            return "misplaced '->'"
        else:
            return "operands side by side" if t == S or t[0].isidentifier() or t[0].isdigit() else f"misplaced {t[:20]!r}"
        i += 1
    if stack or state == NEED or top[2] or top[4]:
        return "statement without end"
    return None


def _ternary(tokens: list[str], i: int) -> int:
    """Whether the condition of a comprehension at i is rather one of a ternary: an else follows before its bracket ends."""
    depth = 0
    for t in tokens[i + 1 :]:
        if t in "([{":
            depth += 1
        elif t in _PAIR:
            if not depth:
                return 0
            depth -= 1
        elif not depth and t in ("for", "if"):
            return 0
        elif not depth and t == "else":
            return 1
    return 0


def _split(tokens: list[str], at: str) -> list[list[str]]:
    """The parts between signs outside brackets."""
    parts, depth, lambdas = [[]], 0, 0
    for t in tokens:
        if t in "([{":
            depth += 1
        elif t in _PAIR:
            depth -= 1
        elif t == "lambda" and not depth:
            lambdas += 1
        elif t == ":" and lambdas and not depth:
            lambdas -= 1
            parts[-1].append(t)
            continue
        if t == at and not depth and not lambdas:
            parts.append([])
        else:
            parts[-1].append(t)
    return parts


def _is_name(t: str) -> bool:
    return t[0].isidentifier() and (t not in _KEYWORDS)


def _import(tokens: list[str]) -> bool:
    if tokens[0] == "from":
        if "import" not in tokens:
            return False
        at = tokens.index("import")
        source, names = tokens[1:at], tokens[at + 1 :]
        if not source or not re.fullmatch(r"(?:\.|\.\.\.)*(?:n(?:\.n)*)?", "".join("n" if _is_name(t) else t for t in source)):
            return False
        if names == ["*"]:
            return True
        if names and names[0] == "(" and names[-1] == ")":
            names = names[1:-1]
            if names and names[-1] == ",":
                names = names[:-1]
        return all(len(p) in (1, 3) and _is_name(p[0]) and (len(p) == 1 or p[1] == "as" and _is_name(p[2])) for p in _split(names, ","))
    for p in _split(tokens[1:], ","):
        shape = " ".join("n" if _is_name(t) else t for t in p)
        if not re.fullmatch(r"n(?: \. n)*(?: as n)?", shape):
            return False
    return True


def _simple(tokens: list[str]) -> str | None:
    first, rest = tokens[0], tokens[1:]
    if first in ("pass", "break", "continue"):
        return f"text after {first}" if rest else None
    if first in ("import", "from"):
        return None if _import(tokens) else "broken import"
    if first in ("global", "nonlocal"):
        return None if rest and all(len(p) == 1 and _is_name(p[0]) for p in _split(rest, ",")) else f"misplaced {first!r}"
    if first == "return":
        return _expression(rest) if rest else None
    if first in ("del", "assert"):
        return _expression(rest) if rest else "operand missing"
    if first == "raise":
        parts = _split(rest, "from")
        return next((x for p in parts if (x := _expression(p))), None) if rest else None
    if first == "type" and len(rest) > 2 and _is_name(rest[0]) and "=" in rest:
        at = rest.index("=")
        return _expression(rest[at + 1 :])
    # Assignments: targets, perhaps with an annotation.
    parts = _split(tokens, "=")
    if len(parts) > 1:
        for p in parts[:-1]:
            if not p or p[-1] == S or p[-1] == "0" and len(p) == 1 or p[0] in ("None", "True", "False"):
                return "no target"
            depth = 0
            target = _split(p, ":")[0]
            for i, t in enumerate(target):
                depth += (t in "([{") - (t in _PAIR)
                if not depth and i and t in _BINARY and target[i - 1] not in (",", "yield"):
                    return "no target"
        annotated = _split(parts[0], ":")
        if len(annotated) > 2:
            return "misplaced ':'"
        parts = annotated + parts[1:]
    else:
        annotated = _split(tokens, ":")
        if len(annotated) == 2:
            parts = annotated
        else:
            depth = 0
            for i, t in enumerate(tokens):
                depth += (t in "([{") - (t in _PAIR)
                if not depth and t in _AUGMENTED:
                    parts = [tokens[:i], tokens[i + 1 :]]
                    break
    for p in parts:
        if fault := _expression(p):
            return fault
    return None


_HEADERS = frozenset("if elif else while for with try except finally def class async match case".split())


def _colon(tokens: list[str]) -> int:
    """Place of the colon that ends a header; -1 if there is none."""
    depth, lambdas = 0, 0
    for i, t in enumerate(tokens):
        if t in "([{":
            depth += 1
        elif t in _PAIR:
            depth -= 1
        elif not depth and t == "lambda":
            lambdas += 1
        elif not depth and t == ":":
            if not lambdas:
                return i
            lambdas -= 1
    return -1


def _header(first: str, head: list[str]) -> str | None:
    """A compound statement's head, without its first word and colon."""
    if first in ("else", "try", "finally"):
        return f"text after {first}" if head else None
    if first in ("if", "elif", "while", "match"):
        if first != "match" and len(_split(head, ",")) > 1:
            return "misplaced ','"
        return _expression(head) if head else "operand missing"
    if first == "for":
        depth = 0
        for i, t in enumerate(head):
            depth += (t in "([{") - (t in _PAIR)
            if not depth and t == "in":
                return _expression(head[: i - (head[i - 1] == ",")] if i else [], target=True) or _expression(head[i + 1 :])
        return "for without in"
    if first == "with":
        if head and head[0] == "(" and head[-1] == ")" and "as" in head:
            inner = head[1:-1]
            head = inner[:-1] if inner and inner[-1] == "," else inner
        return next((x for p in _split(head, ",") for q in _split(p, "as") if (x := _expression(q))), None) if head else "operand missing"
    if first == "except":
        if head[:1] == ["*"]:
            head = head[1:]
            if not head:
                return "operand missing"
        if not head:
            return None
        parts = _split(head, "as")
        if len(parts) > 2 or len(parts) == 2 and not (len(parts[1]) == 1 and _is_name(parts[1][0])):
            return "misplaced 'as'"
        return _expression(parts[0])
    if first == "class":
        if not head or not _is_name(head[0]):
            return "class without name"
        return _expression(head) if not (len(head) > 1 and head[1] not in "([") else "operands side by side"
    if first == "def":
        if len(head) < 3 or not _is_name(head[0]) or head[1] not in "([":
            return "def without name or parameters"
        parts = _split(head, "->")
        if len(parts) > 2 or len(parts) == 2 and _expression(parts[1]):
            return "misplaced '->'"
        if parts[0][-1] != ")":
            return "def without parameters"
        sign = parts[0]
        if sign[1] == "[":  # type parameters
            depth = 0
            for i, t in enumerate(sign):
                depth += (t in "([{") - (t in _PAIR)
                if i and not depth:
                    sign = [sign[0], *sign[i + 1 :]]
                    break
        return _expression(sign, params=True)
    # A pattern: names, literals, alternatives, captures, guards.
    return None if head else "operand missing"


@lru_cache(maxsize=200_000)
def python_statement(shape: str) -> tuple[str | None, str, bool]:
    """(fault, first word, whether an indented block must follow) of a logical line written by python_shapes."""
    tokens = _TOKEN.findall(shape)
    if not tokens:
        return None, "", False
    first = tokens[0]
    for t in tokens:
        if t[0].isdigit() and t != "0":
            return "bad number", first, False
    if first == "@":
        return (_expression(tokens[1:]) if len(tokens) > 1 else "operand missing"), "@", False
    word = first
    soft = first in ("match", "case")
    if first in _HEADERS:
        body = tokens[1:]
        if first == "async":
            if not body or body[0] not in ("def", "for", "with"):
                return "misplaced 'async'", first, False
            word, body = body[0], body[1:]
        at = _colon(body)
        if soft and (at < 0 or not body or body[0] in ("=", ".", ",", ":", ")") or body[0] in _AUGMENTED or at + 1 < len(body) and "=" in body[at + 1 :] and at == 0):
            return next((x for p in _split(tokens, ";") if p and (x := _simple(p))), None), "", False
        if at < 0:
            return "colon missing", word, False
        fault = _header(word, body[:at])
        rest = body[at + 1 :]
        if not fault and rest:
            fault = next((x for p in _split(rest, ";") if p and (x := "misplaced header" if p[0] in _HEADERS - {"match", "case"} else _simple(p))), None)
        return fault, word, not rest
    parts = _split(tokens, ";")
    for k, p in enumerate(parts):
        if not p:
            if k != len(parts) - 1 or k == 0:
                return "misplaced ';'", first, False
        elif p[0] in _HEADERS - {"match", "case"}:
            return "misplaced header", first, False
        elif fault := _simple(p):
            return fault, first, False
    return None, first, False


_FOLLOWS = {"elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except", "try"), "except": ("try", "except"), "finally": ("try", "except", "else")}


class Indentation:
    """Reads (indentation, first word, opens a block) of logical lines in order."""

    def __init__(self) -> None:
        self.stack: list[list] = [[0, "", False]]  # indentation, the last line's first word, whether it is inside a try statement without a clause
        self.opens = False

    def line(self, indent: int, word: str, opens: bool) -> str | None:
        if self.opens:
            if indent <= self.stack[-1][0]:
                return "indented block missing"
            self.stack.append([indent, "", False])
        elif indent > self.stack[-1][0]:
            return "unexpected indentation"
        while indent < self.stack[-1][0]:
            if self.stack[-1][1] == "try":
                return "try without clause"
            self.stack.pop()
        if indent != self.stack[-1][0]:
            return "indentation of no block"
        before = self.stack[-1][1]
        if word in _FOLLOWS:
            if before not in _FOLLOWS[word] and not (word in ("else", "finally") and before == "except"):
                return f"misplaced {word!r}"
        elif before == "try":
            return "try without clause"
        self.stack[-1][1] = word
        self.opens = opens
        return None

    def end(self) -> str | None:
        if self.opens:
            return "indented block missing"
        return "try without clause" if any(x[1] == "try" for x in self.stack) else None


# --- JSON ---------------------------------------------------------------------------------------------------------------------------

_JSON_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_JSON_SCALAR = re.compile(r"(?<![\w.+-])(?:-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)(?![\w.+-])")
_JSON_INNER = re.compile(r"\{(?:(?:S:[SV]|P)(?:,(?:S:[SV]|P))*)?\}|\[(?:[SVA](?:,[SVA])*)?\]")
_JSON_MANY = re.compile(r"(?<=,)[VA](?:,[VA])+(?=,)"), re.compile(r"(?<=,)(?:S:[SV]|P)(?:,(?:S:[SV]|P))+(?=,)")


def json_signs(text: str) -> str | None:
    """S for a string, V for another scalar, and signs; None if there is anything else."""
    bare = _JSON_STRING.sub("\x02", text)
    if '"' in bare or "S" in bare or "V" in bare:
        return None
    bare = _JSON_SCALAR.sub("V", bare)
    if re.search(r"[^\x02V{}\[\],:\s]|[\x02V]\s*[\x02V]|[^\S \t\r\n]", bare):
        return None
    return "".join(bare.replace("\x02", "S").split())


def json_shrunk(signs: str) -> str | None:
    """The signs with every balanced value as one V, also where brackets are open on both sides. Shrinking the parts of a text and then all
    of them together gives what shrinking the text gives. None if a balanced value is none of JSON's."""
    out: list[str] = []
    starts: list[int] = []  # places of openers in out
    for piece in re.findall(r"[^{}\[\]]+|[{}\[\]]", signs):
        if piece in "{[":
            starts.append(len(out))
            out.append(piece)
        elif piece in "}]":
            if not starts:
                out.append(piece)
                continue
            at = starts.pop()
            value = "".join(out[at:]) + piece
            if not _JSON_INNER.fullmatch(value):
                return None
            del out[at:]
            out.append("V")
        else:
            out.append(piece)
    rest = "".join(out)
    # Elements and pairs in the middle of a long array or object become one; a value by itself between commas stands in an array.
    return _JSON_MANY[1].sub("P", _JSON_MANY[0].sub("A", rest)) if len(rest) > 64 else rest


# --- TOML ---------------------------------------------------------------------------------------------------------------------------

_TOML_KEY = rf"(?:[A-Za-z0-9_-]+|{S})(?:[ \t]*\.[ \t]*(?:[A-Za-z0-9_-]+|{S}))*"
_TOML_TABLE = re.compile(rf"\[[ \t]*{_TOML_KEY}[ \t]*\]|\[\[[ \t]*{_TOML_KEY}[ \t]*\]\]")
_TOML_PAIR = re.compile(rf"{_TOML_KEY}[ \t]*=[ \t]*(?=\S)")
_TOML_SCALAR = re.compile(
    rf"{S}|true|false|[+-]?(?:inf|nan)|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|\d{{4}}-\d\d-\d\d(?:[Tt ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d(?::\d\d(?:\.\d+)?)?"
    r"|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?"
)
_TOML_INNER = re.compile(rf"\[\s*(?:V\s*(?:,\s*V\s*)*,?\s*)?\]|\{{[ \t]*(?:{_TOML_KEY}[ \t]*=[ \t]*V[ \t]*(?:,[ \t]*{_TOML_KEY}[ \t]*=[ \t]*V[ \t]*)*)?\}}")


@lru_cache(maxsize=100_000)
def toml_statement(line: str) -> str | None:
    line = line.strip()
    if not line or _TOML_TABLE.fullmatch(line):
        return None
    m = _TOML_PAIR.match(line)
    if not m:
        return "no table, no key with a value"
    value = line[m.end() :]
    if _TOML_SCALAR.fullmatch(value):
        return None
    # Scalars become V, then the innermost brackets, until one V is left.
    value = re.sub(rf"(?<=[\[,=])(\s*)({_TOML_SCALAR.pattern})(?=\s*[,\]}}])", r"\1V", value)
    while True:
        less = _TOML_INNER.sub("V", value)
        if less == value:
            return None if value == "V" else "bad value"
        value = less
