"""Lexer-state maps: what a stretch of source text is, for each state the lexer may be in when it begins.

A stretch begins and ends at line ends, so its first state is one of the few that cross a line end: code, a block comment, a string of several
lines, a string whose line end is escaped. Read in one state, it gives the state it ends in and its masked text: comments are gone, string
bodies and regular expressions are one sign. Maps of neighbouring stretches are joined by taking the second one's entry for the state the
first one ends in, so where a text is cut makes no difference.
"""

from __future__ import annotations

import re

#: A masked string or regular expression.
S = "\x01"
CODE, COMMENT, TEMPLATE, TRIPLE, TRIPLE1, DOUBLE, SINGLE = range(7)

_ESCAPED = {DOUBLE: r'(?:[^"\\\n]|\\[^\n]|\\\n)*', SINGLE: r"(?:[^'\\\n]|\\[^\n]|\\\n)*"}
# How each state goes on to its end. No construct takes memory for each of its characters: they may be as long as the file.
_ENDS = {
    COMMENT: re.compile(r"[\s\S]*?\*/"),
    TEMPLATE: re.compile(r"(?:[^`\\]++|\\[\s\S])*+`"),
    TRIPLE: re.compile(r'(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""'),
    TRIPLE1: re.compile(r"(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''"),
    DOUBLE: re.compile(_ESCAPED[DOUBLE] + '"'),
    SINGLE: re.compile(_ESCAPED[SINGLE] + "'"),
}
_RAW = {TEMPLATE: re.compile(r"[^`]*`"), TRIPLE1: re.compile(r"(?:[^']++|'(?!''))*+'''")}

_COMMON = r"//[^\n]*|/\*[\s\S]*?\*/"
_QUOTED = rf"\"{_ESCAPED[DOUBLE]}\"|'{_ESCAPED[SINGLE]}'"
_TEMPLATE = r"`(?:[^`\\]++|\\[\s\S])*+`"
_REGEX = r"(?<=[(,=:\[!&|?{};+\-*%~^>\n ])/(?![/*\s])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*(?=\s*[.,;)\]}\n]|\s*$)"
_TEXT = r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""'
_TEXT1 = r"'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''"
# What is left open at the end of a stretch, with the state that it leaves.
_OPEN_COMMENT = r"|(?P<c>/\*[\s\S]*\Z)"
_OPEN_QUOTED = rf"|(?P<d>\"{_ESCAPED[DOUBLE]}(?<=\\\n)\Z)|(?P<q>'{_ESCAPED[SINGLE]}(?<=\\\n)\Z)"
_OPEN_TEMPLATE = r"|(?P<t>`[\s\S]*\Z)"
_OPEN_TEXT = r'|(?P<m>"""[\s\S]*\Z)'
_OPEN_TEXT1 = r"|(?P<n>'''[\s\S]*\Z)"
_LEX = {
    "javascript": f"{_COMMON}|{_QUOTED}|{_TEMPLATE}|{_REGEX}{_OPEN_COMMENT}{_OPEN_QUOTED}{_OPEN_TEMPLATE}",
    "java": f"{_COMMON}|{_TEXT}|{_QUOTED}{_OPEN_COMMENT}{_OPEN_TEXT}{_OPEN_QUOTED}",
    "go": f"{_COMMON}|{_QUOTED}|`[^`]*`{_OPEN_COMMENT}{_OPEN_TEMPLATE}{_OPEN_QUOTED}",
    "python": rf"#[^\n]*|\\\n|(?<![\w.])[rRbBuUfF]{{1,2}}(?=[\"'])|{_TEXT}|{_TEXT1}{_OPEN_TEXT}{_OPEN_TEXT1}|{_QUOTED}{_OPEN_QUOTED}",
    "toml": rf"#[^\n]*|{_TEXT}|'''(?:[^']++|'(?!''))*+'''{_OPEN_TEXT}{_OPEN_TEXT1}|\"(?:[^\"\\\n]|\\[^\n])*\"|'[^'\n]*'",
}
_LEX["typescript"] = _LEX["javascript"]
_LEX = {k: re.compile(v) for k, v in _LEX.items()}
_LEAVES = {"c": COMMENT, "t": TEMPLATE, "m": TRIPLE, "n": TRIPLE1, "d": DOUBLE, "q": SINGLE}
#: The states a stretch of each language may begin in.
STATES = {
    "javascript": (CODE, COMMENT, TEMPLATE, DOUBLE, SINGLE), "typescript": (CODE, COMMENT, TEMPLATE, DOUBLE, SINGLE), "java": (CODE, COMMENT, TRIPLE, DOUBLE, SINGLE),
    "go": (CODE, COMMENT, TEMPLATE, DOUBLE, SINGLE), "python": (CODE, TRIPLE, TRIPLE1, DOUBLE, SINGLE), "toml": (CODE, TRIPLE, TRIPLE1),
}
_LEFT = {"python": re.compile(r"[\"']"), "toml": re.compile(r"[\"']"), "go": re.compile(r'/\*|["\'`]')}
_LEFT_CURLY = re.compile(r'/\*|"""|["\'`]')


def masked(text: str, language: str, state: int) -> tuple[str, int, bool]:
    """(masked text, state at the end, whether a string is left open in a line) of a stretch that begins in `state`."""
    head = ""
    if state != CODE:
        ends = _RAW.get(state, _ENDS[state]) if language in ("go", "toml") else _ENDS[state]
        m = ends.match(text)
        if not m:
            # Still inside, unless a string whose line end must be escaped simply stops.
            stays = state not in _ESCAPED or re.fullmatch(_ESCAPED[state], text) is not None and text.endswith("\\\n")
            return "", state, not stays
        head, text = (" " if state == COMMENT else S), text[m.end() :]
    leaves = CODE

    def mask(m: re.Match) -> str:
        nonlocal leaves
        if kind := m.lastgroup:
            leaves = _LEAVES[kind]
            return " " if kind == "c" else S
        t = m.group()
        if t[0] == "#" or t.startswith("//"):
            return ""
        if t.startswith("/*"):
            return "\n" if "\n" in t else " "
        if t == "\\\n":
            return " "
        return "" if t[0] in "rRbBuUfF" else S

    # A sign before the text stands for the line end before it, which a regular expression may follow.
    out = _LEX[language].sub(mask, "\n" + text)[1:] if not head else _LEX[language].sub(mask, text)
    return head + out, leaves, _LEFT.get(language, _LEFT_CURLY).search(out) is not None


_BRACKET = re.compile(r"[()\[\]{}]")
_CLOSES = {")": "(", "]": "[", "}": "{"}


def summary(text: str) -> tuple[str, str] | None:
    """(closers, openers) that the text leaves unmatched; None if two of it contradict each other."""
    shut, open_ = [], []
    for b in _BRACKET.findall(text):
        if b in "([{":
            open_.append(b)
        elif not open_:
            shut.append(b)
        elif open_.pop() != _CLOSES[b]:
            return None
    return "".join(shut), "".join(open_)


def join_summaries(a: tuple[str, str] | None, b: tuple[str, str] | None) -> tuple[str, str] | None:
    """Associative: the summary of two texts one after the other."""
    if a is None or b is None:
        return None
    n = min(len(a[1]), len(b[0]))
    for opener, closer in zip(reversed(a[1]), b[0][:n]):
        if _CLOSES[closer] != opener:
            return None
    return a[0] + b[0][n:], a[1][: len(a[1]) - n] + b[1]
