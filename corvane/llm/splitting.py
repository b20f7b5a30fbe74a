"""Oversized items cut into pieces at natural boundaries, each overlapping the one before.

The text is cut by a hierarchy of separators (section, declaration within it, paragraph, line, sentence, word, character): a part that is still larger than the
limit is cut by the next separator. The parts are packed greedily up to the limit; the next piece begins with the trailing parts of the one
before, up to the overlap. Pieces without their overlap put together give the text again, character by character.

Only items over the limit give pieces. Null and empty contents give none. Rewritten rows count once, by the latest created_at (then the
longer, then the larger text), so an item whose latest version is short gives none. Lines are 1-based in the file; where start_line is null or 0 the pieces' lines are null. A limit counts code
points, line ends included; a CRLF is never cut.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import flat_map

LIMIT, OVERLAP = 2_000, 200

#: Separators from the widest to the narrowest; a part ends where the match begins, or after it for those that close a part.
_DECLARED = r"(?:@[\w.]+[^\n]*\n[ \t]*)*(?:export |default |public |private |protected |static |async |abstract |final |override |readonly )*"
_KINDS = r"(?:class|interface|enum|struct|def|func|function|fn|impl|type|module|namespace) "
_BEFORE = (
    re.compile(rf"\n(?=#{{1,6}} |{_DECLARED}{_KINDS})"),
    # Declarations within others: methods by keyword or by a name, brackets and a brace.
    re.compile(rf"\n(?=[ \t]+{_DECLARED}(?:{_KINDS}|(?!(?:if|for|while|switch|catch|return|else|do|try|with)\b)[\w$<>\[\], ]*[\w$]\([^\n;]*\)[^\n;(){{}}]*\{{[ \t\r]*\n))"),
)
_AFTER = (
    re.compile(r"\n[ \t\r]*\n(?!\s*\n)"),
    re.compile(r"\n"),
    re.compile(r"(?<=[.!?;:…。])\s+"),
    re.compile(r"\s+"),
)


def _cut(text: str, start: int, end: int, level: int, limit: int) -> list[tuple[int, int]]:
    """Parts of text[start:end] up to the limit; a part keeps the separator that closes it."""
    if end - start <= limit:
        return [(start, end)]
    if level == len(_BEFORE) + len(_AFTER):
        out, at = [], start
        while at < end:
            stop = min(end, at + limit)
            if stop < end and text[stop - 1] == "\r" and text[stop] == "\n" and stop - at > 1:
                stop -= 1
            out.append((at, stop))
            at = stop
        return out
    if level < len(_BEFORE):
        cuts = [m.start() + 1 for m in _BEFORE[level].finditer(text, start, end)]
    else:
        cuts = [m.end() for m in _AFTER[level - len(_BEFORE)].finditer(text, start, end)]
    bounds = [start, *(c for c in cuts if start < c < end), end]
    out = []
    for a, b in zip(bounds, bounds[1:]):
        out += _cut(text, a, b, level + 1, limit)
    return out


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, characters shared with the piece before) of each piece."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if len(text) <= limit:
        return [(0, len(text), 0)]
    # Parts leave room for the overlap, so any part can follow any tail.
    parts = _cut(text, 0, len(text), 0, limit - overlap)
    out: list[tuple[int, int, int]] = []
    i, shared = 0, 0
    while i < len(parts):
        start = parts[i][0] - shared
        j = i
        while j + 1 < len(parts) and parts[j + 1][1] - start <= limit:
            j += 1
        end = parts[j][1]
        out.append((start, end, shared))
        shared = _tail(text, parts, i, j, overlap) if j + 1 < len(parts) else 0
        i = j + 1
    return out


def _tail(text: str, parts: list[tuple[int, int]], i: int, j: int, overlap: int) -> int:
    """Length of the trailing overlap: whole parts if they fit, else from a line, sentence or word on."""
    end, start = parts[j][1], None
    k = j
    while k > i and end - parts[k][0] <= overlap:
        start = parts[k][0]
        k -= 1
    if start is not None:
        return end - start
    low = max(parts[i][0], end - overlap)
    for separator in _AFTER[1:]:
        m = separator.search(text, max(0, low - 1), end - 1)
        if m and low <= m.end() < end:
            return end - m.end()
    if low > 0 and text[low - 1] == "\r" and low < len(text) and text[low] == "\n":
        low += 1
    return end - low


def oversized_pieces(
    df: DataFrame, id_col: str = "chunk_id", content_col: str = "content", start_col: str | None = "start_line", time_col: str | None = "created_at", limit: int = LIMIT, overlap: int = OVERLAP, texts: bool = True
) -> DataFrame:
    """One row for each piece of each oversized item: id, piece number from 0, character offsets, overlap, lines, text."""
    pieces("", limit, overlap)
    kind = df.schema[id_col].dataType.simpleString()
    # Short texts take part in finding the latest version, but not with their characters.
    large = F.when(F.length(content_col) > limit, F.col(content_col))
    order = F.struct(F.col(time_col).cast("string") if time_col else F.lit(""), F.length(content_col), large)
    start = F.col(start_col).cast("int") if start_col else F.lit(None).cast("int")
    known = df.where(F.col(content_col).isNotNull())
    latest = known.groupBy(F.col(id_col).alias("id")).agg(F.max_by(F.struct(large.alias("content"), start.alias("line")), order).alias("x")).select("id", "x.content", "x.line").where("content is not null")

    def make() -> Callable:
        def row(key, content, line) -> Iterable[tuple]:
            out = []
            known = line is not None and line > 0
            at, n = 0, 0  # line feeds before each start are counted once, not from the beginning each time
            for k, (s, e, shared) in enumerate(pieces(content, limit, overlap)):
                n += content.count("\n", at, s) if s >= at else -content.count("\n", s, at)
                at = s
                first = line + n if known else None
                last = first + content.count("\n", s, e - 1) if known else None
                out.append((key, k, s, e, shared, first, last, content[s:e] if texts else None))
            return out

        return row

    return flat_map(latest, ["id", "content", "line"], make, f"{id_col} {kind}, piece int, start_char int, end_char int, overlap int, start_line int, end_line int, text string")
