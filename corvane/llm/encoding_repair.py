"""Texts decoded with the wrong character encoding: find the passages and restore them.

Characters are mapped back to the bytes of a legacy code page. A byte-structure automaton (the well-formed sequences of UTF-8) finds
the maximal spans of multibyte sequences, and only those spans are decoded again; twice-decoded text takes another turn. Two further
faults leave no multibyte structure: text of one single-byte code page read as another (judged by the shape of the words) and bytes
already lost to the replacement character (found, but not restorable).

Null and empty texts, and pure ASCII, are never garbled. Repeated ids give one row. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import flat_map

#: Code pages whose misreading of UTF-8 is looked for.
MULTIBYTE_PAGES = ("cp1252", "cp1250", "cp1251", "iso8859_2", "mac_roman", "cp437", "cp850")
#: (read as, was): single-byte pages taken for one another.
SINGLE_BYTE_PAIRS = (("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1252", "iso8859_2"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"))

# The byte-structure automaton: well-formed multibyte sequences of UTF-8, as ranges of bytes.
_SEQUENCES = (
    ((0xC2, 0xDF), (0x80, 0xBF)),
    ((0xE0, 0xE0), (0xA0, 0xBF), (0x80, 0xBF)),
    ((0xE1, 0xEC), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xED, 0xED), (0x80, 0x9F), (0x80, 0xBF)),
    ((0xEE, 0xEF), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xF0, 0xF0), (0x90, 0xBF), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xF1, 0xF3), (0x80, 0xBF), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xF4, 0xF4), (0x80, 0x8F), (0x80, 0xBF), (0x80, 0xBF)),
)
# What such a span may say: letters and signs of the living scripts, not the rare blocks that natural text hits by chance.
_PLAUSIBLE = re.compile("[\x80-ſƒȘ-țˆ˜Ά-ώЁЄ-ЇА-яё-џҐґא-תء-ي‐-⁄€№™←-⇿∀-⋿─-╿、-ヿ一-鿿️﻿�！-～\U0001f300-\U0001faff]+")
# Letters and signs of the large European languages; of pages that explain as much, the one that gives these is taken.
_COMMON = re.compile("[\xa0-¿àâäæçèéêëîïôöùûüÿßœáíñóúãõąćęłńśźżšžřýěůőűåøÀÂÄÇÈÉÊËÎÏÔÖÙÛÜŒÁÍÑÓÚÃÕĄĆĘŁŃŚŹŻа-яА-ЯёЁ‐-”„…€™→─-╿]+")
_INNER_CAPITAL = re.compile("(?<=[a-zà-öø-ÿа-яё])[A-ZÀ-ÖØ-ÞА-ЯЁ]")
_C1 = re.compile("[\x80-\x84\x86-\x9f]")
_LOST = re.compile("[^\\W\\d_]�|�[^\\W\\d_]|��")


def _page(name: str) -> dict[int, str]:
    """Character to byte (as a character below 256); undefined bytes and C1 controls stand for themselves."""
    table = {b: chr(b) for b in range(128, 160)}
    for b in range(128, 256):
        try:
            table[ord(bytes([b]).decode(name))] = chr(b)
        except UnicodeDecodeError:
            table[b] = chr(b)
    return table


class _Page:
    """A legacy page with the automaton spelt in the page's own characters, so that one search finds the maximal spans."""

    def __init__(self, name: str):
        self.name, self.to_byte = name, _page(name)
        chars: dict[int, list[str]] = {}
        for c, b in self.to_byte.items():
            chars.setdefault(ord(b), []).append(chr(c))

        def one(low: int, high: int) -> str:
            return "[" + "".join(re.escape(c) for b in range(low, high + 1) for c in chars.get(b, [])) + "]"

        self.span = re.compile("(?:" + "|".join("".join(one(*r) for r in seq) for seq in _SEQUENCES if all(any(b in chars for b in range(r[0], r[1] + 1)) for r in seq)) + ")+")

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        found = []
        for m in self.span.finditer(text):
            good = m.group().translate(self.to_byte).encode("latin-1").decode("utf-8")
            if _PLAUSIBLE.fullmatch(good):
                found.append((m.start(), m.end(), good))
        return found


class Repairer:
    def __init__(self, pages: Iterable[str] = MULTIBYTE_PAGES, pairs: Iterable[tuple[str, str]] = SINGLE_BYTE_PAIRS):
        self.pages = [_Page(p) for p in pages]
        self.pairs = []
        for read_as, was in pairs:
            table = {}
            for c, b in _page(read_as).items():
                try:
                    table[c] = bytes([ord(b)]).decode(was)
                except UnicodeDecodeError:
                    pass
            self.pairs.append((f"{was} as {read_as}", read_as, was, table))

    def multibyte(self, text: str) -> tuple[str, list[str], int]:
        """The text with all wrongly decoded multibyte spans restored, the pages found, the number of spans."""
        used, n = [], 0
        while True:  # each layer makes the text shorter
            best: tuple[tuple[int, int], str, list] | None = None
            for page in self.pages:
                spans = page.spans(text)
                # The page that explains most characters, then the one that gives common letters and puts fewer capitals
                # within words, then the earlier.
                # What natural text holds by chance doesn't reach this: its decoded form isn't plausible.
                if not spans:
                    continue
                odd = sum((not _COMMON.fullmatch(good)) + len(_INNER_CAPITAL.findall(text[s - 1 : s] + good)) for s, _, good in spans)
                gain = (sum(e - s for s, e, _ in spans), -odd)
                if best is None or gain > best[0]:
                    best = (gain, page.name, spans)
            if best is None:
                break
            parts, at = [], 0
            for s, e, good in best[2]:
                parts += [text[at:s], good]
                at = e
            text = "".join([*parts, text[at:]])
            used.append(f"utf_8 as {best[1]}")
            n += len(best[2])
        return text, used, n

    def single_byte(self, text: str) -> tuple[str, str, int] | None:
        """A passage of one single-byte page read as another, with the words restored."""
        for label, read_as, was, table in self.pairs:
            bad = (_cyrillic if read_as in ("cp1251", "koi8_r", "cp866") else _latin_as_cyrillic if was in ("cp1251", "koi8_r") else _latin2)(text, table)
            if bad:
                fixed = re.sub(r"[^\s]+", lambda m: m.group().translate(table) if m.group() in bad else m.group(), text)
                return fixed, label, len(bad)
        return None

    def repair(self, text: str) -> tuple[str, list[str], int, bool] | None:
        """(restored text, faults in the order they were undone, spans, whether something is lost); None if the text is sound."""
        fixed, used, n = text, [], 0
        if single := self.single_byte(text):
            fixed, label, n = single
            used = [label]
        fixed, pages, k = self.multibyte(fixed)
        used += pages
        n += k
        if _C1.search(fixed):
            fixed, k = _C1.subn(lambda m: m.group().encode("latin-1").decode("cp1252", "replace"), fixed)
            used.append("cp1252 as latin_1")
            n += k
        lost = bool(_LOST.search(fixed))
        if lost:
            used.append("lost bytes")
            n += len(_LOST.findall(fixed))
        return (fixed, used, n, lost) if used else None


_WORD = re.compile(r"[^\s]+")
_CYR_WORD = re.compile("[Ѐ-џҐґ]{3,}")
_ODD_CASE = re.compile("[а-яё][А-ЯЁ]{3,}")
_VOWEL = re.compile("[аеёиоуыэюяАЕЁИОУЫЭЮЯ]")


def _well_shaped(word: str) -> bool:
    return word.islower() or word.istitle() or word.isupper()


def _cyrillic(text: str, table: dict[int, str]) -> set[str]:
    """Words whose case is inside out (small first letter, capitals after it) and right again in the other page."""
    bad, sure = set(), 0
    if not _ODD_CASE.search(text):
        return bad
    for m in _WORD.finditer(text):
        w = m.group()
        for c in _CYR_WORD.findall(w):
            good = c.translate(table)
            odd = not _well_shaped(c) or (c.isupper() and good.islower())
            if odd and _well_shaped(good) and _VOWEL.search(good) and _CYR_WORD.fullmatch(good):
                bad.add(w)
                sure += bool(_ODD_CASE.fullmatch(c))
                break
    if not sure:
        return set()
    # In such a passage the short words are turned as well.
    return bad | {w for w in _WORD.findall(text) if _turned(w, table)}


def _turned(word: str, table: dict[int, str]) -> bool:
    c = re.sub("[^Ѐ-џ]", "", word)
    return len(c) > 1 and c[1:].isupper() and c.translate(table).islower()


_LATIN2_INNER = re.compile("[a-zóêæñ][\xb1\xb3\xb6\xbc\xbf\xb9œŸ\xa1\xa6\xac\xaf\xa3]+[a-zóêæñ]")
_LATIN2_SIGN = re.compile("[\xb1\xb3\xb6\xbc\xbf\xb9œŸ\xa1\xa6\xac\xaf\xa3\xea\xe6\xf1\xca\xc6\xd1]")
_POLISH = re.compile("[A-Za-zóÓąćęłńśźżĄĆĘŁŃŚŹŻ]+")


def _latin2(text: str, table: dict[int, str]) -> set[str]:
    """Words with a sign between letters that is a letter of Polish in the other page."""
    if not _LATIN2_INNER.search(text):
        return set()
    bad, sure = set(), False
    for m in _WORD.finditer(text):
        w = m.group().strip(".,;:!?()\"'`*")
        if _LATIN2_SIGN.search(w) and not w.isascii() and _POLISH.fullmatch(w.translate(table)):
            bad.add(m.group())
            sure = sure or bool(_LATIN2_INNER.search(w))
    return bad if sure else set()


_HIGH_LATIN = re.compile("[À-ÿ]{4,}")


def _latin_as_cyrillic(text: str, table: dict[int, str]) -> set[str]:
    """Words of nothing but accented Latin letters that are well-shaped Cyrillic in the other page."""
    bad: set[str] = set()
    if not _HIGH_LATIN.search(text):
        return bad
    for m in _WORD.finditer(text):
        for c in _HIGH_LATIN.findall(m.group()):
            good = c.translate(table)
            if _well_shaped(good) and good[1:].islower() and _VOWEL.search(good) and _CYR_WORD.fullmatch(good):
                bad.add(m.group())
    return bad


def garbled_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each record with a wrongly decoded passage: id, restored text, faults, number of spans, whether bytes are lost."""

    def make() -> Callable:
        repair = Repairer().repair

        def row(key, text):
            found = repair(text)
            return [(key, *found)] if found else []

        return row

    kind = df.schema[id_col].dataType.simpleString()
    # Sound ASCII never leaves the JVM.
    high = df.where(F.col(text_col).rlike(r"[^\x00-\x7F]"))
    return flat_map(high, [F.col(id_col).alias("id"), F.col(text_col).alias("text")], make, f"{id_col} {kind}, restored string, faults array<string>, spans int, lossy boolean").dropDuplicates([id_col])
