"""Encoding of whole texts with a public byte-level BPE vocabulary, exactly as merging by rank would.

Backtracking encoder: an Aho-Corasick automaton over the vocabulary gives the longest token at a position (and, by a table, the next
shorter ones); a step is taken only if the token may stand beside the one before it, which a pair-compatibility table decides. A position
that led nowhere is never tried again, so the work is linear in the text. Decoding uses one byte string and an offset table.

Null and empty texts both give an empty list. Texts that look like special tokens are plain text. Invalid surrogates become U+FFFD.
Repeated ids give one row (their texts are the same document). Very long texts and very long words need no special case.
"""

from __future__ import annotations

import base64
import importlib
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import flat_map
from ..session import cut

#: The split of the byte-level vocabularies into words, a fixed value of the public tokenizer.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept with their ids in one Python worker; beyond that the memory is emptied. It changes no result.
CACHED_WORDS = 200_000
#: Tokenizer files are bounded: a larger one is refused, as it is sent to every executor.
MAX_FILE_BYTES = 64 << 20


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    return importlib.import_module("public_tokenizers").path(name)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class BacktrackingEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = WORD_PATTERN):
        self.pattern = regex.compile(pattern)
        self.ids = {t.decode("latin-1"): r for t, r in ranks.items()}
        self.tokens = {r: t for t, r in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.trie = ahocorasick.Automaton()
        for t, r in self.ids.items():
            self.trie.add_word(t, (len(t), r))
        self.shorter: dict[int, int] = {}  # of a token, the longest token that is a proper prefix
        for t, r in self.ids.items():
            n = len(t) - 1
            while n > 0 and t[:n] not in self.ids:
                n -= 1
            if n > 0:
                self.shorter[r] = self.ids[t[:n]]
        # The two parts each token is merged from, and the merges: a pair is compatible unless a merge would bridge it earlier.
        self.parts: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        for r in sorted(self.tokens):
            t, left = self.tokens[r], self.shorter.get(r)
            self.parts[r] = (r, r)
            while left is not None:
                right = self.ids.get(t[len(self.tokens[left]) :])
                if right is not None and left < r and right < r and self.compatible(left, right):
                    self.merges[left, right] = r
                    self.parts[r] = (left, right)
                    break
                left = self.shorter.get(left)
        self.memory: dict[str, list[int]] = {}
        self.offsets = [0]
        blob = bytearray()
        for r in range(max(self.tokens) + 1):
            blob += self.tokens.get(r, "").encode("latin-1")
            self.offsets.append(len(blob))
        self.blob = bytes(blob)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens may stand side by side: undo the merges on both sides of the seam, the later one first, and look for
        a merge over the seam that would have come before."""
        limit = 1 << 62
        while True:
            if self.merges.get((left, right), 1 << 62) < limit:
                return False
            if left > right:
                limit, inner = left, self.parts[left][1]
                if inner == left:
                    # An atom on the left: go on with the right side.
                    limit, inner = right + 1, self.parts[right][0]
                    if inner == right:
                        return True
                    right = inner
                else:
                    left = inner
            else:
                limit, inner = right + 1, self.parts[right][0]
                if inner == right:
                    limit, inner = left, self.parts[left][1]
                    if inner == left:
                        return True
                    left = inner
                else:
                    right = inner

    def _word(self, word: str) -> list[int]:
        """word: its UTF-8 bytes as characters below 256."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        at, out, dead = 0, [], set()
        token: int | None = self._longest_match(word)
        n = len(word)
        while token is not None:
            end = at + len(self.tokens[token])
            while True:
                if end not in dead and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    at = end
                    token = self._longest_match(word[at : at + self.longest]) if at < n else None
                    break
                shorter = self.shorter.get(token)
                if shorter is not None:
                    token = shorter
                    end = at + len(self.tokens[token])
                else:
                    dead.add(at)
                    token = out.pop()
                    at -= len(self.tokens[token])
                    end = at + len(self.tokens[token])
        return out

    def _longest_match(self, rest: str) -> int:
        """The longest token that rest starts with; the walk through the automaton may end between two tokens."""
        n = self.trie.longest_prefix(rest)
        while rest[:n] not in self.ids:
            n -= 1
        return self.ids[rest[:n]]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memory, out = self.memory, []
        for word in self.pattern.findall(text):
            ids = memory.get(word)
            if ids is None:
                ids = self._word(word.encode("utf-8", "replace").decode("latin-1"))
                if len(memory) >= CACHED_WORDS:
                    memory.clear()
                if len(word) < 64:
                    memory[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.blob[self.offsets[i] : self.offsets[i + 1]] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder_of(data: bytes) -> BacktrackingEncoder:
    """Built once in each Python worker."""
    return BacktrackingEncoder(read_ranks(data))


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id and ids (array<int>) of every text; see the module for nulls and repeats."""
    with open(path or vocabulary_path(), "rb") as f:
        data = f.read()
    if len(data) > MAX_FILE_BYTES:
        raise ValueError("the vocabulary file is larger than may be broadcast")
    sent = df.sparkSession.sparkContext.broadcast(data)

    def make() -> Callable:
        encode = encoder_of(sent.value).encode
        return lambda key, text: [(key, encode(text))]

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return flat_map(_once(rows), ["id", "text"], make, f"{id_col} {kind}, ids array<int>")


#: Ids that stand in several rows are sent to every executor up to this number; of more, all rows meet by id.
MAX_REPEATED = 1_000_000


def _once(rows: DataFrame) -> DataFrame:
    """One row of each id. Only the ids are counted, so texts of ids that stand alone are never shuffled."""
    repeated = cut(rows.groupBy("id").count().where("count > 1").select(F.col("id").alias("again")))
    n = repeated.count()
    if n == 0:
        return rows
    if n > MAX_REPEATED:
        return rows.dropDuplicates(["id"])
    met = F.col("id").eqNullSafe(F.col("again"))
    alone = rows.join(F.broadcast(repeated), met, "left_anti")
    return alone.unionByName(rows.join(F.broadcast(repeated), met, "left_semi").dropDuplicates(["id"]))


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """id and text of every list of ids; a null list gives a null text."""
    with open(path or vocabulary_path(), "rb") as f:
        data = f.read()
    if len(data) > MAX_FILE_BYTES:
        raise ValueError("the vocabulary file is larger than may be broadcast")
    sent = df.sparkSession.sparkContext.broadcast(data)

    def make() -> Callable:
        decode = encoder_of(sent.value).decode
        return lambda key, ids: [(key, None if ids is None else decode(ids))]

    kind = df.schema[id_col].dataType.simpleString()
    return flat_map(df, [F.col(id_col).alias("id"), F.col(ids_col).alias("ids")], make, f"{id_col} {kind}, text string")
