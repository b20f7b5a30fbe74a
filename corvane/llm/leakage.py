"""Held-out evaluation passages inside a training corpus.

Winnowing: of every WINDOW neighbouring k-word hashes the smallest is kept, on both sides, so any shared run of at least
K + WINDOW - 1 words gives a common fingerprint; a passage of 20 words with one word in eight changed always holds such a run. The
fingerprints of both sides are tables and are joined on the hash. The hits of a document and an item are then extended: they are chained
along the document and the words between them aligned, and a passage counts if at least MIN_WORDS words of the item are covered at an edit
rate up to MAX_EDITS, and if MIN_SPECIFIC of the specific words in it agree: a word in more than COMMON_SHARE of all items belongs to the
style of the questions and proves nothing.

A hash that more than HOT_OWNERS items share would meet each of its documents with all of them. It is joined by a longer run instead: of the
fingerprint and the one after it, and if that is shared as often, of 4 or of RUNS[-1] fingerprints, however many items share those. So every
span of items and document that agrees word by word and is long enough is still found; such runs are some 16 words long.

The corpus is scanned once. A document's fingerprints leave their task only if a bitmap of FILTER_BITS bits says that some item may have
them, and with them the words around them; whole texts are never shuffled. Two such bitmaps are all that is sent to every executor, and their size
doesn't depend on the data.

Null and empty texts on either side leak nothing. Items shorter than MIN_WORDS words can't hold such a passage. Repeated rows count once.
Texts are read whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import flat_map
from ..session import cut

K, WINDOW = 4, 2
#: Fingerprints in a run, from the shortest on.
RUNS = (1, 2, 4, 8)
HOT_OWNERS = 16
FILTER_BITS = 1 << 26
MIN_WORDS, MAX_EDITS = 20, 0.2
COMMON_SHARE, MIN_SPECIFIC = 0.25, 0.6
#: Specific words that any passage of MIN_WORDS words must share before it is aligned.
LEAST_SHARED = 2
#: Words between two hits that may belong to one passage.
MAX_GAP = 12
#: Words around the hits that may belong to one passage: MIN_WORDS and the edits allowed in them.
MARGIN = MIN_WORDS + 4
#: Words that agree in order in any passage: MIN_WORDS less the edits allowed in them.
LEAST_AGREE = round(MIN_WORDS * (1 - MAX_EDITS))
#: What an edit costs against a word that agrees.
EDIT_COST = 3.0
#: Hashes of words that a Python worker keeps at most.
CACHED_WORDS = 500_000

_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,60}>")
_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Words without case, punctuation, markup and line breaks."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _WORDS.findall(text.lower())


class WordIds(dict):
    """Signed 64-bit hashes of words, computed once for each word."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        n = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        self[word] = n = n - (1 << 64) if n >> 63 else n
        return n

    def of(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words_of(text)), np.int64)


_IDS = WordIds()


def _hashes(ids: np.ndarray) -> np.ndarray:
    """Of every K neighbouring word ids (unsigned 64-bit arithmetic, mixed so that the smallest is spread evenly)."""
    n = len(ids) - K + 1
    if n < 1:
        return np.array([], np.uint64)
    words, h = ids.astype(np.int64).view(np.uint64), np.zeros(n, np.uint64)
    for j in range(K):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _winnow(h: np.ndarray) -> np.ndarray:
    """Positions of the smallest hash of each window."""
    if len(h) <= WINDOW:
        return np.array([int(h.argmin())] if len(h) else [], np.int64)
    w = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    return np.unique(w.argmin(axis=1) + np.arange(len(w)))


def _runs(at: np.ndarray, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes (signed) of the runs of kept fingerprints."""
    n = max(0, len(h) - length + 1)
    run = np.full(n, np.uint64(length), np.uint64)
    for j in range(length):
        run = (run ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        run ^= run >> np.uint64(31)
    return at[:n], run.view(np.int64)


def _kept(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = _hashes(ids)
    at = _winnow(h)
    return at, h[at]


def fingerprints(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of RUNS the positions and the hashes of the runs of kept fingerprints that begin there."""
    at, h = _kept(ids)
    return [_runs(at, h, length) for length in RUNS if len(h) >= length]


def _segments(ids: np.ndarray, passes: Callable[[np.ndarray], np.ndarray], begins: Callable[[np.ndarray], np.ndarray]) -> list[tuple[int, list[int], list[int], list[int]]]:
    """Stretches of a document around the runs that pass: first word, word ids, positions and hashes of the runs. Longer runs are only made
    where a fingerprint begins one of the items' runs."""
    at, h = _kept(ids)
    if not len(h) or not begins(_runs(at, h, 1)[1]).any():
        return []
    hits = []
    for length in RUNS:
        places, run = _runs(at, h, length)
        good = passes(run)
        hits += zip(places[good].tolist(), run[good].tolist())
    hits.sort()
    groups: list[list[tuple[int, int]]] = []
    for hit in hits:
        if groups and hit[0] - groups[-1][-1][0] <= 2 * MARGIN + K:
            groups[-1].append(hit)
        else:
            groups.append([hit])
    out = []
    for g in groups:
        first, last = max(0, g[0][0] - MARGIN), min(len(ids), g[-1][0] + K + MARGIN)
        if last - first >= LEAST_AGREE:
            out.append((first, ids[first:last].tolist(), [p for p, _ in g], [h for _, h in g]))
    return out


def _extend(doc: list[int], item: list[int], seeds: list[tuple[int, int]], common: frozenset[int]) -> tuple[int, int, int, int, float] | None:
    """The best passage through the hits of one item."""
    # Hits that a passage could join lie on near diagonals and near each other.
    seeds = sorted(set(seeds))
    groups: list[list[tuple[int, int]]] = []
    for p, q in seeds:
        for g in reversed(groups):
            if p - g[-1][0] > MAX_GAP + K:
                continue
            if abs((p - q) - (g[-1][0] - g[-1][1])) <= MAX_GAP // 2:
                g.append((p, q))
                break
        else:
            groups.append([(p, q)])
    best = None
    for g in groups:
        q0, q1 = max(0, min(q for _, q in g) - MAX_GAP), min(len(item), max(q for _, q in g) + K + MAX_GAP)
        p0, p1 = max(0, g[0][0] - MAX_GAP), min(len(doc), g[-1][0] + K + MAX_GAP)
        got = None
        if q1 - q0 >= MIN_WORDS and _may_agree(doc[p0:p1], item[q0:q1], common) and len(set(doc[p0:p1]).intersection(item[q0:q1]) - common) >= LEAST_SHARED:
            got = _align(doc[p0:p1], item[q0:q1], common)
        if not got:
            # Edits near the start, or a head without hits.
            q0, q1 = max(0, min(q for _, q in g) - MARGIN), min(len(item), max(q for _, q in g) + K + MARGIN)
            p0, p1 = max(0, g[0][0] - MARGIN), min(len(doc), g[-1][0] + K + MARGIN)
            if len(set(doc[p0:p1]).intersection(item[q0:q1]) - common) >= LEAST_SHARED and _may_agree(doc[p0:p1], item[q0:q1], common):
                got = _align(doc[p0:p1], item[q0:q1], common, heads=True)
        if got and (best is None or got[2] > best[2]):
            best = (p0 + got[0], p0 + got[1], *got[2:])
    return best


def _may_agree(a: list[int], b: list[int], common: frozenset[int]) -> bool:
    """Whether a passage may be there: of its words at least MIN_WORDS less the edits allowed in them agree, in order, and of its specific
    words at least MIN_SPECIFIC of those that any MIN_WORDS words of the item hold."""
    if _agreeing(a, b) < LEAST_AGREE:
        return False
    sums = [0]
    for w in b:
        sums.append(sums[-1] + (w not in common))
    least = min((y - x for x, y in zip(sums, sums[MIN_WORDS:])), default=0)
    return _agreeing([w for w in a if w not in common], [w for w in b if w not in common]) >= MIN_SPECIFIC * least


def _agreeing(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, taken for all places of b at once as the bits of one number."""
    places: dict[int, int] = {}
    for j, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << j
    whole = free = (1 << len(b)) - 1
    for w in a:
        if m := places.get(w):
            met = free & m
            free = (free + met | free - met) & whole
    return len(b) - free.bit_count()


def _heads(a: list[int], b: list[int], common: frozenset[int]) -> list[tuple[int, int, int, int]]:
    """(words of a, words of b, edits, specific words that agreed) of the passages that end where a and b end and begin with a word that
    agrees, by edit distance; at most MARGIN words of b."""
    a, b = a[: -MARGIN - 5 : -1], b[: -MARGIN - 1 : -1]
    found = []
    above = [(j, 0) for j in range(len(b) + 1)]  # edits, and less the specific words that agreed
    for i, word in enumerate(a, 1):
        row = [(i, 0)]
        for j, w in enumerate(b, 1):
            if word == w:
                e, k = above[j - 1]
                row.append((e, k - (w not in common)))
                found.append((i, j, e, (w not in common) - k))
            else:
                e, k = min(above[j - 1], above[j], row[j - 1])
                row.append((e + 1, k))
        above = row
    return found


def _align(a: list[int], b: list[int], common: frozenset[int], heads: bool = False) -> tuple[int, int, int, int, float] | None:
    """Local alignment of words: +1 for one that agrees, -EDIT_COST for one changed, added or missing. Of the alignments found that cover at
    least MIN_WORDS words of b at the allowed rates, the one that covers most. An alignment begins anew where its score falls to 0; with
    `heads` the words before are joined to it again as far as the rates allow."""
    known: dict[tuple[int, int], list] = {}
    n = len(b)
    special = [w not in common for w in b]
    seen = [0]  # specific words of b before each place
    for x in special:
        seen.append(seen[-1] + x)
    # A cell: score, first word in a and in b, edits, specific words that agreed.
    above: list[tuple] = [(0.0, 0, j, 0, 0) for j in range(n + 1)]
    best: tuple | None = None
    for i, word in enumerate(a):
        row: list[tuple] = [(0.0, i + 1, 0, 0, 0)]
        for j in range(1, n + 1):
            same = word == b[j - 1]
            d, u, l = above[j - 1], above[j], row[j - 1]
            if same:
                s, from_a, from_b, e, k = d[0] + 1, d[1], d[2], d[3], d[4] + special[j - 1]
            else:
                s, from_a, from_b, e, k = d[0] - EDIT_COST, d[1], d[2], d[3] + 1, d[4]
            if u[0] - EDIT_COST > s:
                s, from_a, from_b, e, k = u[0] - EDIT_COST, u[1], u[2], u[3] + 1, u[4]
            if l[0] - EDIT_COST > s:
                s, from_a, from_b, e, k = l[0] - EDIT_COST, l[1], l[2], l[3] + 1, l[4]
            if s <= 0:
                row.append((0.0, i + 1, j, 0, 0))
                continue
            row.append((s, from_a, from_b, e, k))
            covered = j - from_b
            if same and covered >= MIN_WORDS and (best is None or covered > best[2]) and e <= MAX_EDITS * covered and k >= MIN_SPECIFIC * (seen[j] - seen[from_b]):
                best = (from_a, i, covered, e, e / covered)
            if same and heads:
                at = from_a, from_b
                if at not in known:
                    known[at] = _heads(a[:from_a], b[:from_b], common)
                for x, y, more, agreed in known[at]:
                    total = covered + y
                    if total >= MIN_WORDS and (best is None or total > best[2]) and e + more <= MAX_EDITS * total and k + agreed >= MIN_SPECIFIC * (seen[j] - seen[from_b - y]):
                        best = (from_a - x, i, total, e + more, (e + more) / total)
        above = row
    return best



# --- Spark --------------------------------------------------------------------------------------------------------------------------


def item_words(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item and ids of its words, of the items that are long enough."""
    once = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("t")).where("item is not null and t is not null").groupBy("item").agg(F.max("t").alias("t"))
    kind = items.schema[item_col].dataType.simpleString()

    def make() -> Callable:
        def row(item, text):
            ids = _IDS.of(text)
            return [(item, ids.tolist())] if len(ids) >= MIN_WORDS else []

        return row

    return flat_map(once, ["item", "t"], make, f"item {kind}, words array<bigint>")


def _bounds(ids: list[int], common: frozenset[int]) -> tuple[list[int], int, int]:
    """The specific words of an item, and how many different words, and different specific ones, any passage shares with the document: of the
    words of every stretch of MIN_WORDS or more, less those that edits may take away."""
    least = least_special = len(ids)
    for start in range(len(ids) - MIN_WORDS + 1):
        seen: set[int] = set()
        special: set[int] = set()
        count = 0
        for n, w in enumerate(ids[start:], 1):
            seen.add(w)
            if w not in common:
                special.add(w)
                count += 1
            if n >= MIN_WORDS:
                least = min(least, len(seen) - int(MAX_EDITS * n))
                least_special = min(least_special, len(special) - int((1 - MIN_SPECIFIC) * count))
    return sorted(set(ids) - common), least, max(least_special, LEAST_SHARED)


def _bounded(words: DataFrame, common: frozenset[int]) -> DataFrame:
    def make() -> Callable:
        return lambda item, ids: [(item, ids, *_bounds(ids, common))]

    return flat_map(words, ["item", "words"], make, f"item {words.schema['item'].dataType.simpleString()}, words array<bigint>, special array<bigint>, least int, least_special int")


def item_fingerprints(words: DataFrame, hot_owners: int) -> DataFrame:
    """hash, item, pos, head: for each fingerprint of an item the shortest of its runs that few enough items share, or else the longest, and the
    hash of the fingerprint by itself."""
    kind = words.schema["item"].dataType.simpleString()

    def make() -> Callable:
        return lambda item, ids: [(item, p, n, h) for n, (at, hashes) in zip(RUNS, fingerprints(np.array(ids, np.int64))) for p, h in zip(at.tolist(), hashes.tolist())]

    every = cut(flat_map(words, ["item", "words"], make, f"item {kind}, pos int, run int, hash bigint"))
    owners = every.select("hash", "item").distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    # A run too long to begin near the end of an item doesn't exist there; the longest that does then stands.
    fit = F.when(F.col("owners") <= hot_owners, F.col("run")).otherwise(1_000 - F.col("run"))
    return every.join(owners, "hash").groupBy("item", "pos").agg(F.min_by("hash", fit).alias("hash"), F.min_by("hash", "run").alias("head")).select("hash", "item", "pos", "head")


def _bitmap(prints: DataFrame) -> np.ndarray:
    """One bit for each place that a hash of the items falls on; at most FILTER_BITS / 64 numbers reach the driver."""
    places = prints.select(F.pmod("hash", F.lit(FILTER_BITS)).alias("bit")).selectExpr("cast(bit div 64 as int) AS at", "shiftleft(1L, cast(bit % 64 AS int)) AS w")
    rows = places.groupBy("at").agg(F.bit_or("w").alias("w")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[rows["at"].to_numpy(np.int64)] = rows["w"].to_numpy(np.int64)
    return bits.view(np.uint64)


def leaked_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", hot_owners: int = HOT_OWNERS) -> DataFrame:
    """One row for each document and item that leaked into it: ids, first_word and last_word in the document, covered words, edits, rate."""
    words = cut(item_words(items, item_col, item_text_col))
    count = words.count()
    # At most as many words as 1 / COMMON_SHARE items hold can stand in such a share of all items.
    common = frozenset(r[0] for r in words.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").count().where(F.col("count") > max(2, COMMON_SHARE * count)).select("w").collect())
    prints = cut(item_fingerprints(words, hot_owners))
    sent = docs.sparkSession.sparkContext.broadcast((_bitmap(prints), _bitmap(prints.select(F.col("head").alias("hash")))))
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()

    def cutter() -> Callable:
        mask = np.int64(FILTER_BITS - 1)

        def looks(bits: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
            return lambda h: (bits[(h & mask) >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) != 0

        passes, begins = map(looks, sent.value)
        return lambda key, text: [(key, *x) for x in _segments(_IDS.of(text), passes, begins)]

    texts = docs.where(F.col(text_col).isNotNull() & (F.length(text_col) > 0))
    segments = flat_map(texts, [F.col(id_col).alias("doc"), F.col(text_col).alias("text")], cutter, f"doc {kinds[0]}, first int, ids array<bigint>, pos array<int>, hash array<bigint>")
    segments = cut(segments.withColumn("row", F.monotonically_increasing_id()))
    light = segments.select("row", F.explode(F.arrays_zip("pos", "hash")).alias("x")).select("row", F.col("x.pos").alias("p"), F.col("x.hash").alias("hash"))
    met = light.join(prints.select("hash", "item", F.col("pos").alias("q")), "hash").groupBy("row", "item").agg(F.collect_set(F.col("p").cast("long") * (1 << 32) + F.col("q")).alias("seeds"))
    pairs = met.join(segments.select("row", "doc", "first", "ids"), "row").join(cut(_bounded(words, common)), "item")
    # What shares too few words, or too few specific ones, with the item can hold no passage of it.
    pairs = pairs.where(F.size(F.array_intersect("ids", "special")) >= F.col("least_special")).where(F.size(F.array_intersect("ids", "words")) >= F.col("least")).select("row", "item", "doc", "first", "ids", "seeds", "words")

    def extender() -> Callable:
        def row(doc, item, first, ids, seeds, item_ids):
            best = _extend(ids, item_ids, [((x >> 32) - first, x & 0xFFFFFFFF) for x in seeds], common)
            return [(doc, item, first + best[0], first + best[1], *best[2:])] if best else []

        return row

    schema = f"{id_col} {kinds[0]}, {item_col} {kinds[1]}, first_word int, last_word int, covered int, edits int, edit_rate double"
    # The rows are small and the alignment is not, so they are spread over all cores, whatever their bytes.
    pairs = pairs.repartition(3 * docs.sparkSession.sparkContext.defaultParallelism, "row", "item")
    found = flat_map(pairs, ["doc", "item", "first", "ids", "seeds", "words"], extender, schema)
    return found.groupBy(id_col, item_col).agg(F.max(F.struct("covered", (-F.col("edits")).alias("e"), (-F.col("first_word")).alias("f"), "last_word", "edit_rate")).alias("x")).select(
        id_col, item_col, (-F.col("x.f")).alias("first_word"), "x.last_word", "x.covered", (-F.col("x.e")).alias("edits"), "x.edit_rate"
    )
