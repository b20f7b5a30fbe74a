"""Keyword and vector retrieval, their fusion and the metrics of retrieval quality.

Corpora are scoped (by repository): statistics, ranks and results never cross a scope. Scores are rounded to six places before they are
ranked, and ties go to the smaller id, so results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship

# The usual parameters of Okapi BM25 and the least score that counts.
K1, B, EPSILON, LEAST_SCORE = 1.5, 0.75, 0.25, 0.01
# Rank constant and weights of the fusion.
RRF_K, VECTOR_WEIGHT, KEYWORD_WEIGHT = 60, 0.7, 0.3
#: Numbers of the query vectors that one scan of the corpus is asked with; more queries take further scans.
SCAN_NUMBERS = 8_000_000
#: Rows an index is fitted on at most, rows of a block of a cell, rounds of fitting.
INDEX_SAMPLE, CELL_ROWS, INDEX_ROUNDS = 20_000, 50_000, 12


def document_frequencies(docs: DataFrame, scope: str, tokens: Column) -> DataFrame:
    """scope, term, df. Each document's terms are made distinct in its row, so that partial counts are all that is shuffled."""
    return docs.select(scope, F.explode(F.array_distinct(tokens)).alias("term")).groupBy(scope, "term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, scope: str, tokens: Column) -> DataFrame:
    """Documents and mean length of each scope (a document without tokens counts)."""
    return docs.groupBy(scope).agg(F.count("*").alias("n"), F.avg(F.size(tokens)).alias("mean_dl"))


def _raw_idf() -> Column:
    return F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)


def term_stats(df: DataFrame, stats: DataFrame, scope: str) -> DataFrame:
    """df and idf of each term; a negative idf becomes EPSILON of the scope's mean idf."""
    raw = df.join(stats, scope).withColumn("raw", _raw_idf())
    mean = raw.groupBy(scope).agg(F.avg("raw").alias("mean_idf"))
    return raw.join(mean, scope).select(scope, "term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


def bm25(docs: DataFrame, queries: DataFrame, scope: str, key: str, tokens: Column, top: int, min_score: float = LEAST_SCORE, keep: Column | None = None) -> DataFrame:
    """query_id, scope, key, score, rank: the best documents for each query. queries: query_id, scope and terms (array<string>); a repeated
    term counts as often. keep: which documents may be found; the others still count in the statistics of the corpus. docs is read twice or three times, so let it be a written table. Only postings of asked terms are shuffled and meet the queries; hot scopes are spread by term."""
    base = docs.select(scope, key, tokens.alias("tokens"), (F.lit(True) if keep is None else keep).alias("keep"))
    stats = corpus_stats(base, scope, F.col("tokens"))
    asked = queries.select("query_id", scope, F.explode("terms").alias("term")).groupBy("query_id", scope, "term").agg(F.count("*").alias("times"))
    terms = asked.select(scope, "term").distinct()
    posts = cut(base.select(scope, key, "keep", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(terms, [scope, "term"], "left_semi").groupBy(scope, key, "keep", "dl", "term").agg(F.count("*").alias("tf")))
    raw = posts.groupBy(scope, "term").agg(F.count("*").alias("df")).join(stats, scope).withColumn("raw", _raw_idf())
    # The mean over all terms is only asked of scopes where an asked term stands in more than half of the documents.
    common = base.join(raw.where("raw < 0").select(scope).distinct(), scope, "left_semi")
    mean = document_frequencies(common, scope, F.col("tokens")).join(stats, scope).groupBy(scope).agg(F.avg(_raw_idf()).alias("mean_idf"))
    weights = raw.join(mean, scope, "left").select(scope, "term", "n", "mean_dl", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    part = F.col("idf") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean_dl")))
    scored = posts.where("keep").join(weights, [scope, "term"]).select(scope, key, "term", part.alias("part"))
    total = asked.join(scored, [scope, "term"]).groupBy("query_id", scope, key).agg(F.round(F.sum(F.col("part") * F.col("times")), 6).alias("score"))
    ranked = total.where(F.col("score") >= min_score).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", scope).orderBy(F.desc("score"), key)))
    return ranked.where(F.col("rank") <= top)


def _best(ids: list, scores: np.ndarray, keys: np.ndarray, top: int, min_score: float, skip_self: bool) -> tuple[list, list, list]:
    """The best keys of each query (a row of scores) by score, then key: positions of queries, keys, scores."""
    order = np.argsort(keys, kind="stable")
    keys, scores = keys[order], scores[:, order]
    k = min(scores.shape[1], top + skip_self)
    # The k-th best score of each row; whatever is at least as good is looked at, so ties are kept.
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    out: tuple[list, list, list] = ([], [], [])
    rows, cols = np.nonzero(scores >= np.maximum(least, min_score)[:, None])
    for i, js in zip(*_runs(rows, cols)):
        best = js[np.argsort(-scores[i, js], kind="stable")]
        taken = [j for j in best[: k + 1] if not (skip_self and keys[j] == ids[i])][:top]
        out[0].extend([i] * len(taken))
        out[1].extend(keys[taken].tolist())
        out[2].extend(scores[i, taken].tolist())
    return out


def _runs(rows: np.ndarray, cols: np.ndarray) -> tuple[list, list]:
    """The columns of each row, from sorted pairs."""
    if not len(rows):
        return [], []
    cuts = np.flatnonzero(np.diff(rows)) + 1
    return [int(r[0]) for r in np.split(rows, cuts)], np.split(cols, cuts)


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.linalg.norm(m, axis=1)
    return m / np.maximum(norms, 1e-300)[:, None], norms == 0


def nearest(corpus: DataFrame, queries: DataFrame, key: str, vector: str, top: int, min_score: float = -1.0, skip_self: bool = True, label: str | None = None) -> DataFrame:
    """query_id, key, score, rank by cosine. Exact: the stated queries meet every row. They go out in blocks of bounded size, a scan for each;
    each task keeps the best rows of each query over all it reads, and only those are shuffled. label: a column whose value must be the
    query's own. Null or zero vectors are never found."""
    ship(corpus.sparkSession)
    spark = corpus.sparkSession
    kind = corpus.schema[key].dataType.simpleString()
    group = F.col(label) if label else F.lit(0)

    def one(block: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(([r.k for r in block], np.array([r.v for r in block], np.float64).reshape(len(block), -1), np.array([r.g for r in block], object)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, groups = sent.value
            if not ids:
                return
            q, _ = _unit(q)
            held: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.array([], np.int64), np.array([], object), np.array([]))
            types = None
            for batch in batches:
                types = batch.schema.field(0).type
                keys = np.array(batch.column(0).to_pylist(), object)
                if not len(keys):
                    continue
                m, zero = _unit(np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64))
                scores = np.round(q @ m.T, 6)
                scores[:, zero] = -np.inf
                if label:
                    scores[groups[:, None] != np.array(batch.column(2).to_pylist(), object)[None, :]] = -np.inf
                new = _best(ids, scores, keys, top, min_score, skip_self)
                held = tuple(np.concatenate([a, np.array(b, a.dtype)]) for a, b in zip(held, new))
                # Of each query the best so far stay: by score, then key.
                order = np.lexsort((np.unique(held[1], return_inverse=True)[1], -held[2], held[0]))
                held = tuple(a[order] for a in held)
                place = np.arange(len(held[0])) - np.searchsorted(held[0], held[0], "left")
                held = tuple(a[place < top] for a in held)
            if len(held[0]):
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in held[0]], types), pa.array(held[1].tolist(), types), pa.array(held[2], pa.float64())], names=["query_id", key, "score"])

        rows = corpus.select(key, vector, group.alias("g")).where(F.col(vector).isNotNull() & F.col(key).isNotNull())
        return rows.mapInArrow(run, f"query_id {kind}, {key} {kind}, score double")

    found, block = [], []
    for r in queries.select(F.col(key).alias("k"), F.col(vector).alias("v"), group.alias("g")).where("k is not null and v is not null").dropDuplicates(["k"]).toLocalIterator():
        if block and (len(block) + 1) * len(r.v) > SCAN_NUMBERS:
            found.append(one(block))
            block = []
        block.append(r)
    found.append(one(block))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)))
    return ranked.where(F.col("rank") <= top)


class CellIndex:
    """An inverted file of vectors: centres fitted on a bounded sample, every row in the cell of its nearest centre."""

    def __init__(self, rows: DataFrame, centres: np.ndarray, key: str):
        self.rows, self.centres, self.key = rows, centres, key

    def search(self, queries: DataFrame, vector: str, top: int, probes: int, skip_self: bool = True) -> DataFrame:
        """query_id, key, score, rank among the rows of the `probes` nearest cells of each query. Queries and rows meet by cell; a cell of more
        than CELL_ROWS rows is cut into blocks that the queries visit one by one, so no group is unbounded by a hot cell."""
        key, kind = self.key, self.rows.schema[self.key].dataType.simpleString()
        asked = _celled(queries.select(F.col(key).alias("query_id"), F.col(vector).alias("v")), "query_id", self.centres, probes)
        sizes = self.rows.groupBy("cell", "block").count().select(F.col("cell").alias("c"), F.col("block").alias("b"))
        asked = asked.join(sizes, F.col("cell") == F.col("c")).select("query_id", "v", "c", "b")

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame({"query_id": [], key: [], "score": []})
            m, zero = _unit(np.stack(right.v.to_numpy()).astype(np.float64))
            keys, ids, out = right[key].to_numpy(object), left.query_id.tolist(), []
            for at in range(0, len(ids), 500):
                q, _ = _unit(np.stack(left.v.to_numpy()[at : at + 500]).astype(np.float64))
                scores = np.round(q @ m.T, 6)
                scores[:, zero] = -np.inf
                i, k, s = _best(ids[at : at + 500], scores, keys, top, -1.0, skip_self)
                out.append(pd.DataFrame({"query_id": [ids[at + x] for x in i], key: k, "score": s}))
            return pd.concat(out)

        met = asked.groupBy("c", "b").cogroup(self.rows.groupBy("cell", "block")).applyInPandas(meet, f"query_id {kind}, {key} {kind}, score double")
        ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)))
        return ranked.where(F.col("rank") <= top)


def _celled(rows: DataFrame, key: str, centres: np.ndarray, cells: int) -> DataFrame:
    """key, v and cell: a row for each of the nearest cells of a vector."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            m, _ = _unit(np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64))
            best = np.argsort(-(m @ c.T), axis=1, kind="stable")[:, :cells]
            at = np.repeat(np.arange(batch.num_rows), best.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(best.ravel().astype(np.int32))], names=[key, "v", "cell"])

    wide = rows.where(F.col(key).isNotNull() & F.col("v").isNotNull()).select(key, F.col("v").cast("array<double>").alias("v"))
    return wide.mapInArrow(run, f"{key} {kind}, v array<double>, cell int")


def cell_index(corpus: DataFrame, key: str, vector: str, cells: int) -> CellIndex:
    """Fits the centres by spherical k-means on at most INDEX_SAMPLE rows, chosen by hash, and puts every row into its cell."""
    ship(corpus.sparkSession)
    rows = corpus.select(key, F.col(vector).alias("v")).where(F.col(key).isNotNull() & F.col("v").isNotNull())
    n = rows.count()
    share = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = np.array([r.v for r in rows.where(share < min(1.0, 0.9 * INDEX_SAMPLE / max(1, n))).orderBy(key).select("v").limit(INDEX_SAMPLE).collect()], np.float64)
    if not len(sample):
        sample = np.zeros((1, 1))
    m, _ = _unit(sample)
    centres = m[:: max(1, len(m) // cells)][:cells]
    for _ in range(INDEX_ROUNDS):
        near = np.argmax(m @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, m)
        moved, empty = _unit(sums)
        centres = np.where(empty[:, None], centres, moved)
    placed = _celled(rows, key, centres, 1)
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("blocks"))
    return CellIndex(cut(placed.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).drop("blocks")), centres, key)


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, key: str, top: int, k: int = RRF_K, vector_weight: float = VECTOR_WEIGHT, keyword_weight: float = KEYWORD_WEIGHT) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists for each query_id; weights are normalised, a missing side adds nothing."""
    total = vector_weight + keyword_weight
    wv, wk = (vector_weight / total, keyword_weight / total) if total > 0 else (0.5, 0.5)
    v = vector_hits.select("query_id", key, F.col("rank").alias("vector_rank"))
    b = keyword_hits.select("query_id", key, F.col("rank").alias("keyword_rank"))
    both = v.join(b, ["query_id", key], "full").withColumn("score", F.round(F.coalesce(wv / (k + F.col("vector_rank")), F.lit(0.0)) + F.coalesce(wk / (k + F.col("keyword_rank")), F.lit(0.0)), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.coalesce("vector_rank", F.lit(1 << 30)), F.coalesce("keyword_rank", F.lit(1 << 30)), key)
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def retrieval_metrics(ranked: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Reciprocal rank, NDCG, precision at 1, 5 and k, first relevant rank of each query. ranked: query_id, rank, relevant (boolean). The ideal
    gain is that of the relevances returned; a query without results gets zeros."""
    rel = F.when(F.col("relevant"), 1.0).otherwise(0.0)
    cut_ = ranked.where(F.col("rank") <= k)
    per = cut_.groupBy("query_id").agg(
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_rank"),
        F.sum(rel / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum(rel).cast("int").alias("hits"),
        F.sum(F.when(F.col("rank") <= 1, rel).otherwise(0.0)).alias("h1"),
        F.sum(F.when(F.col("rank") <= 5, rel).otherwise(0.0)).alias("h5"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("hits")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    out = queries.select("query_id").join(per, "query_id", "left")
    return out.select(
        "query_id",
        F.coalesce("first_rank", F.lit(0)).alias("first_rank"),
        F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.when(F.coalesce("hits", F.lit(0)) > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg"),
        F.round(F.coalesce("h1", F.lit(0.0)), 6).alias("p1"),
        F.round(F.coalesce(F.col("h5") / 5, F.lit(0.0)), 6).alias("p5"),
        F.round(F.coalesce(F.col("hits") / k, F.lit(0.0)), 6).alias("pk"),
    )


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """One row: queries, queries with a relevant result, means of the metrics (0 where there is no query)."""
    means = ("reciprocal_rank", "ndcg", "p1", "p5", "pk")
    return per_query.agg(F.count("*").alias("queries"), F.count_if(F.col("first_rank") > 0).alias("answered"), *(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"mean_{c}") for c in means))


def first_seen(results: DataFrame, key: str, scope: str, order: list[str], top: int) -> DataFrame:
    """Results of several queries of a scope as one list: each key where it comes first, in the order of the lists."""
    first = results.groupBy(scope, key).agg(F.min(F.struct(*order)).alias("o"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(scope).orderBy("o", key)))
    return placed.where(F.col("place") <= top).select(scope, key, "o.*", "place")


def reranked(ranked: DataFrame, query: str, key: str, top: int, score: Column | None = None) -> DataFrame:
    """query, key, final_score and final_rank. score: what a model gives for each row; without it, or where it is null, the rank and the score
    that a row has stay what they are, after all rows that were given one."""
    given = F.lit(None).cast("double") if score is None else score
    order = Window.partitionBy(query).orderBy(F.desc_nulls_last("given"), "rank", key)
    placed = ranked.withColumn("given", given).withColumn("final_rank", F.row_number().over(order))
    return placed.where(F.col("final_rank") <= top).select(query, key, F.coalesce("given", "score").alias("final_score"), "final_rank")
