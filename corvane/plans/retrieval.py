"""Queries of keyword, vector and hybrid search, with their metrics, filters, indexes and shaping of results.

All of them take every token of every text; those named capped_... index the first 512 tokens of a chunk only, for comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import lenses, retrieval
from ..session import cut, table

#: Terms of the keyword query asked of every repository.
ASKED = ["restore", "token", "cache", "token"]
#: Questions of the search that asks several times, results of each side of a fusion, and of a search.
VARIANTS = [["restore", "cache"], ["token", "key"], ["cache", "shard", "queue"]]
CANDIDATES, TOP = 20, 10
#: Cells of the vector index and cells visited.
CELLS, PROBES = 16, 12


def _indexed(spark: SparkSession, sf: str, limit: int | None = None, *more: str) -> DataFrame:
    c = lenses.chunks(spark, sf, "repo_id", "name", "docstring", "content", *more)
    return c.select("repo_id", "chunk_id", t.code_tokens(t.index_text(F.col("name"), F.col("docstring"), F.col("content")), limit).alias("tokens"), *more)


def _token_heads(indexed: DataFrame) -> DataFrame:
    return indexed.select("chunk_id", F.size("tokens").alias("n_tokens"), F.array_join(F.slice("tokens", 1, 10), " ").alias("head"))


def _terms(indexed: DataFrame) -> DataFrame:
    docs = cut(indexed)
    frequencies = retrieval.document_frequencies(docs, "repo_id", F.col("tokens"))
    out = retrieval.term_stats(frequencies, retrieval.corpus_stats(docs, "repo_id", F.col("tokens")), "repo_id")
    return out.select("repo_id", "term", "df", F.round("idf", 6).alias("idf"))


def _search(spark: SparkSession, sf: str, indexed: DataFrame) -> DataFrame:
    docs = cut(indexed)
    queries = table(spark, sf, "repositories").select("repo_id", F.lit(1).alias("query_id"), F.array(*map(F.lit, ASKED)).alias("terms"))
    return retrieval.bm25(docs, queries, "repo_id", "chunk_id", F.col("tokens"), TOP).select("repo_id", "chunk_id", "score", "rank")


def tokenize_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _token_heads(_indexed(spark, sf))


def capped_tokenize_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _token_heads(_indexed(spark, sf, t.MAX_TOKENS))


def bm25_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequency and weight of every term of every repository."""
    return _terms(_indexed(spark, sf))


def top_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Number of terms of each repository and the ten that most chunks hold."""
    n = retrieval.document_frequencies(_indexed(spark, sf), "repo_id", F.col("tokens"))
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("df"), "term"))
    head = n.withColumn("place", place).where("place <= 10").groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("t"))
    return n.groupBy("repo_id").agg(F.count("*").alias("terms")).join(head, "repo_id").select("repo_id", "terms", F.array_join("t.term", " ").alias("top"))


def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, _indexed(spark, sf))


def capped_bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, _indexed(spark, sf, t.MAX_TOKENS))


def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The same search among the Python methods and functions; weights are those of the whole repository."""
    docs = cut(_indexed(spark, sf, None, "language", "chunk_type"))
    queries = table(spark, sf, "repositories").select("repo_id", F.lit(1).alias("query_id"), F.array(*map(F.lit, ASKED)).alias("terms"))
    keep = F.coalesce((F.col("language") == "python") & F.col("chunk_type").isin("function", "method"), F.lit(False))
    return retrieval.bm25(docs, queries, "repo_id", "chunk_id", F.col("tokens"), TOP, keep=keep).select("repo_id", "chunk_id", "score", "rank")


def multi_query_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every repository asked several ways; a chunk stands where it is found first, and brings its content."""
    docs = cut(_indexed(spark, sf))
    asked = [table(spark, sf, "repositories").select("repo_id", F.lit(i).alias("query_id"), F.array(*map(F.lit, v)).alias("terms")) for i, v in enumerate(VARIANTS)]
    found = retrieval.bm25(docs, reduce(DataFrame.unionByName, asked), "repo_id", "chunk_id", F.col("tokens"), TOP)
    merged = retrieval.first_seen(found, "chunk_id", "repo_id", ["query_id", "rank"], TOP)
    content = lenses.chunks(spark, sf, "content", "file_path", "start_line")
    return merged.join(content, "chunk_id").select("repo_id", "chunk_id", "query_id", "place", "file_path", "start_line", F.md5("content").alias("digest"))


def citations(spark: SparkSession, sf: str) -> DataFrame:
    """The five best chunks of each repository as sources: place, file, lines, score to four places."""
    hits = bm25_search(spark, sf).where("rank <= 5")
    return hits.join(lenses.chunks(spark, sf, "file_path", "name", "start_line", "end_line"), "chunk_id").select("repo_id", "rank", "file_path", "name", "start_line", "end_line", F.round("score", 4).alias("score"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0")


def vector_search(spark: SparkSession, sf: str) -> DataFrame:
    corpus = table(spark, sf, "embeddings")
    return retrieval.nearest(corpus, _asked(spark, sf), "vec_id", "embedding", TOP).select("query_id", "vec_id", "score", "rank")


def vector_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The same search among the vectors of the query's own label."""
    corpus = table(spark, sf, "embeddings")
    return retrieval.nearest(corpus, _asked(spark, sf), "vec_id", "embedding", TOP, min_score=0.2, label="label").select("query_id", "vec_id", "score", "rank")


def indexed_search(spark: SparkSession, sf: str) -> DataFrame:
    """The same search by an index that holds every vector; the recall against vector_search stands in the README."""
    index = retrieval.cell_index(table(spark, sf, "embeddings"), "vec_id", "embedding", CELLS)
    return index.search(_asked(spark, sf), "embedding", TOP, PROBES).select("query_id", "vec_id", "score", "rank")


def fresh_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Requests whose question was answered in the hour before, by the latest such answer of the repository."""
    r = lenses.requests(spark, sf, "repo_id", "question", "asked_at").where("repo_id is not null and question is not null and asked_at is not null")
    w = Window.partitionBy("repo_id", "question").orderBy("asked_at", "request_id")
    before = r.select("request_id", "asked_at", F.lag("request_id").over(w).alias("source"), F.lag("asked_at").over(w).alias("stored_at"))
    return before.where("source is not null and asked_at < stored_at + interval 1 hour").select("request_id", "source")


def semantic_cache(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest stored vector of each question, and whether it is near enough to answer from."""
    best = retrieval.nearest(table(spark, sf, "embeddings"), _asked(spark, sf), "vec_id", "embedding", 1)
    return best.select("query_id", "vec_id", "score", (F.col("score") >= 0.5).alias("hit"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.lit(0).alias("corpus"), F.col("doc_id").alias("vec_id"), t.code_tokens(F.col("text")).alias("tokens"))


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = cut(_documents(spark, sf))
    vectors = retrieval.nearest(table(spark, sf, "embeddings"), _asked(spark, sf), "vec_id", "embedding", CANDIDATES, skip_self=False)
    queries = docs.join(_asked(spark, sf).select("vec_id"), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "corpus", F.col("tokens").alias("terms"))
    return vectors, retrieval.bm25(docs, queries, "corpus", "vec_id", F.col("tokens"), CANDIDATES)


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Vector and keyword search over the documents, fused. Asked with every token of each query document."""
    fused = retrieval.fuse(*_sides(spark, sf), "vec_id", TOP)
    return fused.select("query_id", F.col("vec_id").alias("doc_id"), "vector_rank", "keyword_rank", "score", "rank")


def reranked_search(spark: SparkSession, sf: str) -> DataFrame:
    """The order of the search where no model reranks it: places and scores stay."""
    return retrieval.reranked(hybrid_search(spark, sf), "query_id", "doc_id", 5)


def one_sided_search(spark: SparkSession, sf: str) -> DataFrame:
    """The fusion with one side left empty: the vectors alone."""
    vectors = retrieval.nearest(table(spark, sf, "embeddings"), _asked(spark, sf), "vec_id", "embedding", CANDIDATES, skip_self=False)
    fused = retrieval.fuse(vectors, vectors.limit(0), "vec_id", TOP, vector_weight=1.0, keyword_weight=0.0)
    return fused.select("query_id", F.col("vec_id").alias("doc_id"), "vector_rank", "score", "rank")


def retrieval_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of the vector search, where a result of the query's label is relevant."""
    v = table(spark, sf, "embeddings").select("vec_id", "label")
    hits = retrieval.nearest(table(spark, sf, "embeddings"), _asked(spark, sf), "vec_id", "embedding", TOP)
    judged = hits.join(v, "vec_id").join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want")), "query_id").withColumn("relevant", F.col("label") == F.col("want"))
    return retrieval.retrieval_metrics(judged, _asked(spark, sf).select(F.col("vec_id").alias("query_id")))


def retrieval_means(spark: SparkSession, sf: str) -> DataFrame:
    """Means of the quality over all queries."""
    return retrieval.mean_metrics(retrieval_quality(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (top_terms, bm25_filtered, multi_query_search, citations, vector_filtered, indexed_search, fresh_answers, reranked_search, one_sided_search, retrieval_means, tokenize_chunks, bm25_terms, bm25_search, vector_search, semantic_cache, hybrid_search, retrieval_quality, capped_tokenize_chunks, capped_bm25_search)
}


def _tokens(text: str, cap: str = "") -> str:
    return (
        rf"list_transform(list_filter(string_split_regex(translate(regexp_replace(regexp_replace({text}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_-', '  '), '[^a-zA-Z0-9]+'), lambda x: length(x) >= 2), lambda x: lower(x)){cap}"
    )


def _indexed_sql(cap: str = "", more: str = "") -> str:
    text = "concat_ws(' ', nullif(name, ''), nullif(name, ''), nullif(name, ''), nullif(docstring, ''), nullif(content, ''))"
    return f"""{lenses.SQL["chunks"]}, indexed AS (
  SELECT repo_id, chunk_id, coalesce({_tokens(text, cap)}, []) AS tokens{more} FROM chunks)"""


_INDEXED, _CAPPED = _indexed_sql(), _indexed_sql("[1:512]")


def _weights(source: str, scope: str, key: str) -> str:
    return f"""stats AS (SELECT {scope}, count(*) AS n, avg(len(tokens)) AS mean_dl FROM {source} GROUP BY ALL),
posts AS (SELECT {scope}, {key}, dl, term, count(*) AS tf FROM (SELECT {scope}, {key}, len(tokens) AS dl, unnest(tokens) AS term FROM {source}) GROUP BY ALL),
raws AS (SELECT p.{scope}, term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM posts p JOIN stats s ON s.{scope} = p.{scope} GROUP BY p.{scope}, term),
terms AS (SELECT {scope}, term, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY {scope}) ELSE raw END AS idf FROM raws)"""


def _scored(scope: str, key: str) -> str:
    return f"""SELECT q.query_id, p.{scope}, p.{key}, round(sum(t.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / s.mean_dl))), 6) AS score
FROM asked q JOIN posts p ON p.{scope} = q.{scope} AND p.term = q.term JOIN terms t ON t.{scope} = p.{scope} AND t.term = p.term JOIN stats s ON s.{scope} = p.{scope} GROUP BY ALL"""


_NEAR = """SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
FROM embeddings q JOIN embeddings e ON {join} WHERE q.vec_id % 100 = 0"""
_BEST = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM ({})"



def _search_sql(indexed: str, asked: str, where: str = "true") -> str:
    return f"""WITH {indexed}, {_weights("indexed", "repo_id", "chunk_id")}, asked AS ({asked}),
scored AS (SELECT * FROM ({_scored("repo_id", "chunk_id")}) JOIN (SELECT chunk_id, {where} AS kept FROM chunks) USING (chunk_id) WHERE kept),
ranked AS (SELECT query_id, repo_id, chunk_id, score, row_number() OVER (PARTITION BY query_id, repo_id ORDER BY score DESC, chunk_id)::INT AS rank FROM scored WHERE score >= 0.01)"""


_ONE = f"SELECT 1 AS query_id, repo_id, unnest({ASKED!r}) AS term FROM repositories"
_MANY = " UNION ALL ".join(f"SELECT {i} AS query_id, repo_id, unnest({v!r}) AS term FROM repositories" for i, v in enumerate(VARIANTS))
_HEADS = "SELECT chunk_id, len(tokens)::INT AS n_tokens, array_to_string(tokens[1:10], ' ') AS head FROM indexed"
_RANKED = "SELECT repo_id, chunk_id, score, rank FROM ranked WHERE rank <= 10"
ORACLES = {
    "tokenize_chunks": f"WITH {_INDEXED} {_HEADS}",
    "capped_tokenize_chunks": f"WITH {_CAPPED} {_HEADS}",
    "top_terms": f"""WITH {_INDEXED}, n AS (SELECT repo_id, term, count(*) AS df FROM (SELECT repo_id, unnest(list_distinct(tokens)) AS term FROM indexed) GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY df DESC, term) AS place FROM n)
SELECT repo_id, count(*) AS terms, string_agg(term, ' ' ORDER BY place) FILTER (place <= 10) AS top FROM p GROUP BY 1""",
    "bm25_search": f"{_search_sql(_INDEXED, _ONE)} {_RANKED}",
    "capped_bm25_search": f"{_search_sql(_CAPPED, _ONE)} {_RANKED}",
    "bm25_filtered": f"""{_search_sql(_INDEXED, _ONE, "coalesce(language = 'python' AND chunk_type IN ('function', 'method'), false)")} {_RANKED}""",
    "multi_query_search": f"""{_search_sql(_INDEXED, _MANY)}, f AS (SELECT repo_id, chunk_id, min({{'q': query_id, 'r': rank}}) AS o FROM ranked WHERE rank <= 10 GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY o, chunk_id)::INT AS place FROM f)
SELECT p.repo_id, p.chunk_id, o.q AS query_id, place, c.file_path, c.start_line, md5(c.content) AS digest FROM p JOIN chunks c ON c.chunk_id = p.chunk_id WHERE place <= 10""",
    "citations": f"{_search_sql(_INDEXED, _ONE)} SELECT r.repo_id, r.rank, c.file_path, c.name, c.start_line, c.end_line, round(r.score, 4) AS score FROM ranked r JOIN chunks c ON c.chunk_id = r.chunk_id WHERE rank <= 5",
    "vector_filtered": f"SELECT query_id, vec_id, score, rank FROM ({_BEST.format(_NEAR.format(join='e.vec_id <> q.vec_id AND e.label = q.label') + ' AND round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) >= 0.2')}) WHERE rank <= 10",
    "fresh_answers": f"""WITH {lenses.SQL["requests"]}, b AS (SELECT request_id, asked_at, lag(request_id) OVER w AS source, lag(asked_at) OVER w AS stored_at FROM requests WHERE repo_id IS NOT NULL AND question IS NOT NULL AND asked_at IS NOT NULL WINDOW w AS (PARTITION BY repo_id, question ORDER BY asked_at, request_id))
SELECT request_id, source FROM b WHERE source IS NOT NULL AND asked_at < stored_at + INTERVAL 1 HOUR""",
    "one_sided_search": f"""WITH v AS (SELECT query_id, vec_id AS doc_id, rank AS vector_rank FROM ({_BEST.format(_NEAR.format(join="true"))}) WHERE rank <= 20), s AS (SELECT *, round(1.0::DOUBLE / (60 + vector_rank), 6) AS score FROM v)
SELECT * FROM (SELECT query_id, doc_id, vector_rank, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_rank, doc_id)::INT AS rank FROM s) WHERE rank <= 10""",
    "bm25_terms": f"WITH {_INDEXED}, {_weights('indexed', 'repo_id', 'chunk_id')} SELECT repo_id, term, df, round(idf, 6) AS idf FROM terms",
    "vector_search": f"SELECT * FROM ({_BEST.format(_NEAR.format(join='e.vec_id <> q.vec_id'))}) WHERE rank <= 10",
    "semantic_cache": f"SELECT query_id, vec_id, score, score >= 0.5 AS hit FROM ({_BEST.format(_NEAR.format(join='e.vec_id <> q.vec_id'))}) WHERE rank = 1",
    "hybrid_search": f"""WITH docs AS (SELECT 0 AS corpus, doc_id AS vec_id, coalesce({_tokens("text")}, []) AS tokens FROM documents), {_weights("docs", "corpus", "vec_id")},
asked AS (SELECT d.vec_id AS query_id, 0 AS corpus, unnest(d.tokens) AS term FROM docs d JOIN embeddings e ON e.vec_id = d.vec_id WHERE d.vec_id % 100 = 0),
scored AS ({_scored("corpus", "vec_id")}),
words AS (SELECT * FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS keyword_rank FROM scored WHERE score >= 0.01) WHERE keyword_rank <= 20),
vectors AS (SELECT query_id, vec_id, rank AS vector_rank FROM ({_BEST.format(_NEAR.format(join="true"))}) WHERE rank <= 20),
fused AS (SELECT query_id, vec_id, vector_rank, keyword_rank, round(coalesce(0.7 / (60 + vector_rank), 0) + coalesce(0.3 / (60 + keyword_rank), 0), 6) AS score FROM vectors FULL JOIN words USING (query_id, vec_id))
SELECT query_id, vec_id AS doc_id, vector_rank, keyword_rank, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(vector_rank, 1073741824), coalesce(keyword_rank, 1073741824), vec_id)::INT AS rank FROM fused) WHERE rank <= 10""",
    "retrieval_quality": f"""WITH hits AS (SELECT * FROM ({_BEST.format(_NEAR.format(join='e.vec_id <> q.vec_id'))}) WHERE rank <= 10),
judged AS (SELECT h.*, CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END AS rel FROM hits h JOIN embeddings a ON a.vec_id = h.vec_id JOIN embeddings b ON b.vec_id = h.query_id),
per AS (SELECT query_id, min(CASE WHEN rel = 1 THEN rank END) AS first_rank, sum(rel / log2(rank + 1)) AS dcg, sum(rel)::INT AS hits, sum(CASE WHEN rank <= 1 THEN rel ELSE 0 END) AS h1, sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS h5 FROM judged GROUP BY 1)
SELECT e.vec_id AS query_id, coalesce(first_rank, 0)::INT AS first_rank, round(coalesce(1 / first_rank::DOUBLE, 0), 6) AS reciprocal_rank,
round(CASE WHEN hits > 0 THEN dcg / list_sum(list_transform(range(1, hits + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6)::DOUBLE AS ndcg,
round(coalesce(h1, 0), 6)::DOUBLE AS p1, round(coalesce(h5 / 5, 0), 6)::DOUBLE AS p5, round(coalesce(hits / 10, 0), 6)::DOUBLE AS pk
FROM embeddings e LEFT JOIN per ON per.query_id = e.vec_id WHERE e.vec_id % 100 = 0""",
}
ORACLES["retrieval_means"] = f"""SELECT count(*) AS queries, count(*) FILTER (first_rank > 0) AS answered, {", ".join(f"round(coalesce(avg({c}), 0), 6) AS mean_{c}" for c in ("reciprocal_rank", "ndcg", "p1", "p5", "pk"))} FROM ({ORACLES["retrieval_quality"]})"""
ORACLES["reranked_search"] = f"SELECT query_id, doc_id, score AS final_score, rank AS final_rank FROM ({ORACLES['hybrid_search']}) WHERE rank <= 5"
