import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import text as t
from corvane.operators import chunkers, code_graph, packing, retrieval, scanning, store
from corvane.sources import files as source_files
from corvane.streaming import jobs


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "value, want",
    [("hashPassword", ["hash", "password"]), ("verify_user_token", ["verify", "user", "token"]), ("HTTPSConnection", ["https", "connection"]), ("a + b = c", []), (None, []), ("", [])],
)
def test_code_tokens(spark, value, want):
    assert one(spark, value, t.code_tokens) == want


def test_token_estimates_and_routes(spark):
    assert [one(spark, v, t.token_estimate) for v in (None, "", "ab", "a" * 9)] == [0, 0, 1, 2]
    assert one(spark, "Is this unsafe design?", t.task_type) == "security"
    assert one(spark, None, t.task_type) == "code_qa"
    assert one(spark, "abcde", lambda c: t.fixed_blocks(c, 2)) == ["ab", "cd", "e"]
    assert one(spark, "", lambda c: t.fixed_blocks(c, 2)) == []


def test_error_signal(spark):
    df = spark.createDataFrame([("KeyError: 'user_id' in verify_token at auth/middleware.py:52",), ("boom (payments/processor.py line 88)",), (None,)], "x string")
    rows = df.select(*(c.alias(k) for k, c in t.error_signal(F.col("x")).items())).collect()
    assert tuple(rows[0]) == ("KeyError", "auth/middleware.py", 52, "verify_token")
    assert (rows[1].file_path, rows[1].line_number) == ("payments/processor.py", 88)
    assert tuple(rows[2]) == (None, None, None, None)


CORPUS = [("r", "1", "hash password in auth"), ("r", "2", "verify token in auth"), ("r", "3", "database connect"), ("q", "4", "hash hash table"), ("r", "5", None)]


def test_bm25_against_the_formula(spark):
    docs = spark.createDataFrame(CORPUS, "scope string, id string, x string").select("scope", "id", t.code_tokens(F.col("x")).alias("tokens"))
    queries = spark.createDataFrame([(1, "r", ["password", "password", "auth"])], "query_id int, scope string, terms array<string>")
    got = {r.id: r.score for r in retrieval.bm25(docs, queries, "scope", "id", F.col("tokens"), 10).collect()}
    words = {i: (x or "").split() for s, i, x in CORPUS if s == "r"}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    vocabulary = {w for ws in words.values() for w in ws}
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w in vocabulary for d in [sum(w in ws for ws in words.values())]}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    for i, ws in words.items():
        want = sum(idf[w] * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w in ("password", "password", "auth") if w in ws)
        assert got.get(i, 0.0) == pytest.approx(want, abs=1e-6) or want < 0.01


def test_nearest_against_brute_force_with_null_and_zero_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)] + [(500, None), (501, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    got = {}
    for r in retrieval.nearest(df, df.where("id % 40 = 0"), "id", "v", 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and any(v)}
    for q, found in got.items():
        want = sorted(((-round(float(unit[q] @ u), 6), i) for i, u in unit.items() if i != q))[:5]
        assert [i for _, i in sorted(found)] == [i for _, i in want]


def test_fusion_and_metrics(spark):
    v = spark.createDataFrame([(1, "A", 1), (1, "B", 2)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(1, "A", 1), (1, "C", 2)], "query_id int, id string, rank int")
    fused = [r.id for r in retrieval.fuse(v, b, "id", 10).orderBy("rank").collect()]
    assert fused == ["A", "B", "C"]
    ranked = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, True)], "query_id int, rank int, relevant boolean")
    m = {r.query_id: r for r in retrieval.retrieval_metrics(ranked, spark.createDataFrame([(1,), (2,), (3,)], "query_id int")).collect()}
    assert (m[1].reciprocal_rank, m[2].reciprocal_rank, m[3].reciprocal_rank) == (0.5, 1.0, 0.0)
    assert m[1].ndcg == pytest.approx(1 / math.log2(3), abs=1e-6) and m[2].ndcg == 1.0 and m[3].ndcg == 0.0


EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("a", "b")]


def test_traversals_on_a_cyclic_graph(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    start = spark.createDataFrame([("a",)], "id string")
    assert {(r.id, r.depth) for r in code_graph.reach(start, edges, 5).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert {r.id: "".join(r.path) for r in code_graph.shortest_paths(start, edges, 5).collect()} == {"a": "a", "b": "ab", "c": "ac", "d": "acd"}
    walks = {"".join(r.path) for r in code_graph.trails(start, edges, 3).collect()}
    assert walks == {"ab", "ac", "abc", "aca", "acd", "abca", "abcd", "acab"}


def test_degrees_of_isolated_nodes(spark):
    nodes = spark.createDataFrame([("a", "r"), ("b", "r"), ("z", "r")], "id string, repo_id string")
    d = {r.id: r for r in code_graph.degrees(nodes, spark.createDataFrame([("a", "b")], "src string, dst string")).collect()}
    assert d["a"].entry and not d["b"].entry and d["z"].isolated and d["a"].centrality == 1.0


def test_budgets(spark):
    df = spark.createDataFrame([("g", "a", 9, 700), ("g", "b", 8, 200), ("g", "c", 7, 90), ("h", "x", 1, 5000)], "g string, k string, p int, c int")
    assert {(r.g, r.k) for r in packing.prefix_budget(df, "g", [F.desc("p")], "c", 800).collect()} == {("g", "a"), ("h", "x")}
    assert {(r.g, r.k, r.used) for r in packing.greedy_pack(df, "g", "k", "p", "c", 800).collect()} == {("g", "a", 700), ("g", "c", 790)}
    means = [r["mean"] for r in packing.running_mean(df.where("g = 'g'"), "g", [F.col("k")], "c", 0.1).orderBy("k").collect()]
    assert means == pytest.approx([700, 650, 594])


LINES = {
    "SEC001": 'q = f"SELECT * FROM t WHERE id = {user}"', "SEC002": 'password = "hunter22"', "SEC003": "pickle.loads(x)", "SEC004": "subprocess.run(cmd, shell=True)", "SEC005": "open(request.path)", "SEC006": "hashlib.md5(x)",
    "SEC007": "random.randint(1, 2)", "SEC008": "debug = True", "SEC009": "jwt.decode(t, verify_signature=False)", "SEC010": 'allow_origins=["*"]', "SEC011": "el.innerHTML = x", "SEC012": "requests.get(request.args)", "SEC013": "Template(request.args)",
    "SEC014": "redirect(request.args)", "SEC015": "lxml.parse(x, resolve_entities = True)",
}


def test_every_line_rule_fires_and_clean_code_does_not(spark):
    df = spark.createDataFrame([(k, "def add(a, b):\n" + v, 10) for k, v in LINES.items()] + [("clean", "def add(a, b):\n    return a + b", 1), ("null", None, 1)], "k string, x string, s int")
    got = {(r.k, r.rule, r.line) for r in scanning.line_findings(df, "k", "x", "s").collect()}
    assert {(k, k, 11) for k in LINES} <= got and not any(k in ("clean", "null") for k, *_ in got)
    bugs = spark.createDataFrame([(1, "try:\n  f()\nexcept:\n  pass"), (2, "# todo later"), (3, "x = 1")], "k int, x string")
    assert {(r.k, r.title) for r in scanning.text_findings(bugs, "k", "x").collect()} == {(1, "Swallowed exception"), (2, "Pending fragile code marker")}


SAMPLE = '''import os
from .pkg import thing
class Dog(Animal, FetchMixin):
    """Says."""
    @staticmethod
    def bark(x):
        if x and os:
            return loud(x)
    async def run(self): pass
def outer():
    def inner():
        return 1
    return inner()
'''


def test_python_symbols(spark):
    df = spark.createDataFrame([("f", SAMPLE), ("bad", "def broken(:\n"), ("null", None), ("blank", " ")], "file_id string, content string")
    rows = {(r.kind, r.name): r for r in chunkers.python_symbols(df).where("file_id = 'f'").collect()}
    assert set(rows) == {("class", "Dog"), ("method", "bark"), ("async_method", "run"), ("function", "outer"), ("function", "inner")}
    assert rows["class", "Dog"].bases == "Animal, FetchMixin" and rows["class", "Dog"].documented and rows["method", "bark"].parent == "Dog" and rows["method", "bark"].calls == "loud" and rows["method", "bark"].branches == 3
    assert (rows["class", "Dog"].start_line, rows["class", "Dog"].end_line, rows["method", "bark"].end_line, rows["function", "inner"].end_line) == (3, 9, 8, 12)
    # A file that doesn't parse gives its symbols, null and blank ones give none.
    assert [(r.file_id, r.name) for r in chunkers.python_symbols(df).where("file_id <> 'f'").collect()] == [("bad", "broken")]
    assert {r.module for r in chunkers.python_imports(df).collect()} == {"os", ".pkg"}


def test_upsert_and_edges(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 1), (None, 5)], "k string, v int")
    assert sorted(((r.k or "", r.v) for r in store.upsert(old, new, "k").collect())) == [("", 5), ("a", 1), ("b", 3), ("c", 1)]
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b", "X"), ("a", "b", "X"), ("a", "z", "X")], "src string, dst string, rel_type string")
    assert store.merge_edges(edges, nodes).count() == 1
    with pytest.raises(Exception, match="length 2"):
        store.check_dimension(spark.createDataFrame([([1.0, 2.0],)], "v array<double>"), "v", 3).collect()


def test_scan(spark, tmp_path):
    for name, text in {"a.py": "x\ny\n", "pkg/b.TS": "z", "node_modules/c.js": "z", "yarn.lock": "z", "d.bin": "z", "big.py": "x" * (1 << 20) + "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "latin.go").write_bytes(b"// caf\xe9 \xff\xfe\nx")
    rows = source_files.scan(spark, str(tmp_path)).collect()
    got = {r.relative_path: (r.language, r.line_count) for r in rows}
    assert got == {"a.py": ("python", 3), "pkg/b.TS": ("typescript", 1), "latin.go": ("go", 2)}
    assert next(r.content for r in rows if r.relative_path == "latin.go").startswith("// caf\ufffd")


def test_streams_give_each_row_once_over_late_files_and_restarts(spark, tmp_path):
    first = [("r1", "p", 5, "2025-03-01 10:00:00"), ("r1", "p", 5, "2025-03-01 10:00:00"), ("r2", "p", None, "2025-03-01 23:00:00"), ("r3", None, 1, "2025-03-02 01:00:00")]
    second = [("r4", "p", 7, "2025-04-20 09:00:00"), ("r2", "p", None, "2025-03-01 23:00:00")]
    third = [("r5", "p", 1, "2025-03-01 08:00:00"), ("r4", "p", 7, "2025-04-20 09:00:00"), ("r6", "q", 2, None)]  # seven weeks late
    folder, name = str(tmp_path / "log"), f"t{tmp_path.name}"

    def write(rows):
        df = spark.createDataFrame(rows, "request_id string, provider_used string, estimated_tokens int, at string").withColumn("asked_at", F.col("at").cast("timestamp_ntz")).drop("at")
        df.coalesce(1).write.mode("append").parquet(folder)
        return df.schema

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        return jobs.run(jobs.first_requests(stream).drop("at"), "append", name=name)

    schema = write(first)
    write(second)
    assert sorted(r.request_id for r in run().collect()) == ["r1", "r2", "r3", "r4"]
    assert sorted(r.request_id for r in run().collect()) == ["r1", "r2", "r3", "r4"]  # a restart without new files
    write(third)
    seen = run()
    assert sorted(r.request_id for r in seen.collect()) == ["r1", "r2", "r3", "r4", "r5"]
    assert {tuple(r) for r in jobs.daily_usage(seen).collect()} == {("2025-03-01", "p", 3, 6), ("2025-04-20", "p", 1, 7)}


def test_a_window_that_grows_in_a_later_batch_is_counted_once(spark, tmp_path):
    folder, name = str(tmp_path / "events"), f"e{tmp_path.name}"
    rows = lambda *x: spark.createDataFrame([(k, v, t) for k, v, t in x], "event_type string, value double, t string").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    schema = rows(("a", 1.0, "2025-01-01 10:00:00")).schema
    for r in ((("a", 1.0, "2025-01-01 10:00:00"), ("b", 2.0, "2025-01-01 11:00:00")), (("a", 3.0, "2025-01-01 12:00:00"),)):
        rows(*r).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        got = {tuple(x) for x in jobs.run(jobs.event_counts(stream), "update", ["day", "event_type"], name=name).collect()}
    assert got == {("2025-01-01", "a", 2, 2.0), ("2025-01-01", "b", 1, 2.0)}


def test_hashed_vectors(spark):
    from corvane.operators import vectors

    df = spark.createDataFrame([(1, "open the cache"), (2, "open the cache"), (3, None), (4, "")], "id long, x string")
    got = {r.id: r.vector for r in vectors.hashed_vectors(df, "id", "x", 16).collect()}
    assert got[1] == got[2] and sum(v * v for v in got[1]) == pytest.approx(1, abs=1e-5)
    assert got[3] == got[4] == [0.0] * 16


@pytest.mark.parametrize("interpolate", [True, False])
def test_exact_percentiles_against_numpy(spark, interpolate):
    rng = np.random.default_rng(3)
    groups = {"even": rng.normal(size=501).round(2).tolist(), "skewed": [1.0] * 400 + (10 ** rng.uniform(0, 9, 37)).tolist(), None: [5.0], "equal": [2.0] * 9}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("null", None)], "g string, v double").repartition(5)
    got = {r.g: (r.a, r.b) for r in packing.exact_percentiles(df.withColumnRenamed("g", "group"), ["group"], "v", {"a": 0.5, "b": 0.95}, interpolate).withColumn("g", F.col("group")).collect()}
    for g, vs in groups.items():
        want = [np.percentile(vs, p, method="linear" if interpolate else "lower") for p in (50, 95)]
        assert got[g] == pytest.approx(tuple(want))
    assert set(got) == set(groups)


def test_running_means_over_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [("hot", i, float(v)) for i, v in enumerate(rng.normal(size=700))] + [("one", 0, 5.0), ("two", 1, 2.0), ("two", 2, 4.0)]
    got = {(r.g, r.i): r.mean for r in packing.running_mean(spark.createDataFrame(rows, "g string, i int, v double").repartition(7), "g", ["i"], "v", 0.1).collect()}
    mean = None
    for g, i, v in rows[:700]:
        mean = v if mean is None else 0.1 * v + 0.9 * mean
        assert got[g, i] == pytest.approx(mean)
    assert got["one", 0] == 5.0 and got["two", 2] == pytest.approx(0.1 * 4 + 0.9 * 2) and len(got) == len(rows)


def test_packing_refuses_groups_without_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_ITEMS", 2)
    df = spark.createDataFrame([("g", str(i), 1, 1) for i in range(3)], "g string, k string, p int, c int")
    with pytest.raises(Exception, match="too many items"):
        packing.greedy_pack(df, "g", "k", "p", "c", 10).collect()


def test_index_recall_against_brute_force(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = vectors.where("vec_id % 10 = 0")
    pairs = lambda df: {(r.query_id, r.vec_id) for r in df.collect()}
    want = pairs(retrieval.nearest(vectors, asked, "vec_id", "embedding", 10))
    index = retrieval.cell_index(vectors, "vec_id", "embedding", 16)
    assert index.rows.count() == vectors.count()
    got = pairs(index.search(asked, "embedding", 10, 12))
    assert len(got & want) / len(want) >= 0.9
    assert pairs(index.search(asked, "embedding", 10, 16)) == want  # all cells


def test_hot_cells_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CELL_ROWS", 7)
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)] + [(99, None), (98, [0.0] * 4)], "id long, v array<double>")
    pairs = lambda d: {(r.query_id, r.id, r["rank"]) for r in d.collect()}
    index = retrieval.cell_index(df, "id", "v", 2)
    assert index.rows.select("cell", "block").distinct().count() > 5
    assert pairs(index.search(df.where("id % 20 = 0"), "v", 5, 2)) == pairs(retrieval.nearest(df, df.where("id % 20 = 0"), "id", "v", 5))


def test_nearest_of_one_label_and_many_scans(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist(), i % 3) for i in range(90)], "id long, v array<double>, label int").repartition(4)
    asked = df.where("id % 10 = 0")
    pairs = lambda d: {(r.query_id, r.id, r["rank"]) for r in d.collect()}
    want = pairs(retrieval.nearest(df, asked, "id", "v", 3, label="label"))
    assert all(q % 3 == k % 3 for q, k, _ in want) and len(want) == 27
    monkeypatch.setattr(retrieval, "SCAN_NUMBERS", 8)
    assert pairs(retrieval.nearest(df, asked, "id", "v", 3, label="label")) == want


def test_searches_take_the_whole_text(spark, tmp_path):
    from corvane.plans.retrieval import QUERIES

    text = "filler " * 600 + "needle"
    assert one(spark, text, t.code_tokens) == ["filler"] * 600 + ["needle"]
    chunks = [("c1", "r", "one", "", text, 1), ("c2", "r", "two", "", "other words", 1), ("c3", "r", "three", "", "others", 1)]
    spark.createDataFrame(chunks, "chunk_id string, repo_id string, name string, docstring string, content string, created_at long").write.parquet(f"{tmp_path}/code_chunks.parquet")
    assert ("needle", 1) in {(r.term, r.df) for r in QUERIES["bm25_terms"](spark, str(tmp_path)).collect()}
    assert {r.chunk_id: r.n_tokens for r in QUERIES["tokenize_chunks"](spark, str(tmp_path)).collect()} == {"c1": 604, "c2": 5, "c3": 4}
    spark.createDataFrame([("r",)], "repo_id string").write.parquet(f"{tmp_path}/repositories.parquet")
    spark.createDataFrame([("c9", "r", "nine", "", "filler " * 600 + "restore", 1)], "chunk_id string, repo_id string, name string, docstring string, content string, created_at long").write.mode("append").parquet(f"{tmp_path}/code_chunks.parquet")
    assert [r.chunk_id for r in QUERIES["bm25_search"](spark, str(tmp_path)).collect()] == ["c9"]
    # The document asked with and document 1 share only words far behind.
    docs = [(100, "head " * 600 + "needle"), (1, "tail " * 600 + "needle"), (2, "nothing"), (3, "nothing"), (4, "nothing")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r.doc_id for r in QUERIES["hybrid_search"](spark, str(tmp_path)).where("keyword_rank is not null").collect()} == {100, 1}
