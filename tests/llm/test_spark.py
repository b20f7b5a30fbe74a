"""The operators on small tables: nulls, empty and very long texts, repeats, clashing columns, empty tables."""

import pytest

from corvane.llm import credentials, documented, encoding_repair, handwritten, leakage, pair_defects, queries, splitting, syntax, tokenize

CHUNKS = "chunk_id string, content string, language string, name string, chunk_type string, start_line int, created_at string, id string, text string"
FILES = "file_id string, repo_id string, relative_path string, content string, id string, path string, repo string"
LONG = "x = 1\n" * 50_000


def chunks(spark, rows):
    return spark.createDataFrame([(k, c, lang, n, t, s, at, "clash", "clash") for k, c, lang, n, t, s, at in rows], CHUNKS)


def test_splitting(spark):
    rows = [("a", "line\n" * 1000, None, None, None, 11, "1"), ("a", "line\n" * 1000, None, None, None, 11, "2"), ("b", "short", None, None, None, 1, "1"), ("c", None, None, None, None, None, None), ("d", LONG, None, None, None, 0, None), (None, "", None, None, None, None, None)]
    out = splitting.oversized_pieces(chunks(spark, rows)).collect()
    assert {r.chunk_id for r in out} == {"a", "d"}
    a = sorted((r for r in out if r.chunk_id == "a"), key=lambda r: r.piece)
    assert a[0].start_line == 11 and a[-1].end_line == 1010 and all(len(r.text) <= 2000 for r in out) and "".join(r.text[r.overlap :] for r in a) == "line\n" * 1000
    assert all(r.start_line is None for r in out if r.chunk_id == "d")
    assert splitting.oversized_pieces(chunks(spark, [])).count() == 0


def test_documented_functions_and_templates(spark):
    code = 'def f{0}(x):\n    """{1}"""\n    return x\n'
    rows = [(f"t{i}", code.format(i, "Please consult our manual pages."), "python", f"name{i}", "function", 1, "1") for i in range(30)]
    rows += [("good", code.format("a", "Keeps the oldest entry of every group."), "python", "fa", "function", 1, "1"), ("good", code.format("a", "Keeps the newest entry of every group."), "python", "fa", "function", 1, "2")]
    rows += [("later", code.format("c", "Keeps the oldest entry of every group."), "python", "fc", "function", 1, "1"), ("later", "def c(x):\n    return x\n", "python", "fc", "function", 1, "2")]
    rows += [("class", code.format("b", "Keeps the oldest entry."), "python", "b", "class", 1, "1"), ("null", None, None, None, "function", None, None), ("blank", "", "go", "", "method", 0, None), ("long", "/** Keeps the very last entries only. */\nfunction g() {\n" + LONG + "}", None, None, "function", 1, None)]
    got = {r.chunk_id: r for r in documented.documented_functions(chunks(spark, rows)).collect()}
    assert set(got) == {"good", "long"}
    assert got["good"].description == "Keeps the newest entry of every group." and '"""' not in got["good"].code
    assert documented.documented_functions(chunks(spark, []), texts=False).count() == 0


def test_documented_functions_of_files(spark):
    text = 'def f(x):\n    """Keeps the oldest entry of every group."""\n    return x\n\n\ndef g(x):\n    return (\n'
    rows = [("a", text, "python", "1"), ("a", text, "python", "1"), ("b", text, "python", "1"), ("b", "x = 1\n", "python", "2"), ("c", None, "python", None), ("d", "", "go", None), ("e", text, None, None), (None, text, "python", "1")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "file_id string, content string, language string, scanned_at string, id string, n string")
    assert [(r.file_id, r.n, r.name, r.start_line, r.end_line, r.whole) for r in documented.file_functions(df).collect()] == [("a", 0, "f", 1, 3, True)]
    assert documented.file_functions(df.limit(0)).count() == 0


def test_credentials(spark):
    key = 'token = "ghp_' + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8" + '"'
    rows = [("a", "x\n" + key, None, None, None, 1, "1"), ("a", "x\n" + key, None, None, None, 1, "2"), ("b", None, None, None, None, None, None), ("c", "", None, None, None, None, None), ("d", LONG + key, None, None, None, 1, None)]
    df = chunks(spark, rows)
    assert {(r.chunk_id, r.line_no) for r in credentials.credential_lines(df).collect()} == {("a", 2), ("d", 50_001)}
    red = {r.chunk_id: r for r in credentials.redacted(df).collect()}
    assert red["a"].redacted == 'x\ntoken = "<redacted>"' and red["b"].redacted is None and red["c"].redacted == ""
    assert len(credentials.redacted(df).collect()) == 4 and {r.chunk_id for r in credentials.redacted(df, found_only=True).collect()} == {"a", "d"}
    rewritten = chunks(spark, [("a", "x\n" + key, None, None, None, 1, "1"), ("a", "x", None, None, None, 1, "2")])
    assert credentials.redacted(rewritten, found_only=True).count() == 0
    assert credentials.credential_lines(chunks(spark, [])).count() == 0


def test_pairs(spark):
    schema = "request_id string, question string, answer string, logged_at string, id string, q string, at string"
    rows = [("1", "Why is it so?", None, "1", "x", "x", "x"), ("2", None, "Yes.", "1", None, None, None), ("3", "Why is it so?", "It is done.", "2", None, None, None), ("3", "Why is it so?", "", "1", None, None, None), ("4", "", "word " * 20_000, None, None, None, None), (None, "q", "", "1", None, None, None)]
    assert {tuple(r) for r in pair_defects.defective_pairs(spark.createDataFrame(rows, schema)).collect()} == {("1", "empty"), ("4", "truncated")}
    assert pair_defects.defective_pairs(spark.createDataFrame([], schema)).count() == 0


def hand_written(i):
    return f"import os\n\n\ndef load_{i}(path, limit=None):\n    # keep the order of the rows\n    rows = []\n    with open(path) as handle:\n        for line in handle:\n            if not line.strip():\n                continue\n            rows.append(line.split()[{i % 5}])\n    return rows[:limit]\n"


def test_handwritten(spark):
    made = lambda i: "\n".join(f"export const a{i}_{j} = {i * 7 + j * 13};" for j in range(40))
    rows = [(f"h{i}", "r1", f"src/h{i}.py", hand_written(i)) for i in range(120)]
    rows += [(f"g{i}", "r1", f"src/g{i}.js", "// Code generated by x. DO NOT EDIT.\n" + made(i)) for i in range(80)] + [("silent", "r1", "src/s.js", made(99))]
    rows += [(f"c{i}", f"r{i % 3}", f"lib/c{i}.py", ("\r\n" if i else "\n").join(hand_written(777).split("\n"))) for i in range(3)] + [("two1", "r1", "a.py", hand_written(778)), ("two2", "r2", "a.py", hand_written(778))]
    rows += [("null", None, None, None), ("empty", "r1", "a.py", ""), ("lock", "r1", "a/pnpm-lock.yaml", None), ("h0", "r1", "src/h0.py", hand_written(0)), (None, "r1", "x_pb2.py", "x")]
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], FILES)
    got = {r.file_id: r.reasons for r in handwritten.not_handwritten(df).collect()}
    assert {f"g{i}" for i in range(80)} | {"silent", "c0", "c1", "c2", "lock"} == set(got)
    assert got["silent"] == ["generated by its text"] and "copied" in got["c0"]
    assert handwritten.not_handwritten(df.limit(0)).count() == 0


def test_syntax_whole_and_in_chunks(spark):
    good = "function f(a) {\n  return a;\n}\n/* a\n comment { */\nvar t = `x { ${1}`;\n" * 40
    rows = [("good", "r", "a.js", good), ("good", "r", "a.js", good), ("bad", "r", "b.js", good + "function g( {\n}\n"), ("open", "r", "c.js", good + "function g() {\n" + good), ("text", "r", "d.js", good + "var x = `open\n" + "y\n" * 300), ("py", "r", "e.py", "def f(:\n"), ("md", "r", "f.md", "((("), ("null", "r", "g.py", None), ("empty", "r", "h.json", ""), ("nopath", None, None, "(((")]
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], FILES)
    for size, spread in ((syntax.CHUNK_CHARS, syntax.SPREAD_CHARS), (97, 1 << 20), (97, 10)):
        assert {r.file_id for r in syntax.invalid_files(df, chunk_chars=size, spread_chars=spread).collect()} == {"bad", "open", "text", "py"}
    rates = {r.language: (r.files, r.invalid) for r in syntax.invalid_rates(df).where("repo_id = 'r'").collect()}
    assert rates == {"javascript": (4, 3), "python": (1, 1)}
    assert syntax.invalid_files(df.limit(0)).count() == 0


def test_syntax_of_large_files_is_that_of_small_ones(spark):
    line = 'f("a\'b, http://x"); // it\'s "left\n'
    conflict = line * 20 + "<<<<<<< main\n" + line + "=======\n" + line + ">>>>>>> topic\n" + line * 20
    java = "package a;\n" + "class A {\n  // it's\n  int f() {\n    return 1;\n  }\n}\n" * 20
    texts = {"strings.js": line * 40, "conflict.js": conflict, "side.js": line * 20 + "foo bar\n" + line * 20, "good.java": java, "loose.java": java + "int x;\n" + java[11:]}
    df = spark.createDataFrame([(k, "r", k, v, "", "", "") for k, v in texts.items()], FILES)
    for size in (syntax.CHUNK_CHARS, 90, 91, 97):
        assert {r.file_id: r.fault for r in syntax.invalid_files(df, chunk_chars=size, spread_chars=10).collect()} == {"conflict.js": "merge conflict", "side.js": "operands side by side", "loose.java": "no declaration"}


def test_syntax_of_given_files_at_any_chunk_size(spark):
    files = spark.read.parquet("/root/testdata/sf0.001/scanned_files.parquet")
    each = [{(r.file_id, r.language) for r in syntax.invalid_files(files, chunk_chars=size, spread_chars=spread).collect()} for size, spread in ((64, 1000), (997, 1 << 20), (1 << 20, 1 << 20))]
    assert each[0] and each[0] == each[1] == each[2]


def documents(spark, rows):
    return spark.createDataFrame([(i, x, "clash") for i, x in rows], "doc_id long, text string, id string")


def test_encoding(spark):
    df = documents(spark, [(1, "cafÃ© demo"), (1, "cafÃ© demo"), (2, None), (3, ""), (4, "café"), (5, "é" * 200_000), (None, "cafÃ©")])
    assert {r.doc_id: r.restored for r in encoding_repair.garbled_texts(df).collect()} == {1: "café demo", None: "café"}
    assert encoding_repair.garbled_texts(df.limit(0)).count() == 0


def test_tokens(spark, monkeypatch):
    pytest.importorskip("public_tokenizers")
    df = documents(spark, [(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (4, "ab" * 100_000), (None, "x"), (None, "x")])
    for most in (tokenize.MAX_REPEATED, 1):
        monkeypatch.setattr(tokenize, "MAX_REPEATED", most)
        rows = tokenize.encode_texts(df).collect()
        got = {r.doc_id: r.ids for r in rows}
        assert got[1] == [31373, 995] and got[2] == [] and got[3] == [] and len(got[4]) > 1000 and len(got) == len(rows) == 5
    assert len(tokenize.encode_texts(df.where("doc_id > 1")).collect()) == 3 and tokenize.encode_texts(df.limit(0)).count() == 0
    back = {r.doc_id: r.text for r in tokenize.decode_ids(tokenize.encode_texts(df)).collect()}
    assert back[1] == "hello world" and back[2] == back[3] == "" and back[4] == "ab" * 100_000


def test_leaks(spark):
    items = [(i, " ".join(f"w{(i * 31 + j * j) % 97}x{i}" for j in range(40))) for i in range(25)] + [(90, None), (91, ""), (92, "too short"), (3, " ".join(f"w{(3 * 31 + j * j) % 97}x3" for j in range(40)))]
    eval_items = spark.createDataFrame([(i, x, "clash") for i, x in items], "item_id long, text string, doc_id string")
    docs = documents(spark, [(1, "before " + items[3][1] + " after"), (1, "before " + items[3][1] + " after"), (2, None), (3, ""), (4, "none of it"), (5, items[7][1] + " z" * 50_000 + " " + items[8][1])])
    want = {(1, 3), (5, 7), (5, 8)}
    assert {(r.doc_id, r.item_id) for r in leakage.leaked_items(docs, eval_items).collect()} == want
    # Hashes of more than one item are joined by longer runs, which no other item shares.
    assert {(r.doc_id, r.item_id) for r in leakage.leaked_items(docs, eval_items, hot_owners=0).collect()} == want
    assert leakage.leaked_items(docs, eval_items.limit(0)).count() == 0 and leakage.leaked_items(docs.limit(0), eval_items).count() == 0


def test_leaks_of_many_items_and_of_items_that_share_their_words(spark):
    style = " ".join(f"style{j}" for j in range(12))
    items = spark.range(50_000).selectExpr("id AS item_id", f"concat('{style} ', array_join(transform(sequence(1, 28), j -> concat('w', pmod(xxhash64(id * 100 + j), 5000))), ' ')) AS text")
    docs = items.where("item_id % 5000 = 7").selectExpr("item_id AS doc_id", "concat('before it ', text, ' after it') AS text").unionByName(spark.range(100_000, 100_200).selectExpr("id AS doc_id", f"'{style} and nothing else of it' AS text"))
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_items(docs, items).collect()}
    assert got == {(i, i) for i in range(7, 50_000, 5000)}


def test_registered_names():
    assert {f"p{n}_found" for n in (2, 3, 4, 5, 6, 7, 9, 10)} | {"p8_ids"} <= set(queries.QUERIES)
