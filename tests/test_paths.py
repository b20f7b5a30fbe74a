"""Shortest paths where there are many more of them than edges: 120 functions call one, which calls another, which calls 120."""

import datetime as dt
import random
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from corvane.operators import code_graph, walks

WIDE = 120


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at, to = dt.datetime(2024, 1, 1), tmp_path_factory.mktemp("wide")
    calls = {f"start_{i:03}": ["hub_a"] for i in range(WIDE)} | {"hub_a": ["hub_b"], "hub_b": [f"leaf_{i:03}" for i in range(WIDE)]} | {f"leaf_{i:03}": [] for i in range(WIDE)}
    chunks = [{"chunk_id": f"id-{random.Random(n).random()}", "repo_id": "r", "file_id": f"f{i}", "file_path": f"{n}.py", "chunk_type": "function", "name": n, "content": f"def {n}():\n" + "".join(f"    {x}()\n" for x in to), "start_line": 1, "parent_name": None, "created_at": at} for i, (n, to) in enumerate(calls.items())]
    chunks.append(chunks[0] | {"content": "", "created_at": at - dt.timedelta(1)})  # a version before, with no call
    files = [{"file_id": f"file-{n}", "repo_id": "r", "relative_path": f"{n}.py", "language": "python", "content": "".join(f"import {x}\n" for x in to), "scanned_at": at} for n, to in calls.items()]
    classes = [{"chunk_id": f"class-{n}", "repo_id": "r", "class_name": n, "extracted_at": at} for n in calls]
    refs = [{"repo_id": "r", "chunk_id": f"class-{n}", "name": x, "is_abstract": False, "is_mixin": False} for n, to in calls.items() for x in to]
    for name, rows in {"code_chunks": chunks, "scanned_files": files, "class_hierarchy": classes, "base_class_refs": refs}.items():
        pq.write_table(pa.Table.from_pylist(rows), to / f"{name}.parquet")
    return to


def _written(spark) -> int:
    """Rows of the tables written to the checkpoint folder so far."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return 0
    kept = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    return sum(pq.read_metadata(f).num_rows for f in Path(kept).rglob("*.parquet"))


def _agrees(spark, folder, name: str, rows: int, most: int) -> None:
    """Equal to SQL, with no more than `most` rows written on the way."""
    con, before = duckdb.connect(), _written(spark)
    for f in folder.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, str(folder))
    got, want = sorted(map(tuple, df.collect()), key=str), con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted(want, key=str) and len(got) == rows
    assert _written(spark) - before < most


def test_shortest_call_paths_write_no_paths(spark, folder):
    _agrees(spark, folder, "shortest_call_paths", WIDE * (2 + WIDE), WIDE * WIDE // 3)


def test_chain_steps_write_no_paths(spark, folder):
    _agrees(spark, folder, "chain_steps", WIDE * (2 + 3 + 4 * WIDE), WIDE * WIDE // 3)


def test_typed_paths_write_no_paths(spark, folder):
    """Functions, files and classes, each as wide."""
    _agrees(spark, folder, "typed_paths", 3 * WIDE * (2 + WIDE), WIDE * WIDE)


@pytest.mark.parametrize("typed", [False, True])
def test_both_ways_to_walk_agree(spark, monkeypatch, typed):
    """Cycles, repeated edges, edges of two types, a start outside the graph; batches that end within a start."""
    r = random.Random(5)
    ids = [f"n{r.randrange(10**6)}" for _ in range(40)]
    edges = spark.createDataFrame([(r.choice(ids), r.choice(ids), r.choice("AB")) for _ in range(110)], "src string, dst string, rel_type string")
    starts = spark.createDataFrame([(x,) for x in [*ids[:10], "outside", ids[0]]], "id string")
    got = []
    for sent, batch in ((10**6, 100_000), (10**6, 7), (10, 7)):
        monkeypatch.setattr(walks, "SENT", sent)
        monkeypatch.setattr(walks, "BATCH", batch)
        got.append(sorted((x.start, x.id, x.depth, tuple(x.path)) for x in code_graph.shortest_paths(starts, edges, 4, typed).collect()))
    assert got[0] == got[1] == got[2] and ("outside", "outside", 0, ("outside",)) in got[0] and len(got[0]) > 200
    none = code_graph.shortest_paths(starts, edges.where("src is null"), 4, typed).collect()
    assert sorted((x.start, x.depth) for x in none) == sorted((x, 0) for x in {*ids[:10], "outside"})
