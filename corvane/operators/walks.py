"""Shortest paths over a graph of bounded size that every worker holds, so that no path is shuffled or kept on disk."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

#: Edges, nodes and names together of a graph that is sent to the workers: 50 MB of numbers and each text once.
SENT = 4_000_000
#: Elements of paths that a worker gives back at once.
BATCH = 100_000
PATHS = "start string, id string, depth int, path array<string>"


class Graph:
    """Nodes and names of edges as numbers. Numbers of names are in the order of the names, and each node's edges (to `ends`, from first[node]
    on) are in the order of theirs, so that of several paths to a node the smallest is met first. texts holds the names and, from `at` on, the
    sorted ids of the nodes; at is 0 where these are the names."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, name: np.ndarray, texts: pa.Array, at: int):
        order = np.lexsort((name, src))
        self.ends, self.name, self.texts, self.at = dst[order], name[order], texts, at
        self.first = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(texts) - at))])

    def number(self, text: str | None) -> int | None:
        """The node of an id. Found in the sorted ids, which takes no memory."""
        i = len(self.texts) if text is None else bisect_left(self.texts, text, self.at, key=lambda x: x.as_py())
        return i - self.at if i < len(self.texts) and self.texts[i].as_py() == text else None

    def levels(self, start: int, depth: int, seen: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1, 2 ... `depth` steps the nodes first reached with as many, and a row of names for the smallest path to each. seen (all false,
        and so again at the end) and place have an element for each node."""
        front, paths = np.array([start]), np.empty((1, 0), np.int32)
        reached = [front]
        seen[front] = True
        for _ in range(depth):
            n = self.first[front + 1] - self.first[front]
            edge = np.arange(n.sum()) + np.repeat(self.first[front] - (np.cumsum(n) - n), n)
            before = np.repeat(np.arange(len(front)), n)  # the front is in the order of its paths, so these edges are in that of theirs
            new = ~seen[self.ends[edge]]
            edge, before = edge[new], before[new]
            ends, at = self.ends[edge], np.arange(len(edge))
            place[ends[::-1]] = at[::-1]
            new = place[ends] == at
            front, paths = ends[new], np.column_stack([paths[before[new]], self.name[edge[new]]])
            if not len(front):
                break
            seen[front] = True
            reached.append(front)
            yield front, paths
        for nodes in reached:
            seen[nodes] = False

    def found(self, starts: pa.Array, depth: int) -> Iterator[pa.RecordBatch]:
        """Rows of PATHS; a start outside the graph reaches itself only."""
        kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())]
        batch = lambda *columns: pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds)], ["start", "id", "depth", "path"])
        yield batch(starts, starts, pa.array(np.zeros(len(starts), np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32)), starts))
        texts, ids = self.texts, self.texts.slice(self.at)
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            start, rows = np.array([s for s, *_ in held], np.int32), [len(f) for _, f, _ in held]
            steps = np.repeat([p.shape[1] for *_, p in held], rows).astype(np.int32)
            flat = np.concatenate([np.column_stack([np.full(len(p), self.at + s), p]).ravel() for s, _, p in held])
            offsets = np.concatenate([[0], np.cumsum(steps + 1)]).astype(np.int32)
            return batch(ids.take(pa.array(np.repeat(start, rows))), ids.take(pa.array(np.concatenate([f for _, f, _ in held]))), pa.array(steps), pa.ListArray.from_arrays(pa.array(offsets), texts.take(pa.array(flat))))

        seen, place, size = np.zeros(len(ids), bool), np.zeros(len(ids), np.int32), 0
        for start in (n for x in starts if (n := self.number(x.as_py())) is not None):
            for front, paths in self.levels(start, depth, seen, place):
                most = max(1, BATCH // (paths.shape[1] + 1))
                for i in range(0, len(front), most):
                    held.append((start, front[i : i + most], paths[i : i + most]))
                    size += len(held[-1][1]) * (paths.shape[1] + 1)
                    if size >= BATCH:
                        yield out()
                        held.clear()
                        size = 0
        if held:
            yield out()


def _ranks(values: DataFrame) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The numbers that `values` (x, n) has, in order, the rank of each one's x, and the x by rank."""
    t = values.select(F.col("x").cast("string").alias("x"), "n").toArrow().combine_chunks()
    x, n = pa.concat_arrays(t["x"].chunks) if t.num_rows else pa.array([], pa.string()), t["n"].to_numpy()
    order = pc.sort_indices(x).to_numpy()
    rank = np.empty(len(n), np.int32)
    rank[order] = np.arange(len(n))
    by = np.argsort(n)
    return n[by], rank[by], x.take(pa.array(order))


def shortest(starts: DataFrame, links: DataFrame, depth: int, typed: bool) -> DataFrame | None:
    """The rows of code_graph.shortest_paths, or None for a graph beyond SENT. links: distinct src, dst and name, the name being dst unless
    typed. The driver gathers the edges as numbers, and each text once."""
    count = links.count()
    if count > SENT:
        return None
    numbered = lambda *columns: cut(links.select(F.explode(F.array(*columns)).alias("x")).where("x is not null").distinct().withColumn("n", F.monotonically_increasing_id()))
    nodes = numbered("src", "dst")
    names = numbered("name") if typed else nodes
    if count + nodes.count() + names.count() * typed > SENT:
        return None
    edges = links
    for column, values in (("src", nodes), ("dst", nodes), ("name", names))[: 2 + typed]:
        edges = edges.join(values.select(F.col("x").alias(column), F.col("n").alias(f"{column}_n")), column)
    t = edges.select("src_n", "dst_n", *["name_n"] * typed).toArrow()
    n, rank, ids = _ranks(nodes)
    src, dst = (rank[np.searchsorted(n, t[c].to_numpy())] for c in ("src_n", "dst_n"))
    name, texts, at = dst, ids, 0
    if typed:
        n, rank, texts = _ranks(names)
        texts, at = pa.concat_arrays([texts, ids]), len(texts)
        name = rank[np.searchsorted(n, t["name_n"].to_numpy())]
    spark = links.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(Graph(src, dst, name, texts, at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from sent.value.found(batch.column(0), depth)

    # A few starts may have most of the paths, so they are spread over all tasks; written first, else they would keep fewer partitions.
    return cut(starts.select("id").distinct()).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").mapInArrow(run, PATHS)
