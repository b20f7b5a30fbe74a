"""Arrow-batched row functions: Spark cuts the partitions, Python sees one batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..session import ship

#: Output rows handed back to the JVM at once.
OUT_ROWS = 2_000


def flat_map(df: DataFrame, columns: list[str | Column], make: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """Apply a row function that yields any number of output tuples.

    Only `columns` cross to Python, so clashing or extra columns of df don't matter. `make` runs once in each task and returns the
    row function, which gets the values of `columns` in order.
    """
    ship(df.sparkSession)
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        out: list[tuple] = []
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                out.extend(row(*values))
                if len(out) >= OUT_ROWS:
                    yield _batch(out, arrow)
                    out = []
            # Spark bounds the bytes of what comes in; nothing that was made of it is held beyond its batch.
            if out:
                yield _batch(out, arrow)
                out = []

    return df.select(*columns).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
