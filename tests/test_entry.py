import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_flagship_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() >= 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_oracle(spark, con, name):
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    text = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    columns = sorted(names)
    rows = [dict(zip(names, r)) for r in want.fetchall()]
    assert sorted([text(r[c]) for c in columns] for r in got.collect()) == sorted([text(r[c]) for c in columns] for r in rows)
