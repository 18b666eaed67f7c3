"""Every registered query of the catalog runs on the smallest tables; with SQL, it must give the same rows as DuckDB."""

import math
import os

import duckdb
import pytest

from tidemark.plans.registry import QUERIES
from tidemark import catalog  # noqa: F401  registers the queries

DATA = os.environ.get("TIDEMARK_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "none"
    return f"{v + 0.0:.4f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    q = QUERIES[name]
    df = q.run(spark, DATA)
    got = sorted(tuple(map(plain, r)) for r in df.collect())
    if q.sql:
        cur = con.execute(q.sql)
        assert [c[0] for c in cur.description] == df.columns
        want = sorted(tuple(map(plain, r)) for r in cur.fetchall())
        assert got == want
    else:
        assert len(df.columns) == len(set(df.columns))
