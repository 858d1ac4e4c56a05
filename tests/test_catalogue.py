"""Every catalogue query against its oracle on the small tables."""

import os

import duckdb
import pytest

from filelake.plans.catalogue import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["documents", "pages", "events", "orders", "lineitem", "labels"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, con, name):
    got = QUERIES[name](spark, DATA)
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(names, want.fetchall())
