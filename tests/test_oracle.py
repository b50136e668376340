"""Every registered ledger query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from saldo import plans  # noqa: F401
from saldo.plans.registry import QUERIES, SQL

DATA = os.environ.get("SALDO_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, float):
            return f"{v:.4f}".replace("-0.0000", "0.0000")
        if isinstance(v, int):
            return str(v)
        return str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    con = duck.execute(SQL[name])
    names = [c[0] for c in con.description]
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(con.fetchall(), names)


#: Queries that SQL would answer one row after the other; a plain loop in the named test gives their rows.
LOOPS = {"canonical_ingest": "test_canonical"}


def test_every_query_has_sql_or_a_loop():
    assert set(QUERIES) == set(SQL) | set(LOOPS)
