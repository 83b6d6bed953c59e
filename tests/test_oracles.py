"""Every registered query of the library against its DuckDB SQL."""

import math

import duckdb
import pytest

from gridloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    got = registry.QUERIES[name](spark, FOLDER)
    want = db.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert ordered(got.select(*[f"`{c}`" for c in want.columns]).collect()) == ordered(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    """Queries that SQL can't express give rows, the same ones again."""
    first, second = (ordered(registry.QUERIES[name](spark, FOLDER).collect()) for _ in range(2))
    assert first and first == second
