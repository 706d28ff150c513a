"""Every query that has SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from fathomweb import queries

WHERE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{WHERE}/{t}.parquet'")
    return con


def plain(rows):
    fixed = lambda x: round(x, 6) if isinstance(x, float) and math.isfinite(x) else x
    return sorted((tuple(map(fixed, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, WHERE)
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    got = plain(df.select(*names).collect())
    assert got == plain(want.fetchall())
    assert got


def test_without_sql(spark):
    for name in set(queries.QUERIES) - set(queries.ORACLE_SQL):
        assert queries.QUERIES[name](spark, WHERE).count() > 0
