"""Every core query against its SQL on the smallest tables; those without SQL give the same rows twice."""

import math

import duckdb
import pytest

from strandloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, map(tuple, df.collect()))
    if name in catalog.SQL:
        result = duck.execute(catalog.SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, result.fetchall())
    else:
        again = catalog.QUERIES[name](spark, SF)
        assert got and got == rows(again.columns, map(tuple, again.collect()))


def test_every_sql_has_its_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
