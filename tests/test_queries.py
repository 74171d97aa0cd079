"""Every query against its SQL on the small tables; queries without SQL must give rows."""

import math
from decimal import Decimal

import duckdb
import pytest

from lamina.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, Decimal):
        return plain(float(v))
    if hasattr(v, "tolist"):
        v = v.tolist()
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    assert got
    if name in SQL:
        rel = duck.sql(SQL[name])
        assert sorted(rel.columns) == sorted(df.columns)
        want = rows(rel.columns, rel.fetchall())
        assert len(got) == len(want)
        bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
        assert not bad, bad[:3]
