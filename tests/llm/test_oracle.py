import duckdb
import pytest

from lamina.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(registry.ORACLE_SQL[name])
    df = registry.QUERIES[name](spark, sf)
    assert sorted(rel.columns) == sorted(df.columns)
    want = sorted(map(str, rel.select(*sorted(rel.columns)).fetchall()))
    assert sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect()) == want
