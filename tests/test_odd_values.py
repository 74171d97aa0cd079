"""Values that small tables do not hold: long names, marks that text runs into, multiples of the overflow."""

import datetime as dt

import duckdb
import pytest

from lamina.operators import coding
from lamina.plans import catalog
from lamina.plans.recovery import MARK


def _same(spark, folder, name, table):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = catalog.queries()[name](spark, folder)
    rel = con.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    got, want = sorted(df.select(cols).collect()), sorted(rel.select(*cols).fetchall())
    assert [tuple(r) for r in got] == want
    assert want


@pytest.mark.parametrize("name", ["fs18_catalogue", "conv13_directory"])
def test_names_of_more_than_seven_letters(spark, tmp_path, name):
    rows = [(10**k + i, 1 + k % 2, 900.5) for k in range(3, 19) for i in range(5)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    _same(spark, str(tmp_path), name, "part")


def test_text_that_runs_into_a_mark(spark, tmp_path):
    kinds = [(c, n, j) for c in "ĉčęċ" for n in (1, 2) for j in range(3)] * 12
    texts = [(i, "".join("a" * (250 - 2 * n * (k == j)) + c * n * (k == j) for k in range(6))) for i, (c, n, j) in enumerate(kinds)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    _same(spark, str(tmp_path), "fuse21_recover_stream", "documents")
    whole = MARK + b"a" * 248 + "č".encode() + MARK + b"b" * 250
    assert coding.recover_stream(whole, MARK, 2048, weigh=True) == (whole, 0, 0)


def test_multiples_of_the_overflow(spark, tmp_path):
    at, rows = dt.datetime(2024, 1, 1), []
    for i, gap in enumerate([0, 65536, 131072, 65535, 65537, 3]):
        at += dt.timedelta(seconds=gap)
        rows.append((i, at, 1, "view", 1.0))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    _same(spark, str(tmp_path), "io03_flux_container", "events")
