"""Steps whose memory or time grew faster than their input: pairs that leave a join, trellises, windows, votes, states."""

import datetime as dt

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lamina.functions import cells as cl
from lamina.operators import compare, decode, windows
from lamina.plans import catalog
from lamina.sources.carriers import images
from lamina.streaming import pipeline as pipe


def _plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_sketches_differ_in_no_more_bits_than_bytes(spark):
    rng, rows = np.random.default_rng(5), [(0, None, None), (1, b"", b"")]
    for n in (1, 7, 256, 300):
        for d in (0, 1, n // 10, n):
            x = rng.integers(0, 256, n).astype(np.uint8)
            y = x.copy()
            y[rng.choice(n, d, replace=False)] ^= 85
            rows.append((len(rows), x.tobytes(), y.tobytes()))
    df = spark.createDataFrame(rows, "id long, x binary, y binary")
    a = {r["id"]: r for r in compare.sketches(df, "x").collect()}
    b = {r["id"]: r for r in compare.sketches(df, "y").collect()}
    assert len(a) == len(rows) and a[0]["s0"] is None and a[1]["s0"] is not None
    for k, x, y in rows[1:]:
        bits = sum(((a[k][s] ^ b[k][s]) & (2**64 - 1)).bit_count() for s in ("s0", "s1"))
        assert bits <= sum(p != q for p, q in zip(x, y, strict=True))


def test_only_likely_pairs_leave_the_join(spark, tmp_path):
    rng = np.random.default_rng(6)  # all chunks share their first 30 bytes, so that each meets each; one pair alone is near
    texts = ["x" * 30 + "".join(chr(97 + c) for c in rng.integers(0, 26, 226)) for _ in range(200)]
    texts[100] = texts[7][:200] + "#" * 20 + texts[7][220:]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.queries()["join18_duplicate_recovery"](spark, str(tmp_path))
    assert [tuple(r) for r in df.select("image", "chunk", "from_image", "from_chunk", "equal_bytes").collect()] == [(100, 0, 7, 0, 236)]
    plan = _plan(df)
    assert "bit_count" in next(x for x in plan.splitlines() if "Join Inner" in x and "xxhash64" not in x and "h#" in x)


def _one_by_one(text):
    """Least cost and digits of one string, position by position; a later way must be cheaper."""
    cost, way = {0: (0, "")}, decode._TABLES
    for p in range(len(text)):
        for size in (5, 4, 6):
            if p in cost and p + size <= len(text):
                v = int(text[p : p + size], 2)
                new = cost[p][0] + int(way[size][0][v])
                if new < cost.get(p + size, (1 << 20,))[0]:
                    cost[p + size] = new, cost[p][1] + f"{way[size][1][v]:X}"
    return cost.get(len(text), (-1, ""))


def test_trellises_side_by_side_as_one_by_one():
    rng = np.random.default_rng(7)
    texts = ["".join(map(str, rng.integers(0, 2, int(n)))) for n in [*rng.integers(0, 70, 300), 639, 2100]]
    assert decode.trellises(texts) == [_one_by_one(t) for t in texts]


def test_group_trellis_makes_no_strings_of_bits(spark, sf_dir):
    plan = _plan(catalog.queries()["dec26_viterbi"](spark, sf_dir))
    assert "replace(" not in plan and "hex(" not in plan


def test_lost_bits_of_odd_rows(spark, tmp_path):
    rows = [(i, t) for t in ("a", "bcd" * 40) for i in (0, 3, -1, -2, -3, -11, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = images(spark, str(tmp_path), 64).select("image", "chunk", cl.five(F.col("data")).alias("bits"))
    at = (F.col("image") * 7 + F.col("chunk") * 13) % F.length("bits")
    lost = c.select("image", "chunk", F.concat(F.substring("bits", F.lit(1), at.cast("int")), F.substring("bits", (at + 2).cast("int"), F.length("bits"))).alias("bits"))
    order = lambda df: sorted(map(str, df.collect()))
    got = order(catalog.queries()["dec26_viterbi"](spark, str(tmp_path)))
    assert len(got) == 21 and got == order(decode.group_trellis(lost))


def _runs_one_by_one(rows):
    out = []
    for part, label, value in rows:
        if out and out[-1][0] == part and out[-1][1] == label:
            out[-1][3:] = [out[-1][3] + 1, out[-1][4] + value]
        else:
            out.append([part, label, out[-1][2] + out[-1][3] if out and out[-1][0] == part else 0, 1, value])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("cut", [1, 2, 5, 1000])
def test_runs_go_on_over_batches(cut):
    rng = np.random.default_rng(cut)
    parts = [None] * 9 + sorted(rng.integers(0, 40, 500).tolist()) + [77] * 60
    rows = [(p, int(v), float(v + 1)) for p, v in zip(parts, rng.integers(0, 2, len(parts)) * (np.arange(len(parts)) < 540), strict=True)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.int32()), pa.array([r[2] for r in some])], names=["p", "l", "v"]) for some in (rows[i : i + cut] for i in range(0, len(rows), cut))]
    schema = pa.schema([("p", pa.int64()), ("l", pa.int32()), ("first", pa.int64()), ("length", pa.int64()), ("total", pa.float64())])
    got = [tuple(r.values()) for b in windows._short_runs(iter(batches), schema) for r in b.to_pylist()]
    assert got == _runs_one_by_one(rows)


def test_segments_are_sorted_once_and_ranked_once(spark, sf_dir):
    plan = _plan(catalog.queries()["win17_confidence_segments"](spark, sf_dir), "sparkPlan")
    assert plan.count("Window") == 1 and "Aggregate" not in plan


def test_lines_of_tracks_are_dealt_once(spark, sf_dir):
    plan = _plan(catalog.queries()["fuse05_multi_read_track"](spark, sf_dir), "executedPlan")
    assert plan.count("Exchange") == 1 and "Generate" not in plan and "Join" not in plan


def test_reads_of_odd_lines(spark, tmp_path):
    kinds = [("R", "O"), ("A", "F"), ("N", "O"), (None, "F")]
    rows = [(t, 10 * i + t, i, s, 7.0 * i, 100.0 + i, *kinds[(t * 3 + (s or 9) + i * i) % 4], dt.datetime(2024, 1, 1 + i)) for t in range(1, 9) for s in (1, 2, None, 3) for i in range(1 + t % 4)]
    rows += [(50, 1, 1, s, 5.0, 9.0, None, "O", dt.datetime(2024, 1, 1)) for s in (1, 2)] + [(None, 1, 1, 1, 5.0, 9.0, "A", "O", dt.datetime(2024, 1, 1))]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    df, rel = catalog.queries()["fuse05_multi_read_track"](spark, str(tmp_path)), con.sql(catalog.oracle_sql()["fuse05_multi_read_track"])
    cols = sorted(df.columns)
    want = sorted(rel.select(*cols).fetchall())
    assert sorted(tuple(r) for r in df.select(cols).collect()) == want and want


class _Held:
    """A state of one value that counts what it is asked."""

    def __init__(self):
        self.value, self.calls, self.names = None, 0, []

    def __getattr__(self, name):
        if name.startswith("get") and name.endswith("State"):
            return lambda label, *_: self.names.append(label) or self
        raise AttributeError(name)

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value


def test_a_track_asks_its_state_once_a_batch():
    held, made = _Held(), pipe.Chunker(4, 1, 2, 20.0, None)
    made.init(held)
    row = Row("track", "seq", "amp", "kind")
    out = []
    for batch in ([3, 5, 0], [2, 1], [4, None, 2, 6]):
        out += made.handleInputRows((9,), iter([row(9, s, None if s == 6 else float(s or 0), pipe.DATA) for s in batch]), None)
    assert held.names == ["track"] and held.calls == 6
    assert [(r["start"], r["length"], r["mean"]) for r in out if r["length"]] == [(0, 4, 1.5), (3, 4, None)]
    assert [(r["pushed"], r["buffered"], r["waiting"], r["refused"]) for r in out if not r["length"]] == [(1, 1, 2, 0), (4, 1, 1, 0), (7, 1, 0, 2)]
