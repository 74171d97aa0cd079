"""Tracks coded and read side by side: damaged and cut tracks, loops over cells, nothing written by the way."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import lanes
from lamina.operators import tracks as tr
from lamina.plans import catalog


def _sectors(spark, size, tracks=3, n=5):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(t, s, rng.bytes(size).hex().upper()) for t in range(tracks) for s in range(n)], "track long, sector long, data string")


@pytest.mark.parametrize("encoding", tr.ENCODINGS)
def test_cut_tracks_keep_what_is_whole(spark, encoding):
    cells = tr.encode(_sectors(spark, tr.SIZES[encoding]), encoding)
    half = cells.withColumn("cells", F.expr("substring(cells, 1, length(cells) * 2 div 3 + track)"))
    good = tr.DECODERS[encoding](half).where("header_ok AND data_ok")
    assert {(r["track"], r["n"]) for r in good.groupBy("track").agg(F.count("*").alias("n")).collect()} == {(0, 3), (1, 3), (2, 3)}


def test_no_interval_is_a_row(spark, sf_dir):
    plan = catalog.queries()["dec15_mfm_tracks"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("Generate") == 1  # the turns' sectors alone


def test_loop_over_cells_as_over_rows(spark):
    cells = tr.encode(_sectors(spark, 128), "MFM")
    times = lambda track, idx, n: n * 2000 + (idx * 37 + track) % 301 - 150
    loop = lanes.phase_loop(2000.0, 0.05, 0.02)
    rows = tr.intervals(cells).withColumn("dt", F.col("cells") * 2000 + (F.col("idx") * 37 + F.col("track")) % 301 - 150)
    want = tr.from_intervals(lanes.scan(rows, "track", "idx", ["dt"], *loop, "cells long, period double").select("track", "idx", "cells"))
    assert sorted(lanes.recover_cells(cells, times, *loop).collect()) == sorted(want.collect())
    odd = spark.createDataFrame([(1, "0000"), (2, ""), (3, None), (4, "0100")], "track long, cells string")
    assert lanes.recover_cells(odd, times, *loop).collect() == [(4, "01")]


def test_second_attempt_writes_no_tracks(spark, sf_dir):
    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(base.glob("*")) if base.exists() else set()
    catalog.queries()["dec31_pipeline_run"](spark, sf_dir).collect()
    made = {p.name.split("-")[0] for p in set(base.glob("*")) - before}
    assert made == {"attempts"}


def test_intervals_as_arrays_are_those_as_rows(spark):
    cells = tr.encode(_sectors(spark, 128), "MFM").unionByName(spark.createDataFrame([(9, "00100")], "track long, cells string"))
    assert sorted(tr.from_runs(tr.runs(cells)).collect()) == sorted(tr.from_intervals(tr.intervals(cells)).collect())


def test_conversion_has_no_row_an_interval(spark, sf_dir):
    plan = catalog.queries()["conv03_dispatch"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(regexp_extract_all" not in plan
