"""Classes' first traces and opened files without a row a value and without contents that are shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import cells as cl
from lamina.functions import octets
from lamina.plans import catalog
from lamina.sources.carriers import images, noise


def _plan(spark, sf, name):
    return catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_shift_has_no_row_a_value(spark, sf_dir):
    assert "Generate" not in _plan(spark, sf_dir, "win33_shift_estimate")


def test_shift_of_rows_without_a_class_or_a_value(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = [float(x) for x in rng.normal(size=12)]
    rows = [(1, v, 0), (2, [0.0, 0.0, *v[:10]], 0), (3, v, None), (4, None, 0), (5, [], 0), (6, v[:1], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["trace"]: r["shift"] for r in catalog.queries()["win33_shift_estimate"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 6} and got[1] == 0 and got[2] == 2


def test_opened_files_are_not_joined(spark, sf_dir):
    plan = _plan(spark, sf_dir, "src13_smart_open")
    assert "Join" not in plan and "Window" not in plan


@pytest.mark.parametrize("size", [256, 60])
def test_noise_is_mixed_outside_of_arrays(spark, sf_dir, size):
    mixed = F.transform(octets.values(F.col("data")), lambda b: (b * 37 + F.col("image") * 11 + F.col("chunk")) % 256)
    want = images(spark, sf_dir, size).select("image", "chunk", F.array_join(F.transform(mixed, lambda b: octets.digits(b, 1)), "").alias("data"))
    got = noise(spark, sf_dir, size)
    assert "transform(" not in got.select("data")._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert sorted(got.collect()) == sorted(want.collect())
    assert sorted(noise(spark, sf_dir, size, "bits").collect()) == sorted(want.withColumn("data", cl.bits(F.col("data"))).collect())


@pytest.mark.parametrize("name", ["fuse24_forensic_sector", "fuse13_sift"])
def test_lines_are_dealt_once(spark, sf_dir, name):
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
