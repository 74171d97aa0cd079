"""Sequence operators over ordered series: runs, frames, change points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def islands(df: DataFrame, part: list[str], order: str, label: Column, name: str = "island") -> DataFrame:
    """Number of the run of equal labels that each row is in, from 1, in each part."""
    w = Window.partitionBy(*part).orderBy(order)
    change = F.when(F.lag(label).over(w).eqNullSafe(label), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn(name, F.sum("_change").over(w)).drop("_change")


def runs(df: DataFrame, part: list[str], order: str, label: Column, *aggregates: Column) -> DataFrame:
    """One row for each run of equal labels: first, last, length and the aggregates."""
    marked = islands(df.withColumn("run_label", label), part, order, F.col("run_label"))
    return marked.groupBy(*part, "island", "run_label").agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"), *aggregates).drop("island")


def _short_runs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Runs of (part, label, value) in their order; the last run of a batch is held back, as the next batch may go on with it."""
    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0)
        code = key.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        label, value = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
        other = np.concatenate([[True], code[1:] != code[:-1]])
        place = np.arange(b.num_rows)
        idx = place - np.maximum.accumulate(np.where(other, place, 0))
        first = np.flatnonzero(other | np.concatenate([[True], label[1:] != label[:-1]]))
        found = [key.take(pa.array(first)), label[first], idx[first], np.diff(np.append(first, b.num_rows)), np.add.reduceat(value, first)]
        if held:
            if held[0].equals(key.slice(0, 1)):
                found[2][: np.searchsorted(first, np.append(np.flatnonzero(other)[1:], b.num_rows)[0])] += held[2] + held[3]
                if held[1][0] == label[0]:
                    found[2][0], found[3][0], found[4][0] = held[2][0], held[3][0] + found[3][0], held[4][0] + found[4][0]
                    held = []
            if held:
                found = [pa.concat_arrays([held[0], found[0]]), *[np.append(x, y) for x, y in zip(held[1:], found[1:], strict=True)]]
        held = [x[-1:] for x in found]
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1]) if isinstance(x, np.ndarray) else x[:-1] for x in found], schema=schema)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in held], schema=schema)


def sorted_runs(df: DataFrame, part: str, order: list[str], label: str, value: str) -> DataFrame:
    """part, label (int), first (from 0), length and total (of value) of each run of equal labels in each part.

    Rows are dealt and sorted once and pass as they come, so no row beside a batch is held but the sort's."""
    kind = df.schema[part].dataType.simpleString()
    schema = f"{part} {kind}, {label} int, first long, length long, total double"
    dealt = df.select(part, F.col(label).cast("int").alias(label), F.col(value).cast("double").alias(value), *order).repartition(part).sortWithinPartitions(part, *order)
    out = to_arrow_schema(StructType.fromDDL(schema))
    return dealt.select(part, label, value).mapInArrow(lambda batches: _short_runs(batches, out), schema)


def trailing(part: list[str], order: str, size: int):
    return Window.partitionBy(*part).orderBy(order).rowsBetween(-(size - 1), 0)


def rms(x: Column, window) -> Column:
    return F.sqrt(F.avg(x * x).over(window))


def decibel(x: Column, floor: float) -> Column:
    """20 log10 x, floor where x isn't positive."""
    return F.when(x > 0, F.lit(20.0) * F.log10(x)).otherwise(F.lit(floor))


def cusum(series: Column, mean: Column, slack: float, limit: float) -> Column:
    """Positions of the change points of an array: both sums restart after a change.

    The recurrence runs inside one array expression; a track's array is its unit of work."""
    start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("n"), F.lit(0).cast("long").alias("i"), F.array().cast("array<long>").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        p = F.greatest(F.lit(0.0), acc["p"] + x - mean - slack)
        n = F.greatest(F.lit(0.0), acc["n"] - x + mean - slack)
        hit = (p > limit) | (n > limit)
        return F.struct(F.when(hit, 0.0).otherwise(p).alias("p"), F.when(hit, 0.0).otherwise(n).alias("n"), (acc["i"] + 1).alias("i"),
                        F.when(hit, F.concat(acc["at"], F.array(acc["i"]))).otherwise(acc["at"]).alias("at"))

    return F.aggregate(series, start, step)["at"]


def interpolate(df: DataFrame, part: list[str], order: str, value: str, bad: Column) -> DataFrame:
    """Replace bad values by the line between their good neighbours (the one neighbour at an edge)."""
    w = Window.partitionBy(*part).orderBy(order)
    good = F.when(~bad, F.col(value))
    at = F.when(~bad, F.col(order))
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    marked = df.withColumns({
        "_v0": F.last(good, True).over(before), "_i0": F.last(at, True).over(before), "_v1": F.first(good, True).over(after), "_i1": F.first(at, True).over(after)})
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(order) - F.col("_i0")) / F.nullif(F.col("_i1") - F.col("_i0"), F.lit(0))
    return marked.withColumn("repaired", F.coalesce(F.when(~bad, F.col(value)), line, "_v0", "_v1")).drop("_v0", "_i0", "_v1", "_i1")
