"""Positional comparison, verification and lookups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import codec


def positional(a: DataFrame, b: DataFrame, keys: list[str], data: str, status: str, size: str | None = None) -> DataFrame:
    """Full outer join of two images by position with one verdict a row.

    The precedence is: missing in one, other size, other data, other status, identical."""
    cols = [data, status, *([size] if size else [])]
    left = a.select(*keys, F.lit(True).alias("_in_a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    right = b.select(*keys, F.lit(True).alias("_in_b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    both = left.join(right, keys, "full")
    verdict = F.when(F.col("_in_a").isNull(), "MISSING_IN_A").when(F.col("_in_b").isNull(), "MISSING_IN_B")
    if size:
        verdict = verdict.when(~F.col(f"{size}_a").eqNullSafe(F.col(f"{size}_b")), "SIZE")
    verdict = verdict.when(~F.col(f"{data}_a").eqNullSafe(F.col(f"{data}_b")), "DATA").when(~F.col(f"{status}_a").eqNullSafe(F.col(f"{status}_b")), "STATUS").otherwise("IDENTICAL")
    return both.withColumn("verdict", verdict).drop("_in_a", "_in_b")


def similarity(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Share of identical positions."""
    same = F.count_if(F.col("verdict") == "IDENTICAL")
    return verdicts.groupBy(*by).agg(F.count("*").alias("total"), same.alias("identical"), F.round(same / F.count("*"), 6).alias("similarity"))


def left_default(left: DataFrame, right: DataFrame, keys: list[str], value: str, default: str) -> DataFrame:
    """Left lookup; what has no partner gets the default."""
    return left.join(right, keys, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def hex_bytes_differing(a: Column, b: Column) -> Column:
    """Bytes in which two hexadecimal strings differ, and the bytes that one has beyond the other."""
    n = F.least(F.length(a), F.length(b)) / 2
    pairs = F.when(n >= 1, F.sequence(F.lit(1), n.cast("int")))
    diff = F.aggregate(F.coalesce(pairs, F.array().cast("array<int>")), F.lit(0).cast("long"),
                       lambda acc, i: acc + F.when(F.substring(a, i * 2 - 1, F.lit(2)) != F.substring(b, i * 2 - 1, F.lit(2)), 1).otherwise(0))
    return diff + (F.abs(F.length(a) - F.length(b)) / 2).cast("long")


def equal_bytes(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with same: at how many places two binary columns hold the same byte; null where one is null."""

    def run(batches):
        for batch in batches:
            same = []
            for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True):
                if x is None or y is None:
                    same.append(None)
                else:
                    n = min(len(x), len(y))
                    same.append(int(np.count_nonzero(np.frombuffer(x, np.uint8)[:n] == np.frombuffer(y, np.uint8)[:n])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(same, pa.int64())], names=[*batch.schema.names, "same"])

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, StructField("same", LongType())]))


#: A bit for each byte value at even and at odd places.
_MARKS = np.random.default_rng(18).integers(0, 2, (2, 256), np.uint8)


def sketches(df: DataFrame, data: str) -> DataFrame:
    """df with s0 and s1, 128 bits of a binary column, one for every other pair of bytes: of two values of one length no more bits differ than bytes; null where it is null."""

    def run(batches):
        for b in batches:
            raw, at = codec.flat(b.column(data))
            n = np.diff(at)
            wide = np.zeros((b.num_rows, max(1, -(-int(n.max(initial=0)) // 256)) * 256), np.uint8)
            wide[np.arange(wide.shape[1]) < n[:, None]] = raw
            bits = (_MARKS[0][wide[:, ::2]] ^ _MARKS[1][wide[:, 1::2]]).reshape(b.num_rows, -1, 128)
            words = np.packbits(np.bitwise_xor.reduce(bits, 1), axis=1).view(np.int64)
            none = b.column(data).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(words[:, k], mask=none) for k in (0, 1)]], names=[*b.schema.names, "s0", "s1"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("s0", LongType()), StructField("s1", LongType())]))
