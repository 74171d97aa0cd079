"""Sync words found at any bit by sliding a word over whole streams, all positions of a batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def windows(bits: np.ndarray, width: int) -> np.ndarray:
    """The number that each width bits in a row make, at every position; widths double, so a few shifts serve all positions."""
    have, value, left = 1, bits.astype(np.uint64), width
    done, out = 0, np.zeros(len(bits), np.uint64)
    while left:
        if left & 1:  # the next `have` bits stand `done` bits further on
            m = max(0, len(value) - done)
            out, done = (out[:m] << np.uint64(have)) | value[done : done + m], done + have
        left >>= 1
        if left:
            m = max(0, len(value) - have)
            value, have = (value[:m] << np.uint64(have)) | value[have : have + m], 2 * have
    return out


def places(stream: np.ndarray, sync: int, width: int, errors: int, reach: int) -> list[tuple[int, int, int]]:
    """(position, slip, distance): exact places of sync; where there is none, those within errors wrong bits, each moved by
    up to reach to where the distance is least (the least distance, then the shortest way, then the left)."""
    d = np.bitwise_count(windows(stream, width) ^ np.uint64(sync)).astype(np.int64)
    exact = d == 0
    at = np.flatnonzero(exact if exact.any() else d <= errors)
    out = []
    for p in at.tolist():
        near = [(int(d[q]), abs(q - p), q) for q in range(max(0, p - reach), min(len(d), p + reach + 1))]
        best, _, q = min(near)
        out.append((q, q - p, best) if best < d[p] else (p, 0, int(d[p])))
    return out


def found(streams: DataFrame, sync: int, width: int, errors: int = 6, reach: int = 2) -> DataFrame:
    """The keys of (image, chunk, bits) with position, slip and distance of each place; bits as bytes 0 and 1, null: none."""

    def run(batches):
        for batch in batches:
            rows = []
            for image, chunk, bits in zip(*(batch.column(c).to_pylist() for c in ("image", "chunk", "bits")), strict=True):
                stream = np.frombuffer(bits or b"", np.uint8)
                rows += [(image, chunk, *p) for p in places(stream, sync, width, errors, reach)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["image", "chunk", "position", "slip", "distance"])

    return streams.select("image", "chunk", "bits").mapInArrow(run, "image long, chunk long, position long, slip long, distance long")
