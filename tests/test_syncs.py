"""Sliding words against a plain comparison at every bit; equal bytes of pairs."""

import random

import numpy as np
import pytest

from lamina.operators import compare, syncs


@pytest.mark.parametrize("width", [1, 5, 16, 48, 63])
def test_windows(width):
    rng = np.random.default_rng(width)
    for n in (0, width - 1, width, width + 1, 200):
        bits = rng.integers(0, 2, max(0, n)).astype(np.uint8)
        want = [int("".join(map(str, bits[p : p + width])), 2) for p in range(len(bits) - width + 1)]
        assert syncs.windows(bits, width).tolist() == want


def plain(stream, sync, errors, reach):
    n = len(sync)
    d = [sum(a != b for a, b in zip(stream[p : p + n], sync, strict=True)) for p in range(len(stream) - n + 1)]
    at = [p for p, x in enumerate(d) if x == 0] or [p for p, x in enumerate(d) if x <= errors]
    out = []
    for p in at:
        best = min((d[q], abs(q - p), q) for q in range(max(0, p - reach), min(len(d), p + reach + 1)))
        out.append((best[2], best[2] - p, best[0]) if best[0] < d[p] else (p, 0, d[p]))
    return out


def test_places_and_streams(spark):
    rng = random.Random(4)
    sync = "0100010010001001"
    rows, want = [], []
    for i in range(40):
        s = "".join(rng.choices("01", k=rng.choice([0, 3, 40, 90])))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(s) + 1)
            word = list(sync)
            for _ in range(rng.randrange(3)):
                word[rng.randrange(16)] = rng.choice("01")
            s = s[:k] + "".join(word) + s[k:]
        got = syncs.places(np.frombuffer(s.encode(), np.uint8) & 1, int(sync, 2), 16, 3, 2)
        assert got == plain(s, sync, 3, 2)
        rows.append((i, 0, bytearray(int(c) for c in s)))
        want += [(i, 0, *p) for p in got]
    df = spark.createDataFrame([*rows, (99, 0, None)], "image long, chunk long, bits binary")
    assert sorted(map(tuple, syncs.found(df, int(sync, 2), 16, 3, 2).collect())) == sorted(want)


def test_equal_bytes(spark):
    rows = [(1, bytearray(b"abcd"), bytearray(b"abxd")), (2, bytearray(b""), bytearray(b"x")), (3, None, bytearray(b"x")), (4, bytearray(b"ab"), bytearray(b"abc"))]
    got = compare.equal_bytes(spark.createDataFrame(rows, "k long, x binary, y binary"), "x", "y").select("k", "same").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 3), (2, 0), (3, None), (4, 2)]
