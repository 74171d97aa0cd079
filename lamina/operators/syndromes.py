"""Bits put right by their checksum, for whole batches of blocks of any length.

A checksum is linear: the difference of the stored and the counted one depends on the turned bits alone, and a bit's share only on its
distance from the block's end. So one table, distance to syndrome, and its inverse serve every length: one wrong bit is a lookup of
the difference, two are a lookup of the difference and each first bit's share together. All blocks of a batch are counted and looked up
side by side.

Outcomes: OK (no difference), ONE and TWO (the only bit or pair that explains it is turned back), AMBIGUOUS (several do), NONE. Wrong bits of the
checksum itself are not looked for. Three wrong bits may look like one; what was
turned back then meets the checksum and is still wrong, as it must be with sixteen bits.

Defined cases: a null block or checksum has a null outcome; an empty block has the preset as its checksum; blocks longer than
most_two bytes are not searched for pairs."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PRESET, POLYNOMIAL = 0xFFFF, 0x1021
#: Distances after which the syndromes of single bits repeat.
PERIOD = 32_767


@functools.cache
def _bytes_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        c = ((c << 1) ^ np.where(c & 0x8000, POLYNOMIAL, 0)).astype(np.uint32) & 0xFFFF
    return c.astype(np.uint16)


@functools.cache
def single() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of the bit at each distance from the end (0: the last), and the distance of each syndrome (-1: none)."""
    s, c = np.zeros(PERIOD, np.uint16), POLYNOMIAL
    for d in range(PERIOD):
        s[d] = c
        c = (c << 1 ^ (POLYNOMIAL if c & 0x8000 else 0)) & 0xFFFF
    inverse = np.full(65536, -1, np.int32)
    inverse[s] = np.arange(PERIOD)
    return s, inverse


def checksums(blocks: list[bytes]) -> np.ndarray:
    """The checksum of each block; blocks are laid with their ends together and stepped a byte at a time."""
    sizes = np.array([len(b) for b in blocks], np.int64)
    most = int(sizes.max(initial=0))
    laid = np.zeros((len(blocks), most), np.uint8)
    for row, b in zip(laid, blocks, strict=True):
        if b:
            row[most - len(b) :] = np.frombuffer(b, np.uint8)
    table, c = _bytes_table(), np.full(len(blocks), PRESET, np.uint16)
    first = most - sizes
    for at in range(most):
        stepped = (c << np.uint16(8)) ^ table[(c >> np.uint16(8)) ^ laid[:, at]]
        c = np.where(first <= at, stepped, c)
    return c


def explain(wrong: np.ndarray, bits: np.ndarray, most_wrong: int, most_two: int = 512) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Outcome of each difference in a block of so many bits, and the distances of the bits to turn back (-1: none)."""
    shares, inverse = single()
    outcome = np.full(len(wrong), "NONE", object)
    a, b = np.full(len(wrong), -1, np.int64), np.full(len(wrong), -1, np.int64)
    outcome[wrong == 0] = "OK"
    at = inverse[wrong]
    hit = (wrong != 0) & (at >= 0) & (at < bits)
    outcome[hit] = np.where(at[hit] + PERIOD < bits[hit], "AMBIGUOUS", "ONE")
    a[outcome == "ONE"] = at[outcome == "ONE"]
    if most_wrong > 1:
        left = np.flatnonzero((wrong != 0) & ~hit & (bits > 0) & (bits <= 8 * most_two))
        for k in range(0, len(left), 256):
            rows = left[k : k + 256]
            n = int(bits[rows].max())
            first = np.arange(n)
            other = inverse[wrong[rows][:, None] ^ shares[None, :n]]
            pair = (other > first[None, :]) & (other < bits[rows][:, None])
            found = pair.sum(axis=1)
            outcome[rows[found > 1]] = "AMBIGUOUS"
            one = np.flatnonzero(found == 1)
            place = pair[one].argmax(axis=1)
            outcome[rows[one]] = "TWO"
            a[rows[one]], b[rows[one]] = place, other[one, place]
    return outcome.tolist(), a, b


def repair(blocks: list[bytes | None], stored: list[int | None], most_wrong: int = 2, most_two: int = 512) -> tuple[list[str | None], list[bytes | None]]:
    """Outcome of each block and its bytes put right; bytes stay as they are where nothing explains the difference."""
    have = [i for i, (x, c) in enumerate(zip(blocks, stored, strict=True)) if x is not None and c is not None]
    some = [blocks[i] for i in have]
    wrong = checksums(some) ^ np.array([stored[i] for i in have], np.uint16)
    outcome, a, b = explain(wrong, np.array([8 * len(x) for x in some], np.int64), most_wrong, most_two)
    states, made = [None] * len(blocks), list(blocks)
    for k, i in enumerate(have):
        states[i] = outcome[k]
        turned = [d for d in (int(a[k]), int(b[k])) if d >= 0]
        if turned:
            x = bytearray(some[k])
            for d in turned:
                x[len(x) - 1 - d // 8] ^= 1 << d % 8
            made[i] = bytes(x)
    return states, made


def repaired(blocks: DataFrame, most_wrong: int = 2, most_two: int = 512) -> DataFrame:
    """The rows of blocks (with columns data and crc) and outcome, fixed."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                some = batch.slice(k, 4096)
                outcome, fixed = repair(some.column("data").to_pylist(), some.column("crc").to_pylist(), most_wrong, most_two)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(outcome, pa.string()), pa.array(fixed, pa.binary())], names=[*some.schema.names, "outcome", "fixed"])

    return blocks.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in blocks.dtypes) + ", outcome string, fixed binary")
