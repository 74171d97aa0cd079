"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import octets


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def soft_threshold(x: Column, t: float) -> Column:
    return F.when(x > t, x - t).when(x < -t, x + t).otherwise(F.lit(0.0))


def hard_threshold(x: Column, t: float) -> Column:
    return F.when(F.abs(x) > t, x).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def glob(name: Column, pattern: str) -> Column:
    """Match * and ? only, case-sensitive, over the whole name."""
    import re

    text = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return name.rlike(f"^(?s:{text})$")


def crc16_ccitt(hexed: Column, preset: int = 0xFFFF) -> Column:
    """CRC-16 (0x1021) of the bytes of a hexadecimal string, as one array expression."""

    def step(acc: Column, byte: Column) -> Column:
        byte = byte.cast("int")
        y = F.shiftright(acc, 8).bitwiseXOR(byte)
        x = y.bitwiseXOR(F.shiftright(y, 4))  # the polynomial's shifts for a whole byte
        return F.shiftleft(acc, 8).bitwiseXOR(F.shiftleft(x, 12)).bitwiseXOR(F.shiftleft(x, 5)).bitwiseXOR(x).bitwiseAND(0xFFFF)

    return F.aggregate(octets.values(hexed), F.lit(preset), step)
