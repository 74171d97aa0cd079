"""Bytes held as hexadecimal digits: reading numbers out of them and writing them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size(hexed: Column) -> Column:
    return (F.length(hexed) / 2).cast("int")


def cut(hexed: Column, at, n) -> Column:
    """n bytes from position at (from 0), as digits."""
    at = at if isinstance(at, Column) else F.lit(at)
    n = n if isinstance(n, Column) else F.lit(n)
    return F.substring(hexed, (at * 2 + 1).cast("int"), (n * 2).cast("int"))


def number(digits: Column) -> Column:
    """A big-endian number; null without digits."""
    return F.conv(F.nullif(digits, F.lit("")), 16, 10).cast("long")


def byte(hexed: Column, at) -> Column:
    return number(cut(hexed, at, 1))


def big(hexed: Column, at, n: int) -> Column:
    return number(cut(hexed, at, n))


def little(hexed: Column, at: int, n: int) -> Column:
    return number(F.concat(*[cut(hexed, at + i, 1) for i in reversed(range(n))]))


def once(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def values(hexed: Column) -> Column:
    """All bytes as an array of numbers, none of null; the digits are cut once from left to right."""
    pairs = F.regexp_extract_all(hexed, F.lit(".."), F.lit(0))
    return F.coalesce(F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("long")), F.array().cast("array<bigint>"))


def digits(value: Column, n: int) -> Column:
    """A number as the digits of n bytes, most significant first."""
    return F.lpad(F.hex(value), 2 * n, "0")


def digits_little(value: Column, n: int) -> Column:
    d = digits(value, n)
    return F.concat(*[F.substring(d, 2 * i + 1, 2) for i in reversed(range(n))])


# The same in DuckDB's SQL, as text.
def sql_byte(h: str, at: str) -> str:
    return f"CAST('0x' || substr({h}, CAST(({at}) * 2 + 1 AS BIGINT), 2) AS BIGINT)"


def sql_values(h: str) -> str:
    return f"[CAST('0x' || substr({h}, CAST(i * 2 + 1 AS BIGINT), 2) AS BIGINT) FOR i IN range(0, length({h}) // 2)]"
