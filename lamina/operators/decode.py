"""Group codes read along the cheapest path."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import codec

# The sixteen five-bit codes.
_CODES = (10, 11, 18, 19, 14, 15, 22, 23, 9, 25, 26, 27, 13, 29, 30, 21)
SLIP = 3


def _tables() -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Cost and half byte of each pattern of four, five or six bits: differing bits, and SLIP where a bit was lost or put in."""
    out = {}
    for n in (4, 5, 6):
        cost, digit = np.full(1 << n, 99), np.zeros(1 << n, np.int64)
        for v in range(1 << n):
            text = f"{v:0{n}b}"
            for i, code in enumerate(_CODES):
                c = f"{code:05b}"
                if n == 5:
                    d = sum(a != b for a, b in zip(text, c, strict=True))
                else:
                    short, long_ = (text, c) if n == 4 else (c, text)
                    d = SLIP + min(sum(a != b for a, b in zip(short, long_[:k] + long_[k + 1 :], strict=True)) for k in range(len(long_)))
                if d < cost[v]:
                    cost[v], digit[v] = d, i
        out[n] = cost, digit
    return out


_TABLES = _tables()
#: Bits of a group by its rank; rank 3 stands at a string's beginning.
_SIZES = np.array([6, 5, 4, 0])


def _packed() -> tuple[list[bytes], np.ndarray]:
    """By six bits: four times the cost of their first four, five or six bits and the rank in which equal costs win (six bits, five, four); by rank and six bits: the digit."""
    cost, digit = [bytes(256)] * 3, np.zeros(256, np.uint8)
    for rank, size in enumerate(_SIZES[:3].tolist()):
        c, d = _TABLES[size]
        six = np.arange(64) >> 6 - size
        cost[rank] = (c[six] * 4 + rank).astype(np.uint8).tobytes().ljust(256, b"\0")
        digit[rank * 64 : rank * 64 + 64] = np.frombuffer(b"0123456789ABCDEF", np.uint8)[d[six]]
    return cost, digit


_COSTS, _DIGITS = _packed()
#: Strings and positions that are stepped side by side.
_ROWS, _CELLS = 4096, 1 << 22


def cheapest(bits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least cost of strings of bits (0 and 1, one behind another, with their offsets) read as groups of five, of four (one lost) or six (one too many), all
    digits and their offsets; -1 and no digits where no such groups fill a string. All strings step through their positions together."""
    n = np.diff(at)
    wide, rows = int(n.max(initial=0)), len(n)
    by_row = np.zeros((rows, wide + 6), np.uint8)
    by_row[np.arange(wide + 6) < n[:, None]] = bits
    b = np.ascontiguousarray(by_row.T)
    seen = np.zeros((wide + 1, rows), np.uint8)  # six bits from each position on; those behind the end are in no group
    for k in range(6):
        seen = seen << 1 | b[k : k + wide + 1]
    kind, far = (np.int16, 1 << 14) if wide < 2000 else (np.int32, 1 << 29)  # four times a cost is at most 5.5 times the bits
    whole = seen.tobytes()
    six, five, four = (np.frombuffer(whole.translate(c), np.uint8).reshape(wide + 1, rows).astype(kind) for c in _COSTS)
    cost = np.full((wide + 1, rows), far, kind)  # four times the cost
    rank = np.full((wide + 1, rows), 3, np.uint8)
    cost[0] = 0
    best, other = np.empty(rows, kind), np.empty(rows, kind)
    for q in range(4, wide + 1):
        np.add(cost[q - 4], four[q - 4], out=best)
        if q >= 5:
            np.minimum(best, np.add(cost[q - 5], five[q - 5], out=other), out=best)
        if q >= 6:
            np.minimum(best, np.add(cost[q - 6], six[q - 6], out=other), out=best)
        np.bitwise_and(best, 3, out=rank[q], casting="unsafe")
        np.bitwise_and(best, -4, out=cost[q])
    each = np.arange(rows)
    total = cost[n, each].astype(np.int64)
    total = np.where(total < far, total >> 2, -1)
    spot = np.where(total < 0, 0, n) * rows + each
    made = np.zeros((wide // 4 + 1, rows), np.uint8)
    flat, ranks, back = seen.reshape(-1), rank.reshape(-1), _SIZES * rows
    k = 0
    while (spot >= rows).any():
        r = ranks[spot]
        spot -= back[r]
        made[k] = _DIGITS[r << 6 | flat[spot]]
        k += 1
    digits = made[:k][::-1].T.reshape(-1)
    return total, digits[digits > 0], np.concatenate([[0], np.cumsum(np.count_nonzero(made[:k], axis=0))])


def trellises(texts: list[str]) -> list[tuple[int, str]]:
    """Least cost and half bytes of strings of bits; (-1, "") where no groups fill a string."""
    total, digits, at = cheapest(np.frombuffer("".join(texts).encode(), np.uint8) & 1, np.cumsum([0, *map(len, texts)]))
    return [(c, digits[i:j].tobytes().decode()) for c, i, j in zip(total.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]


def coded_with_a_loss(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bits and their offsets of (image, chunk, data, at) in group code without bit `at`; one that is null leaves no bits, a negative one (of a negative
    number) those that substring gives from at + 2 on."""
    raw, off = codec.flat(b.column("data"))
    bits, off = codec.group_bits(raw), off * 10
    n = np.diff(off)
    none, lost = b.column("at").is_null().to_numpy(zero_copy_only=False), b.column("at").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    keep = np.ones(len(bits), bool)
    keep[(off[:-1] + lost)[~none & (lost >= 0) & (lost < n)]] = False
    for r in np.flatnonzero(none | (lost < 0)).tolist():
        first = n[r] if none[r] else 0 if lost[r] >= -2 else max(0, n[r] + lost[r] + 2)
        keep[off[r] : off[r] + first] = False
    return bits[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def _as_given(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text, at = codec.flat(b.column("bits"))
    return text & 1, at


def group_trellis(df: DataFrame, bits: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]] = _as_given) -> DataFrame:
    """(image, chunk, cost, decoded) of (image, chunk, bits), or of what bits makes of a batch."""

    def run(batches):
        for whole in batches:
            values, ends = bits(whole)
            step = max(1, min(_ROWS, _CELLS // max(1, int(np.diff(ends).max(initial=0)))))
            for lo in range(0, whole.num_rows, step):
                b, at = whole.slice(lo, step), ends[lo : lo + step + 1]
                cost, digits, offsets = cheapest(values[at[0] : at[-1]], at - at[0])
                yield pa.RecordBatch.from_arrays([b.column("image"), b.column("chunk"), pa.array(cost), codec.strings(digits, offsets)], names=["image", "chunk", "cost", "decoded"])

    return df.mapInArrow(run, "image long, chunk long, cost long, decoded string")
