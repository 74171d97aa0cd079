"""Sectors and cells as matrices of bytes: all sectors of an Arrow batch are coded or read side by side, a numpy row each.

Cells are bytes "0" and "1"; inside this module bits are 0 and 1. A block that ends early keeps the bytes that it holds."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from ..functions import cells as cl

#: Tracks and blocks that are worked on at once.
TRACKS, BLOCKS = 64, 2048
_HEX = np.frombuffer(b"0123456789ABCDEF?", np.uint8)
_NIBBLES = np.full(32, 16, np.uint8)
for _i, _c in enumerate(cl.GROUPS):
    _NIBBLES[int(_c, 2)] = _i
_FIVE = np.array([[int(x) for x in c] for c in cl.GROUPS], np.uint8)
_TEN = np.concatenate([np.repeat(_FIVE, 16, axis=0), np.tile(_FIVE, (16, 1))], axis=1)
_SIX = np.array(cl.SIX, np.uint8)
_PLACE = np.zeros(256, np.int64)
_PLACE[_SIX] = np.arange(len(_SIX))


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.int64) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, t << 1 ^ 0x1021, t << 1) & 0xFFFF
    return t


_CRC = _crc_table()


def flat(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without nulls, and its offsets from 0."""
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64) if len(a) else np.zeros(1, np.int64)
    data = a.buffers()[2]
    got = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return got, offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An array of strings (or bytes) from their bytes and offsets."""
    return pa.Array.from_buffers(kind or pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data, np.uint8).tobytes())])


def digits(data: np.ndarray) -> np.ndarray:
    """Two hexadecimal digits of each byte."""
    return np.stack([_HEX[data >> 4], _HEX[data & 15]], axis=-1).reshape(*data.shape[:-1], -1)


def crc16(rows: np.ndarray, preset: int, n: np.ndarray | None = None) -> np.ndarray:
    """CRC-16 (0x1021) of each row, of its first n bytes if n is given."""
    crc = np.full(len(rows), preset, np.int64)
    for i in range(rows.shape[1]):
        new = crc << 8 & 0xFFFF ^ _CRC[crc >> 8 ^ rows[:, i]]
        crc = new if n is None else np.where(i < n, new, crc)
    return crc


def _bits(rows: np.ndarray) -> np.ndarray:
    return np.unpackbits(rows, axis=1)


def _const(text: str, n: int) -> np.ndarray:
    return np.broadcast_to(np.frombuffer(text.encode(), np.uint8) - 48, (n, len(text)))


def _mfm(bits: np.ndarray, last: int) -> np.ndarray:
    before = np.concatenate([np.full((len(bits), 1), last, np.uint8), bits[:, :-1]], axis=1)
    return np.stack([(before | bits) ^ 1, bits], axis=2).reshape(len(bits), -1)


def _fm(bits: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(bits), bits], axis=2).reshape(len(bits), -1)


def _with_crc(rows: np.ndarray, preset: int) -> np.ndarray:
    crc = crc16(rows, preset)
    return np.concatenate([rows, np.stack([crc >> 8, crc & 255], axis=1).astype(np.uint8)], axis=1)


def _column(*parts) -> np.ndarray:
    n = max(len(p) for p in parts if isinstance(p, np.ndarray))
    return np.concatenate([p.reshape(n, -1) if isinstance(p, np.ndarray) else np.full((n, 1), p) for p in parts], axis=1).astype(np.uint8)


def _mfm_sector(cyl, sector, data):
    n = len(data)
    lead, gap = _const("10" * 96 + cl.SYNC * 3, n), _mfm(_bits(np.full((n, 22), 0x4E, np.uint8)), 0)
    address = _with_crc(_column(0xFE, cyl, 0, sector, 0), cl.AFTER_SYNC)
    return [lead, _mfm(_bits(address), 1), gap, lead, _mfm(_bits(_with_crc(_column(0xFB, data), cl.AFTER_SYNC)), 1), gap]


def _fm_sector(cyl, sector, data):
    n = len(data)
    lead, gap = _const("10" * 48, n), _const("1" * 176, n)
    address, body = _with_crc(_column(0xFE, cyl, 0, sector, 0), 0xFFFF)[:, 1:], _with_crc(_column(0xFB, data), 0xFFFF)[:, 1:]
    return [lead, _const(cl.FM_ADDRESS, n), _fm(_bits(address)), gap, lead, _const(cl.FM_DATA, n), _fm(_bits(body)), gap]


def _five(rows: np.ndarray) -> np.ndarray:
    return _FIVE[np.stack([rows >> 4, rows & 15], axis=2).reshape(len(rows), -1)].reshape(len(rows), -1)


def group_bits(raw: np.ndarray) -> np.ndarray:
    """Ten bits for each byte: its half bytes in group code."""
    return _TEN[raw].reshape(-1)


def _c64_sector(cyl, sector, data):
    n = len(data)
    ids = _column(sector, cyl + 1, 0x32, 0x41)
    header, body = _column(0x08, np.bitwise_xor.reduce(ids, axis=1), ids, 0x0F, 0x0F), _column(0x07, data, np.bitwise_xor.reduce(data, axis=1), 0, 0)
    sync, gap = _const("1" * 40, n), _const("01" * 36, n)
    return [sync, _five(header), gap, sync, _five(body), gap]


def _apple_sector(cyl, sector, data):
    n = len(data)
    pairs = lambda v: np.stack([v >> 1 | 0xAA, v | 0xAA], axis=1)
    volume = np.full(n, 254)
    address = _column(0xD5, 0xAA, 0x96, pairs(volume), pairs(cyl), pairs(sector), pairs(volume ^ cyl ^ sector), 0xDE, 0xAA, 0xEB)
    held = np.zeros((n, 258), np.uint8)
    held[:, : min(258, data.shape[1])] = data[:, :258]
    low = (held & 1) << 1 | held >> 1 & 1
    six = np.concatenate([low[:, :86] | low[:, 86:172] << 2 | low[:, 172:] << 4, data >> 2], axis=1)
    code = _SIX[np.concatenate([six[:, :1], six[:, 1:] ^ six[:, :-1], six[:, -1:]], axis=1)]
    return [_const("1" * 64, n), _bits(address), _const("1" * 48, n), _bits(_column(0xD5, 0xAA, 0xAD, code, 0xDE, 0xAA, 0xEB))]


def _odd_even(rows: np.ndarray) -> np.ndarray:
    b = _bits(rows)
    return np.concatenate([b[:, ::2], b[:, 1::2]], axis=1)


def _xor16(bits: np.ndarray) -> np.ndarray:
    """Exclusive or of the rows' whole groups of 16 bits."""
    return np.bitwise_xor.reduce(bits[:, : bits.shape[1] // 16 * 16].reshape(len(bits), -1, 16), axis=1)


def _amiga_sector(cyl, sector, data):
    n = len(data)
    head = np.concatenate([_odd_even(_column(0xFF, cyl, sector, 1)), np.zeros((n, 128), np.uint8)], axis=1)
    body, zero = _odd_even(data), np.zeros((n, 16), np.uint8)
    return [_const("10" * 16 + cl.SYNC * 2, n), _mfm(np.concatenate([head, zero, _xor16(head), zero, _xor16(body), body], axis=1), 1)]


_WRITERS: dict[str, Callable] = {"MFM": _mfm_sector, "FM": _fm_sector, "C64": _c64_sector, "APPLE": _apple_sector, "AMIGA": _amiga_sector}


def _one_byte(v: np.ndarray) -> np.ndarray:
    """A number's first two hexadecimal digits, as headers hold it."""
    v = v.copy()
    while (v > 255).any():
        v = np.where(v > 255, v >> 4, v)
    return v


def written(batches: Iterator[pa.RecordBatch], encoding: str) -> Iterator[pa.RecordBatch]:
    """(track, cells) of (track, sectors: an array of sector, data, damage), tracks side by side."""
    for whole in batches:
        for lo in range(0, whole.num_rows, TRACKS):
            b = whole.slice(lo, TRACKS)
            ends = np.concatenate([[0], np.cumsum(b.column(1).value_lengths().to_numpy(zero_copy_only=False))])
            rows = b.column(1).flatten()
            number, cut = rows.field(0).to_numpy(zero_copy_only=False).astype(np.int64), rows.field(2).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, at = flat(rows.field(1))
            track = np.repeat(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(ends))
            size, made = np.diff(at), [b""] * len(rows)
            for n in np.unique(size).tolist():
                who = np.flatnonzero(size == n)
                data = raw[at[who][:, None] + np.arange(n)]
                cells = np.concatenate(_WRITERS[encoding](_one_byte(np.fmod(track[who], 160)), _one_byte(number[who]), data), axis=1)
                hurt = np.flatnonzero((cut[who] > 0) & (cut[who] < cells.shape[1]))
                cells[hurt, cells.shape[1] - cut[who][hurt] - 1] ^= 1
                for k, i in enumerate(who.tolist()):
                    made[i] = (cells[k] + 48).tobytes()
            tracks = [b"".join(made[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tracks, pa.binary()).cast(pa.string())], names=["track", "cells"])


def _every(raw: bytes, word: bytes) -> Iterator[int]:
    at = raw.find(word)
    while at >= 0:
        yield at
        at = raw.find(word, at + 1)


def _after(pattern: bytes) -> Callable[[bytes], tuple[list[int], list[int]]]:
    """Where blocks start and end that stand between matches of pattern."""
    compiled = re.compile(pattern)

    def run(raw: bytes) -> tuple[list[int], list[int]]:
        spans = [m.span() for m in compiled.finditer(raw)]
        return [e for _, e in spans], [s for s, _ in spans[1:]] + [len(raw)] * bool(spans)

    return run


def _from(*words: bytes) -> Callable[[bytes], tuple[list[int], list[int]]]:
    """The same where the words themselves belong to the blocks that they start; one at the very start has nothing before it and is left."""

    def run(raw: bytes) -> tuple[list[int], list[int]]:
        at = sorted(p for w in words for p in _every(raw, w) if p > 0)
        return at, at[1:] + [len(raw)] * bool(at)

    return run


def _as_bits(hexed: str) -> bytes:
    return "".join(f"{int(c, 16):04b}" for c in hexed).encode()


#: How tracks are cut into blocks, and the cells of a block that are looked at (of sectors of so many bytes).
_CUTS: dict[str, tuple[Callable, Callable[[int], int]]] = {
    "MFM": (_after(b"(?:" + cl.SYNC.encode() + b"){3}"), lambda size: 16 * (size + 3)), "FM": (_from(cl.FM_ADDRESS.encode(), cl.FM_DATA.encode()), lambda size: 16 * (size + 3)),
    "C64": (_after(b"1{10,}"), lambda size: 2600), "APPLE": (_from(_as_bits(cl.APPLE_ADDRESS), _as_bits(cl.APPLE_DATA)), lambda size: 8 * 346), "AMIGA": (_after(b"(?:" + cl.SYNC.encode() + b")+"), lambda size: 16 * 540)}


def _packed(bits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of rows of bits, and how many of them are whole."""
    return np.packbits(bits, axis=1), n // 8


def _second(cells: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The second cell of every pair; a last one without a partner stands for itself."""
    odd = np.flatnonzero(n % 2)
    cells[odd, n[odd]] = cells[odd, n[odd] - 1]
    return cells[:, 1::2], (n + 1) // 2


def _texts(rows: np.ndarray, n: np.ndarray) -> pa.Array:
    """Strings of the rows' first n characters."""
    n = np.clip(n, 0, rows.shape[1])
    return strings(rows[np.arange(rows.shape[1]) < n[:, None]], np.concatenate([[0], np.cumsum(n)]))


def _numbers(v: np.ndarray, there: np.ndarray) -> pa.Array:
    return pa.array(v.astype(np.int64), mask=~there)


def _truths(v: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
    return pa.array(v, mask=None if there is None else ~there)


def _read_checked(cells, n, same, size, preset):
    rows, k = _packed(*_second(cells, n))
    kind = np.where(k < 1, 0, np.where(rows[:, 0] == 0xFE, 1, np.where(rows[:, 0] == 0xFB, 2, 0)))
    at = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2) & same)
    a, d, na, nd = rows[at], rows[at + 1], k[at], k[at + 1]
    number = lambda i: _numbers(a[:, i], na > i)
    ok = lambda r, m, most: _truths(crc16(r[:, :most], preset, np.minimum(m, most)) == 0)
    return at, [number(1), number(2), number(3), _texts(digits(d[:, 1 : size + 1]), 2 * (nd - 1)), ok(a, na, 7), ok(d, nd, size + 3)]


def _read_mfm(cells, n, same, size):
    return _read_checked(cells, n, same, size, cl.AFTER_SYNC)


def _read_fm(cells, n, same, size):
    return _read_checked(cells, n, same, size, 0xFFFF)


def nibbles(cells: np.ndarray) -> np.ndarray:
    """Half bytes of rows of five-bit groups, 16 where a group is none."""
    g = cells[:, : cells.shape[1] // 5 * 5].reshape(len(cells), -1, 5)
    return _NIBBLES[g @ np.array([16, 8, 4, 2, 1], np.uint8)]


def in_groups(digit: bytes, cost: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For (image, chunk, data as bytes): each five-bit group of the data's bits as its digit, and the sum of the groups' costs; both given by the group's value."""
    table, weight = np.frombuffer(digit, np.uint8), np.array(cost, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = flat(b.column(2))
            size, made, total = np.diff(at), [b""] * b.num_rows, np.zeros(b.num_rows, np.int64)
            for n in np.unique(size).tolist():
                who = np.flatnonzero(size == n)
                bits = np.unpackbits(raw[at[who][:, None] + np.arange(n)], axis=1)
                g = bits[:, : bits.shape[1] // 5 * 5].reshape(len(who), -1, 5) @ np.array([16, 8, 4, 2, 1], np.uint8)
                total[who] = weight[g].sum(axis=1)
                for i, text in zip(who.tolist(), table[g], strict=True):
                    made[i] = text.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary()).cast(pa.string()), pa.array(total)], names=["image", "chunk", "decoded", "cost"])

    return run


def _read_c64(cells, n, same, size):
    x, k = nibbles(cells), n // 5
    kind = np.where((k >= 2) & (x[:, 0] == 0), np.where(x[:, 1] == 8, 1, np.where(x[:, 1] == 7, 2, 0)), 0)
    at = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2) & same)
    h, d, nh, nd = x[at].astype(np.int64), x[at + 1].astype(np.int64), k[at], k[at + 1]

    def value(i):  # digits up to the first that is none
        hi, lo = h[:, 2 * i], h[:, 2 * i + 1]
        return np.where(hi > 15, 0, np.where((lo > 15) | (nh < 2 * i + 2), hi, hi * 16 + lo))

    xor = np.zeros(len(at), np.int64)
    for i in range(2, 6):
        xor ^= np.where(nh >= 2 * i + 2, value(i), 0)
    valid = ~((d[:, :516] > 15) & (np.arange(516) < nd[:, None])).any(axis=1)
    body = np.where((d > 15) | (np.arange(d.shape[1]) >= nd[:, None]), 0, d)
    pairs = body[:, 0:516:2] * 16 + body[:, 1:516:2]
    sound = np.bitwise_xor.reduce(pairs[:, 1:257], axis=1) == pairs[:, 257]
    return at, [_numbers(value(3) - 1, nh > 6), _numbers(np.zeros(len(at)), np.ones(len(at), bool)), _numbers(value(2), nh > 4), _texts(_HEX[d[:, 2:514]], nd - 2), _truths(xor == value(1), nh > 2), _truths(valid & sound, ~valid | (nd > 514))]


def _read_apple(cells, n, same, size):
    rows, k = _packed(cells[:, : cells.shape[1] // 8 * 8], n)
    third = rows[:, 2]
    kind = np.where((k >= 3) & (rows[:, 0] == 0xD5) & (rows[:, 1] == 0xAA), np.where(third == 0x96, 1, np.where(third == 0xAD, 2, 0)), 0)
    at = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2) & same)
    a, d, na, nd = rows[at].astype(np.int64), rows[at + 1], k[at], np.clip(k[at + 1] - 3, 0, 343)
    two = lambda i: (a[:, i] * 2 + 1) & 255 & a[:, i + 1]
    six = np.bitwise_xor.accumulate(_PLACE[d[:, 3:346]], axis=1)
    i = np.arange(256)
    low = six[:, i % 86] >> np.where(i >= 172, 4, np.where(i >= 86, 2, 0))
    data = (six[:, 86:342] * 4 + (low & 1) * 2 + (low >> 1 & 1)).astype(np.uint8)
    return at, [_numbers(two(5), na > 6), _numbers(np.zeros(len(at)), np.ones(len(at), bool)), _numbers(two(7), na > 8), _texts(digits(data), 2 * (nd - 86)), _truths(two(3) ^ two(5) ^ two(7) == two(9), na > 10), _truths(six[:, 342] == 0, nd > 342)]


def _read_amiga(cells, n, same, size):
    bits, k = _second(cells, n)
    bits = np.where(np.arange(bits.shape[1]) < k[:, None], bits, 0).astype(np.uint8)

    def field(at, count, of):  # bytes of a field of count bytes from byte at, and how many are whole
        odd, even = bits[of, at * 8 : at * 8 + count * 4], bits[of, at * 8 + count * 4 : (at + count) * 8]
        return _packed(np.stack([odd, even], axis=2).reshape(len(of), -1), 2 * np.clip(k[of] - at * 8 - count * 4, 0, count * 4))

    info, whole = field(0, 4, np.arange(len(bits)))
    at = np.flatnonzero((whole >= 1) & (info[:, 0] == 0xFF))
    info, whole = info[at], whole[at]

    def sound(lo, hi, check):  # groups of 16 that are not whole are left out
        body = np.where(np.arange(hi - lo) < np.clip(k[at] - lo, 0, hi - lo)[:, None] // 16 * 16, bits[at, lo:hi], 0).astype(np.uint8)
        x = _xor16(body)
        return _truths((np.packbits(np.stack([np.zeros_like(x), x], axis=2).reshape(len(at), -1), axis=1) == check[0]).all(axis=1) & (check[1] == 4))

    data, nd = field(28, 512, at)
    return at, [_numbers(info[:, 1], whole > 1), _numbers(np.zeros(len(at)), np.ones(len(at), bool)), _numbers(info[:, 2], whole > 2), _texts(digits(data), 2 * nd), sound(0, 160, field(20, 4, at)), sound(224, 4320, field(24, 4, at))]


_READERS: dict[str, Callable] = {"MFM": _read_mfm, "FM": _read_fm, "C64": _read_c64, "APPLE": _read_apple, "AMIGA": _read_amiga}
FOUND = "cyl long, head long, sector long, data string, header_ok boolean, data_ok boolean"


def read(batches: Iterator[pa.RecordBatch], encoding: str, size: int) -> Iterator[pa.RecordBatch]:
    """The track of (track, cells) and what FOUND names, for each sector that has a header and, right after it, data."""
    cut, width = _CUTS[encoding][0], _CUTS[encoding][1](size)
    for whole in batches:
        for lo in range(0, whole.num_rows, TRACKS):
            b = whole.slice(lo, TRACKS)
            owner, first, last, raws = [], [], [], []
            base = 0
            for t, text in enumerate(b.column(1)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                starts, ends = cut(raw)
                owner += [t] * len(starts)
                first += [base + s for s in starts]
                last += [base + e for e in ends]
                raws.append(raw)
                base += len(raw)
            if len(owner) == 0:
                continue
            text = np.frombuffer(b"".join([*raws, bytes(width + 2)]), np.uint8)
            start, n, who = np.array(first), np.minimum(np.array(last) - np.array(first), width), np.array(owner)
            for i in range(0, len(who), BLOCKS):  # a block more than is looked at, which may be the data of the one before
                part = slice(i, i + BLOCKS + 1)
                cells = text[start[part][:, None] + np.arange(width + 2)] & 1
                same = who[part][1:] == who[part][:-1]
                at, cols = _READERS[encoding](cells, n[part], same, size)
                keep = pa.array(at < BLOCKS)
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (b.column(0).take(pa.array(who[part][at])), *cols)], names=["track", "cyl", "head", "sector", "data", "header_ok", "data_ok"])
