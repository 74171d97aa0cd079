"""Archives of an adaptive arithmetic code over literals and matches: written one by one, read as lanes.

An archive is the length and the crc32 of its content, four bytes each, then bits: a symbol below 256 is a byte, any other a match
of symbol - 253 bytes (3 to 61), whose distance follows. Symbols have counts that grow as they are used and are halved before their sum
outgrows the coder; distances have fixed counts that favour near ones. The coder keeps 17 bits. Before the content stand 4,096 blanks.

All archives of a batch are read together: each step decodes one symbol of every lane, the interval arithmetic, the shifting of bits and the copying
of matches are array operations over the lanes that are still open.

Outcomes: OK; SIZE (no header, or a length of zero or beyond most); DAMAGED (the bits end too early, or the content has another crc32). A null archive has
a null outcome; an empty content cannot be written."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SYMBOLS, WINDOW, LONGEST = 315, 4096, 61
TOP, HALF, QUARTER = 0x20000, 0x10000, 0x8000
#: The sum of the symbols' counts stays below this.
LIMIT = 0x7FFF
#: Bits that a whole archive may be read beyond its end: what primes the coder.
SLACK = 17
MOST = 1 << 24


@functools.cache
def distances() -> np.ndarray:
    """Cumulative counts of the distances, near ones first."""
    return np.concatenate([[0], np.cumsum(10_000 // (np.arange(1, WINDOW + 1) + 200))]).astype(np.int64)


class _Writer:
    """Bits of an interval that narrows."""

    def __init__(self):
        self.low, self.high, self.waiting, self.bits = 0, TOP, 0, []

    def _put(self, bit: int) -> None:
        self.bits += [bit, *[1 - bit] * self.waiting]
        self.waiting = 0

    def code(self, lo: int, hi: int, total: int) -> None:
        span = self.high - self.low
        self.low, self.high = self.low + span * lo // total, self.low + span * hi // total
        while True:
            if self.high <= HALF:
                self._put(0)
            elif self.low >= HALF:
                self._put(1)
                self.low, self.high = self.low - HALF, self.high - HALF
            elif self.low >= QUARTER and self.high <= HALF + QUARTER:
                self.waiting += 1
                self.low, self.high = self.low - QUARTER, self.high - QUARTER
            else:
                return
            self.low, self.high = 2 * self.low, 2 * self.high

    def done(self) -> bytes:
        self.waiting += 1
        self._put(int(self.low >= QUARTER))
        return np.packbits(np.array(self.bits + [1] * (-len(self.bits) % 8), np.uint8)).tobytes()


def pack(content: bytes) -> bytes:
    """The archive of a content that is not empty; matches begin at the last place of their first three bytes."""
    out, counts, total = _Writer(), np.ones(SYMBOLS, np.int64), SYMBOLS
    table, at, seen = distances(), 0, {}
    while at < len(content):
        before, n = seen.get(content[at : at + 3], -1), 0
        if before >= 0 and at - before <= WINDOW:
            while n < LONGEST and at + n < len(content) and content[before + n] == content[at + n]:
                n += 1
        symbol = content[at] if n < 3 else 253 + n
        lo = int(counts[:symbol].sum())
        out.code(lo, lo + int(counts[symbol]), total)
        if n >= 3:
            d = at - before - 1
            out.code(int(table[d]), int(table[d + 1]), int(table[-1]))
        counts[symbol] += 1
        total += 1
        if total >= LIMIT:
            counts = (counts + 1) >> 1
            total = int(counts.sum())
        for k in range(at, at + max(1, n if n >= 3 else 1)):
            seen[content[k : k + 3]] = k
        at += n if n >= 3 else 1
    return len(content).to_bytes(4, "little") + zlib.crc32(content).to_bytes(4, "little") + out.done()


class _Lanes:
    """The coders of all open archives."""

    def __init__(self, bodies: list[bytes]):
        self.length = np.array([8 * len(b) for b in bodies], np.int64)
        wide = int(self.length.max(initial=0)) + 64
        self.bits = np.ones((len(bodies), wide), np.uint8)
        for row, b in zip(self.bits, bodies, strict=True):
            row[: 8 * len(b)] = np.unpackbits(np.frombuffer(b, np.uint8))
        n = len(bodies)
        self.low, self.high, self.code, self.at = np.zeros(n, np.int64), np.full(n, TOP, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for _ in range(17):
            self._shift(np.arange(n))

    def _shift(self, who: np.ndarray) -> None:
        at = self.at[who]
        self.code[who] = 2 * self.code[who] + self.bits[who, np.minimum(at, self.bits.shape[1] - 1)]
        self.at[who] = at + 1

    def scaled(self, who: np.ndarray, total) -> np.ndarray:
        return ((self.code[who] - self.low[who] + 1) * total - 1) // (self.high[who] - self.low[who])

    def narrow(self, who: np.ndarray, lo: np.ndarray, hi: np.ndarray, total) -> None:
        span = self.high[who] - self.low[who]
        self.high[who] = self.low[who] + span * hi // total
        self.low[who] += span * lo // total
        while len(who):
            low, high = self.low[who], self.high[who]
            upper, middle = low >= HALF, (low >= QUARTER) & (high <= HALF + QUARTER)
            off = np.where(upper, HALF, np.where(middle, QUARTER, 0))
            go = upper | middle | (high <= HALF)
            who, off = who[go], off[go]
            self.low[who] = 2 * (self.low[who] - off)
            self.high[who] = 2 * (self.high[who] - off)
            self.code[who] -= off
            self._shift(who)


def unpack(archives: list[bytes | None], most: int = MOST) -> tuple[list[str | None], list[bytes | None]]:
    """Outcome and content of each archive."""
    outcome: list[str | None] = [None if a is None else "SIZE" for a in archives]
    content: list[bytes | None] = [None] * len(archives)
    size = [int.from_bytes(a[:4], "little") if a and len(a) > 8 else 0 for a in archives]
    have = [i for i, n in enumerate(size) if 0 < n <= most]
    if not have:
        return outcome, content
    lanes, want = _Lanes([archives[i][8:] for i in have]), np.array([size[i] for i in have], np.int64)
    out = np.full((len(have), WINDOW + int(want.max()) + LONGEST), 0x20, np.uint8)
    counts, total, done = np.ones((len(have), SYMBOLS), np.int64), np.full(len(have), SYMBOLS, np.int64), np.zeros(len(have), np.int64)
    table, who = distances(), np.arange(len(have))
    while len(who):
        cum = np.cumsum(counts[who], axis=1)
        symbol = np.minimum((cum <= lanes.scaled(who, total[who])[:, None]).sum(axis=1), SYMBOLS - 1)
        hi = np.take_along_axis(cum, symbol[:, None], 1)[:, 0]
        lanes.narrow(who, hi - counts[who, symbol], hi, total[who])
        counts[who, symbol] += 1
        total[who] += 1
        full = who[total[who] >= LIMIT]
        counts[full] = (counts[full] + 1) >> 1
        total[full] = counts[full].sum(axis=1)
        plain = symbol < 256
        out[who[plain], WINDOW + done[who[plain]]] = symbol[plain]
        match, length = who[~plain], symbol[~plain] - 253
        if len(match):
            place = np.clip(np.searchsorted(table, lanes.scaled(match, table[-1]), "right") - 1, 0, WINDOW - 1)
            lanes.narrow(match, table[place], table[place + 1], table[-1])
            for k in range(int(length.max())):
                some = match[k < length]
                to = WINDOW + done[some] + k
                out[some, to] = out[some, to - place[k < length] - 1]
        done[who] += np.where(plain, 1, symbol - 253)
        # Whoever reads far beyond its bits has been cut.
        who = who[(done[who] < want[who]) & (lanes.at[who] <= lanes.length[who] + SLACK)]
    for k, i in enumerate(have):
        made = out[k, WINDOW : WINDOW + size[i]].tobytes()
        whole = done[k] == want[k] and zlib.crc32(made) == int.from_bytes(archives[i][4:8], "little")
        outcome[i], content[i] = ("OK", made) if whole else ("DAMAGED", None)
    return outcome, content


def unpacked(archives: DataFrame) -> DataFrame:
    """The rows of archives (with a column archive) and outcome, content."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                outcome, content = unpack(some.column("archive").to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(outcome, pa.string()), pa.array(content, pa.binary())], names=[*some.schema.names, "outcome", "content"])

    return archives.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in archives.dtypes) + ", outcome string, content binary")
