"""Sectors of disk images by their format's own layout: zoned disks with an error map, headed images, dumps of records.

Each reader takes a file's bytes to rows (cyl, head, sector, at, size, status): `at` is where the sector's data begin in the
file (-1 where the file holds none), status OK, DELETED, ERROR or MISSING. A file that is cut keeps the
sectors before the cut."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

Row = tuple[int, int, int, int, int, str]
SCHEMA = "cyl int, head int, sector int, at long, size int, status string"
# Sectors of the zones of a zoned disk (first track of a zone, sectors a track).
ZONES = [(1, 21), (18, 19), (25, 18), (31, 17)]


def _zone(track: int) -> int:
    return [n for first, n in ZONES if track >= first][-1]


def read_zoned(raw: bytes, sides: int = 1) -> list[Row]:
    """A zoned disk of 35 to 42 tracks a side, with or without a byte of error for each sector at the end (1 and 0: none)."""
    for tracks in (35, 40, 41, 42):
        n = sides * sum(_zone(t) for t in range(1, tracks + 1))
        if len(raw) in (256 * n, 257 * n):
            break
    else:
        return []
    errors, out, k = raw[256 * n :], [], 0
    for side in range(sides):
        for track in range(1, tracks + 1):
            for sector in range(_zone(track)):
                out.append((track, side, sector, 256 * k, 256, "ERROR" if errors and errors[k] > 1 else "OK"))
                k += 1
    return out


def read_plain(size: int, per_track: int, heads: int) -> Callable[[bytes], list[Row]]:
    """Equal sectors, one after another; a piece at the end that is no whole sector is left."""

    def run(raw: bytes) -> list[Row]:
        return [(k // per_track // heads, k // per_track % heads, k % per_track, k * size, size, "OK") for k in range(len(raw) // size)]

    return run


def read_headed(raw: bytes) -> list[Row]:
    """A 16-byte header that gives the sector size; the first three sectors are always of 128 bytes."""
    size = int.from_bytes(raw[4:6], "little")
    out, at = [], 16
    while size and at < len(raw):
        n = 128 if len(out) < 3 else size
        if at + n > len(raw):
            break
        out.append((len(out) // 18, 0, len(out) % 18 + 1, at, n, "OK"))
        at += n
    return out


def read_dump(raw: bytes) -> list[Row]:
    """A dump of tracks after a comment; maps of cylinders and heads, where a track has them, name its sectors."""
    at, out = raw.find(b"\x1a") + 1, []
    while at and at + 5 <= len(raw):
        _, cyl, head, n, code = raw[at : at + 5]
        size, at = 128 << (code & 7), at + 5
        names, at = raw[at : at + n], at + n
        cyls, at = (raw[at : at + n], at + n) if head & 0x80 else (bytes([cyl]) * n, at)
        heads, at = (raw[at : at + n], at + n) if head & 0x40 else (bytes([head & 1]) * n, at)
        for k in range(n):
            if at >= len(raw) or min(len(names), len(cyls), len(heads)) <= k:
                return out
            kind, at = raw[at], at + 1
            if kind > 8:
                return out
            held = 0 if kind == 0 else 1 if kind % 2 == 0 else size
            if at + held > len(raw):
                return out
            status = "MISSING" if kind == 0 else "ERROR" if kind > 4 else "DELETED" if kind > 2 else "OK"
            out.append((cyls[k], heads[k], names[k], at if held else -1, size, status))
            at += held
    return out


#: Readers by format.
READERS: dict[str, Callable[[bytes], list[Row]]] = {
    "D64": read_zoned, "D71": lambda raw: read_zoned(raw, 2), "D81": read_plain(256, 40, 1), "ADF": read_plain(512, 11, 2), "IMG": read_plain(512, 9, 2), "DO": read_plain(256, 16, 1), "ATR": read_headed, "IMD": read_dump}


def sectors(files: DataFrame) -> DataFrame:
    """path and the sectors of each of (path, format, content) whose format has a reader."""

    def run(batches):
        for batch in batches:
            for path, name, raw in zip(*(batch.column(c).to_pylist() for c in ("path", "format", "content")), strict=True):
                rows = READERS[name](raw or b"")
                if rows:
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *cols], names=["path", "cyl", "head", "sector", "at", "size", "status"])

    return files.where(files["format"].isin(list(READERS))).select("path", "format", "content").mapInArrow(run, "path string, " + SCHEMA)
