"""Flux and sector containers read from any store that Spark reads, and a Python data source.

A container file is one row of Spark's binaryFile source (or a row of any table with a binary column);
the decoders are Arrow maps from such rows to long tables, so files are spread over tasks by Spark."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

FLUX_SCHEMA = "path string, idx long, ticks long"
SECTOR_SCHEMA = "path string, sector long, data binary"
# The stream's opcodes.
FLUX2_LAST, NOP1, NOP3, OVERFLOW, FLUX3, OOB = 0x07, 0x08, 0x0A, 0x0B, 0x0C, 0x0D


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def decode_transitions(raw: bytes) -> np.ndarray:
    """16-bit big-endian interval words; a zero word adds 65,536 to the next and stands as 0 itself."""
    w = np.frombuffer(raw[: len(raw) // 2 * 2], ">u2").astype(np.int64)
    zero = w == 0
    before = np.cumsum(zero) - zero
    last = np.maximum.accumulate(np.where(~zero, np.arange(len(w)), -1)) if len(w) else w
    prev = np.concatenate([[-1], last[:-1]]) if len(w) else w
    since = before - np.where(prev >= 0, before[np.maximum(prev, 0)], 0)
    return np.where(zero, 0, w + 65536 * since)


def encode_transitions(ticks: np.ndarray) -> bytes:
    """The words of intervals of one tick or more."""
    out: list[int] = []
    for t in ticks.tolist():
        while t > 65535:
            out.append(0)
            t -= 65536
        if t == 0:  # a multiple of 65,536 can't be written; the nearest interval stands for it
            t = 1
        out.append(t)
    return np.array(out, ">u2").tobytes()


def decode_stream(raw: bytes) -> tuple[np.ndarray, str]:
    """Intervals of an opcode stream: one-, two- and three-byte intervals, fillers, overflow, out-of-band blocks.

    A cut stream keeps the intervals before the cut."""
    out, at, extra, n = [], 0, 0, len(raw)
    while at < n:
        op = raw[at]
        if op <= FLUX2_LAST:
            if at + 1 >= n:
                return np.array(out, np.int64), "TRUNCATED"
            out.append(extra + (op << 8 | raw[at + 1]))
            at, extra = at + 2, 0
        elif NOP1 <= op <= NOP3:
            at += op - NOP1 + 1
        elif op == OVERFLOW:
            at, extra = at + 1, extra + 65536
        elif op == FLUX3:
            if at + 2 >= n:
                return np.array(out, np.int64), "TRUNCATED"
            out.append(extra + (raw[at + 1] << 8 | raw[at + 2]))
            at, extra = at + 3, 0
        elif op == OOB:
            if at + 3 >= n:
                return np.array(out, np.int64), "TRUNCATED"
            if raw[at + 1] == OOB:
                return np.array(out, np.int64), "OK"
            at += 4 + int.from_bytes(raw[at + 2 : at + 4], "little")
        else:
            out.append(extra + op)
            at, extra = at + 1, 0
    return np.array(out, np.int64), "OK"


def transitions(containers: DataFrame, decoder=decode_transitions) -> DataFrame:
    """(path, idx, ticks) of each container's intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                got = decoder(raw or b"")
                ticks = got[0] if isinstance(got, tuple) else got
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(ticks), pa.string()), pa.array(np.arange(len(ticks))), pa.array(ticks, pa.int64())], names=["path", "idx", "ticks"])

    return containers.select("path", "content").mapInArrow(run, FLUX_SCHEMA)


def sector_image(containers: DataFrame, size: int = 512) -> DataFrame:
    """(path, sector, data) of raw sector images; the last sector may be short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                cut = [raw[i : i + size] for i in range(0, len(raw or b""), size)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(cut), pa.string()), pa.array(range(len(cut)), pa.int64()), pa.array(cut, pa.binary())], names=["path", "sector", "data"])

    return containers.select("path", "content").mapInArrow(run, SECTOR_SCHEMA)


class _Slice(InputPartition):
    def __init__(self, uri: str, start: int, stop: int):
        self.uri, self.start, self.stop = uri, start, stop


class SectorImageSource(DataSource):
    """spark.read.format("sector_image").option("sector_size", 512).load(uri): byte ranges of files are partitions.

    The uri is anything that pyarrow's file systems open; stores that only Spark reads go through sector_image()."""

    @classmethod
    def name(cls) -> str:
        return "sector_image"

    def schema(self) -> str:
        return SECTOR_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _SectorReader(self.options)


class _SectorReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.size = options["path"], int(options.get("sector_size", 512))
        self.chunk = max(1, int(options.get("partition_sectors", 65536))) * self.size

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def partitions(self) -> list[_Slice]:
        from pyarrow import fs

        store, path = self._open()
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File]
        return [_Slice(f.path, a, min(f.size, a + self.chunk)) for f in found for a in range(0, f.size, self.chunk)]

    def read(self, partition: _Slice):
        store, _ = self._open()
        with store.open_input_file(partition.uri) as f:
            for at in range(partition.start, partition.stop, self.size):
                yield partition.uri, at // self.size, f.read_at(min(self.size, partition.stop - at), at)


# Track table of a flux image, chunk names of a capture container.
TABLE_AT, TABLE_TRACKS = 0x10, 168
CAPTURE_HEAD = b"A2R2\xff\n\r\n"


def encode_stream(ticks: np.ndarray) -> bytes:
    """Opcodes of intervals, an information block first, the end mark last."""
    out = bytearray(b"\x0d\x01\x08\x00" + bytes(8))
    for t in ticks.tolist():
        while t > 65535:
            out.append(OVERFLOW)
            t -= 65536
        if OOB < t < 256:
            out.append(t)
        elif t < 2048:
            out += bytes([t >> 8, t & 255])
        else:
            out += bytes([FLUX3, t >> 8, t & 255])
    return bytes(out + bytes([OOB, OOB, OOB, OOB]))


def flux_image(tracks: dict[int, bytes], writable: bool = False) -> bytes:
    """A flux image of one revolution a track: header with checksum, table of offsets, track headers, interval words."""
    body, table = bytearray(), [0] * TABLE_TRACKS
    for no, words in sorted(tracks.items()):
        table[no] = TABLE_AT + 4 * TABLE_TRACKS + len(body)
        body += b"TRK" + bytes([no]) + len(words).to_bytes(4, "little") + (len(words) // 2).to_bytes(4, "little") + (16).to_bytes(4, "little") + words
    rest = b"".join(t.to_bytes(4, "little") for t in table) + bytes(body)
    total = sum(rest) & 0xFFFFFFFF
    return b"SCP\x19\x80\x01" + bytes([min(tracks, default=0), max(tracks, default=0), 4 if writable else 0, 0, 0, 0]) + total.to_bytes(4, "little") + rest


def open_flux_image(raw: bytes) -> list[tuple[int, int, int]]:
    """(track, offset, words) of the tracks that a flux image's table names."""
    out = []
    if raw[:3] == b"SCP":
        for no in range(TABLE_TRACKS):
            at = int.from_bytes(raw[TABLE_AT + 4 * no : TABLE_AT + 4 * no + 4], "little")
            if at and raw[at : at + 3] == b"TRK":
                out.append((no, at, int.from_bytes(raw[at + 8 : at + 12], "little")))
    return out


def flux_track(raw: bytes, no: int) -> np.ndarray:
    """Intervals of one track of a flux image."""
    for track, at, words in open_flux_image(raw):
        if track == no:
            start = at + int.from_bytes(raw[at + 12 : at + 16], "little")
            return decode_transitions(raw[start : start + 2 * words])
    return np.empty(0, np.int64)


def checksum_ok(raw: bytes) -> bool:
    """A flux image's checksum over all after the header; one that may be written to has none."""
    return bool(raw[8] & 4) or sum(raw[TABLE_AT:]) & 0xFFFFFFFF == int.from_bytes(raw[12:16], "little")


def capture_file(captures: dict[int, np.ndarray]) -> bytes:
    """A container of chunks: information, then captures whose intervals are bytes that 255 continues."""
    body = bytearray()
    for no, ticks in sorted(captures.items()):
        data = b"".join(b"\xff" * (t // 255) + bytes([t % 255]) for t in ticks.tolist())
        body += bytes([no, 1]) + len(data).to_bytes(4, "little") + int(ticks.sum()).to_bytes(4, "little") + data
    chunk = lambda name, data: name + len(data).to_bytes(4, "little") + bytes(data)
    return CAPTURE_HEAD + chunk(b"INFO", b"\x01" + bytes(35)) + chunk(b"STRM", body + b"\xff")


def read_captures(raw: bytes) -> list[tuple[int, np.ndarray]]:
    """(location, intervals) of each capture; unknown chunks are passed over."""
    out, at = [], len(CAPTURE_HEAD)
    while raw.startswith(CAPTURE_HEAD) and at + 8 <= len(raw):
        name, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
        body, at = raw[at + 8 : at + 8 + size], at + 8 + size
        k = 0
        while name == b"STRM" and k + 10 <= len(body) and body[k] != 255:
            n = int.from_bytes(body[k + 2 : k + 6], "little")
            b = np.frombuffer(body[k + 10 : k + 10 + n], np.uint8).astype(np.int64)
            ends = np.flatnonzero(b < 255)
            total = np.cumsum(b)[ends]
            out.append((body[k], np.diff(total, prepend=0)))
            k += 10 + n
    return out


def opened(containers: DataFrame, rows, schema: str) -> DataFrame:
    """path and what rows(content) gives, a tuple a row, for each container."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL("path string, " + schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                cols = list(zip(*rows(raw or b""), strict=True)) or [()] * (len(out) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(cols[0]), pa.string()), *[pa.array(c, f.type) for c, f in zip(cols, list(out)[1:], strict=True)]], schema=out)

    return containers.select("path", "content").mapInArrow(run, "path string, " + schema)


def packed(tracks: DataFrame, build) -> DataFrame:
    """(path, content) of (path, no, idx, ticks): build takes a container's intervals by track. A container holds what a disk holds."""

    def run(t: pa.Table) -> pa.Table:
        order = np.lexsort((t["idx"].to_numpy(), t["no"].to_numpy()))
        no, ticks = t["no"].to_numpy()[order], t["ticks"].to_numpy()[order]
        edge = np.flatnonzero(np.concatenate([[True], no[1:] != no[:-1]]))
        parts = {int(no[a]): ticks[a:b] for a, b in zip(edge, np.append(edge[1:], len(no)), strict=True)}
        return pa.table({"path": t["path"].slice(0, 1), "content": pa.array([build(parts)], pa.binary())})

    return tracks.groupBy("path").applyInArrow(run, "path string, content binary")


TRACK_SCHEMA = "path string, track long, idx long, ticks long"


class _Track(InputPartition):
    def __init__(self, path: str, number: int, offset: int):
        self.path, self.number, self.offset = path, number, offset


class FluxImageSource(DataSource):
    """spark.read.format("flux_image").load(uri): the intervals of flux images, a partition a track.

    Only the table of a file is read to plan. With option("push", True), which needs spark.sql.python.filterPushdown.enabled, filters `track = n` and
    `track IN (...)` leave out the other tracks before anything of them is read. The uri is anything that pyarrow's file systems open. A file without the signature, or cut before a track ends, gives what it holds."""

    @classmethod
    def name(cls) -> str:
        return "flux_image"

    def schema(self) -> str:
        return TRACK_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        pushed = str(self.options.get("push", "false")).lower() == "true"
        return (PushedFluxImageReader if pushed else FluxImageReader)(self.options["path"])


class FluxImageReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri, self.wanted = uri, None

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def partitions(self) -> list[_Track]:
        from pyarrow import fs

        store, path = self._open()
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File]
        out = []
        for file in found:
            with store.open_input_file(file.path) as f:
                table = f.read_at(min(file.size, TABLE_AT + 4 * TABLE_TRACKS), 0)
            for no in range((len(table) - TABLE_AT) // 4 if table[:3] == b"SCP" else 0):
                at = int.from_bytes(table[TABLE_AT + 4 * no : TABLE_AT + 4 * no + 4], "little")
                if at and at < file.size and (self.wanted is None or no in self.wanted):
                    out.append(_Track(file.path, no, at))
        return out

    def read(self, partition: _Track | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there are no partitions
            return
        store, _ = self._open()
        with store.open_input_file(partition.path) as f:
            size = f.size()
            head = f.read_at(min(16, size - partition.offset), partition.offset)
            if head[:3] != b"TRK" or len(head) < 16:
                return
            words, start = int.from_bytes(head[8:12], "little"), partition.offset + int.from_bytes(head[12:16], "little")
            raw = f.read_at(max(0, min(2 * words, size - start)), start)
        ticks = decode_transitions(raw)
        n = len(ticks)
        yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n, pa.string()), pa.array(np.full(n, partition.number)), pa.array(np.arange(n)), pa.array(ticks)], names=["path", "track", "idx", "ticks"])


class PushedFluxImageReader(FluxImageReader):
    """Takes filters on the track before it plans."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("track",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = asked if self.wanted is None else self.wanted & asked
            else:
                yield f
