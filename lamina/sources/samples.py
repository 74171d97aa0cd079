"""Container files written from a table: whole images of the formats that probing knows, near misses and truncations.

A file is filler text that its number gives, with the format's own structures laid over it. So every byte of it
follows from the number, and SQL can say what a probe must find. The structures come from the writers below."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .containers import encode_transitions, flux_image

DAMAGES = ("none", "first byte", "half", "structure", "one byte more")


def boot_record(total: int, per_track: int, heads: int, cluster: int, root: int, media: int, per_fat: int) -> bytes:
    """A boot sector with its parameter block for sectors of 512 bytes and two 12-bit tables."""
    fields = [(512, 2), (cluster, 1), (1, 2), (2, 1), (root, 2), (total, 2), (media, 1), (per_fat, 2), (per_track, 2), (heads, 2)]
    head = b"\xeb\x3c\x90" + b"LAMINA10" + b"".join(v.to_bytes(n, "little") for v, n in fields)
    return head + bytes(510 - len(head)) + b"\x55\xaa"


def boot_block(root: int) -> bytes:
    """Two sectors whose big-endian words sum to zero with end-around carry."""
    words = [0x444F5300, 0, root] + [0] * 253
    total = sum(words)
    while total >> 32:
        total = (total & 0xFFFFFFFF) + (total >> 32)
    words[1] = total ^ 0xFFFFFFFF
    return b"".join(w.to_bytes(4, "big") for w in words)


def sector_dump(cylinders: int, heads: int, sectors: int, size: int, kinds: tuple[int, ...]) -> bytes:
    """A dump of tracks with a comment: per track its mode, place, sector count and size code, numbering, then each
    sector's kind (0 missing, 1 whole, 2 one byte repeated, +2 deleted, +4 with an error) and data."""
    out, k = bytearray(b"IMD 1.18: 01/01/2024 00:00:00\r\nlamina\x1a"), 0
    for c in range(cylinders):
        for h in range(heads):
            out += bytes([5, c, h, sectors, size.bit_length() - 8]) + bytes(range(1, sectors + 1))
            for s in range(sectors):
                kind = kinds[k % len(kinds)]
                k += 1
                out.append(kind)
                if kind:
                    out += bytes([c ^ s]) if kind % 2 == 0 else bytes([(c * 7 + h + s + i) & 255 for i in range(size)])
    return bytes(out)


def _little(*values: tuple[int, int]) -> bytes:
    return b"".join(v.to_bytes(n, "little") for v, n in values)


def _big(*values: tuple[int, int]) -> bytes:
    return b"".join(v.to_bytes(n, "big") for v, n in values)


def _copied(cylinders: int) -> bytes:
    """The 133-byte header of a compressed copy; its bytes sum to zero."""
    head = bytearray(133)
    head[:3], head[3:5], head[16:18], head[18:20], head[0x5A], head[0x5B] = b"CQ\x14", _little((512, 2)), _little((9, 2)), _little((2, 2)), cylinders, cylinders
    head[132] = -sum(head) & 255
    return bytes(head)


def _flux(version: int) -> bytes:
    image = bytearray(flux_image({no: encode_transitions(np.arange(80, 480) + no) for no in range(3)}))
    image[3] = version
    return bytes(image)


_GCR = b"GCR-1541" + _little((0, 1), (84, 1), (7928, 2)) + b"".join(_little((0, 4)) for _ in range(168))
_DUMP = sector_dump(3, 2, 9, 512, (1, 2, 1, 5, 1, 0, 3))
_ERRORS = bytes(5 if i % 97 == 3 else 1 for i in range(683))
#: Name, size, extension and the structures (offset, bytes) laid over the filler.
KINDS: list[tuple[str, int, str, list[tuple[int, bytes]]]] = [
    ("disk35", 174848, "d64", [(0x16500, b"\x12\x01\x41\x00")]),
    ("disk35_errors", 175531, "d64", [(0x16500, b"\x00\x00\x41\x00"), (174848, _ERRORS)]),
    ("disk70", 349696, "d71", [(0x16500, b"\x12\x01\x41\x80")]),
    ("disk80", 819200, "d81", [(0x61800, b"\x28\x03\x44\x00")]),
    ("amiga", 901120, "adf", [(0, boot_block(880))]),
    ("pc360", 368640, "img", [(0, boot_record(720, 9, 2, 2, 112, 0xFD, 2))]),
    ("pc160", 163840, "ima", [(0, boot_record(320, 8, 1, 1, 64, 0xFE, 1))]),
    ("bare180", 184320, "dsk", []),
    ("atari90", 92160, "xfd", [(0, b"\x00\x03\x00\x07")]),
    ("apple", 143360, "do", []),
    ("nibbles", 232960, "nib", [(0, (b"\xff" * 60 + b"\xd5\xaa\x96" + b"\xfe" * 353) * 16)]),
    ("spectrum", 655360, "trd", [(0x227, b"\x10")]),
    ("flux", len(_flux(0x19)), "scp", [(0, _flux(0x19))]),
    ("flux_new", len(_flux(0x30)), "SCP", [(0, _flux(0x30))]),
    ("cells", 3072, "hfe", [(0, b"HXCPICFE" + bytes([0, 80, 2, 0]) + _little((250, 2), (0, 2)) + bytes(496))]),
    ("cells_v3", 3072, "HFE", [(0, b"HXCHFEV3" + bytes([0, 90, 2, 0]) + _little((80, 2), (0, 2)) + bytes(496))]),
    ("gcr", 4000, "g64", [(0, _GCR)]),
    ("atari_header", 92176, "atr", [(0, b"\x96\x02" + _little((5760, 2), (128, 2)) + bytes(10))]),
    ("d88", 0x2B0 + 4096, "d88", [(0, b"LAMINA" + bytes(20) + _little((0, 1), (0, 1), (0x2B0 + 4096, 4), (0x2B0, 4), (0x2B0 + 2048, 4)) + bytes(648))]),
    ("dc42", 84 + 2048, "dc42", [(0, b"\x06lamina" + bytes(57) + _big((2048, 4), (0, 4), (0, 4), (0, 4), (1, 1), (0x22, 1), (0x0100, 2)))]),
    ("dump", len(_DUMP), "imd", [(0, _DUMP)]),
    ("timed", 2048, "atx", [(0, b"AT8X" + bytes(44))]),
    ("copied", 3000, "cqm", [(0, _copied(40))]),
    ("copied_bad", 3000, "cqm", [(0, _copied(40)), (40, b"\x01")]),
    ("packed", 2500, "msa", [(0, _big((0x0E0F, 2), (9, 2), (1, 2), (0, 2), (79, 2)))]),
    ("teledisk", 2500, "td0", [(0, b"TD\x00\x00\x15\x00\x00\x00\x00\x02\x00\x00")]),
    ("formatted", 2500, "fdi", [(0, b"FDI\x00" + _little((80, 2), (2, 2), (14, 2), (100, 2), (0, 2)))]),
    ("preserved", 2500, "ipf", [(0, b"CAPS" + _big((12, 4), (0x1CD573BA, 4)))]),
    ("pasti", 2500, "stx", [(0, b"RSY\x00" + _little((3, 2), (1, 2), (0, 2), (80, 1), (2, 1), (0, 4)))]),
    ("universal", 2500, "2mg", [(0, b"2IMGLAMI" + _little((64, 2), (1, 2), (1, 4), (0, 4), (280, 4), (64, 4)) + bytes(36))]),
    ("cpc", 5000, "dsk", [(0, b"MV - CPC" + bytes(248))]),
    ("cpc_extended", 5000, "DSK", [(0, b"EXTENDED" + bytes(248))]),
    ("archive", 2500, "scl", [(0, b"SINCLAIR\x02")]),
    ("text", 50001, "bin", []), ("short", 3, "td0", [(0, b"TD\x00")]), ("empty", 0, "img", []),
]


def build(number: int, kind: int, damage: int) -> bytes:
    """The bytes of a file."""
    _, size, _, parts = KINDS[kind]
    fill = hashlib.md5(str(number).encode()).hexdigest().encode()
    raw = bytearray(fill * (size // 32 + 2))[: size + 1]
    for at, data in parts[: len(parts) - (damage == 3)]:
        raw[at : at + len(data)] = data
    raw = raw[: {2: size // 2, 4: size + 1}.get(damage, size)]
    if damage == 1 and raw:
        raw[0] ^= 0x20
    return bytes(raw)


def written(numbers: DataFrame) -> DataFrame:
    """path, length, content of each (id, kind, damage, ext): the columns of Spark's binaryFile source."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 16):  # some files are a megabyte long
                some = batch.slice(at, 16)
                made = [build(*r) for r in zip(*(some.column(c).to_pylist() for c in ("id", "kind", "damage")), strict=True)]
                paths = [f"{i}.{e}" for i, e in zip(some.column("id").to_pylist(), some.column("ext").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array([len(x) for x in made], pa.int64()), pa.array(made, pa.binary())], names=["path", "length", "content"])

    return numbers.select(F.col("id").cast("long"), "kind", "damage", "ext").mapInArrow(run, "path string, length long, content binary")
