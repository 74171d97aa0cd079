"""Which format a file has: a trie of signatures proposes, checks of the content's structure confirm.

Signatures stand at an offset. All signatures of one offset form a trie over their bytes; a batch of files steps
through it together, a table lookup a byte, so the work does not grow with the number of signatures. Formats without
one are proposed by the file's length, from a table of lengths or by the rule of its tracks. Each proposal is then
held against the content by its format's check, which gives a confidence or refuses. So a file meets the
few formats that could be its own, and no file is joined with all formats."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a file that a probe by path looks at.
WINDOW = 65536

# Formats in the order of their registration, with the extensions they claim.
FORMATS = [
    ("D64", ["d64"]), ("ADF", ["adf"]), ("SCP", ["scp"]), ("HFE", ["hfe"]), ("IMG", ["img", "ima", "dsk", "vfd", "flp"]), ("G64", ["g64"]), ("IMD", ["imd"]), ("ATR", ["atr", "xfd"]), ("TD0", ["td0"]), ("STX", ["stx"]), ("IPF", ["ipf", "ct", "ctr"]),
    ("D71", ["d71"]), ("D81", ["d81"]), ("D88", ["d88", "88d", "d98"]), ("DC42", ["dc42", "image", "img"]), ("ATX", ["atx"]), ("CQM", ["cqm"]), ("MSA", ["msa"]), ("FDI", ["fdi"]), ("2IMG", ["2img", "2mg"]), ("CPC", ["dsk"]), ("SCL", ["scl"]), ("TRD", ["trd"]),
    ("NIB", ["nib"]), ("DO", ["do", "dsk"]), ("PO", ["po", "dsk"]), ("XFD", ["xfd"]), ("JV1", ["jv1", "dsk"])]
# Signatures (format, offset, bytes, least length of the file).
SIGNATURES = [
    ("SCP", 0, b"SCP", 16), ("HFE", 0, b"HXCPICFE", 512), ("HFE", 0, b"HXCHFEV3", 512), ("G64", 0, b"GCR-1541", 12), ("IMD", 0, b"IMD ", 4), ("ATR", 0, b"\x96\x02", 16), ("TD0", 0, b"TD", 2), ("TD0", 0, b"td", 2), ("STX", 0, b"RSY\x00", 16), ("IPF", 0, b"CAPS", 12),
    ("D88", 0x1B, b"\x00", 0x2B0), ("D88", 0x1B, b"\x10", 0x2B0), ("D88", 0x1B, b"\x20", 0x2B0), ("D88", 0x1B, b"\x30", 0x2B0), ("D88", 0x1B, b"\x40", 0x2B0), ("DC42", 82, b"\x01\x00", 84), ("ATX", 0, b"AT8X", 48), ("CQM", 0, b"CQ\x14", 3), ("MSA", 0, b"\x0e\x0f", 10), ("FDI", 0, b"FDI", 14),
    ("2IMG", 0, b"2IMG", 64), ("CPC", 0, b"MV - CPC", 8), ("CPC", 0, b"EXTENDED", 8), ("SCL", 0, b"SINCLAIR", 9)]
# Lengths that a format's images have.
LENGTHS = {
    "D64": [174848, 175531, 196608, 197376, 200960, 201745, 205312, 206114], "D71": [349696, 351062], "D81": [819200, 822400], "ADF": [901120, 1802240], "TRD": [655360, 327680, 163840], "NIB": [232960], "DO": [143360], "PO": [143360],
    "IMG": [163840, 184320, 327680, 368640, 737280, 1228800, 1474560, 1720320, 2949120], "XFD": [92160, 184320, 133120, 266240]}
# Sectors a track and heads that a raw image of another length may have.
TRACKS, HEADS = (18, 9, 15, 36, 21, 8, 10), (2, 1)
REG = {name: i + 1 for i, (name, _) in enumerate(FORMATS)}


class Trie:
    """Byte sequences at one offset: transitions by node and byte (node 0 is the root, node 1 is dead), and what ends at each node."""

    def __init__(self, words: list[tuple[bytes, int]]):
        rows, self.ends = [np.ones(256, np.int32), np.ones(256, np.int32)], [[], []]
        for word, what in words:
            at = 0
            for b in word:
                if rows[at][b] == 1:
                    rows[at][b] = len(rows)
                    rows.append(np.ones(256, np.int32))
                    self.ends.append([])
                at = int(rows[at][b])
            self.ends[at].append(what)
        self.next, self.depth = np.stack(rows), max(len(w) for w, _ in words)
        self.final = np.array([bool(e) for e in self.ends])

    def run(self, data: np.ndarray) -> list[tuple[int, int]]:
        """(row, what) for the sequences that the rows of bytes begin with."""
        state, out = np.zeros(len(data), np.int32), []
        for k in range(min(self.depth, data.shape[1])):
            state = self.next[state, data[:, k]]
            for row in np.flatnonzero(self.final[state]).tolist():
                out += [(row, what) for what in self.ends[state[row]]]
        return out


def _tries() -> dict[int, Trie]:
    by_offset: dict[int, list] = {}
    for n, (_, offset, word, _) in enumerate(SIGNATURES):
        by_offset.setdefault(offset, []).append((word, n))
    return {offset: Trie(words) for offset, words in by_offset.items()}


TRIES = _tries()
HEAD = max(offset + trie.depth for offset, trie in TRIES.items())
_BY_LENGTH: dict[int, list[str]] = {}
for _name, _sizes in LENGTHS.items():
    for _size in _sizes:
        _BY_LENGTH.setdefault(_size, []).append(_name)


def by_length(size: int) -> set[str]:
    """Formats that the length alone allows."""
    out = set(_BY_LENGTH.get(size, ()))
    if size and size % 512 == 0 and any(size // 512 % (h * s) == 0 and 35 <= size // 512 // (h * s) <= 84 for h in HEADS for s in TRACKS):
        out.add("IMG")
    if 0 < size <= 266240 and size % 128 == 0:
        out.add("XFD")
    if size and size % 2560 == 0 and (size // 2560 <= 40 or size // 2560 <= 80 and size // 2560 % 2 == 0):
        out.add("JV1")
    return out


def _le(d: bytes, at: int, n: int = 2) -> int:
    return int.from_bytes(d[at : at + n], "little")


def _be(d: bytes, at: int, n: int = 2) -> int:
    return int.from_bytes(d[at : at + n], "big")


def _last(*steps: tuple[bool, int]) -> int:
    """The confidence of the last step that holds."""
    return [c for ok, c in steps if ok][-1]


def _directory(d: bytes, at: int, link: bytes, kind: int, base: int, linked: int, marked: int) -> int:
    """A disk whose catalogue is known by its first link or its mark, if the window reaches so far."""
    if len(d) < at + 3:
        return base
    return linked if d[at : at + 2] == link else marked if d[at + 2] == kind else base


def _d88(d: bytes, size: int) -> int:
    declared = _le(d, 0x1C, 4)
    if not 0x2B0 <= declared <= size:
        return 0
    starts = [s for s in np.frombuffer(d[0x20:0x2B0], "<u4").tolist() if s]
    if not starts or starts[0] < 0x2B0 or starts[-1] >= declared or any(b <= a for a, b in zip(starts, starts[1:], strict=False)):
        return 0
    named = all(c == 0 or c >= 32 and c != 127 for c in d[:17])
    return 60 + 20 * (declared == size) + 10 * (d[0x1A] in (0, 0x10)) + 5 * named


def _msa(d: bytes, size: int) -> int:
    per_track, sides, first, last = _be(d, 2), _be(d, 4) + 1, _be(d, 6), _be(d, 8)
    if not 1 <= per_track <= 18 or not 1 <= sides <= 2 or last < first:
        return 0
    return 70 + 20 * (not (d[2] or d[4] or d[6] or d[8])) + 5 * (last < 90)


def _cqm(d: bytes, size: int) -> int:
    if len(d) < 133:
        return 60
    ok = sum(d[:133]) & 255 == 0 and 1 <= _le(d, 18) <= 2 and 1 <= _le(d, 16) <= 64 and d[0x5A] >= 1 and _le(d, 3) in (128, 256, 512, 1024, 2048, 4096, 8192)
    return 95 if ok else 60


def _img(d: bytes, size: int) -> int:
    if len(d) < 512:
        return 40
    return _last((True, 40), (d[0] in (0xEB, 0xE9), 60), (d[510:512] == b"\x55\xaa", 80), (all(32 <= c <= 126 for c in d[3:11]), 85), (_le(d, 11) == 512, 90))


def _xfd(d: bytes, size: int) -> int:
    if size not in LENGTHS["XFD"]:
        return 25
    return 82 if len(d) >= 4 and d[0] in (0, 1) and 7 <= d[3] <= 0xBF else 40


def _nib(d: bytes, size: int) -> int:
    part = d[:6656]
    if len(part) < 6656:
        return 80
    full, marks = part.count(0xFF), part.count(b"\xd5\xaa\x96")
    return 95 if marks >= 10 and full > 500 else 88 if full > 200 else 80


def _trd(d: bytes, size: int) -> int:
    if len(d) < 0x228:
        return 70
    return 92 if d[0x227] == 0x10 else 82 if len(d) >= 0x8E5 and d[0x8E4] <= 128 else 70


#: A format's check: (the bytes that the probe sees, length of the file) to a confidence, 0 to refuse.
CHECKS: dict[str, Callable[[bytes, int], int]] = {
    "D64": lambda d, n: _directory(d, 0x16500, b"\x12\x01", 0x41, 75, 92, 88), "D71": lambda d, n: _directory(d, 0x16500, b"\x12\x01", -1, 70, 90, 90), "D81": lambda d, n: _directory(d, 0x61800, b"\x28\x03", 0x44, 80, 92, 88),
    "ADF": lambda d, n: 95 if d[:3] == b"DOS" else 70, "IMG": _img, "XFD": _xfd, "NIB": _nib, "TRD": _trd, "DO": lambda d, n: 60, "PO": lambda d, n: 55, "JV1": lambda d, n: 35,
    "SCP": lambda d, n: 95 if d[3] <= 0x2F else 50,
    "HFE": lambda d, n: min(100, 95 + 2 * (1 <= d[9] <= 84) + 2 * (1 <= d[10] <= 2) + (125 <= _le(d, 12) <= 1000)),
    "G64": lambda d, n: _last((True, 80), (d[8] == 0, 90), (1 <= d[9] <= 84, 95), (1 <= _le(d, 10) <= 7928, 98), (n >= 12 + 8 * d[9], 100)),
    "IMD": lambda d, n: 95, "ATR": lambda d, n: 95, "TD0": lambda d, n: 95, "STX": lambda d, n: 97, "IPF": lambda d, n: 95, "ATX": lambda d, n: 98, "2IMG": lambda d, n: 95, "CPC": lambda d, n: 95, "SCL": lambda d, n: 96,
    "D88": _d88, "DC42": lambda d, n: 0 if d[0] > 63 or not _be(d, 0x40, 4) else 50 if d[0x50] > 3 else 92, "CQM": _cqm, "MSA": _msa, "FDI": lambda d, n: 92 if 1 <= _le(d, 4) <= 180 and 1 <= _le(d, 6) <= 2 else 75}


def proposals(contents: list[bytes], sizes: list[int]) -> list[set[str]]:
    """The formats that each file's first bytes and length allow."""
    out = [by_length(n) for n in sizes]
    head = np.zeros((len(contents), HEAD), np.uint8)
    for row, c in zip(head, contents, strict=True):
        some = c[:HEAD]
        row[: len(some)] = np.frombuffer(some, np.uint8)
    for offset, trie in TRIES.items():
        for row, n in trie.run(head[:, offset:]):
            name, _, word, least = SIGNATURES[n]
            if len(contents[row]) >= max(least, offset + len(word)):
                out[row].add(name)
    return out


def claims(files: DataFrame, window: int | None = WINDOW) -> DataFrame:
    """path, format, reg (place in the order of registration), conf: every format that claims a file of (path, length, content).

    window: the bytes that a probe sees; None for all. A file without bytes is claimed by none."""
    seen = F.col("content") if window is None else F.substring("content", 1, window)

    def run(batches):
        for batch in batches:
            path, size, content = (batch.column(c).to_pylist() for c in ("path", "length", "content"))
            content = [c or b"" for c in content]
            rows = [(p, f, REG[f], conf) for p, n, c, fs in zip(path, size, content, proposals(content, size), strict=True) if c for f in fs if (conf := CHECKS[f](c, n)) > 0]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["path", "format", "reg", "conf"])

    return files.select("path", "length", seen.alias("content")).mapInArrow(run, "path string, format string, reg int, conf int")


def opened(files: DataFrame, readers: dict[str, Callable[[bytes], list[tuple]]], window: int = WINDOW) -> DataFrame:
    """path, format (the winner; of equals the one registered first), warned (others are as sure), and the sectors that the winner's reader finds
    with those of status OK, for each file that a format claims. One pass over the files: no content is shuffled or joined."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 16):  # some files are megabytes long
                batch = whole.slice(lo, 16)
                path, size, content = (batch.column(c).to_pylist() for c in ("path", "length", "content"))
                content = [c or b"" for c in content]
                rows = []
                for p, n, c, fs in zip(path, size, content, proposals([c[:window] for c in content], size), strict=True):
                    ranked = sorted(((-conf, REG[f], f) for f in fs if c and (conf := CHECKS[f](c[:window], n)) > 0))
                    if ranked:
                        found = readers[ranked[0][2]](c) if ranked[0][2] in readers else []
                        rows.append((p, ranked[0][2], len(ranked) > 1 and ranked[1][0] == ranked[0][0], len(found), sum(r[-1] == "OK" for r in found)))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["path", "format", "warned", "sectors", "good"])

    return files.select("path", "length", "content").mapInArrow(run, "path string, format string, warned boolean, sectors long, good long")


def ranking(claimed: DataFrame) -> DataFrame:
    """path, winner (of equals the one registered first), conf, claimants, tied, runner_up (best below the winner's confidence)."""
    every = Window.partitionBy("path")
    c = claimed.withColumn("top", F.max("conf").over(every))
    first = F.when(F.col("conf") == F.col("top"), F.struct(-F.col("reg")))
    below = F.when(F.col("conf") < F.col("top"), F.struct("conf", -F.col("reg")))
    return c.groupBy("path").agg(
        F.max_by("format", first).alias("winner"), F.max("conf").alias("conf"), F.count("*").alias("claimants"), F.count_if(F.col("conf") == F.col("top")).alias("tied"), F.max_by("format", below).alias("runner_up"))


class Spec:
    """What is known of a format to weigh it: prior, lengths, least and greatest length, signature, structure check."""

    def __init__(self, name: str, prior: float, sizes=(), least: int = 0, most: int = 0, magic: bytes = b"", check: Callable[[bytes], bool] | None = None, filesystem: str = ""):
        self.name, self.prior, self.sizes, self.least, self.most, self.magic, self.check, self.filesystem = name, prior, tuple(sizes), least, most, magic, check, filesystem


def _valid_d64(d: bytes) -> bool:
    at = 91392
    return len(d) >= 174848 and d[at] <= 40 and d[at + 1] <= 21 and d[at + 2] in (0x41, 0)


# Two sets of formats with their priors.
FIRST = [
    Spec("D64", 0.15, [174848, 175531, 196608, 197376, 205312, 206114], filesystem="CBM"), Spec("G64", 0.05, magic=b"GCR-1541"), Spec("D71", 0.03, [349696, 351062], filesystem="CBM"), Spec("D81", 0.03, [819200, 822400], filesystem="CBM"),
    Spec("ADF", 0.12, [901120, 1802240], filesystem="OFS"), Spec("ATR", 0.05, magic=b"\x96\x02"), Spec("ST", 0.05, [368640, 737280, 819200], filesystem="FAT"), Spec("DSK", 0.05, [143360]), Spec("WOZ", 0.03, magic=b"WOZ1"),
    Spec("IMG", 0.15, [163840, 184320, 327680, 368640, 737280, 1228800, 1474560], filesystem="FAT"), Spec("SCP", 0.08, magic=b"SCP"), Spec("HFE", 0.05, magic=b"HXCPICFE"), Spec("IPF", 0.04, magic=b"CAPS")]
SECOND = [
    Spec("D64", 0.15, [174848, 175531, 196608, 197376, 205312, 206114], 174848, 210000, check=_valid_d64), Spec("ADF", 0.12, [901120, 1802240], 901120, 1802240, b"DOS", lambda d: len(d) >= 901120),
    Spec("SCP", 0.10, (), 32, 104857600, b"SCP", lambda d: len(d) >= 16 and d[:3] == b"SCP" and d[3] <= 0x29 and d[6] <= d[7] and 1 <= d[5] <= 32),
    Spec("G64", 0.08, (), 7928, 500000, b"GCR-1541", lambda d: len(d) >= 12 and d[:8] == b"GCR-1541" and d[8] == 0 and 1 <= d[9] <= 168), Spec("HFE", 0.08, (), 512, 52428800, b"HXCPICFE"),
    Spec("IMG", 0.15, [163840, 184320, 327680, 368640, 737280, 1228800, 1474560, 2949120], 163840, 3000000), Spec("WOZ", 0.05, (), 256, 10485760, b"WOZ1")]


def evidence_first(d: bytes, n: int) -> list[float]:
    """Prior times likelihood of each of FIRST: length, signature, file system."""
    marked = n >= 512 and d[510:512] == b"\x55\xaa" and _le(d, 11) == 512
    system = {"FAT": marked, "OFS": n >= 512 and d[:3] == b"DOS", "CBM": n > 0x16502 and d[0x16500 : 0x16501] == b"\x12"}
    out = []
    for s in FIRST:
        v = s.prior
        if s.sizes:
            v *= 0.9 if n in s.sizes else 0.1
        if s.magic and len(d) >= 4 and len(s.magic) <= min(n, 64):
            v *= 0.95 if d.startswith(s.magic) else 0.01
        if n >= 512 and system.get(s.filesystem):
            v *= 0.8 if s.filesystem == "FAT" else 0.85
        out.append(v)
    return out


def scores(s: Spec, d: bytes, n: int) -> tuple[float, float, float]:
    """Length, signature and structure of a format of SECOND in a file."""
    size = 1.0 if n in s.sizes else 0.5 if s.least <= n <= s.most else 0.3 if any(0.9 < n / x < 1.1 for x in s.sizes) else 0.01
    if not s.magic:
        magic = 0.5
    elif min(len(d), 64) < len(s.magic):
        magic = 0.01
    else:
        agree = sum(a == b for a, b in zip(d, s.magic, strict=False))
        magic = 1.0 if agree == len(s.magic) else agree / len(s.magic) * 0.5
    return size, magic, 0.5 if s.check is None else 1.0 if s.check(d) else 0.1


def evidence_second(d: bytes, n: int) -> list[float]:
    """Prior times the cubic mean of the scores of each of SECOND; all are judged by the first 64 bytes."""
    made = [(s.prior, scores(s, d[:64], n)) for s in SECOND]
    return [p * (a * b * c) ** (1 / 3) for p, (a, b, c) in made]


def posteriors(files: DataFrame, specs: list[Spec], evidence: Callable[[bytes, int], list[float]], window: int | None = None) -> DataFrame:
    """path, best, post, second, next: the two most probable formats of each file and their probabilities."""
    seen = F.col("content") if window is None else F.substring("content", 1, window)

    def run(batches):
        for batch in batches:
            path, size, content = (batch.column(c).to_pylist() for c in ("path", "length", "content"))
            v = np.array([evidence(c or b"", n) for c, n in zip(content, size, strict=True)], np.float64).reshape(len(path), len(specs))
            post = np.round(v / v.sum(axis=1, keepdims=True), 9)
            order = np.argsort(-post, axis=1, kind="stable")[:, :2]
            best = np.take_along_axis(post, order, axis=1)
            name = lambda k, order=order: pa.array([specs[i].name for i in order[:, k]], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("path"), name(0), pa.array(best[:, 0]), name(1), pa.array(best[:, 1])], names=["path", "best", "post", "second", "next"])

    return files.select("path", "length", seen.alias("content")).mapInArrow(run, "path string, best string, post double, second string, next double")


def score_table(files: DataFrame) -> DataFrame:
    """path, format, size_score, magic_score, structure_score of each of SECOND in the whole content."""

    def run(batches):
        for batch in batches:
            path, size, content = (batch.column(c).to_pylist() for c in ("path", "length", "content"))
            rows = [(p, s.name, *scores(s, c or b"", n)) for p, n, c in zip(path, size, content, strict=True) for s in SECOND]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 2 else pa.float64()) for k, c in enumerate(cols)], names=["path", "format", "size_score", "magic_score", "structure_score"])

    return files.select("path", "length", "content").mapInArrow(run, "path string, format string, size_score double, magic_score double, structure_score double")
