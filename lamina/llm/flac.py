"""FLAC: texts as 8-bit mono PCM, stored losslessly and read back with every checksum verified.

write() stores payloads as FLAC streams: STREAMINFO (with the samples' MD5), a SEEKTABLE with the
frames' sample and byte offsets, and frames of BLOCK samples, each coded by the cheapest of the fixed
linear predictors of order 0 to 2 with Rice residuals, a constant or verbatim samples. read() decodes any
mono stream of 8 to 16 bits with one block size: constant, verbatim, fixed (order 0 to 4) and LPC
subframes, Rice partitions of both kinds with escapes, wasted bits; it verifies each frame's header CRC-8
and frame CRC-16 and the stream's MD5, and gives PCM blocks with their sample offsets.

All frames of a batch are coded together, one numpy lane a frame: the encoder places all codes by
prefix sums; the decoder steps sample by sample through all lanes at once.

Defined cases: a null text is empty; a payload is the text's UTF-8 padded with zero bytes to a positive
multiple of PAD; equal texts, equal values; a wrong checksum is an error; other columns are not read."""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, slices

BLOCK = 4096
PAD = 64
RATE = 8000
#: Fixed values of the format: coefficients of its fixed linear predictors by order.
FIXED = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])
#: Bytes of texts that are coded together.
GROUP = 5 << 20


@functools.cache
def _crc_table(bits: int, poly: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for c in range(256):
        c <<= bits - 8
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint32)


def crc8(data: bytes) -> int:
    table, c = _crc_table(8, 0x07), 0
    for b in data:
        c = int(table[c ^ b])
    return c


def crc16_lanes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 (0x8005) of each span of data; longest spans first through all lanes at once."""
    table = _crc_table(16, 0x8005)
    order = np.argsort(-size, kind="stable")
    s, n, c = start[order], size[order], np.zeros(len(order), np.uint32)
    live = len(n)
    for i in range(int(n.max(initial=0))):
        while live and n[live - 1] <= i:
            live -= 1
        v = c[:live]
        c[:live] = ((v << np.uint32(8)) & np.uint32(0xFFFF)) ^ table[(v >> np.uint32(8)) ^ data[s[:live] + i]]
    out = np.empty(len(order), np.uint32)
    out[order] = c
    return out


def _utf8_number(n: int) -> bytes:
    """Frame numbers are coded as UTF-8 codes characters, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(~(2 * lead + 1) & 0xFF) | n, *reversed(tail)])


def _header(number: int, samples: int) -> bytes:
    code = b"\xff\xf8\x74\x02" if samples != BLOCK else b"\xff\xf8\xc4\x02"
    out = code + _utf8_number(number) + ((samples - 1).to_bytes(2, "big") if samples != BLOCK else b"")
    return out + bytes([crc8(out)])


def _plan(lanes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each lane of samples (rows, padded): predictor (0 to 2; 3 verbatim, 4 constant) and Rice parameter."""
    n, width = lanes.shape
    inside = np.arange(width)[None, :] < length[:, None]
    best, kind, param = 8 * length, np.full(n, 3), np.zeros(n, np.int64)
    res = lanes.astype(np.int32)
    for order in range(3):
        if order:
            res = np.diff(res, axis=1, prepend=0)
        use = inside & (np.arange(width)[None, :] >= order)
        u = np.where(use, (res << 1) ^ (res >> 31), 0)
        count = np.maximum(length - order, 0)
        for k in range(8):
            bits = (u >> k).sum(axis=1) + count * (1 + k) + 8 * order + 10
            better = (bits < best) & (length > order)
            best, kind, param = np.where(better, bits, best), np.where(better, order, kind), np.where(better, k, param)
    same = (np.where(inside, lanes, lanes[:, :1]) == lanes[:, :1]).all(axis=1)
    return np.where(same, 4, kind), param


def encode_frames(payload: np.ndarray, start: np.ndarray, length: np.ndarray, number: np.ndarray) -> list[bytes]:
    """A frame for each lane: payload[start : start + length] less 128 as signed samples."""
    frames: list[bytes] = [b""] * len(start)
    for size in np.unique(length).tolist():
        for at in range(0, int((length == size).sum()), 512):
            rows = np.flatnonzero(length == size)[at : at + 512]
            lanes = payload[start[rows][:, None] + np.arange(size)[None, :]].astype(np.int16) - 128
            kind, param = _plan(lanes, np.full(len(rows), size))
            for what in np.unique(kind).tolist():
                mine = np.flatnonzero(kind == what)
                bodies = _bodies(lanes[mine], what, param[mine])
                for r, body in zip(rows[mine].tolist(), bodies, strict=True):
                    frames[r] = _header(int(number[r]), size) + body
    joined = np.frombuffer(b"".join(frames), np.uint8)
    sizes = np.array([len(f) for f in frames], np.int64)
    crc = crc16_lanes(joined, np.cumsum(sizes) - sizes, sizes)
    return [f + int(c).to_bytes(2, "big") for f, c in zip(frames, crc, strict=True)]


def _bodies(lanes: np.ndarray, kind: int, param: np.ndarray) -> list[bytes]:
    """Subframes of lanes of one kind, each padded to whole bytes."""
    raw = (lanes & 0xFF).astype(np.uint8)
    if kind == 4:
        return [bytes([0, int(r[0])]) for r in raw]
    if kind == 3:
        return [b"\x02" + r.tobytes() for r in raw]
    n, size = lanes.shape
    res = lanes.astype(np.int32)
    for _ in range(kind):
        res = np.diff(res, axis=1, prepend=0)
    res = res[:, kind:]
    u = ((res << 1) ^ (res >> 31)).astype(np.int64)
    k = param[:, None]
    q = u >> k
    head = 8 + 8 * kind + 2 + 4 + 4
    width = q + 1 + k
    stop = np.cumsum(width, axis=1) + head
    total = -(-stop[:, -1] // 8) * 8
    base = np.cumsum(total) - total
    bits = np.zeros(int(total.sum()), np.uint8)

    def put(at: np.ndarray, value: np.ndarray, count: int) -> None:
        for i in range(count):
            bits[at + i] = (value >> (count - 1 - i)) & 1

    put(base, np.full(n, (8 + kind) << 1), 8)
    for i in range(kind):
        put(base + 8 + 8 * i, raw[:, i].astype(np.int64), 8)
    put(base + 8 + 8 * kind + 6, param, 4)
    stops = (base[:, None] + stop - 1).ravel()  # the last bit of each code
    kk, low = np.repeat(param, size - kind), u.ravel()
    bits[stops - kk] = 1
    for i in range(int(param.max(initial=0))):
        some = np.flatnonzero(kk > i) if (param <= i).any() else slice(None)
        bits[stops[some] - i] = (low[some] >> i) & 1
    packed = np.packbits(bits).tobytes()
    return [packed[a // 8 : (a + t) // 8] for a, t in zip(base.tolist(), total.tolist(), strict=True)]


def write(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload of 8-bit samples."""
    start, length, number, owner, at = [], [], [], [], 0
    for i, p in enumerate(payloads):
        for j in range(0, len(p), BLOCK):
            start.append(at + j)
            length.append(min(BLOCK, len(p) - j))
            number.append(j // BLOCK)
            owner.append(i)
        at += len(p)
    whole = np.frombuffer(b"".join(payloads), np.uint8)
    frames = encode_frames(whole, *(np.array(x, np.int64) for x in (start, length, number)))
    own: list[list[int]] = [[] for _ in payloads]
    for f, i in enumerate(owner):
        own[i].append(f)
    out = []
    for p, mine in zip(payloads, own, strict=True):
        sizes = [len(frames[f]) for f in mine]
        digest = hashlib.md5((np.frombuffer(p, np.uint8) ^ np.uint8(128)).tobytes()).digest()
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | len(p)).to_bytes(8, "big") + digest
        seek, offset = b"", 0
        for f, s in zip(mine, sizes, strict=True):
            seek += (number[f] * BLOCK).to_bytes(8, "big") + offset.to_bytes(8, "big") + length[f].to_bytes(2, "big")
            offset += s
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(frames[f] for f in mine))
    return out


def _metadata(stream: bytes) -> tuple[dict, list[tuple[int, int, int]], int]:
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, seek = 4, False, {}, []
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            word = int.from_bytes(body[10:18], "big")
            info = {"block": int.from_bytes(body[:2], "big"), "rate": word >> 44, "channels": (word >> 41 & 7) + 1, "bits": (word >> 36 & 31) + 1,
                    "samples": word & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            for i in range(0, size - 17, 18):
                point = tuple(int.from_bytes(body[i + a : i + b], "big") for a, b in ((0, 8), (8, 16), (16, 18)))
                if point[0] != 2**64 - 1:
                    seek.append(point)
        at += 4 + size
    if info.get("channels") != 1 or not 8 <= info["bits"] <= 16:
        raise ValueError("only mono streams of 8 to 16 bits are read")
    return info, seek, at


def _frame_header(stream: bytes, at: int, info: dict) -> tuple[int, int]:
    """Samples of the frame at a byte position, and its header's length; verifies CRC-8."""
    if stream[at] != 0xFF or stream[at + 1] & 0xFE != 0xF8:
        raise ValueError("no frame where one should start")
    code, rate = stream[at + 2] >> 4, stream[at + 2] & 15
    p = at + 4
    lead = stream[p]
    p += 1 if lead < 0x80 else 8 - ((~lead & 0xFF).bit_length())
    if code == 6:
        samples, p = stream[p] + 1, p + 1
    elif code == 7:
        samples, p = int.from_bytes(stream[p : p + 2], "big") + 1, p + 2
    else:
        samples = 192 if code == 1 else 144 << code if code < 6 else 1 << code
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(stream[at:p]) != stream[p]:
        raise ValueError("a frame header's checksum differs")
    return samples, p + 1 - at


class _Bits:
    """Bit cursors into one byte array, one for each lane."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        pad = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
        w = np.zeros(len(pad) - 7, np.uint64)
        for i in range(8):
            w |= pad[i : len(pad) - 7 + i] << np.uint64(56 - 8 * i)
        self.words, self.at = w, at.astype(np.int64) * 8

    def window(self, rows) -> np.ndarray:
        at = self.at[rows]
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, rows, count: np.ndarray) -> np.ndarray:
        """Unsigned values of count bits (57 at most)."""
        v = self.window(rows)
        n = np.asarray(count, np.int64)
        out = np.where(n > 0, v >> np.uint64(1) >> (63 - n).clip(0).astype(np.uint64), np.uint64(0))
        self.at[rows] += n
        return out.astype(np.int64)

    def signed(self, rows, count: np.ndarray) -> np.ndarray:
        v, n = self.take(rows, count), np.asarray(count, np.int64)
        return np.where((n > 0) & (v >> np.maximum(n - 1, 0) & 1 == 1), v - (1 << n), v)

    def unary(self, rows) -> np.ndarray:
        """Zeros before the next one, and past it; long runs are read window by window."""
        total = np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            v = self.window(rows[left])
            # The 53 leading bits as a float have the position of the first one in their exponent.
            high = v >> np.uint64(11)
            zeros = 53 - np.frexp(high.astype(np.float64))[1]
            some = high > 0
            step = np.where(some, zeros, 48)
            total[left] += step
            self.at[rows[left]] += step + some
            left = left[~some]
        return total


def decode_frames(data: np.ndarray, body: np.ndarray, samples: np.ndarray, bits_per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of each frame as rows (padded), and the byte after each subframe."""
    n, width = len(body), int(samples.max(initial=0))
    cur, every = _Bits(data, body), np.arange(n)
    out = np.zeros((width, n), np.int32)
    head = cur.take(every, np.full(n, 8))
    kind, wasted = head >> 1 & 63, np.zeros(n, np.int64)
    odd = np.flatnonzero(head & 1)
    if len(odd):
        wasted[odd] = cur.unary(odd) + 1
    depth = bits_per - wasted
    const, verb = kind == 0, kind == 1
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if not (const | verb | fixed | lpc).all():
        raise ValueError("a reserved subframe type")
    rows = np.flatnonzero(const)
    if len(rows):
        out[:, rows] = cur.signed(rows, depth[rows])[None, :]
    for i in range(width):
        rows = np.flatnonzero(verb & (samples > i))
        if not len(rows):
            break
        out[i, rows] = cur.signed(rows, depth[rows])
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    coded = np.flatnonzero(fixed | lpc)
    top = int(order[coded].max(initial=0))
    for i in range(top):
        rows = coded[order[coded] > i]
        out[i, rows] = cur.signed(rows, depth[rows])
    coef, shift = np.zeros((max(top, 1), n), np.int64), np.zeros(n, np.int64)
    rows = np.flatnonzero(lpc)
    if len(rows):
        precision = cur.take(rows, np.full(len(rows), 4)) + 1
        shift[rows] = cur.signed(rows, np.full(len(rows), 5))
        for i in range(int(order[rows].max())):
            some = order[rows] > i
            coef[i, rows[some]] = cur.signed(rows[some], precision[some])
    for o, c in enumerate(FIXED[: top + 1]):
        for i, x in enumerate(c):
            coef[i, fixed & (order == o)] = x
    if len(coded):
        method = cur.take(coded, np.full(len(coded), 2))
        parts = cur.take(coded, np.full(len(coded), 4))
        wide = np.where(method == 1, 5, 4)
        span = samples[coded] >> parts
        coded_by = np.argsort(-samples[coded], kind="stable")
        rows, wide, span = coded[coded_by], wide[coded_by], span[coded_by]
        k, raw = np.zeros(len(rows), np.int64), np.full(len(rows), -1)
        first, size, o = order[rows], samples[rows], order[rows]
        live = len(rows)
        plain = bool((span == size).all() and (o == o[0]).all())
        for i in range(width):
            while live and size[live - 1] <= i:
                live -= 1
            if not live:
                break
            lanes = rows[:live]
            # A partition starts at its first residual: the warm-up samples shorten the first one.
            new = np.flatnonzero((i == first[:live]) | ((i % span[:live] == 0) & (i > first[:live]))) if not plain or i == o[0] else ()
            if len(new):
                k[new] = cur.take(lanes[new], wide[new])
                raw[new] = -1
                esc = new[k[new] == np.where(wide[new] == 5, 31, 15)]
                if len(esc):
                    raw[esc] = cur.take(lanes[esc], np.full(len(esc), 5))
            if plain:
                if i < o[0]:
                    continue
                act = np.arange(live)
            else:
                act = np.flatnonzero(i >= first[:live])
                if not len(act):
                    continue
            who = lanes[act] if len(act) < live else lanes
            rice = raw[act] < 0
            if rice.all():
                q = cur.unary(who)
                u = (q << k[act]) | cur.take(who, k[act])
                res = (u >> 1) ^ -(u & 1)
            else:
                res = np.zeros(len(act), np.int64)
                q = cur.unary(who[rice])
                u = (q << k[act][rice]) | cur.take(who[rice], k[act][rice])
                res[rice] = (u >> 1) ^ -(u & 1)
                res[~rice] = cur.signed(who[~rice], raw[act][~rice])
            if top:
                guess = np.zeros(len(act), np.int64)
                for j in range(min(top, i)):
                    guess += coef[j, who] * out[i - 1 - j, who] * (o[act] > j)
                res += guess >> np.maximum(shift[who], 0)
            out[i, who] = res
    out <<= wasted[None, :].astype(np.int32)
    return out, -(-cur.at // 8)


def read(streams: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """PCM blocks (sample offset, samples) of each stream; every checksum is verified."""
    start, body, samples, bits, owner, first = [], [], [], [], [], []
    data = np.frombuffer(b"".join(streams), np.uint8)
    base, infos = 0, []
    for i, s in enumerate(streams):
        info, seek, at = _metadata(s)
        infos.append(info)
        spots = [(p, at + o) for p, o, _ in seek] if seek else _scan(s, at, info)
        for pos, frame in spots:
            count, head = _frame_header(s, frame, info)
            start.append(base + frame)
            body.append(base + frame + head)
            samples.append(count)
            bits.append(info["bits"])
            owner.append(i)
            first.append(pos)
        base += len(s)
    start, body, samples, bits = (np.array(x, np.int64) for x in (start, body, samples, bits))
    blocks: list[list[tuple[int, np.ndarray]]] = [[] for _ in streams]
    if not len(start):
        return blocks
    pcm, end = decode_frames(data, body, samples, bits)
    stored = (data[end].astype(np.uint32) << 8) | data[end + 1]
    if (crc16_lanes(data, start, end - start) != stored).any():
        raise ValueError("a frame's checksum differs")
    for f, i in enumerate(owner):
        blocks[i].append((first[f], pcm[: samples[f], f]))
    for b, info in zip(blocks, infos, strict=True):
        whole = np.concatenate([x for _, x in b])
        kind = "<i1" if info["bits"] <= 8 else "<i2"
        if len(whole) != info["samples"] or hashlib.md5(whole.astype(kind).tobytes()).digest() != info["md5"]:
            raise ValueError("the samples' checksum differs")
    return blocks


def _scan(stream: bytes, at: int, info: dict) -> list[tuple[int, int]]:
    """Frame positions of a stream without a seek table: each frame's end is where its decoding stops."""
    out, pos = [], 0
    data = np.frombuffer(stream, np.uint8)
    while pos < info["samples"]:
        count, head = _frame_header(stream, at, info)
        out.append((pos, at))
        _, end = decode_frames(data, np.array([at + head]), np.array([count]), np.array([info["bits"]]))
        at, pos = int(end[0]) + 2, pos + count
    return out


def payload(text: bytes | None) -> bytes:
    """UTF-8 padded with zeros to a positive multiple of PAD."""
    text = text or b""
    return text + bytes(-len(text) % PAD if text else PAD)


def _feature(samples: np.ndarray) -> str:
    """Peak, rounded RMS and zero crossings of the decoded samples."""
    x = samples.astype(np.int64)
    return f"peak={int(np.abs(x).max())};rms={np.sqrt((x * x).mean()):.3f};zc={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """doc_ids and texts of consecutive rows, about GROUP bytes at a time, so that many frames are coded together."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
            if texts and size + len(text or b"") > GROUP:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc)
            texts.append(text)
            size += len(text or b"")
    if texts:
        yield ids, texts


def media(docs: DataFrame) -> DataFrame:
    """The report of each text's stored form as read back."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _grouped(batches):
            stored = write([payload(t) for t in texts])
            rows = []
            for doc, t, s, blocks in zip(ids, texts, stored, read(stored), strict=True):
                samples = np.concatenate([x for _, x in blocks])
                back = (samples + 128).astype(np.uint8).tobytes()
                rows.append((doc, len(t or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(s),
                             hashlib.sha256(s).hexdigest(), _feature(samples)))
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, media: the FLAC stream of each text."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "media": write([payload(t) for t in as_bytes(batch.column("text"))])}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, media binary")


def pcm_blocks(streams: DataFrame) -> DataFrame:
    """doc_id, sample_offset, samples (little-endian 16-bit PCM) of each block of a column of FLAC streams."""

    def run(batches):
        for batch in slices(batches, 64):
            for doc, blocks in zip(batch.column("doc_id").to_pylist(), read(batch.column("media").to_pylist()), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(blocks), pa.int64()), pa.array([o for o, _ in blocks], pa.int64()), pa.array([x.astype("<i2").tobytes() for _, x in blocks], pa.binary())],
                    names=["doc_id", "sample_offset", "samples"])

    return streams.select("doc_id", "media").mapInArrow(run, "doc_id long, sample_offset long, samples binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
