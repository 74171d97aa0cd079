import hashlib
import zlib

import numpy as np
import pytest

from lamina.llm import flac

from .conftest import odd_rows


def pcm(stream):
    return np.concatenate([x for _, x in flac.read([stream])[0]])


@pytest.mark.parametrize("data", [bytes(64), b"a" * 5000, bytes(range(256)) * 40, b"\xff" * 4096 + b"abc" * 64, bytes([0, 255] * 5000), "é ü text ".encode() * 900])
def test_round_trip(data):
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 256, 9000, dtype=np.uint8).tobytes()
    wave = (128 + 100 * np.sin(np.arange(12000) / 30)).astype(np.uint8).tobytes()
    for stream, want in zip(flac.write([data, noise, wave]), (data, noise, wave), strict=True):
        assert (pcm(stream) + 128).astype(np.uint8).tobytes() == want
    assert len(flac.write([wave])[0]) < len(wave) / 2


def test_seek_points_lead_to_frames_and_blocks_have_offsets():
    stream = flac.write([b"hello world " * 2000])[0]
    info, seek, at = flac._metadata(stream)
    assert [p for p, _, _ in seek] == list(range(0, 24000, flac.BLOCK)) and info["samples"] == 24000
    assert all(stream[at + o] == 0xFF for _, o, _ in seek)
    assert [o for o, _ in flac.read([stream])[0]] == [p for p, _, _ in seek]
    bare = stream[:4] + b"\x80" + stream[5:42] + stream[at:]  # the same without its seek table
    assert (pcm(bare) == pcm(stream)).all()


def test_damage_is_found():
    stream = flac.write([b"hello world " * 2000])[0]
    at = flac._metadata(stream)[2]
    for spot in (at + 3, at + 40, len(stream) - 1):
        bad = bytearray(stream)
        bad[spot] ^= 1
        with pytest.raises(ValueError):
            flac.read([bytes(bad)])


def _bits(*fields):
    text = "".join(format(v & (1 << n) - 1, f"0{n}b") for v, n in fields)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def _rice(values, k):
    out = []
    for v in values:
        u = 2 * v if v >= 0 else -2 * v - 1
        out += [(0, u >> k), (1, 1), (u & (1 << k) - 1, k)] if u >> k else [(1, 1), (u & (1 << k) - 1, k)]
    return out


def test_lpc_partitions_escapes_and_wasted_bits_by_hand():
    rng = np.random.default_rng(3)
    x = (rng.integers(-20, 20, 16) * 2).astype(int)  # one wasted bit
    y = x // 2
    coef, shift = [3, -1], 1
    res = [int(y[i] - ((coef[0] * y[i - 1] + coef[1] * y[i - 2]) >> shift)) for i in range(2, 16)]
    body = _bits((0, 1), (32 + 1, 6), (1, 1), (1, 1), (int(y[0]), 15), (int(y[1]), 15), (3, 4), (shift, 5), (coef[0], 4), (coef[1], 4),
                 (0, 2), (1, 4), (2, 4), *_rice(res[:6], 2), (15, 4), (9, 5), *[(r, 9) for r in res[6:]])
    out, end = flac.decode_frames(np.frombuffer(body, np.uint8), np.array([0]), np.array([16]), np.array([16]))
    assert out[:, 0].tolist() == x.tolist() and end[0] == len(body)


def test_query_values(docs):
    want = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    for r in flac.media(docs).collect():
        data = flac.payload(want[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"]) == (len(want[r["doc_id"]]), len(data))
        assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["tail_crc32"] == zlib.crc32(data[-64:])


def test_media_column_and_pcm(docs, odd_extra, empty):
    blocks = flac.pcm_blocks(flac.media_column(odd_extra)).collect()
    text = max((r[1] for r in odd_rows() if r[0] == 9), key=len)
    mine = sorted((b["sample_offset"], b["samples"]) for b in blocks if b["doc_id"] == 9)
    assert (np.frombuffer(b"".join(s for _, s in mine), "<i2") + 128).astype(np.uint8).tobytes() == flac.payload(text.encode())
    assert len(flac.media(odd_extra).collect()) == len(odd_rows()) and flac.media(empty).count() == 0
