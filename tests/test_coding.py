import itertools
import random

import pytest

from lamina.operators import coding
from lamina.operators import syndromes as sy


def plain_crc(data, c=0xFFFF):
    for byte in data:
        c ^= byte << 8
        for _ in range(8):
            c = (c << 1 ^ 0x1021) & 0xFFFF if c & 0x8000 else c << 1
    return c


def flipped(data, distances):
    x = bytearray(data)
    for d in distances:
        x[len(x) - 1 - d // 8] ^= 1 << d % 8
    return bytes(x)


def test_checksums_of_blocks_of_any_length():
    rng = random.Random(1)
    blocks = [rng.randbytes(n) for n in (0, 1, 2, 3, 17, 64, 255, 300)]
    assert sy.checksums(blocks).tolist() == [plain_crc(b) for b in blocks]
    assert sy.checksums([b"123456789"]).tolist() == [0x29B1] and sy.checksums([]).tolist() == []


@pytest.mark.parametrize("size", [1, 2, 9, 24])
def test_outcomes_equal_a_search_of_all_flips(size):
    rng = random.Random(size)
    data = rng.randbytes(size)
    stored = plain_crc(data)
    for turned in range(4):
        for _ in range(12):
            bad = flipped(data, rng.sample(range(8 * size), turned))
            ones = [flipped(bad, [d]) for d in range(8 * size) if plain_crc(flipped(bad, [d])) == stored]
            twos = [flipped(bad, p) for p in itertools.combinations(range(8 * size), 2) if plain_crc(flipped(bad, p)) == stored] if size < 10 or turned == 2 else None
            (state,), (made,) = sy.repair([bad], [stored])
            if plain_crc(bad) == stored:
                assert (state, made) == ("OK", bad)
            elif ones:
                assert (state, made) == ("ONE", ones[0]) and len(ones) == 1
            elif twos is not None:
                assert state == ("NONE" if not twos else "TWO" if len(twos) == 1 else "AMBIGUOUS")
                assert made == (twos[0] if len(twos) == 1 else bad)
            assert sy.repair([bad], [stored], most_wrong=1)[0][0] == ("OK" if plain_crc(bad) == stored else "ONE" if ones else "NONE")


def test_long_blocks_nulls_and_limits(spark):
    rng = random.Random(5)
    long = rng.randbytes(4200)
    bad = flipped(long, [3])  # a bit a period away has the same share
    assert sy.repair([bad], [plain_crc(long)])[0] == ["AMBIGUOUS"]
    data = rng.randbytes(40)
    pair = flipped(data, [1, 300])
    rows = [(bytearray(pair), plain_crc(data)), (None, 5), (bytearray(b""), 0xFFFF), (bytearray(b""), 1), (bytearray(data), None), (bytearray(data), plain_crc(data))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, data binary, crc long")
    got = {r["id"]: r["outcome"] for r in sy.repaired(df).collect()}
    assert got[0] in ("TWO", "AMBIGUOUS") and got == {0: got[0], 1: None, 2: "OK", 3: "NONE", 4: None, 5: "OK"}
    assert {r["id"]: r["outcome"] for r in sy.repaired(df, most_two=39).collect()}[0] == "NONE"


def plain_recovery(raw, sync, spacing):
    """Byte by byte: mend marks from left to right, then one distance after the other, each time from the start."""
    a, repairs, slips, at = bytearray(raw), 0, 0, 0
    while at < len(a) - len(sync):
        wrong = sum(bin(x ^ y).count("1") for x, y in zip(a[at:], sync, strict=False))
        if wrong > 2:
            at += 1
            continue
        repairs += wrong > 0
        a[at : at + len(sync)] = sync
        at += len(sync)
    while slips < 11:
        marks = [i for i in range(len(a) - len(sync)) if a[i : i + len(sync)] == sync]
        bad = [(i, (j - i) * 8 - spacing) for i, j in zip(marks, marks[1:], strict=False) if 16 < abs((j - i) * 8 - spacing) < 64]
        if not bad:
            break
        place, size = bad[0][0] + spacing // 16, bad[0][1] // 8
        a[place : place + max(0, size)] = bytes(max(0, -size))
        slips += 1
    return bytes(a), repairs, slips


def test_streams_without_checksum_are_mended_as_by_plain_steps():
    rng, sync = random.Random(5), bytes.fromhex("448944894489")
    for trial in range(150):
        raw = b""
        for _ in range(rng.randrange(0, 20)):
            mark = int.from_bytes(sync)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                mark ^= 1 << rng.randrange(48)
            raw += mark.to_bytes(6) + rng.randbytes(58 + rng.choice([0, 0, 3, 5, 7, 8, -3, -4, -7, -8, -20]))
        raw = raw[: len(raw) - rng.randrange(0, 70)] if trial % 3 == 0 else raw
        assert coding.recover_stream(raw, sync, 512) == plain_recovery(raw, sync, 512)
    assert coding.recover_stream(b"", sync, 512) == (b"", 0, 0)
