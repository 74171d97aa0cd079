import binascii
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions.scalars import crc16_ccitt
from lamina.operators import decode, lanes
from lamina.sources import containers as c


def test_transitions_round_trip_and_overflow():
    ticks = np.array([1, 65535, 65537, 200_000, 5])
    got = c.decode_transitions(c.encode_transitions(ticks))
    assert got[got > 0].tolist() == ticks.tolist()
    assert c.decode_transitions(b"").tolist() == [] and c.decode_transitions(b"\0\0\0\x05\0\0").tolist() == [0, 65541, 0]


def test_opcode_stream():
    raw = bytes([0x20, 0x01, 0x10, 0x08, 0x09, 0xFF, 0x0B, 0x30, 0x0C, 0x12, 0x34, 0x0D, 0x02, 0x02, 0x00, 0xAA, 0xBB, 0x40, 0x0D, 0x0D, 0x0D, 0x0D])
    ticks, status = c.decode_stream(raw)
    assert ticks.tolist() == [0x20, 0x110, 65536 + 0x30, 0x1234, 0x40] and status == "OK"
    ticks, status = c.decode_stream(raw[:9])
    assert ticks.tolist() == [0x20, 0x110, 65536 + 0x30] and status == "TRUNCATED"


def test_files_and_data_source(spark, tmp_path):
    (tmp_path / "a.img").write_bytes(bytes(range(256)) * 5)
    got = c.sector_image(c.files(spark, str(tmp_path)), 512).orderBy("sector").collect()
    assert [len(r["data"]) for r in got] == [512, 512, 256]
    spark.dataSource.register(c.SectorImageSource)
    rows = spark.read.format("sector_image").option("sector_size", 512).option("partition_sectors", 1).load(f"file://{tmp_path}")
    assert rows.rdd.getNumPartitions() == 3
    assert b"".join(r["data"] for r in rows.orderBy("sector").collect()) == bytes(range(256)) * 5


@pytest.mark.parametrize("data", [b"", b"123456789", bytes(range(256))])
def test_crc16(spark, data):
    got = spark.createDataFrame([(data.hex().upper(),)], "h string").select(crc16_ccitt(F.col("h"))).first()[0]
    assert got == binascii.crc_hqx(data, 0xFFFF)


def test_a_drifting_clock_is_followed(spark):
    cells, cell, rows = [2, 3, 4, 2, 2, 3] * 40, 2000.0, []
    for i, n in enumerate(cells):
        cell *= 1.0005
        rows.append((1, i, n * cell))
    df = spark.createDataFrame(rows, "t long, i long, dt double")
    for start, step in (lanes.phase_loop(2000.0, 0.5, 0.05), lanes.simple_kalman_loop(2000.0, 10000.0, 1.0, 2500.0)):
        extra = "period double" if len(start) == 2 else "cell double, odd boolean"
        got = lanes.scan(df, "t", "i", ["dt"], start, step, f"cells long, {extra}").orderBy("i").collect()
        assert [r["cells"] for r in got] == cells


def test_lanes_equal_a_plain_loop_across_stretches_and_batches(spark, monkeypatch):
    rng = np.random.default_rng(3)
    series = {t: rng.normal(0, 3, n).round(3).tolist() for t, n in ((1, 9000), (2, 1), (3, 4097), (4, 37), (None, 50))}
    rows = [(t, i, x) for t, xs in series.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "t long, i long, x double").repartition(3)
    start, step = lanes.change_loop(0.5, 12.0)
    want = []
    for t, xs in series.items():
        up = down = 0.0
        for i, x in enumerate(xs):
            up, down = max(0.0, up + x - 0.5), max(0.0, down - x - 0.5)
            hit = up > 12 or down > 12
            want.append((str(t), i, hit))
            up, down = (0.0, 0.0) if hit else (up, down)
    for size in ("10000", "997"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = lanes.scan(df, "t", "i", ["x"], start, step, "hit boolean").collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        assert sorted((str(r["t"]), r["i"], r["hit"]) for r in got) == sorted(want)
    assert lanes.scan(df.limit(0), "t", "i", ["x"], start, step, "hit boolean").count() == 0


def test_flux_images_and_captures():
    rng = np.random.default_rng(4)
    tracks = {n: rng.integers(1, 300_000, 200) for n in (0, 5, 167)}
    tracks = {n: np.where(t % 65536 == 0, t + 1, t) for n, t in tracks.items()}
    raw = c.flux_image({n: c.encode_transitions(t) for n, t in tracks.items()})
    assert [n for n, _, _ in c.open_flux_image(raw)] == [0, 5, 167] and c.checksum_ok(raw)
    for n, t in tracks.items():
        got = c.flux_track(raw, n)
        assert got[got > 0].tolist() == t.tolist()
    assert not c.checksum_ok(raw[:-1] + bytes([raw[-1] ^ 1])) and c.checksum_ok(c.flux_image({}, True)[:-1] + b"\1")
    assert c.open_flux_image(b"") == [] and c.flux_track(raw, 9).tolist() == []
    back = c.read_captures(c.capture_file(tracks))
    assert [n for n, _ in back] == [0, 5, 167] and all(t.tolist() == tracks[n].tolist() for n, t in back)
    assert c.read_captures(b"junk") == []
    ticks, status = c.decode_stream(c.encode_stream(tracks[5]))
    assert status == "OK" and ticks.tolist() == tracks[5].tolist()


def test_trellis_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        bits = "".join(rng.choice(["0", "1"], int(rng.integers(4, 15))))

        def best(p, bits=bits):
            if p == len(bits):
                return 0
            return min((int(decode._TABLES[n][0][int(bits[p : p + n], 2)]) + best(p + n) for n in (4, 5, 6) if p + n <= len(bits)), default=1 << 30)

        cost, _ = decode.trellises([bits, "1" * 20])[0]
        want = best(0)
        assert cost == (want if want < 1 << 20 else -1)
    codes = [f"{x:05b}" for x in decode._CODES]
    text = "".join(codes[i] for i in (1, 2, 3, 9, 12, 5, 7))
    assert decode.trellises([text, "", "01"]) == [(0, "1239C57"), (0, ""), (-1, "")]
    assert decode.trellises([text[:12] + text[13:]])[0][0] == decode.SLIP


def plain_merge(segs, least):
    """The first short segment joins a neighbour, then again from the start; segs are (points, sum)."""
    segs = [(n, t, [i]) for i, (n, t) in enumerate(segs)]
    while len(segs) > 1:
        i = next((i for i, s in enumerate(segs) if s[0] < least), None)
        if i is None:
            break
        mean = [t / n for n, t, _ in segs]
        left = i > 0 and (i + 1 == len(segs) or abs(mean[i] - mean[i - 1]) <= abs(mean[i] - mean[i + 1]))
        a = i - 1 if left else i
        segs[a : a + 2] = [tuple(x + y for x, y in zip(segs[a], segs[a + 1], strict=True))]
    return [s[2] for s in segs]


def test_short_segments_merge_as_by_plain_steps():
    rng = random.Random(3)
    for _ in range(300):
        segs = [(rng.randrange(1, 8), rng.randrange(-20, 20)) for _ in range(rng.randrange(1, 14))]
        start, step = lanes.short_loop(4)
        state, kinds = [np.array([x]) for x in start], []
        for i, (n, t) in enumerate(segs):
            after = segs[i + 1] if i + 1 < len(segs) else (0, 0)
            state, (kind,) = step(state, [np.array([float(x)]) for x in (n, t, *after)])
            kinds.append(int(kind[0]))
        groups = []
        held = []
        for i, kind in enumerate(kinds):
            held.append(i)
            if kind == 1:
                groups[-1] += held
            elif kind == 0:
                groups.append(held)
            if kind != 2:
                held = []
        assert not held and groups == plain_merge(segs, 4)
