"""Probing real bytes: signatures, structures, lengths, ties; sector readers."""

import random

import pytest

from lamina.operators import probing as pr
from lamina.sources import containers, disks, samples

SCHEMA = "path string, length long, content binary"


def confidences(raw, size=None):
    n = len(raw) if size is None else size
    return {f: c for f in pr.proposals([raw], [n])[0] if (c := pr.CHECKS[f](raw, n)) > 0}


def test_lengths_of_zoned_disks():
    for n in (174848, 175531, 196608, 197376, 200960, 201745, 205312, 206114):
        assert confidences(bytes(64), n)["D64"] == 75
    for n in (174847, 174849, 0, 349696):
        assert "D64" not in confidences(bytes(64), n)
    whole = bytearray(174848)
    whole[0x16500:0x16502] = b"\x12\x01"
    assert confidences(bytes(whole))["D64"] == 92
    assert "D71" in confidences(bytes(64), 351062) and "D81" in confidences(bytes(64), 822400)


@pytest.mark.parametrize(("raw", "name", "conf"), [
    (b"GCR-1541" + bytes(24), "G64", 100), (b"GCR-1540" + bytes(24), "G64", None), (b"GCR-1541", "G64", None), (b"HXCPICFE" + bytes(504), "HFE", 95), (b"HXCHFEV3" + bytes(504), "HFE", 95), (b"HXCPICFF" + bytes(504), "HFE", None),
    (b"HXCPICFE" + bytes(56), "HFE", None), (b"\x96\x02" + bytes(30), "ATR", 95), (b"\x02\x96" + bytes(30), "ATR", None), (b"\x96\x02" + bytes(6), "ATR", None), (b"IMD " + bytes(28), "IMD", 95), (b"IMD1" + bytes(28), "IMD", None), (b"IMD", "IMD", None),
    (b"AT8X" + bytes(60), "ATX", 98), (b"X8TA" + bytes(60), "ATX", None), (b"AT8X" + bytes(12), "ATX", None), (b"CQ\x14" + bytes(29), "CQM", 60), (b"CQ\x00" + bytes(29), "CQM", None), (b"CQ", "CQM", None), (samples._copied(40), "CQM", 95)])
def test_signatures(raw, name, conf):
    assert confidences(raw).get(name) == conf


def test_a_track_table_must_be_reachable():
    n = 0x2B0 + 0x200
    head = bytearray(n)
    head[0x1C:0x20] = n.to_bytes(4, "little")
    head[0x20:0x22] = b"\xb0\x02"
    assert confidences(bytes(head))["D88"] == 95
    for change in ({0x20: 0, 0x21: 0}, {0x20: 0x10, 0x21: 0}, {0x1B: 0x77}, {0x1E: 0x10}, {0x24: 0xB0, 0x25: 0x02}):
        bad = bytearray(head)
        for at, b in change.items():
            bad[at] = b
        assert "D88" not in confidences(bytes(bad))


def test_a_big_endian_mark_inside_the_header():
    head = bytearray(128)
    head[82], head[0], head[0x43] = 1, 10, 0x10
    assert confidences(bytes(head))["DC42"] == 92
    for at, b in ((82, 0), (0, 200), (0x43, 0)):
        bad = bytearray(head)
        bad[at] = b
        assert "DC42" not in confidences(bytes(bad))


def test_lengths_of_whole_tracks():
    for tracks, ok in ((1, True), (35, True), (80, True), (41, False), (82, False)):
        assert ("JV1" in pr.by_length(tracks * 2560)) is ok
    assert "JV1" not in pr.by_length(2561) and pr.by_length(0) == set()
    assert "XFD" in pr.by_length(128 * 7) and "XFD" not in pr.by_length(266240 + 128)


def test_the_trie_equals_a_plain_comparison():
    rng = random.Random(1)
    data = [bytes(rng.choices(b"ABCD\x00\x10", k=100)) for _ in range(300)] + [w + bytes(80) for _, _, w, _ in pr.SIGNATURES]
    import numpy as np

    rows = np.array([list(d[:90].ljust(90, b"\0")) for d in data], np.uint8)
    for offset, trie in pr.TRIES.items():
        got = sorted(trie.run(rows[:, offset:]))
        want = sorted((r, n) for r, d in enumerate(data) for n, (_, o, w, _) in enumerate(pr.SIGNATURES) if o == offset and d[:90].ljust(90, b"\0")[o : o + len(w)] == w)
        assert got == want


def test_odd_files_never_fail(spark):
    rng = random.Random(2)
    raws = [b"", b"T", b"TD", None, bytes(512), rng.randbytes(700), rng.randbytes(65537)]
    raws += [w + rng.randbytes(rng.choice([0, 1, 9, 100, 800])) for _, o, w, _ in pr.SIGNATURES if o == 0 for _ in range(3)]
    raws += [samples.build(i, k, d)[: rng.randrange(1, 3000)] for i, k in enumerate(range(len(samples.KINDS))) for d in range(5) if samples.KINDS[k][1]]
    df = spark.createDataFrame([(f"f{i}", len(r or b""), bytearray(r) if r is not None else None) for i, r in enumerate(raws)], SCHEMA)
    c = pr.claims(df)
    assert c.where("path IN ('f0', 'f1', 'f3')").count() == 0
    assert pr.ranking(c).where("tied > claimants OR conf > 100").count() == 0
    assert pr.posteriors(df, pr.FIRST, pr.evidence_first).count() == pr.posteriors(df, pr.SECOND, pr.evidence_second).count() == len(raws)
    assert pr.claims(df.limit(0)).count() == 0


def test_ranking_of_ties_and_runners_up(spark):
    rows = [("a", "X", 2, 75), ("a", "Y", 1, 75), ("a", "Z", 3, 40), ("b", "X", 2, 95), ("b", "Y", 1, 40), ("b", "Z", 3, 40), ("c", "X", 1, 50)]
    got = {r["path"]: (r["winner"], r["conf"], r["claimants"], r["tied"], r["runner_up"]) for r in pr.ranking(spark.createDataFrame(rows, "path string, format string, reg int, conf int")).collect()}
    assert got == {"a": ("Y", 75, 3, 2, "Z"), "b": ("X", 95, 3, 1, "Y"), "c": ("X", 50, 1, 1, None)}


def test_files_of_a_folder_and_no_cross_join(spark, tmp_path):
    for i, (name, _, ext, _) in enumerate(samples.KINDS[:3] + samples.KINDS[12:16]):
        (tmp_path / f"{i}.{ext}").write_bytes(samples.build(i, [k[0] for k in samples.KINDS].index(name), 0))
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}")
    c = pr.claims(files.select("path", "length", "content"))
    plan = pr.ranking(c)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    won = {r["path"].rsplit("/", 1)[1]: r["winner"] for r in pr.ranking(c).collect()}
    assert won == {"0.d64": "D64", "1.d64": "D64", "2.d71": "D71", "3.scp": "SCP", "4.SCP": "SCP", "5.hfe": "HFE", "6.HFE": "HFE"}
    assert containers.files(spark, f"file://{tmp_path}").count() == 7


def test_sector_readers(spark):
    dump = samples.sector_dump(3, 2, 9, 512, (1, 2, 1, 5, 1, 0, 3))
    rows = disks.read_dump(dump)
    assert len(rows) == 54 and [r[5] for r in rows[:7]] == ["OK", "OK", "OK", "ERROR", "OK", "MISSING", "DELETED"] and rows[5][3] == -1
    assert dump[rows[0][3] : rows[0][3] + 3] == bytes([0, 1, 2]) and rows[9][:3] == (0, 1, 1)
    for cut in range(0, len(dump), 601):
        part = disks.read_dump(dump[:cut])
        assert part == rows[: len(part)]
    mapped = b"IMD x\x1a" + bytes([0, 5, 0xC1, 2, 1]) + b"\x07\x08" + b"\x50\x51" + b"\x00\x01" + b"\x02\xaa" + b"\x02\xbb"
    assert [r[:3] for r in disks.read_dump(mapped)] == [(0x50, 0, 7), (0x51, 1, 8)]
    errors = disks.read_zoned(samples.build(1, 1, 0))
    assert len(errors) == 683 and sum(r[5] == "ERROR" for r in errors) == sum(e != 1 for e in samples._ERRORS)
    assert errors[0][:4] == (1, 0, 0, 0) and errors[-1][:4] == (35, 0, 16, 256 * 682)
    assert len(disks.read_zoned(bytes(349696), 2)) == 1366 and disks.read_zoned(bytes(1000)) == []
    atr = disks.read_headed(samples.build(3, 17, 0)[:8] + b"\x00" * 8 + bytes(128 * 3 + 256))
    assert [r[4] for r in atr] == [128] * 5
    df = spark.createDataFrame([("a", "IMD", bytearray(dump)), ("b", "SCP", bytearray(b"SCP")), ("c", "D64", None)], "path string, format string, content binary")
    assert disks.sectors(df).groupBy("path").count().collect()[0]["count"] == 54


def test_boot_structures():
    block = samples.boot_block(880)
    total = 0
    for i in range(0, 1024, 4):
        total += int.from_bytes(block[i : i + 4], "big")
        total = (total & 0xFFFFFFFF) + (total >> 32)
    assert total == 0xFFFFFFFF and len(block) == 1024
    assert len(samples.boot_record(720, 9, 2, 2, 112, 0xFD, 2)) == 512
