"""Tracks of cells, packed records and chunked streams against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import cells, octets
from lamina.operators import chains as ch
from lamina.operators import records as rec
from lamina.operators import tracks as tr
from lamina.sources.storage import stored
from lamina.streaming import pipeline as pipe


def sectors(encoding, seed):
    rng = np.random.default_rng(seed)
    size = tr.SIZES[encoding]
    special = [bytes(size), b"\xff" * size, bytes(range(256)) * (size // 256) if size >= 256 else bytes(range(size))]
    return [(t, s, (special[s] if s < 3 else rng.integers(0, 256, size, dtype=np.uint8).tobytes()).hex().upper()) for t in (3, 77) for s in range(6)]


@pytest.mark.parametrize("encoding", tr.ENCODINGS)
def test_each_encoding_comes_back_and_notices_damage(spark, encoding):
    rows = sectors(encoding, 1)
    df = spark.createDataFrame(rows, "track long, sector long, data string")
    cellsdf = tr.encode(df, encoding)
    got = tr.DECODERS[encoding](cellsdf).where("header_ok AND data_ok").collect()
    assert sorted((r["track"], r["sector"], r["data"]) for r in got) == sorted(rows)
    assert tr.DECODERS[encoding](cellsdf.limit(0)).count() == 0
    assert tr.DECODERS[encoding](spark.createDataFrame([(1, ""), (2, None), (3, "0101")], "track long, cells string")).count() == 0
    hurt = tr.DECODERS[encoding](tr.encode(df, encoding, F.when(F.col("sector") == 4, 700))).collect()
    assert not any(r["data_ok"] and r["header_ok"] and r["sector"] == 4 and (r["track"], 4, r["data"]) not in rows for r in hurt)
    again = tr.from_intervals(tr.intervals(cellsdf)).collect()
    whole = {r["track"]: r["cells"] for r in cellsdf.collect()}
    assert all(whole[r["track"]].startswith(r["cells"]) for r in again)


def test_six_bit_codes_are_64():
    assert len(cells.SIX) == 64 and cells.SIX[0] == 0x96 and cells.SIX[-1] == 0xFF and not {0xAA, 0xD5} & set(cells.SIX)


def _random_table(rng, n, bits):
    bad, end, most = ch.MARKS[bits]
    size = n + 2
    return [rng.choice([0, bad, end, most, 1, size + 3, *[rng.randrange(2, size) for _ in range(8)]]) for _ in range(n)]


def _plain_walk(t, start, bits):
    bad, end, _ = ch.MARKS[bits]
    chain, here = [], start
    while len(chain) <= len(t):
        chain.append(here)
        link = t[here]
        state = "END" if link >= end else "BAD" if link == bad else "FREE" if link == 0 else "RANGE" if link < 2 or link >= len(t) else None
        if state:
            return chain, state
        here = link
    return None, "LOOP"


@pytest.mark.parametrize("bits", [12, 16, 32])
def test_tables_walks_files_and_reach(spark, bits):
    rng = random.Random(bits)
    tables = {v: _random_table(rng, n, bits) for v, n in enumerate([1, 2, 3, 8, 40, 200, 999])}
    tables[7] = [*range(3, 402), ch.MARKS[bits][2]]  # one long chain
    tables[8] = [*range(3, 402), 2]  # one long loop
    df = spark.createDataFrame([(v, [0, 0, *t]) for v, t in tables.items()], "volume long, t array<long>")
    fat = rec.pack12(F.col("t")) if bits == 12 else ch.packed(F.col("t"), bits)
    volumes = df.select("volume", F.size("t").cast("long").alias("size"), fat.alias("fat")).repartition(3)
    want, order, reach = set(), set(), set()
    for v, t in tables.items():
        t = [0, 0, *t]
        linked = {x for k, x in enumerate(t) if k >= 2}
        for c in range(2, len(t)):
            chain, state = _plain_walk(t, c, bits)
            want.add((v, c, len(chain) if chain else None, state, c not in linked))
            if c not in linked:
                here = c
                for _ in t:
                    reach.add((v, here))
                    here = t[here]
                    if not 2 <= here < len(t) or here >= ch.MARKS[bits][0]:
                        break
                if state == "END":
                    order |= {(v, c, k, x) for k, x in enumerate(chain)}
    assert set(map(tuple, ch.walks(volumes, bits).collect())) == want
    assert set(map(tuple, ch.files(volumes, bits).collect())) == order
    assert set(map(tuple, ch.reached(volumes, bits).collect())) == reach
    links = df.select("volume", F.posexplode("t").alias("cluster", "link"), F.size("t").alias("size")).where("cluster >= 2").selectExpr("volume", "cast(cluster AS long) cluster", "link", "cast(size AS long) size")
    got = ch.linked_walks(links, lambda t: stored(t, "test"), bits)
    assert set(map(tuple, got.select("volume", "start", "clusters", "state").collect())) == {w[:4] for w in want}
    assert ch.linked_walks(links.limit(0), lambda t: stored(t, "test"), bits).count() == 0


def test_cut_and_null_tables(spark):
    df = spark.createDataFrame([(1, 5, "F0FFFF"), (2, 4, None), (3, 2, ""), (4, 3, "")], "volume long, size long, fat string")
    got = sorted(map(tuple, ch.walks(df, 12).collect()))
    assert got == [(1, 2, 1, "FREE", True), (1, 3, 1, "FREE", True), (1, 4, 1, "FREE", True), (4, 2, 1, "FREE", True)]


def test_chain_positions_and_paths(spark):
    rng = random.Random(3)
    ids = list(range(300))
    rng.shuffle(ids)
    links, want = [], []
    while ids:
        part = [ids.pop() for _ in range(min(len(ids), rng.randint(1, 40)))]
        links += list(zip(part, [*part[1:], None], strict=True))
        want += [(x, part[0], i) for i, x in enumerate(part)]
    links += [(1000, 1001), (1001, 1000)]  # a cycle has no head
    got = rec.chain_positions(spark.createDataFrame(links, "id long, next long"), lambda t: stored(t, "test"))
    assert sorted((r["id"], r["head"], r["pos"]) for r in got.collect()) == sorted(want)
    entries = spark.createDataFrame([(0, "A", 1), (1, "b", 2), (2, "c.txt", 3)], "parent long, name string, id long")
    paths = spark.createDataFrame([(1, "/a/B/C.TXT"), (2, "/a/x"), (3, "/"), (4, "a")], "path_id long, path string")
    assert sorted((r["path_id"], r["found"], r["depth"]) for r in rec.find_paths(entries, paths).collect()) == [(1, 3, 3), (2, None, 1), (3, 0, 0), (4, 1, 1)]


def test_octets(spark):
    r = spark.createDataFrame([("0102A0FF", ""), (None, None)], "a string, b string").select(
        octets.values(F.col("a")), octets.little(F.col("a"), 1, 2), octets.big(F.col("a"), 0, 4), octets.values(F.col("b")), octets.byte(F.col("b"), 0)).collect()
    assert tuple(r[0]) == ([1, 2, 160, 255], 0xA002, 0x0102A0FF, [], None)


def test_running_stats_with_nulls(spark, tmp_path):
    at = f"file://{tmp_path}"
    rows = [(1, 1.0), (1, None), (2, None), (3, 0.1), (3, 0.2), (3, 0.3)]
    spark.createDataFrame(rows, "track long, amp double").write.parquet(f"{at}/in")
    stream = spark.readStream.schema("track long, amp double").parquet(f"{at}/in")
    pipe.drain(pipe.running_stats(stream), f"{at}/out", f"{at}/state", "update")
    got = sorted(tuple(r)[:5] for r in spark.read.parquet(f"{at}/out").collect())
    assert got == [(1, 2, 1.0, 1.0, 1.0), (2, 1, None, None, None), (3, 3, math.fsum([0.1, 0.2, 0.3]) / 3, 0.1, 0.3)]
