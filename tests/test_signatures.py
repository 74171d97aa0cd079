"""The automaton over masked signatures against a plain comparison at every place."""

import random

import pytest

from lamina.operators import signatures as sg


def plain(buffers, table):
    out = []
    for b, raw in enumerate(buffers):
        for i, (p, m) in enumerate(table):
            for at in range(len(raw or b"") - len(p) + 1) if p else ():
                if all((raw[at + k] ^ p[k]) & m[k] == 0 for k in range(len(p))):
                    out.append((b, i, at))
    return sorted(out)


def found(buffers, table):
    return sorted(zip(*(x.tolist() for x in sg.Automaton(table).find(buffers)), strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_equals_a_plain_scan(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(sg, "PIECE", rng.choice([3, 7, 64]))
    monkeypatch.setattr(sg, "LANES", rng.choice([2, 50]))
    letters = bytes(rng.sample(range(256), rng.choice([2, 3, 6])))
    buffers = [bytes(rng.choices(letters, k=rng.choice([0, 1, 5, 63, 64, 65, 200]))) for _ in range(12)] + [None]
    table = []
    for _ in range(40):
        n = rng.randint(1, 9)
        p = bytes(rng.choices(letters, k=n))
        table.append((p, bytes(rng.choice([255, 255, 255, 0xF0, 0x0F, 0]) for _ in range(n))))
    table += [(b"", b""), table[0], (letters[:1] * 4, b"\xff" * 4), (letters[:1] * 4, b"\0" * 4)]
    assert found(buffers, table) == plain(buffers, table)


def test_overlaps_and_suffixes():
    table = [(w, b"\xff" * len(w)) for w in (b"he", b"she", b"his", b"hers", b"e", b"ushers", b"aa")]
    buffers = [b"ushers", b"aaaa", b"", b"xushershe"]
    assert found(buffers, table) == plain(buffers, table)


def test_scan_in_spark(spark, monkeypatch):
    rng = random.Random(9)
    buffers = [(i, bytearray(rng.choices(b"abc", k=rng.randint(0, 300)))) for i in range(60)] + [(99, None)]
    table = [(f"s{i}", bytearray(rng.choices(b"abc", k=rng.randint(1, 6))), rng.choice([None, bytearray(b"\xff\x00\xff\xff\xff\xff")])) for i in range(30)] + [("none", None, None)]
    b = spark.createDataFrame(buffers, "key long, content binary").repartition(3)
    t = spark.createDataFrame(table, "sig string, pattern binary, mask binary")
    pairs = [(bytes(p), bytes(m)[: len(p)].ljust(len(p), b"\xff") if m else b"\xff" * len(p)) for _, p, m in table[:-1]]
    want = plain([bytes(c) if c is not None else None for _, c in buffers], pairs)
    every = sorted((buffers[x][0], table[i][0], at) for x, i, at in want)
    got = sorted(map(tuple, sg.scan(b, t, first=False).collect()))
    assert got == every
    monkeypatch.setattr(sg, "BLOCK", 20)
    firsts = {}
    for k, s, at in every:
        firsts[k, s] = min(at, firsts.get((k, s), at))
    assert sorted(map(tuple, sg.scan(b, t).collect())) == sorted((k, s, at) for (k, s), at in firsts.items())
    assert sg.scan(b, t.limit(0)).count() == 0 and sg.scan(b.limit(0), t).count() == 0


def test_cost_does_not_follow_the_number_of_signatures():
    import time

    rng = random.Random(1)
    buffers = [bytes(rng.choices(range(97, 123), k=20_000)) for _ in range(20)]
    words = [bytes(rng.choices(range(97, 123), k=10)) for _ in range(1000)]
    took = []
    for n in (10, 1000):
        a = sg.Automaton([(w, b"\xff" * 10) for w in words[:n]])
        began = time.perf_counter()
        a.find(buffers)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]
