"""Archives written and read back; damaged ones are told apart."""

import random

from lamina.operators import archives as ar


def contents():
    rng = random.Random(1)
    words = [bytes(rng.choices(range(97, 110), k=rng.randint(1, 7))) for _ in range(40)]
    return [
        b"a", b"ab", b"aaa", b"abcabcabcabc" * 30, b" " * 500, bytes(range(256)) * 3, rng.randbytes(700), b" ".join(rng.choices(words, k=400)), b" ".join(rng.choices(words, k=3)),
        "Été où ça? naïve — 中文 ".encode() * 9, b"\0" * 100 + b"x" + b"\0" * 100]


def test_archives_come_back():
    every = contents()
    outcome, back = ar.unpack([ar.pack(c) for c in every])
    assert outcome == ["OK"] * len(every) and back == every
    assert len(ar.pack(b"abcabcabcabc" * 30)) < 60


def test_counts_are_halved_and_the_window_is_left(monkeypatch):
    monkeypatch.setattr(ar, "LIMIT", 400)
    rng = random.Random(2)
    every = [rng.randbytes(900), bytes(rng.choices(b"ab", k=3000)), b"start" + rng.randbytes(4200) + b"start"]
    assert ar.unpack([ar.pack(c) for c in every]) == (["OK"] * 3, every)


def test_damage_is_told_apart(spark):
    rng = random.Random(3)
    rows, want = [], []
    for i, c in enumerate(contents() * 3):
        a = ar.pack(c)
        kind = i % 5
        if kind == 1:
            a = a[: 8 + (len(a) - 8) // 2]
        elif kind == 2:
            k = 8 + (len(a) - 8) // 3
            a = a[:k] + bytes([a[k] ^ 1 << rng.randrange(8)]) + a[k + 1 :]
        elif kind == 3:
            a = b"\0" * 4 + a[4:]
        same = kind in (0, 4)
        rows.append((i, bytearray(a)))
        want.append("OK" if same else None)
    rows += [(1000, None), (1001, bytearray(b"")), (1002, bytearray(b"\x05\0\0\0")), (1003, bytearray(b"\xff" * 20))]
    got = {r["id"]: r for r in ar.unpacked(spark.createDataFrame(rows, "id long, archive binary")).collect()}
    for (i, _), w, c in zip(rows, want, contents() * 3, strict=False):
        if w == "OK":
            assert got[i]["outcome"] == "OK" and bytes(got[i]["content"]) == c
        elif i % 5 == 3:
            assert got[i]["outcome"] == "SIZE"
        else:
            assert got[i]["outcome"] in ("DAMAGED", "SIZE") or bytes(got[i]["content"]) == c
    assert got[1000]["outcome"] is None and [got[i]["outcome"] for i in (1001, 1002, 1003)] == ["SIZE"] * 3
