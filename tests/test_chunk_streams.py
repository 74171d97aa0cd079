"""Chunks of streams whose rows come in any order, twice, late, or not at all; restarts and idle timers."""

import random

from lamina.streaming import pipeline as pipe

CHUNK, OVERLAP = 10, 3


def expected(rows, tracks):
    """Chunks of each track's samples in the order of seq."""
    want = []
    for t in tracks:
        buf, start, pushed = [], 0, 0
        for _, seq, amp, kind in sorted((r for r in rows if r[0] == t), key=lambda r: (r[1], (1, 0, 2)[r[3]])):
            if kind == pipe.RESET:
                buf, start = [], pushed
            elif kind == pipe.FLUSH:
                if len(buf) >= 4:
                    want.append((t, start, len(buf), round(sum(buf) / len(buf), 6), True))
                buf, start = [], start + len(buf)
            else:
                buf.append(amp)
                pushed += 1
                if len(buf) == CHUNK:
                    want.append((t, start, CHUNK, round(sum(buf) / CHUNK, 6), False))
                    buf, start = buf[CHUNK - OVERLAP :], start + CHUNK - OVERLAP
    return sorted(want)


def write(spark, rows, path):
    spark.createDataFrame(rows, pipe.ROWS).coalesce(1).write.mode("append").parquet(path)


def run(spark, at, idle=None, seconds=None):
    stream = pipe.stateful(spark).readStream.schema(pipe.ROWS).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    pipe.drain(pipe.chunked(stream, CHUNK, OVERLAP, idle=idle), f"{at}/out", f"{at}/state", "update", seconds)
    return spark.read.parquet(f"{at}/out")


def chunks(out):
    return sorted((r["track"], r["start"], r["length"], round(r["mean"], 6), r["flushed"]) for r in out.where("length > 0").collect())


def status(out):
    last = {}
    for r in sorted(out.where("length = 0").collect(), key=lambda r: r["batch"]):
        last[r["track"]] = (r["pushed"], r["buffered"], r["waiting"], r["refused"])
    return last


def test_any_order_gives_the_chunks_of_the_right_order(spark, tmp_path):
    rng = random.Random(6)
    rows = [(t, i, float(rng.randrange(100)), pipe.DATA) for t, n in enumerate([0, 3, 57, 140]) for i in range(n)]
    rows += [(2, 20, 0.0, pipe.RESET), (3, 140, 0.0, pipe.FLUSH), (3, 31, 0.0, pipe.FLUSH), (1, 3, 0.0, pipe.FLUSH)]
    mixed = rows * 1
    rng.shuffle(mixed)
    at = f"file://{tmp_path}"
    for k in range(6):
        write(spark, mixed[k::6], f"{at}/in")
    out = run(spark, at)
    assert chunks(out) == expected(rows, range(4))
    assert status(out) == {1: (3, 0, 0, 0), 2: (57, (57 - 21 - CHUNK) % (CHUNK - OVERLAP) + OVERLAP, 0, 0), 3: (140, 0, 0, 0)}
    assert pipe.stateful(spark).conf.get("spark.sql.streaming.stateStore.providerClass") != spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_repeated_late_and_unplaced_rows_are_counted(spark, tmp_path):
    at = f"file://{tmp_path}"
    rows = [(1, i, float(i), pipe.DATA) for i in range(25)]
    write(spark, [*rows[:12], (1, None, 5.0, pipe.DATA), (1, -3, 5.0, pipe.DATA), rows[4]], f"{at}/in")
    first = run(spark, at)
    assert status(first) == {1: (12, 5, 0, 3)}
    write(spark, [rows[3], *rows[14:], (1, 10, 0.0, pipe.RESET), (1, 10, 0.0, pipe.RESET)], f"{at}/in")
    waits = status(run(spark, at))
    assert waits == {1: (12, 0, 11, 5)}  # the reset has been used once; 12 and 13 are missing
    write(spark, [rows[13], rows[12]], f"{at}/in")
    assert status(run(spark, at))[1][:3] == (25, (25 - 12 - CHUNK) % (CHUNK - OVERLAP) + OVERLAP, 0)


def test_a_restart_in_the_middle_gives_the_same_chunks(spark, tmp_path):
    rng = random.Random(3)
    rows = [(t, i, float(rng.randrange(100)), pipe.DATA) for t in range(4) for i in range(80)] + [(t, 80, 0.0, pipe.FLUSH) for t in range(4)]
    rng.shuffle(rows)
    whole, halves = f"file://{tmp_path}/whole", f"file://{tmp_path}/halves"
    for k in range(4):
        write(spark, rows[k::4], f"{whole}/in")
    for k in range(4):
        write(spark, rows[k::4], f"{halves}/in")
        again = run(spark, halves)  # a new query from the checkpoint each time
    assert chunks(run(spark, whole)) == chunks(again) == expected(rows, range(4))


def test_an_idle_track_is_flushed_by_its_timer(spark, tmp_path):
    at = f"file://{tmp_path}"
    write(spark, [(1, i, float(i), pipe.DATA) for i in [*range(14), 17, 18]], f"{at}/in")
    out = run(spark, at, idle=1500, seconds=15)
    assert [c[:3] for c in chunks(out)] == [(1, 0, 10), (1, 7, 9)] and status(out)[1] == (16, 0, 0, 0)


def test_a_table_replayed_in_files(spark, tmp_path):
    rng = random.Random(8)
    rows = [(t, i, float(rng.randrange(100)), pipe.DATA) for t in range(3) for i in range(rng.randrange(5, 200))]
    at = f"file://{tmp_path}"
    stream = pipe.chunked(pipe.replayed(spark.createDataFrame(rows, pipe.ROWS), f"{at}/in", 5, 2), CHUNK, OVERLAP)
    pipe.drain(stream, f"{at}/out", f"{at}/state", "update")
    ends = [(t, 1 + max(r[1] for r in rows if r[0] == t), 0.0, pipe.FLUSH) for t in range(3)]
    assert chunks(spark.read.parquet(f"{at}/out")) == expected(rows + ends, range(3))
