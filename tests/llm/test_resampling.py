import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from lamina.llm import resampling as rs

from .conftest import DOC_SCHEMA, odd_rows, words


def features(text):
    ws = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return len(ws), [zlib.crc32(b" ".join(ws[i : i + n])) % 10_000 for n in (1, 2) for i in range(len(ws) - n + 1)]


def brute(rows, items):
    """Every document's row by the definition."""
    s, t = Counter(), Counter()
    for _, text, *_ in rows:
        s.update(features(text)[1])
    for text in items:
        t.update(features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    out = []
    for doc, text, *_ in rows:
        n, f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = i + 1
    return sorted(str(tuple(r[:5])) for r in out)


def result(docs, bench):
    return sorted(str(tuple(r)) for r in rs.resample(docs, bench).select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_matches_the_definition_on_the_table(spark, docs, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert result(docs, bench) == brute(rows, [r["text"] for r in bench.collect()])


def test_odd_rows(spark, odd_extra, empty):
    rng = random.Random(2)
    bench = spark.createDataFrame([(1, words(rng, 40)), (None, None), (3, ""), (4, words(rng, 30))], "item_id long, text string")
    assert result(odd_extra, bench) == brute(odd_rows(), [r["text"] for r in bench.collect()])
    assert result(empty, bench) == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert result(odd_extra, none) == brute(odd_rows(), [])


def test_ties_and_many_ranges_give_one_sequence_of_ranks(spark):
    rng = random.Random(7)
    rows = [(i // 3, words(rng, 22) if i % 3 else "same " * 25, "en", "s", 1) for i in range(400)]
    df = spark.createDataFrame(rows, DOC_SCHEMA).repartition(9)
    assert result(df, df.limit(0)) == brute(rows, [])


def test_a_long_text_is_cut_anywhere(monkeypatch):
    text = words(random.Random(1), 3000).encode() + b" \xc3\xa9t\xc3\xa9, x"
    n, whole = rs.buckets(text)
    monkeypatch.setattr(rs, "PIECE", 17)
    m, cut = rs.buckets(text)
    assert n == m == 3002 and np.array_equal(np.sort(whole), np.sort(cut)) and len(whole) == 2 * n - 1


def test_runs_merge_to_counts():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 50, 1000).astype(np.uint16) for _ in range(5)]
    values, n = rs.merged([rs.run_lengths(np.sort(p)) for p in parts])
    want = np.bincount(np.concatenate(parts))
    assert np.array_equal(want[values], n) and n.sum() == 5000
