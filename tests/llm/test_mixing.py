import itertools
import re
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from lamina.llm import mixing

from .conftest import odd_rows


def test_targets_share_by_weight_with_a_ceiling():
    got = mixing.targets([("a", 100), ("b", 1000), (None, 500)])
    assert got["a"] == 200  # 5/8 of 2400 is above twice its words
    assert abs(sum(got.values()) - 2400) < 1e-6
    assert abs(got["b"] - 2 * got[None]) < 1e-6 and got[None] <= 1000 and got["b"] <= 2000
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0}


def slow_targets(words):
    """Targets in exact fractions: water filling by weight below twice each source's words."""
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed, left = {}, Fraction(3, 2) * sum(words.values())
    while True:
        free = [s for s in order if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * words[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = Fraction(2 * words[s])
            left -= fixed[s]


def check_rows(rows, got):
    """Every column of the mixture against a plain computation; taken is one of the two whole multiples around the rate."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    words: dict = {}
    for _, text, _, source, _ in rows:
        words[source] = words.get(source, 0) + size(text)
    goal = slow_targets(words)
    want = sorted((str(doc), size(text), words[source], round(float(goal[source]), 6)) for doc, text, _, source, _ in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6)) for r in got) == want
    for r in got:
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["taken"] in {r["size"] * int(rate), r["size"] * (int(rate) + (rate > int(rate)))}


def test_rows_equal_a_plain_computation(docs, odd):
    for df in (docs, odd):
        check_rows([tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()], mixing.mixture(df).collect())


def test_flight_stays_in_the_null_space_of_both_constraints():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 7, 200):
        prob, size = rng.random(n), rng.integers(0, 50, n)
        p = mixing.flight(prob, size, rng.random(n + 4))
        assert ((p >= 0) & (p <= 1)).all() and ((p > 0) & (p < 1)).sum() <= 2
        assert abs(p.sum() - prob.sum()) < 1e-6 and abs(p @ size - prob @ size) < 1e-4


def test_inclusion_probabilities_are_kept_on_average():
    rng = np.random.default_rng(6)
    prob, size = np.array([0.2, 0.5, 0.7, 0.4, 0.9]), np.array([3, 9, 4, 7, 5])
    mean = np.mean([mixing.flight(prob, size, rng.random(9)) for _ in range(4000)], axis=0)
    assert np.abs(mean - prob).max() < 0.03


def test_landing_is_the_best_rounding():
    rng = np.random.default_rng(7)
    for n in range(5):
        prob, size = rng.random(n), rng.integers(1, 30, n)
        best = min((abs(float(np.dot(size, np.array(r) - prob))) for r in itertools.product((0, 1), repeat=n)), default=0)
        assert abs(abs(float(size @ (mixing.landing(prob, size) - prob))) - best) < 1e-9


def test_names_of_the_caller_come_back(spark, docs):
    names = ["key", "mate", "src", "doc", "copies", "__key", "__row", "__source", "__copies", "__mate", "col"]
    mixed = mixing.mix(docs.select("*", *[F.lit("x").alias(n) for n in names]))
    assert mixed.columns == [*docs.columns, *names]
    assert mixed.where(" OR ".join(f"`{n}` <> 'x'" for n in names)).isEmpty() and mixed.select("doc_id").distinct().count() > 1


def test_sources_come_near_their_targets(docs):
    got = mixing.mixture(docs)
    rows = got.groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.sum("size").alias("s"), F.max("size").alias("m")).collect()
    for r in rows:
        assert abs(r["t"] - r["target"]) <= max(r["m"], 0.02 * r["target"]), r
    assert got.where("taken > 2 * size").count() == 0 and got.count() == docs.count()


def test_blocks_and_reruns_agree(docs, monkeypatch):
    one = sorted(map(tuple, mixing.mixture(docs).collect()))
    assert one == sorted(map(tuple, mixing.mixture(docs.repartition(7)).collect()))
    monkeypatch.setattr(mixing, "BLOCK", 4)
    many = mixing.mixture(docs)
    for r in many.groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.max("size").alias("m")).collect():
        assert abs(r["t"] - r["target"]) <= 2 * r["m"], r


def test_balance_keeps_the_count(docs):
    got = mixing.copies(mixing.sized(docs))
    for r in got.groupBy("source").agg(F.sum("copies").alias("c"), F.count("*").alias("n"), F.first(F.col("target") / F.col("source_size")).alias("r")).collect():
        assert abs(r["c"] - r["n"] * r["r"]) <= 2.5


def test_odd_rows(odd_extra, empty):
    got = mixing.mixture(odd_extra).collect()
    sizes = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in odd_rows())
    assert sorted(r["size"] for r in got) == sizes
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mixture(empty).count() == 0 and mixing.mix(empty).count() == 0
    mixed = mixing.mix(odd_extra)
    assert mixed.columns == odd_extra.columns
    taken = sum(r["taken"] for r in got)
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in mixed.collect()) == taken
