import random
import re

import numpy as np

from lamina.llm import near_dedup as nd

from .conftest import DOC_SCHEMA, words


def brute(rows):
    """component and set size by comparing every pair of texts."""
    sets = []
    for doc, text, *_ in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    up = {doc: doc for doc, *_ in rows if doc is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, *_) in enumerate(rows):
        for j, (b, *_) in enumerate(rows[:i]):
            if a is not None and b is not None and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    p, q = root(a), root(b)
                    up[max(p, q)] = min(p, q)
    return sorted((str(d), len(s), str(root(d)) if d is not None else "None") for (d, *_), s in zip(rows, sets, strict=True))


def result(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in nd.near_dedup(df).collect())


def test_matches_brute_force_on_the_table(spark, docs):
    rows = [tuple(r) for r in docs.collect()]
    assert result(docs) == brute(rows)


def test_chains_and_groups(spark):
    rng = random.Random(3)
    rows = []
    for g in range(4):
        base = words(rng, 120).split()
        for i in range(25):
            ws = list(base)
            for _ in range(rng.randint(0, 4)):
                ws[rng.randrange(len(ws))] = f"w{g}x{i}"
            rows.append((len(rows), " ".join(ws), "en", "s", 1))
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    assert result(df) == brute(rows)


def test_a_blocked_bucket_gives_the_same(spark, monkeypatch):
    rng = random.Random(4)
    base = words(rng, 60).split()
    rows = [(i, " ".join([*base[: 60 - i % 30], *[f"t{i}"] * (i % 30)]), "en", "s", 1) for i in range(40)]
    monkeypatch.setattr(nd, "BLOCK", 200)
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    assert result(df) == brute(rows)


def test_odd_rows(odd_extra, empty):
    from .conftest import odd_rows

    assert result(odd_extra) == brute(odd_rows())
    assert nd.near_dedup(empty).count() == 0
    kept = nd.keep_one(odd_extra)
    assert kept.columns == odd_extra.columns
    assert 7 not in [r["doc_id"] for r in kept.collect()]


def _sets(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def brute_rows(rows, percent):
    """Rows that stay when texts, not doc_ids, are grouped: the smallest doc_id of each component of sets."""
    sets = {}
    for doc, text, *_ in rows:
        if doc is not None and _sets(text):
            sets[_sets(text)] = min(doc, sets.get(_sets(text), doc))
    up = {s: s for s in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                up[root(a)] = root(b)
    least = {}
    for s in sets:
        least[root(s)] = min(least.get(root(s), 2**70), sets[s])
    return sorted(str((d, t)) for d, t, *_ in rows if d is None or not _sets(t) or d == least[root(_sets(t))])


def test_a_repeated_doc_id_loses_no_text(spark):
    rng = random.Random(8)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(1, a), (5, a), (5, b), (9, b)]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOC_SCHEMA)
    assert result(df) == brute(rows)
    assert sorted((r["doc_id"], r["text"]) for r in nd.keep_one(df, 80).collect()) == [(1, a), (5, b)]


def test_random_tables_with_repeated_doc_ids(spark):
    for seed in range(3):
        rng = random.Random(seed)
        bases = [words(rng, 50).split() for _ in range(8)]
        rows = []
        for _ in range(90):
            ws = list(rng.choice(bases))
            for _ in range(rng.randint(0, 2)):
                ws[rng.randrange(len(ws))] = rng.choice("uvwxyz")
            rows.append((rng.choice([None, *range(30), -(2**40), 2**62 + 5 if seed == 2 else 31]), rng.choice([" ".join(ws), " ".join(ws), None, ""]), "en", "s", 1))
        df = spark.createDataFrame(rows, DOC_SCHEMA)
        assert result(df) == brute(rows)
        kept = sorted(str((r["doc_id"], r["text"])) for r in nd.keep_one(df, 80).collect())
        # Of several sets of one component that share the smallest doc_id one stays; all others of brute_rows do.
        want = brute_rows(rows, 80)
        assert set(kept) <= set(want)
        comps = {c for c in _components(rows, 80).values()}
        assert {_components(rows, 80)[_sets(t)] for d, t in map(eval, kept) if d is not None and _sets(t)} == comps


def _components(rows, percent):
    sets = list({_sets(t) for d, t, *_ in rows if d is not None and _sets(t)})
    comp = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    return dict(zip(sets, comp, strict=True))


def test_pigeonhole_keys_meet_within_distance():
    rng = np.random.default_rng(0)
    sig = rng.integers(0, 65536, (200, nd.POSITIONS)).astype(np.uint16)
    other = sig.copy()
    for row in other:
        row[rng.choice(nd.POSITIONS, nd.DISTANCE, replace=False)] ^= 1
    assert (nd._keys(sig) == nd._keys(other)).any(axis=1).all()
