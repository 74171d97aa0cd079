import numpy as np
import pytest

from lamina.llm import cover_tree as ct

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, cosine=0.98):
    """n_links and component_id by comparing every pair of rows."""
    n = len(rows)
    vectors = [None if e is None or not len(e) or label is None or i is None or any(v is None or not np.isfinite(v) for v in e) or not any(e) else np.array(e, np.float64) for i, label, e, *_ in rows]
    up = {i: i for i, *_ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            x, y = vectors[i], vectors[j]
            if x is not None and y is not None and rows[i][1] == rows[j][1] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i] += 1
                links[j] += 1
                p, q = root(rows[i][0]), root(rows[j][0])
                up[max(p, q)] = min(p, q)
    return sorted(str((r[0], k, None if r[0] is None else root(r[0]), r[0] is None or root(r[0]) == r[0])) for r, k in zip(rows, links, strict=True))


def result(df):
    return sorted(str(tuple(r)) for r in ct.near_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect())


def clusters(rng, n, dim=16, spread=(0.02, 0.2)):
    """Chains, groups of near copies and of copies, and random directions."""
    rows, base = [], rng.normal(size=(6, dim))
    for i in range(n):
        kind = i % 4
        if kind == 0:
            e = rng.normal(size=dim)
        elif kind == 1:
            e = base[rng.integers(3)] + rng.normal(size=dim) * spread[0] * rng.random() * 10
        elif kind == 2:
            e = base[3] + base[4] * (i / n)
        else:
            e = np.round(base[5] + rng.normal(size=dim) * spread[1], 1)
        rows.append((i * 7 % n, int(rng.integers(3)) if kind else 1, [float(np.float32(v)) for v in e]))
    return rows


@pytest.mark.parametrize("dim", [2, 16])
def test_matches_brute_force(spark, dim):
    rows = clusters(np.random.default_rng(dim), 300, dim)
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_many_blocks_and_cells_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(ct, "BLOCK", 20)
    monkeypatch.setattr(ct, "SAMPLE", 200)
    rows = clusters(np.random.default_rng(9), 320, 3)
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_odd_rows(spark):
    nan, inf, e = float("nan"), float("inf"), [1.0, 2.0, 3.0]
    rows = [
        (1, 1, None), (2, 1, []), (3, 1, [0.0, 0.0, 0.0]), (4, 1, [1.0, None, 3.0]), (5, 1, [nan, 1.0, 1.0]), (6, 1, [inf, 1.0, 1.0]), (7, None, e), (None, 1, e), (8, 1, e),
        (9, 1, [2.0, 4.0, 6.0]), (9, 1, [2.0, 4.0, 6.0]), (10, 2, e), (11, 1, [1.0, 2.0, 3.0, 0.0]), (12, 1, [3e38, 3e38, 3e38]), (13, 1, [1e-30, 1e-30, 1e-30]), (14, 1, [-1.0, -2.0, -3.0]),
        (20, 1, [9.0, 1.0, 0.0]), (20, 1, [0.0, 0.0, 5.0]), (20, 1, None), (21, 1, [0.0, 0.0, 6.0]), (19, 1, [9.0, 1.01, 0.0]), (15, 1, [-0.0, 0.0, 5.0]), (None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = df.selectExpr("*", *[f"'x' AS {c}" for c in ("node", "grp", "key", "raw", "cell", "part", "side", "copies", "links", "root", "comp", "component_id")])
    assert result(extra) == brute(rows)
    assert result(df.limit(0)) == []
    wide = [(1, 1, [1e200, 1e200]), (2, 1, [1e-200, 1e-200]), (3, 1, [1.0, -1.0])]
    got = result(spark.createDataFrame(wide, "vec_id long, label int, embedding array<double>"))
    assert got == sorted(map(str, [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]))


def test_the_traversal_prunes_and_counts_whole_nodes(monkeypatch):
    rng = np.random.default_rng(3)
    x = ct.units(np.concatenate([rng.normal(size=(1, 8)) + rng.normal(size=(400, 8)) * 0.01 for _ in range(5)]))
    links = ct.Links(x, np.ones(len(x), np.int64), 0.98)
    compared = []
    monkeypatch.setattr(ct.Links, "pairs", lambda self, i, j: compared.append(len(i)))
    root = ct.Node(x, np.arange(len(x)), 2.0)
    ct.traverse(root, root, links, np.sqrt(0.04))
    assert sum(compared) < 1000
    near = x @ x.T >= 0.98
    assert np.array_equal(links.count, near.sum(axis=1) - 1)


def test_nodes_cover_their_points():
    rng = np.random.default_rng(4)
    x = ct.units(rng.normal(size=(500, 3)))
    todo = [ct.Node(x, np.arange(500), 2.0)]
    while todo:
        node = todo.pop()
        if node.whole:
            continue
        centres, radii, nodes = node.children()
        d = ct.apart(centres, centres) + 9 * np.eye(len(centres))
        assert d.min() > nodes[0].level and np.array_equal(centres[0], x[node.members[0]]) and sum(len(k.members) for k in nodes) == len(node.members)
        for c, r, k in zip(centres, radii, nodes, strict=True):
            assert ct.apart(x[k.members], c[None]).max() <= r + 1e-7 and r <= k.level
        todo += nodes
