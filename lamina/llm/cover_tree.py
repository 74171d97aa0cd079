"""Embedding near-dedup: exact pairs above a cosine, by cover trees and a dual traversal.

Vectors of one label and length are compared as points of the unit sphere, where a cosine of at least c is a distance of at
most sqrt(2 - 2c). A cover tree's levels halve their radius: a node's children are the centres of a net of its points, farther
apart than the level's radius, the node's own centre first, and each point lies with a centre within that radius. A node
also keeps its covering radius, the greatest distance from its centre to any of its points. The traversal holds two
nodes against each other: farther apart than both covering radii and the threshold, none of their pairs links; so close
that all pairs must, all are counted at once; else the children are held against each other, all centres in one
product, down to single points, whose cosines decide. Nodes are made when the traversal first enters them.

Equal vectors of a label are one point with a number of copies. Points are dealt to cells, the leaves of a cover tree of a bounded
sample (SAMPLE points in all; it decides where points go, never what is compared), and a cell to blocks of
about BLOCK points by a hash, so a label, cell or group of copies of any size is many blocks. Pairs of blocks whose cells' covering radii leave a link
possible are one task each; it returns at most one row a point: how many vectors it links, and one other point of its
component within the task. Links are never listed. Where a label's points have no near neighbours in common regions (random
directions in many dimensions), no bound can prune cells and the block pairs of that label grow with the square of its blocks;
inside them only centres meet.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components, a null label and a null vec_id link
with nothing, n_links 0; vectors of different lengths do not link; n_links counts rows other than the vector's own; rows that
repeat a vec_id are vectors of their own to n_links and one vertex to the components, so they share a component_id; a
null vec_id has a null component_id and is kept; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, stored
from .near_dedup import components

COSINE = 0.98
#: Points of a block: two blocks are what a task holds.
BLOCK = 4096
#: Points of the sample that the tree of cells is made of.
SAMPLE = 16_384
#: A cell with more children than this stays whole: its points have no regions to tell apart.
FAN = 64
#: Nodes of at most so many points are compared point by point.
LEAF = 32
#: Distances come from products of unit vectors; near zero they are off by up to 1e-7.
MARGIN = 1e-6
_ROWS = 1024


def units(x: np.ndarray) -> np.ndarray:
    """Rows of finite, non-zero vectors at length 1, in doubles."""
    x = x.astype(np.float64)
    with np.errstate(over="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))
    odd = ~(np.isfinite(norm) & (norm > 1e-150))
    if odd.any():
        x[odd] /= np.abs(x[odd]).max(axis=1, keepdims=True)
        norm[odd] = np.sqrt((x[odd] * x[odd]).sum(axis=1))
    return x / norm[:, None]


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances between unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def net(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres farther apart than radius, the first point among them; each point's nearest centre and its distance."""
    centres = np.zeros(1, np.int64)
    for at in range(0, len(x), 256):
        part = x[at : at + 256]
        far = np.flatnonzero(apart(part, x[centres]).min(axis=1) > radius)
        if len(far):
            near = apart(part[far], part[far]) <= radius
            new = []
            for i in range(len(far)):
                if not near[i, new].any():
                    new.append(i)
            centres = np.concatenate([centres, at + far[new]])
    owner, distance = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), _ROWS):
        d = apart(x[at : at + _ROWS], x[centres])
        owner[at : at + _ROWS] = d.argmin(axis=1)
        distance[at : at + _ROWS] = d.min(axis=1)
    owner[centres], distance[centres] = np.arange(len(centres)), 0.0
    return centres, owner, distance


class Node:
    """Points around a centre; its children, at half the level's radius or less, are made on demand."""

    def __init__(self, x: np.ndarray, members: np.ndarray, level: float, radius: float | None = None):
        self.x, self.members, self.level = x, members, level
        self.radius = float(apart(x[members], x[members[:1]]).max()) if radius is None else radius
        self._children = None

    @property
    def whole(self) -> bool:
        """No children: few points, or all at one place."""
        return len(self.members) <= LEAF or self.radius <= MARGIN

    def children(self) -> tuple[np.ndarray, np.ndarray, list[Node]]:
        """Centres, covering radii and nodes."""
        if self._children is None:
            level, mine = self.level / 2, self.x[self.members]
            while level >= self.radius:
                level /= 2
            centres, owner, distance = net(mine, level)
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(1, len(centres)))
            radii = np.maximum.reduceat(distance[order], np.concatenate([[0], cuts]))
            nodes = []
            for k, part in enumerate(np.split(order, cuts)):
                first = np.concatenate([[centres[k]], part[part != centres[k]]])
                nodes.append(Node(self.x, self.members[first], level, float(radii[k])))
            self._children = (mine[centres], radii, nodes)
        return self._children


class Links:
    """What a traversal finds: per point the vectors it links, and the component it is in."""

    def __init__(self, x: np.ndarray, copies: np.ndarray, cosine: float):
        self.x, self.copies, self.cosine = x, copies, cosine
        self.count = np.zeros(len(x), np.int64)
        self.up = np.arange(len(x))

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Put each i and j in one component: hook the greater root to the less, then jump to the roots."""
        while len(i):
            p, q = self.up[i], self.up[j]
            other = p != q
            i, j, p, q = i[other], j[other], p[other], q[other]
            np.minimum.at(self.up, np.maximum(p, q), np.minimum(p, q))
            while (self.up[self.up] != self.up).any():
                self.up = self.up[self.up]

    def all(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """All pairs of a and b link; same: a is b, and a point does not link itself."""
        if same:
            self.count[a] += self.copies[a].sum() - self.copies[a]
        else:
            self.count[a] += self.copies[b].sum()
            self.count[b] += self.copies[a].sum()
        whole = a if same else np.concatenate([a, b])
        self.join(whole[1:], np.broadcast_to(whole[:1], len(whole) - 1))

    def some(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """Those pairs of a and b whose cosine is high enough."""
        for at in range(0, len(a), _ROWS):
            near = self.x[a[at : at + _ROWS]] @ self.x[b].T >= self.cosine
            if same:
                near &= np.arange(len(b))[None, :] > np.arange(at, at + len(near))[:, None]
            i, j = np.nonzero(near)
            self.pairs(a[at + i], b[j])

    def pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.count, i, self.copies[j])
        np.add.at(self.count, j, self.copies[i])
        self.join(i, j)


def traverse(a: Node, b: Node, links: Links, reach: float) -> None:
    """All links between the points of a and of b; a is b for the links within a node."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        same = a is b
        d = 0.0 if same else float(apart(a.x[a.members[:1]], b.x[b.members[:1]])[0, 0])
        if d > a.radius + b.radius + reach + MARGIN:
            continue
        if (2 * a.radius if same else d + a.radius + b.radius) <= reach - MARGIN:
            links.all(a.members, b.members, same)
        elif a.whole and b.whole:
            links.some(a.members, b.members, same)
        else:
            (ca, ra, na), (cb, rb, nb) = (n.children() if not n.whole else (n.x[n.members[:1]], np.array([n.radius]), [n]) for n in (a, b))
            one_a, one_b = (np.array([n.members[0] if len(n.members) == 1 else -1 for n in ns]) for ns in (na, nb))
            for at in range(0, len(ca), _ROWS):
                gap = apart(ca[at : at + _ROWS], cb)
                near = gap <= ra[at : at + _ROWS, None] + rb[None, :] + (reach + MARGIN)
                if same:
                    near &= np.arange(len(cb))[None, :] >= np.arange(at, at + len(gap))[:, None]
                i, j = np.nonzero(near)
                single = (one_a[at + i] >= 0) & (one_b[j] >= 0)
                p, q = one_a[at + i[single]], one_b[j[single]]
                p, q = p[p != q], q[p != q]
                for s in range(0, len(p), 1 << 16):
                    u, v = p[s : s + (1 << 16)], q[s : s + (1 << 16)]
                    linked = np.einsum("ij,ij->i", links.x[u], links.x[v]) >= links.cosine
                    links.pairs(u[linked], v[linked])
                todo += [(na[at + k], nb[m]) for k, m in zip(i[~single].tolist(), j[~single].tolist(), strict=True)]


def points(table: DataFrame) -> DataFrame:
    """vec_id, grp (label and length), key (digest of grp and vector), raw (the vector's bytes); all but vec_id null for a
    vector that links with nothing."""
    wide = "double" in dict(table.dtypes)["embedding"]
    kind, width = (np.float64, 8) if wide else (np.float32, 4)

    def run(batches):
        for batch in batches:
            column, labels, ids = batch.column("embedding"), batch.column("label").to_pylist(), batch.column("vec_id")
            flat = column.flatten().cast(pa.float64() if wide else pa.float32()).to_numpy(zero_copy_only=False)
            size = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
            start = np.cumsum(size) - size
            grp, key, raw = ([None] * batch.num_rows for _ in range(3))
            missing = ids.is_null().to_pylist()
            for i in range(batch.num_rows):
                x = flat[start[i] : start[i] + size[i]]
                if labels[i] is not None and not missing[i] and len(x) and np.isfinite(x).all() and x.any():
                    grp[i], raw[i] = f"{labels[i]}|{len(x)}", x.astype(kind).tobytes()
                    key[i] = xxhash.xxh3_128_digest(grp[i].encode() + b"\0" + raw[i])
            yield pa.RecordBatch.from_arrays([ids, pa.array(grp, pa.string()), pa.array(key, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "grp", "key", "raw"])

    plain = table.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>" if wide else "array<float>"))
    return plain.mapInArrow(run, "vec_id long, grp string, key binary, raw binary"), width


def matrix(raw: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Unit vectors of equally long raw ones."""
    rows = raw.to_pylist()
    return units(np.frombuffer(b"".join(rows), np.float64 if width == 8 else np.float32).reshape(len(rows), -1))


def cells(x: np.ndarray, wanted: float) -> list[tuple[np.ndarray, list[int], int]]:
    """The tree of cells over a sample: per node its children's centres, their numbers, and -1 or a leaf's cell number.

    A node is cut while it stands for more than one block and its net has at most FAN centres; wanted: the blocks that
    a sampled point stands for."""
    nodes, todo, leaf = [None], [(0, Node(x, np.arange(len(x)), 2.0))], 0
    while todo:
        at, node = todo.pop()
        kids = node.children()[2] if len(node.members) * wanted > 1 and not node.whole else []
        if 1 < len(kids) <= FAN:
            numbers = list(range(len(nodes), len(nodes) + len(kids)))
            nodes += [None] * len(kids)
            nodes[at] = (x[[k.members[0] for k in kids]], numbers, -1)
            todo += zip(numbers, kids, strict=True)
        else:
            nodes[at] = (x[node.members[:1]], [], leaf)
            leaf += 1
    return nodes


def descend(nodes: list, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each point, the nearest child at every level, and the distance from that cell's centre."""
    cell, distance, todo = np.zeros(len(x), np.int32), np.zeros(len(x)), [(0, np.arange(len(x)))]
    while todo:
        at, mine = todo.pop()
        centres, numbers, leaf = nodes[at]
        if leaf >= 0:
            cell[mine], distance[mine] = leaf, apart(x[mine], centres)[:, 0] if len(mine) else 0
            continue
        near = apart(x[mine], centres).argmin(axis=1)
        todo += [(n, mine[near == k]) for k, n in enumerate(numbers) if (near == k).any()]
    return cell, distance


def placed(reps: DataFrame, trees: dict[str, list], width: int) -> DataFrame:
    """node, grp, copies, raw with cell and distance to the cell's centre (0, 0 in a label without a tree)."""

    def run(batches):
        for batch in batches:
            grp = np.array(batch.column("grp").to_pylist(), object)
            cell, distance = np.zeros(len(grp), np.int32), np.zeros(len(grp))
            for g in set(grp.tolist()) & trees.keys():
                at = np.flatnonzero(grp == g)
                cell[at], distance[at] = descend(trees[g], matrix(batch.column("raw").take(pa.array(at)), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(distance)], names=[*batch.schema.names, "cell", "distance"])

    return reps.mapInArrow(run, "node long, grp string, copies long, raw binary, cell int, distance double")


def block_pairs(rows: DataFrame, trees: dict[str, list], reach: float) -> DataFrame:
    """(grp, ca, pa, cb, pb): pairs of blocks, part p of cell c, among whose points a link is possible. A row of its input is a cell."""
    table = rows.groupBy("grp", "cell").agg(F.max("distance").alias("radius"), F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    side = lambda s: table.select("grp", *[F.col(c).alias(f"{c}_{s}") for c in ("cell", "radius", "parts")])
    both = side("a").join(side("b"), "grp").where("cell_a <= cell_b")
    centres = {g: np.concatenate([c for c, _, leaf in nodes if leaf >= 0]) for g, nodes in trees.items()}

    def run(batches):
        for batch in batches:
            g, a, b, ra, rb = (batch.column(c).to_pylist() for c in ("grp", "cell_a", "cell_b", "radius_a", "radius_b"))
            keep = [x == y or float(np.linalg.norm(centres[k][x] - centres[k][y])) <= p + q + reach + MARGIN for k, x, y, p, q in zip(g, a, b, ra, rb, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    near = both.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in both.dtypes))
    parts = near.select("grp", F.col("cell_a").alias("ca"), F.col("cell_b").alias("cb"), "parts_b", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1)).alias("pa"))
    return parts.select("grp", "ca", "pa", "cb", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)).alias("pb")).where("ca < cb OR pa <= pb")


def found(rows: DataFrame, pairs: DataFrame, width: int, cosine: float, reach: float) -> DataFrame:
    """node, links (vectors of other points linked), root (null or another node of its component) from each pair of blocks."""
    pair = ["grp", "ca", "pa", "cb", "pb"]
    one = F.struct(F.col("ca").alias("cell"), F.col("pa").alias("part"), F.lit(0).alias("side"))
    two = F.struct(F.col("cb").alias("cell"), F.col("pb").alias("part"), F.lit(1).alias("side"))
    dealt = pairs.select(*pair, F.explode(F.when((F.col("ca") == F.col("cb")) & (F.col("pa") == F.col("pb")), F.array(one)).otherwise(F.array(one, two))).alias("s")).select(*pair, "s.*")
    sizes = rows.groupBy("grp", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    cut = rows.join(broadcast_if_small(stored(sizes, "cells")), ["grp", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def run(group: pa.Table) -> pa.Table:
        side = group["side"].to_numpy()
        order = np.argsort(side, kind="stable")
        nodes, first = group["node"].to_numpy()[order], int((side == 0).sum())
        links = Links(matrix(group["raw"], width)[order], group["copies"].to_numpy()[order], cosine)
        if first == len(order):
            root = Node(links.x, np.arange(first), 2.0)
            traverse(root, root, links, reach)
        elif first:
            traverse(Node(links.x, np.arange(first), 2.0), Node(links.x, np.arange(first, len(order)), 2.0), links, reach)
        some = np.flatnonzero(links.count)
        return pa.table({"node": nodes[some], "links": links.count[some], "root": nodes[links.up[some]]})

    given = cut.join(dealt, ["grp", "cell", "part"]).select(*pair, "side", "node", "copies", "raw")
    return given.groupBy(*pair).applyInArrow(run, "node long, links long, root long")


def near_vectors(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, label, embedding)."""
    reach = math.sqrt(2 - 2 * cosine)
    parsed, width = points(table)
    parsed = stored(parsed, "points")
    valid = parsed.where("key IS NOT NULL")
    alike = valid.groupBy("key").agg(F.first("grp").alias("grp"), F.first("raw").alias("raw"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    reps = stored(alike.select(F.monotonically_increasing_id().alias("node"), "*"), "reps")
    trees = cell_trees(reps, width)
    rows = stored(placed(reps.select("node", "grp", "copies", "raw"), trees, width), "placed")
    pairs = stored(block_pairs(rows, trees, reach), "block-pairs")
    links = stored(found(rows, pairs, width, cosine, reach), "links")
    discard(rows, pairs)
    ids = reps.select("key", "node")
    edges = links.where("root <> node").select(F.col("root").alias("a"), F.col("node").alias("b"))
    # Rows of one vec_id are one vertex: their points are joined.
    repeated = stored(valid.groupBy("vec_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("vec_id"), "repeated")
    again = not repeated.isEmpty()
    if again:
        many = valid.join(repeated, "vec_id").join(ids, "key").select("vec_id", "node")
        edges = edges.union(many.join(many.groupBy("vec_id").agg(F.min("node").alias("a")), "vec_id").select("a", F.col("node").alias("b")).where("a <> b"))
    comp = components(edges, "vector-components")
    labelled = reps.select("key", "node", "copies", "least").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sums = links.groupBy("node").agg(F.sum("links").alias("links"))
    least = labelled.groupBy("comp").agg(F.min("least").alias("component_id"))
    known = labelled.join(sums, "node", "left").join(least, "comp").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    got = parsed.select("vec_id", "key").join(known, "key", "left")
    if parsed.where("key IS NULL AND vec_id IS NOT NULL").isEmpty():
        component = F.coalesce("component_id", "vec_id")
    else:
        # A row that links with nothing may share its vec_id with one that does.
        other = got.where("key IS NOT NULL").groupBy("vec_id").agg(F.min("component_id").alias("shared"))
        got = got.join(other, "vec_id", "left")
        component = F.coalesce("component_id", "shared", "vec_id")
    discard(repeated)
    return got.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def cell_trees(reps: DataFrame, width: int) -> dict[str, list]:
    """A tree of cells for each label with more than a block of points, of at most SAMPLE points in all."""
    large = reps.groupBy("grp").count().where(F.col("count") > BLOCK)
    total = large.agg(F.sum("count")).first()[0] or 0
    if not total:
        return {}
    share = min(1.0, SAMPLE / 2 / total)
    drawn = reps.join(large.select("grp"), "grp", "left_semi").where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))
    held: dict[str, list[bytes]] = {}
    for row in drawn.select("grp", "raw").limit(SAMPLE).toLocalIterator():
        held.setdefault(row["grp"], []).append(bytes(row["raw"]))
    return {g: cells(matrix(pa.array(sorted(raw)), width), 1 / (share * BLOCK)) for g, raw in held.items()}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
