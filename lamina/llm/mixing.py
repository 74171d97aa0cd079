"""Mixing sources to target weights with cube-method balanced sampling.

Sources, by code point with null last, weigh 5, 2, 1, 5, 2, 1, ...; together they are to give RATIO
times all words. A target stops at LIMIT times its source's words and the excess goes to the others by
weight, until none is above. A source that gives r times its words takes each of its documents floor(r)
times, and once more for a sample in which every document has the inclusion probability r - floor(r).

The sample is balanced on the number of documents and the number of words. The flight phase moves the
probabilities of a few documents at a time along the null space of the two constraints until one of
them is 0 or 1; it runs in blocks of a source (about BLOCK documents, dealt by a hash, so a hot source is
many blocks), the few that a block leaves undecided meet in the next round's blocks, and the last few of a
source are the landing problem, solved by trying every rounding. All choices come from hashes of the
rows and a seed, so reruns agree.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source is a source of its own;
rows equal in source, doc_id and text are one unit
of the sample and get equal values, other rows that repeat a doc_id are separate documents; a source without words has target 0 where it has no
words to give; an empty table gives an empty result; other columns are carried only by mix()."""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

WEIGHTS = (5.0, 2.0, 1.0)
RATIO = 1.5
LIMIT = 2.0
BLOCK = 8192
SEED = 11
_COLS = ["source", "key", "doc_id", "size", "mult", "base", "prob"]
_UNITS = "source string, key long, doc_id long, size long, mult long, base long, prob double, blocks int"


def targets(sizes: list[tuple[str | None, int]], ratio: float = RATIO, limit: float = LIMIT) -> dict[str | None, float]:
    """Target words of each source from its words, by weight with a ceiling."""
    order = sorted((s for s, _ in sizes), key=lambda s: (s is None, s or ""))
    words = dict(sizes)
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = ratio * sum(words.values()), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] > limit * words[s]]
        if not over:
            out |= share
            break
        for s in over:
            out[s] = limit * words[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def flight(prob: np.ndarray, size: np.ndarray, dice: np.ndarray) -> np.ndarray:
    """Move probabilities along the null space of (count, words) until at most two are fractional."""
    p = prob.astype(float).copy()
    eps = 1e-9
    pool = [i for i in range(len(p)) if eps < p[i] < 1 - eps]
    at = 3
    act = pool[:3]
    while len(act) == 3:
        i, j, k = act
        u = np.array([size[k] - size[j], size[i] - size[k], size[j] - size[i]], float)
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])
        x = np.array([p[i], p[j], p[k]])
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > 0, (1 - x) / u, np.where(u < 0, -x / u, np.inf)))
            down = np.min(np.where(u > 0, x / u, np.where(u < 0, (x - 1) / u, np.inf)))
        step = up if dice[at % len(dice)] * (up + down) < down else -down
        x = x + step * u
        x[x < eps] = 0.0
        x[x > 1 - eps] = 1.0
        p[i], p[j], p[k] = x
        act = [m for m in act if 0 < p[m] < 1]
        while len(act) < 3 and at < len(pool):
            act.append(pool[at])
            at += 1
        if len(act) < 3:
            break
    return p


def landing(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The rounding of a few probabilities that stays closest to their words, then to their number."""
    best = min(itertools.product((0.0, 1.0), repeat=len(prob)),
               key=lambda r: (abs(float(np.dot(size, np.array(r) - prob))), abs(sum(r) - prob.sum()), r)) if len(prob) else ()
    return np.array(best, float)


def _step(last: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.select([*_COLS, "blocks"])
        t = table.to_pandas().sort_values(["key", "doc_id", "size"], kind="stable", na_position="last")
        prob, size = t["prob"].to_numpy(), (t["size"] * t["mult"]).to_numpy()
        dice = np.random.default_rng([SEED, int(t["key"].iloc[0]) & (2**63 - 1), len(t)]).random(len(t) + 4)
        p = flight(prob, size, dice)
        if last:
            frac = np.flatnonzero((p > 0) & (p < 1))
            p[frac] = landing(p[frac], size[frac])
        t["prob"] = p
        return pa.Table.from_pandas(t, schema=table.schema, preserve_index=False)

    return run


def sized(docs: DataFrame) -> DataFrame:
    """source, key (hash of doc_id and text), doc_id, size in words, mult (rows that are equal in these)."""
    size = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select("source", F.xxhash64(F.lit(SEED), "doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"))
    return rows.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("mult"))


def copies(units: DataFrame) -> DataFrame:
    """The units that sized() gives, with source_size, target and copies."""
    base = stored(units, "units")
    sums = base.groupBy("source").agg(F.sum(F.col("size") * F.col("mult")).alias("words"), F.count("*").alias("n")).collect()  # a row a source
    goal = targets([(r["source"], r["words"]) for r in sums])
    count = {r["source"]: max(1, -(-r["n"] // BLOCK)) for r in sums}
    plan = base.sparkSession.createDataFrame(
        [(r["source"], r["words"], float(goal[r["source"]]), count[r["source"]]) for r in sums], "src string, source_size long, target double, blocks int")
    mine = F.col("source").eqNullSafe(F.col("src"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    live = base.join(plan, mine).withColumn("base", F.floor(rate)).withColumn("prob", rate - F.floor(rate)).select(*_COLS, "blocks")
    done, level = [], 0
    while True:
        last = max(count.values(), default=1) == 1
        dealt = live.withColumn("blk", F.pmod(F.xxhash64("key", F.lit(level)), F.col("blocks")))
        moved = stored(dealt.groupBy("source", "blk").applyInArrow(_step(last), _UNITS), "flight")
        settled = (F.col("prob") <= 0) | (F.col("prob") >= 1)
        done.append(moved.where(settled).select(*_COLS))
        if last:
            break
        # A block leaves at most two undecided, so the next round needs fewer blocks.
        count = {s: max(1, -(-2 * b // BLOCK)) for s, b in count.items()}
        live = moved.where(~settled).withColumn("blocks", F.greatest(F.lit(1), F.ceil(2 * F.col("blocks") / BLOCK)).cast("int"))
        level += 1
    out = functools.reduce(DataFrame.unionByName, done)
    return out.join(plan.drop("blocks"), mine).select(
        "source", "key", "doc_id", "size", "mult", "source_size", "target", (F.col("base") + F.round("prob").cast("long")).alias("copies"))


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of (doc_id, text, source)."""
    every = copies(sized(docs)).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "mult")))
    return every.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """Rows of docs, with all their columns, each as often as the mix takes it."""
    got = copies(sized(docs)).where("copies > 0").select(F.col("key").alias("mate"), F.col("source").alias("src"), "copies")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))  # apart from this function's own names
    keyed = docs.select(whole.alias("doc"), F.xxhash64(F.lit(SEED), "doc_id", "text").alias("key"))
    joined = keyed.join(got, (F.col("key") == F.col("mate")) & F.col("doc.source").eqNullSafe(F.col("src")))
    return joined.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))
