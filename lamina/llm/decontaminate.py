"""Benchmark decontamination with training suffix arrays.

Documents are taken in shards (Arrow batches). A shard's words become ids of the benchmark's
vocabulary (0: a word that no item has, also put between documents), and its suffixes are sorted
into a suffix array by their first DEPTH words; a suffix that cannot begin a window, because its
first words begin none, has no match and is left out of the array. Every suffix of every item is
then looked up by binary search: the range of suffixes that begin with a window gives all its
occurrences, and windows that follow each other on one diagonal give the longest verbatim match.

The benchmark is the stated query set. It is cut into blocks of at most BLOCK_WORDS words. One block is sent to
the executors and searched in one pass without a shuffle. Where there are more, one pass cuts each text once and probes
sorted hashes of all windows (at most PROBE_WINDOWS in one broadcast) for the blocks whose windows it may
hold; what it finds, few rows, is written, and each block is sent, searched in its own candidates and released
before the next. So what is broadcast at once is bounded whatever the benchmark's size.

Defined cases: null, empty and wordless texts have n_words 0 and no hits; wordless or null items have no
window; an item of fewer than WINDOW words is one window; equal items each count; a null item_id is
left out; rows that repeat a doc_id get their own rows; other columns are not read."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, arrow_map, as_bytes, broadcast_if_small, mix64, rolling, slices, stored

WINDOW = 10
DEPTH = 16
BLOCK_WORDS = 400_000
PROBE_WINDOWS = 8_000_000
_HITS = "array<struct<s: int, e: int>>"
_RUNS = "array<struct<item: long, at: int, origin: int, words: int>>"


class Block:
    """Items whose suffixes are searched together: vocabulary, item words, allowed first words."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        words = sorted({w for _, ws in items for w in ws})
        self.vocab = {w: i + 1 for i, w in enumerate(words)}
        self.items = [(i, np.array([self.vocab[w] for w in ws], np.int64)) for i, ws in items]
        windows = [(i, at, ws[at : at + WINDOW]) for i, ws in self.items for at in range(max(1, len(ws) - WINDOW + 1))]
        self.lead = min([3, *(len(w) for _, _, w in windows)])
        self.owner = np.array([i for i, _, _ in windows], np.int64)
        self.offset = np.array([at for _, at, _ in windows], np.int64)
        self.length = np.array([len(w) for _, _, w in windows], np.int64)
        rows = np.zeros((len(windows), DEPTH), np.int64)
        for row, (_, _, w) in zip(rows, windows, strict=True):
            row[: len(w)] = w
        self.leads = lead_keys(rows, self.lead)
        self.first = np.unique(self.leads)
        self.low = _sortable(rows)
        rows[np.arange(DEPTH)[None, :] >= self.length[:, None]] = 2**32 - 1
        self.high = _sortable(rows)


def lead_keys(rows: np.ndarray, lead: int) -> np.ndarray:
    """A hash of the first lead ids of each row; rows that collide are told apart by the comparison of their words."""
    key = np.full(len(rows), lead, np.uint64)
    for i in range(lead):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i].astype(np.uint64))
    return key


def _sortable(rows: np.ndarray) -> np.ndarray:
    """Rows of ids as byte strings that sort as the id sequences do."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


def suffix_array(ids: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in the order of their suffixes' first DEPTH words, those words, and the first-word keys that occur."""
    n = len(ids)
    pad = np.concatenate([ids, np.zeros(DEPTH, ids.dtype)])
    ok = np.ones(n, bool)
    for i in range(block.lead):
        ok &= pad[i : n + i] > 0
    at = np.flatnonzero(ok)
    key = lead_keys(pad[at[:, None] + np.arange(block.lead)[None, :]], block.lead)
    spot = np.searchsorted(block.first, key)
    held = (spot < len(block.first)) & (block.first[np.minimum(spot, len(block.first) - 1)] == key)
    at, key = at[held], key[held]
    rows = _sortable(pad[at[:, None] + np.arange(DEPTH)[None, :]])
    order = np.argsort(rows, kind="stable")
    return at[order], rows[order], np.unique(key)


def occurrences(ids: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(window, position) for each occurrence of each of the block's windows in ids."""
    if not len(block.first) or not len(ids):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, rows, present = suffix_array(ids, block)
    tried = np.flatnonzero(np.isin(block.leads, present))
    lo, hi = np.searchsorted(rows, block.low[tried], "left"), np.searchsorted(rows, block.high[tried], "right")
    count = np.maximum(hi - lo, 0)
    which = np.repeat(tried, count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return which, at[np.repeat(lo, count) + within]


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals of sorted-by-start ones."""
    if not len(start):
        return start, end
    top = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > top[:-1]])
    return start[new], top[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])]


def search_shard(texts: list[bytes | None], block: Block) -> dict:
    """Per text: number of words, hit intervals [s, e), items found, longest verbatim match in words, and all such
    matches: item, first word in the text, first word in the item, words."""
    word_ids, starts, total = [], [], 0
    for text in texts:
        words = alnum_words(text) if text else []
        word_ids.append(np.fromiter(map(block.vocab.get, words, itertools.repeat(0)), np.int32, len(words)))
        starts.append(total)
        total += len(words) + 1
    ids = np.zeros(total, np.int32)
    for s, w in zip(starts, word_ids, strict=True):
        ids[s : s + len(w)] = w
    n = [len(w) for w in word_ids]
    hits, items, longest, runs = [[] for _ in n], [[] for _ in n], [0] * len(n), [[] for _ in n]
    which, pos = occurrences(ids, block)
    if len(pos):
        first = np.asarray(starts)
        doc = np.searchsorted(first, pos, "right") - 1
        size = block.length[which]
        # Runs of windows on one diagonal (same document, item and shift) are one verbatim match.
        shift = pos - block.offset[which]
        order = np.lexsort((pos, shift, block.owner[which], doc))
        d, o, sh, p, z = doc[order], block.owner[which][order], shift[order], pos[order], size[order]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (o[1:] != o[:-1]) | (sh[1:] != sh[:-1]) | (p[1:] > p[:-1] + 1)])
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:] - 1, [len(p) - 1]])
        np.maximum.at(best := np.zeros(len(n), np.int64), d[head], p[tail] + z[tail] - p[head])
        longest = best.tolist()
        for k, t in zip(head.tolist(), tail.tolist(), strict=True):
            at = int(p[k] - first[d[k]])
            runs[d[k]].append({"item": int(o[k]), "at": at, "origin": int(p[k] - sh[k]), "words": int(p[t] + z[t] - p[k])})
        order = np.lexsort((pos, doc))
        edges = np.searchsorted(doc[order], np.arange(len(n) + 1))
        for i in np.unique(doc).tolist():
            mine = order[edges[i] : edges[i + 1]]
            s, e = _merge(pos[mine] - first[i], pos[mine] - first[i] + size[mine])
            hits[i] = [{"s": a, "e": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)]
            items[i] = np.unique(block.owner[which[mine]]).tolist()
    return {"n_words": n, "hits": hits, "items": items, "longest": longest, "runs": runs}


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The benchmark's items and their words in blocks of at most block_words words (or one item)."""
    part, words = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    for item, text in rows.orderBy("item_id", "text").toLocalIterator():
        ws = alnum_words(text.encode("utf-8", "surrogatepass"))
        if not ws:
            continue
        if part and words + len(ws) > block_words:
            yield part
            part, words = [], 0
        part.append((item, ws))
        words += len(ws)
    yield part


class Probe(NamedTuple):
    """Sorted hashes of windows, the block of each, and the windows' lengths."""

    keys: np.ndarray
    block: np.ndarray
    sizes: tuple[int, ...]


def window_hashes(words: list[bytes], n: int) -> np.ndarray:
    return rolling(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), n)


def probes(parts: Iterator[list[tuple[int, list[bytes]]]], most: int = PROBE_WINDOWS) -> Iterator[Probe]:
    """The windows of all blocks in probes of about most windows (or one block)."""
    keys, owner, sizes, held = [], [], set(), 0

    def made() -> Probe:
        k, b = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(k, kind="stable")
        return Probe(k[order], b[order], tuple(sorted(sizes)))

    for number, part in enumerate(parts):
        if held > most:
            yield made()
            keys, owner, sizes, held = [], [], set(), 0
        for _, ws in part:
            n = min(WINDOW, len(ws))
            keys.append(window_hashes(ws, n))
            owner.append(np.full(len(keys[-1]), number, np.int32))
            sizes.add(n)
            held += len(keys[-1])
    yield made()


def blocks_of(words: list[bytes], probe: Probe) -> list[int]:
    """The blocks that hold a window with the hash of one of the text's."""
    found: set[int] = set()
    for n in probe.sizes:
        if len(words) >= n:
            mine = np.unique(window_hashes(words, n))
            lo, hi = np.searchsorted(probe.keys, mine, "left"), np.searchsorted(probe.keys, mine, "right")
            for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                found.update(probe.block[a:b].tolist())
    return sorted(found)


def _search(base: DataFrame, block: Block) -> tuple[DataFrame, object]:
    """The rows of base searched in one block, and the broadcast that they use."""
    sent = base.sparkSession.sparkContext.broadcast(block)

    def run(batch: pa.RecordBatch) -> dict:
        return {c: batch.column(c) for c in ("doc_id", "h")} | search_shard(as_bytes(batch.column("text")), sent.value)

    return arrow_map(base.select("doc_id", "h", "text"), run, f"doc_id long, h long, n_words long, hits {_HITS}, items array<long>, longest long, runs {_RUNS}"), sent


def _union(hits: list[list[dict]]) -> list[dict]:
    """One sorted list of disjoint intervals from several blocks'."""
    every = sorted((x["s"], x["e"]) for part in hits for x in part)
    s, e = _merge(np.array([x for x, _ in every], np.int64), np.array([x for _, x in every], np.int64))
    return [{"s": x, "e": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)]


def _found_in_blocks(base: DataFrame, benchmark: DataFrame, block_words: int, probe_windows: int) -> tuple[DataFrame, DataFrame]:
    """n_words of every row of base, and what all blocks found in the distinct (doc_id, h) that hold a window."""
    counts, near = None, []
    sc = base.sparkSession.sparkContext
    for probe in probes(blocks(benchmark, block_words), probe_windows):
        sent = sc.broadcast(probe)
        first = counts is None

        def run(batch: pa.RecordBatch, sent=sent, first=first) -> dict:
            out = {c: [] for c in ("doc_id", "h", "n_words", "text", "blocks")}
            for doc, h, text in zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), as_bytes(batch.column("text")), strict=True):
                words = alnum_words(text) if text else []
                found = blocks_of(words, sent.value)
                if found or first:
                    for c, v in zip(out, (doc, h, len(words), text.decode("utf-8", "surrogatepass") if found else None, found), strict=True):
                        out[c].append(v)
            return out

        table = stored(arrow_map(base, run, "doc_id long, h long, n_words long, text string, blocks array<int>"), "probed")
        sent.destroy()
        counts = table.select("doc_id", "h", "n_words") if first else counts
        near.append(table.where("size(blocks) > 0").dropDuplicates(["doc_id", "h"]))
    near = functools.reduce(DataFrame.unionByName, near)
    wanted = {r[0] for r in near.select(F.explode("blocks").alias("b")).distinct().collect()}  # block numbers
    parts = []
    for number, part in enumerate(blocks(benchmark, block_words)):
        if number in wanted:
            found, sent = _search(near.where(F.array_contains("blocks", number)), Block(part))
            parts.append(stored(found, "searched"))
            sent.destroy()
    if not parts:
        return counts, _search(base.limit(0), Block([]))[0]

    def join(batch: pa.RecordBatch) -> dict:
        out = {c: batch.column(c) for c in ("doc_id", "h", "longest")}
        rows = batch.to_pylist()
        return out | {"hits": [_union(r["hits"]) for r in rows], "items": [sorted(set(itertools.chain(*r["items"]))) for r in rows],
                      "runs": [list(itertools.chain(*r["runs"])) for r in rows]}

    every = functools.reduce(DataFrame.unionByName, parts).groupBy("doc_id", "h").agg(
        *(F.collect_list(c).alias(c) for c in ("hits", "items", "runs")), F.max("longest").alias("longest"))  # a row a block
    return counts, stored(arrow_map(every.where("longest > 0"), join, f"doc_id long, h long, hits {_HITS}, items array<long>, longest long, runs {_RUNS}"), "found")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")


def _single(benchmark: DataFrame, block_words: int) -> Block | None:
    """The benchmark as one block, or None where it is more."""
    two = list(itertools.islice(blocks(benchmark, block_words), 2))
    return Block(two[0]) if len(two) == 1 else None


def matches(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, probe_windows: int = PROBE_WINDOWS) -> DataFrame:
    """doc_id, n_words, hits (disjoint word intervals), items, longest, runs (maximal verbatim matches: item, first word
    in the text and in the item, words) for every row of docs."""
    base = _keyed(docs)
    block = _single(benchmark, block_words)
    if block is not None:
        return _search(base, block)[0].drop("h")
    counts, found = _found_in_blocks(base, benchmark, block_words, probe_windows)
    mate = found.select(F.col("doc_id").alias("mate"), F.col("h").alias("mate_h"), "hits", "items", "longest", "runs")
    joined = counts.join(broadcast_if_small(mate), F.col("doc_id").eqNullSafe(F.col("mate")) & (F.col("h") == F.col("mate_h")), "left")
    empty = lambda c: F.coalesce(c, F.array().cast(mate.schema[c].dataType)).alias(c)
    return joined.select("doc_id", "n_words", empty("hits"), empty("items"), F.coalesce("longest", F.lit(0).cast("long")).alias("longest"), empty("runs"))


def locations(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item, at, origin, words: each maximal verbatim match of a window's length or more."""
    return matches(docs, benchmark, block_words).select("doc_id", F.explode("runs").alias("run")).select("doc_id", "run.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, probe_windows: int = PROBE_WINDOWS) -> DataFrame:
    """The report for each document, with its longest match beside it."""
    found = matches(docs, benchmark, block_words, probe_windows)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x.e - x.s)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
        F.col("longest").alias("longest_match"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of docs, with all their columns, in which no window of any item occurs; with one block there is no shuffle."""
    block = _single(benchmark, block_words)
    if block is None:
        _, found = _found_in_blocks(_keyed(docs), benchmark, block_words, PROBE_WINDOWS)
        gone = broadcast_if_small(found.select(F.col("doc_id").alias("mate"), F.col("h").alias("mate_h")))
        return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("mate")) & (F.xxhash64(docs["text"]) == F.col("mate_h")), "left_anti")
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        for batch in slices(batches):
            found = search_shard(as_bytes(batch.column("text")), sent.value)
            yield batch.filter(pa.array([not h for h in found["hits"]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
