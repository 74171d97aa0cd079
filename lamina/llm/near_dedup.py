"""MinHash near-dedup by a multi-index Hamming join, links confirmed on full shingle sets.

A document's set is its distinct five-word shingles (64-bit hashes of the word sequences). Its
signature is POSITIONS b-bit MinHash values (b = 16). Two documents' distance is the number of
positions that differ. The signature is cut into CHUNKS chunks of WIDTH positions; a pair within
DISTANCE = 2 * CHUNKS - 1 has, by the pigeonhole principle, a chunk with at most one error, and the
errors are enumerated: each chunk gives WIDTH keys, each leaving one position out. So every pair
within DISTANCE shares a key. A pair at Jaccard 0.85 differs at 9 of 60 positions on average
(standard deviation 2.8), so DISTANCE 23 misses about two such pairs in a million. These are op3's
values; for another similarity the chunks are chosen so that no larger share is missed: at 0.8, 15
chunks of 4 and a distance of 29 (about one such pair in five million).

Documents with equal sets collapse into their smallest doc_id before any pair is made. Buckets are
never expanded into all their pairs: each member is paired with its bucket's smallest one; the best
pair of each member is confirmed and joined into components, then its other such pairs that would
join two. Buckets that still hold several components are searched in blocks of members, held against
each other on their full sets inside a task, which gives only the links that join components. A pair
left out lies within one component already, or is beyond DISTANCE, so no link is lost.

Defined cases: a null, empty or all-space text has n_shingles 0 and is linked with nothing; with one
to four words the whole sequence is the single shingle; a row with a null doc_id is linked with
nothing, has a null component_id and is kept; other columns are not read. near_dedup reports documents: rows that repeat a
doc_id, with equal or different texts, are one document, whose links are those of all its rows, and each gets that
document's component. keep_one removes rows: of a group of near-duplicate texts the row with the smallest doc_id stays, so rows of one
doc_id with different texts stay or go each by its own text, and no text is lost with a doc_id; rows equal in
doc_id and set stay or go together."""

from __future__ import annotations

import functools
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import arrow_map, as_bytes, broadcast_if_small, discard, held, mix64, rolling, slices, space_words, stored

SHINGLE = 5
CHUNKS = 12
WIDTH = 5
POSITIONS = CHUNKS * WIDTH
DISTANCE = 2 * CHUNKS - 1
#: 100 * intersection >= PERCENT * union
PERCENT = 85
#: Largest share of the pairs just at the similarity that may lie beyond the distance.
MISSED = 3e-6
#: Shingles of a bucket's members that one task holds against as many others at a time.
BLOCK = 300_000
_MEMO = 60_000


class Plan(NamedTuple):
    """A similarity and the chunks that find its pairs."""

    percent: int
    chunks: int

    @property
    def width(self) -> int:
        return POSITIONS // self.chunks

    @property
    def distance(self) -> int:
        return 2 * self.chunks - 1


def plan(percent: int) -> Plan:
    """The fewest chunks, CHUNKS at least, whose distance misses no more than MISSED of the pairs at the similarity."""
    p = 1 - percent / 100
    for made in (Plan(percent, c) for c in range(CHUNKS, POSITIONS // 2 + 1) if POSITIONS % c == 0):
        if sum(math.comb(POSITIONS, k) * p**k * (1 - p) ** (POSITIONS - k) for k in range(made.distance + 1, POSITIONS + 1)) <= MISSED:
            return made
    raise ValueError(f"no chunks of {POSITIONS} positions find pairs at {percent} %")


class _WordHash(dict):
    """xxh3 of a word, remembered; emptied when full, so memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _memo() -> _WordHash:
    mine = held("near_dedup")
    if "words" not in mine:
        mine["words"] = _WordHash()
    return mine["words"]


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = space_words(text) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_memo().__getitem__, words), np.uint64, len(words))
    return np.unique(rolling(h, min(SHINGLE, len(h))))


@functools.cache
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * POSITIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x[:POSITIONS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[POSITIONS:] >> np.uint64(32)).astype(np.uint32)


def signature(s: np.ndarray) -> np.ndarray:
    """POSITIONS 16-bit values: low bits of the mixed minimum of each multiply-add hash."""
    mul, add = _seeds()
    lo, hi = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    mul, add = mul[:, None], add[:, None]
    for at in range(0, len(s), 512):
        x = lo[None, at : at + 512] * mul
        x += add
        x ^= (x >> np.uint32(16)) ^ hi[None, at : at + 512]
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        np.minimum(least, x.min(axis=1), out=least)
    return (least * np.uint32(0xC2B2AE35) >> np.uint32(16)).astype(np.uint16)


def _keys(sigs: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """(rows x POSITIONS) keys: each chunk of width positions with one left out."""
    out = np.empty((len(sigs), POSITIONS), np.uint64)
    wide = sigs.astype(np.uint64)
    for at in range(0, POSITIONS, width):
        for skip in range(width):
            acc = np.full(len(sigs), at + skip + 1, np.uint64)
            for i in range(width):
                if i != skip:
                    acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + wide[:, at + i])
            out[:, at + skip] = acc
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the full set), sig for every row."""

    def run(batch: pa.RecordBatch) -> dict:
        n, key, sig = [], [], []
        for text in as_bytes(batch.column("text")):
            s = shingles(text)
            n.append(len(s))
            key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sig.append(signature(s).tobytes() if len(s) else None)
        return {"doc_id": batch.column("doc_id"), "n_shingles": n, "set_key": key, "sig": sig}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_shingles long, set_key binary, sig binary")


def _emit_keys(reps: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                ids = batch.column("rep").to_numpy()
                sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, POSITIONS)
                keys = _keys(sigs, width).view(np.int64)
                each = lambda x, n=keys.shape[1]: pa.array(np.repeat(x, n))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), each(ids), each(batch.column("size").to_numpy())], names=["key", "rep", "size"])

    return reps.mapInArrow(run, "key long, rep long, size long")


def _within(pairs: DataFrame, sigs: DataFrame, distance: int) -> DataFrame:
    """(a, b, d) of the pairs whose signatures differ at no more than distance positions."""
    both = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(
        sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, POSITIONS) for c in ("sig_a", "sig_b"))
            d = (x != y).sum(axis=1).astype(np.int32)
            ok = d <= distance
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column("a").to_numpy()[ok]), pa.array(batch.column("b").to_numpy()[ok]), pa.array(d[ok])], names=["a", "b", "d"])

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, d int")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose full shingle sets meet the similarity."""
    both = pairs.select("a", "b").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches):
        last, mine = None, None
        for batch in slices(batches):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = batch.column("text_a"), batch.column("text_b")
            out = []
            for i in range(len(a)):
                if a[i] != last:
                    last, mine = a[i], shingles(ta[i].as_py().encode("utf-8", "surrogatepass"))
                other = shingles(tb[i].as_py().encode("utf-8", "surrogatepass"))
                inter = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * inter >= percent * (len(mine) + len(other) - inter):
                    out.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in out], pa.int64()), pa.array([b[i] for i in out], pa.int64())], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, comp): comp is the smallest node reachable. Min-label hooking with pointer jumping; the
    tables stay distributed and each round is written to the shared folder."""
    both = stored(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct(), label)
    comp = stored(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("x"), F.min("y")).alias("comp")), label)
    while True:
        reach = both.join(comp.select(F.col("node").alias("y"), "comp"), "y").groupBy(F.col("x").alias("node")).agg(F.min("comp").alias("near"))
        hooked = comp.join(reach, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = comp.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = stored(hooked.join(jump, "comp").select("node", "old", F.least("comp", "up").alias("comp")), label)
        discard(comp)
        if new.where("comp <> old").isEmpty():
            discard(both)
            return new
        comp = new


def _relabel(members: DataFrame, comp: DataFrame) -> DataFrame:
    """members with comp of each rep; a rep without links is its own component."""
    return members.join(comp.select(F.col("node").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def _ends(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """pairs with the components p of a and q of b."""
    side = lambda x, y: comp.select(F.col("node").alias(x), F.col("comp").alias(y))
    both = pairs.join(side("a", "p"), "a", "left").join(side("b", "q"), "b", "left")
    return both.withColumns({"p": F.coalesce("p", "a"), "q": F.coalesce("q", "b")})


def _links_within(ids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join different components, between members of left and of right, on full sets.

    One member at a time is held against all others by counting its shingles in theirs; members that a link
    has put into one component are not held against each other again, so at most one link a member comes out."""
    sizes = np.array([len(x) for x in sets], np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    stop = np.cumsum(sizes)
    start = stop - sizes
    mark = np.zeros(int(flat.max()) + 1, bool)
    comps, out = comps.copy(), []
    lo, hi = (int(start[right[0]]), int(stop[right[-1]])) if len(right) else (0, 0)
    edge = start[right] - lo
    for r in left.tolist():
        if not (comps[right] != comps[r]).any():
            continue
        mine = flat[start[r] : stop[r]]
        mark[mine] = True
        both = np.add.reduceat(mark[flat[lo:hi]], edge, dtype=np.int64)
        mark[mine] = False
        for k in right[(100 * both >= percent * (sizes[r] + sizes[right] - both)) & (comps[right] != comps[r])].tolist():
            if comps[k] != comps[r]:
                comps[comps == comps[k]] = comps[r]
                out.append((min(int(ids[k]), int(ids[r])), max(int(ids[k]), int(ids[r]))))
    return out


def _mixed_buckets(members: DataFrame, comp: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b): confirmed links that join the components that meet in one bucket.

    A bucket is cut by a hash into blocks of about BLOCK shingles, whatever its size; each pair of its blocks whose
    members lie in more than one component is one group, and what comes out of a group is at most one row a member.
    The pairs are made of blocks' least and greatest components, not of members."""
    labelled = _relabel(members, comp)
    spans = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    left = labelled.join(spans.select("key"), "key")
    cut = stored(left.withColumn("blocks", F.ceil(F.col("weight") / BLOCK).cast("int")).withColumn(
        "blk", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).select("key", "blk", "rep", "comp"), "cut")
    side = lambda n: cut.groupBy("key", F.col("blk").alias(n)).agg(F.min("comp").alias(f"lo_{n}"), F.max("comp").alias(f"hi_{n}"))
    pairs = side("i").join(side("j"), "key").where("i <= j AND least(lo_i, lo_j) < greatest(hi_i, hi_j)")
    meet = pairs.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("blk"))
    dealt = cut.join(meet, ["key", "blk"]).join(texts, "rep")

    def run(group: pa.Table) -> pa.Table:
        blk, i, j = group["blk"].to_numpy(), group["i"][0].as_py(), group["j"][0].as_py()
        order = np.argsort(blk, kind="stable")
        raw = group["text"].cast(pa.binary())
        sets = [shingles(raw[int(k)].as_py()) for k in order]
        blk = blk[order]
        got = _links_within(group["rep"].to_numpy()[order], group["comp"].to_numpy()[order], sets, np.flatnonzero(blk == i), np.flatnonzero(blk == j), percent)
        return pa.table({"a": pa.array([x for x, _ in got], pa.int64()), "b": pa.array([y for _, y in got], pa.int64())})

    found = stored(dealt.groupBy("key", "i", "j").applyInArrow(run, "a long, b long"), "more")
    discard(cut)
    return found


def _repeats(table: DataFrame) -> DataFrame:
    """doc_ids of more than one row, and whether those rows' sets differ."""
    rows = table.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("set_key").alias("low"), F.max("set_key").alias("high"))
    return stored(rows.where("n > 1").select("doc_id", F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("mixed")), "repeats")


def _numbered(groups: DataFrame) -> DataFrame:
    """groups with a rep of its own for each set: the smallest doc_id, or a number that no doc_id has where that one stands for several sets."""
    several = groups.groupBy("doc").agg(F.min("set_key").alias("first"), F.count("*").alias("n")).where("n > 1").select("doc", "first")
    low, high = groups.agg(F.min("doc"), F.max("doc")).first()
    more = F.monotonically_increasing_id() + 1
    other = F.lit(high).cast("long") + more if (high or 0) < 2**62 else F.lit(low).cast("long") - more
    mine = F.col("first").isNull() | (F.col("first") == F.col("set_key"))
    return groups.drop("rep").join(several, "doc", "left").withColumn("rep", F.when(mine, F.col("doc")).otherwise(other)).drop("first")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (the whole row), id, set_key of every row."""
    schema = StructType([StructField("doc", docs.schema), StructField("id", LongType()), StructField("set_key", BinaryType())])

    def run(batches):
        for batch in slices(batches):
            sets = [shingles(text) for text in as_bytes(batch.column("text"))]
            keys = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("id"), pa.array(keys, pa.binary())], names=["doc", "id", "set_key"])

    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(whole.alias("doc"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text")).mapInArrow(run, schema)


def _texts(docs: DataFrame, groups: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """(rep, text) of the wanted representatives. Where doc_ids repeat, a doc_id's rows are told apart by their sets."""
    if not repeated:
        texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").where("text IS NOT NULL")
        return texts.join(broadcast_if_small(wanted), "rep", "left_semi")
    own = groups.select("rep", "doc", "set_key").join(wanted, "rep", "left_semi")
    rows = _keyed(docs.select("doc_id", "text")).select("id", "set_key", F.col("doc.text").alias("text"))
    return rows.join(own, (F.col("id") == F.col("doc")) & (rows["set_key"] == own["set_key"])).select("rep", "text").dropDuplicates(["rep"])


def linked_sets(docs: DataFrame, percent: int, by_document: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sketches of all rows; set_key, doc (smallest doc_id), rep, comp of each set; the doc_ids that repeat.

    by_document: sets of rows with one doc_id are linked too."""
    at = plan(percent)
    table = stored(sketches(docs), "sketches")
    usable = table.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    groups = usable.groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.min_by("sig", "doc_id").alias("sig"), F.max("n_shingles").alias("size")).withColumn("rep", F.col("doc"))
    repeats = _repeats(table)
    repeated = not repeats.isEmpty()
    groups = stored(_numbered(stored(groups, "sets")) if repeated else groups, "groups")
    sigs = groups.select("rep", "sig")
    keys = _emit_keys(groups.select("rep", "sig", "size"), at.width)
    shared = keys.groupBy("key").agg(
        F.min("rep").alias("pivot"), F.max("rep").alias("top"), F.count("*").alias("n"), F.sum("size").alias("weight"),
        F.bit_xor(F.xxhash64("rep")).alias("mark")).where("n > 1")
    # Near copies meet in many keys with the same members: one key of each member set is enough.
    shared = stored(shared.groupBy("pivot", "top", "n", "weight", "mark").agg(F.min("key").alias("key")).select("key", "pivot", "n", "weight"), "shared")
    members = stored(keys.join(broadcast_if_small(shared), "key").select("key", "rep", "pivot", "n", "weight"), "members")
    star = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    close = stored(_within(star, sigs, at.distance), "close")
    # One pass moves the texts of documents that share a key; all confirmations read this smaller table.
    wanted = stored(members.select("rep").distinct(), "wanted")
    texts = stored(_texts(docs, groups, wanted, repeated), "texts")
    best = close.groupBy("b").agg(F.min(F.struct("d", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    edges = stored(_confirmed(best, texts, percent), "edges")
    comp = components(edges)
    rest = stored(_ends(close.join(best, ["a", "b"], "left_anti"), comp).where("p <> q").select("a", "b"), "rest")
    if not rest.isEmpty():
        first, edges = edges, stored(edges.union(_confirmed(rest, texts, percent)), "edges")
        discard(first, comp)
        comp = components(edges)
    # Buckets of two have had their pair; in larger ones others than the smallest member may be linked.
    more = _mixed_buckets(members.where("n > 2").select("key", "rep", "weight"), comp, texts, percent)
    links = edges.union(more)
    if repeated and by_document:
        rows = usable.join(repeats.where("mixed").select("doc_id"), "doc_id", "left_semi").select("doc_id", "set_key").distinct()
        rows = stored(rows.join(groups.select("set_key", "rep"), "set_key").select("doc_id", "rep"), "rows")
        links = links.union(rows.join(rows.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).where("a <> b"))
    if repeated or not more.isEmpty():
        discard(comp)
        comp = components(links)
    linked = stored(_relabel(groups.select("set_key", "doc", "rep"), comp).select("set_key", "doc", "rep", "comp"), "linked")
    discard(groups, shared, members, close, wanted, texts, edges, comp, rest, more)
    return table, linked, repeats


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of (doc_id, text); pairs from percent up are links."""
    table, linked, repeats = linked_sets(docs, percent, by_document=True)
    if repeats.isEmpty():
        got = table.join(linked.select("set_key", F.col("comp").alias("least")), "set_key", "left")
    else:
        # A component may be labelled with a set's own number, and a row without words belongs to its document's component.
        least = linked.groupBy("comp").agg(F.min("doc").alias("least"))
        own = table.join(linked.join(least, "comp").select("set_key", "least"), "set_key", "left")
        others = own.join(repeats.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("least").alias("other"))
        got = own.join(others, "doc_id", "left").withColumn("least", F.coalesce("least", "other"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return got.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows of docs, with all their columns: of each group of near-duplicate texts the one with the smallest doc_id."""
    table, linked, repeats = linked_sets(docs, percent, by_document=False)
    rows = table.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    if repeats.isEmpty():
        gone = stored(rows.join(linked, "set_key").where("doc_id <> comp").select("doc_id"), "gone")
        return docs.join(broadcast_if_small(gone), "doc_id", "left_anti")
    best = linked.groupBy("comp").agg(F.min(F.struct("doc", "rep")).alias("m")).select("comp", F.col("m.rep").alias("best"))
    stay = linked.join(best, "comp").where("rep = best").select("set_key", "doc")
    gone = rows.join(stay, "set_key", "left").where("doc IS NULL OR doc <> doc_id").select("doc_id", "set_key").distinct()
    gone = broadcast_if_small(stored(gone.select(F.col("doc_id").alias("gone_id"), F.col("set_key").alias("gone_set")), "gone"))
    return _keyed(docs).join(gone, (F.col("id") == F.col("gone_id")) & (F.col("set_key") == F.col("gone_set")), "left_anti").select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), PERCENT)
