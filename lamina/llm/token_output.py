"""Token-ID / binary output: raw id payloads in shards, each with a minimal perfect hash index.

Documents are dealt into ranges of ascending doc_id and encoded there with END appended to each. A
shard holds consecutive documents: their ids as one raw little-endian payload of 2 bytes an id (4 for
vocabularies beyond 65,536), about SHARD_IDS ids unless one document is longer. Beside it stand, for its
distinct keys, a minimal perfect hash (a displacement for each of its buckets), the stored fingerprint,
the position and the length of the document in each slot. A keyed read finds its part among the parts' first keys, its shard among
the part's first and last keys, hashes the key, reads one slot, compares the fingerprint and slices the payload: constant time,
whatever the shard holds. Parts are folders, so parts without a wanted key are not opened, and shards are left out by the
statistics of their first keys.

Shards are rows of Parquet files written by Spark into the shared folder, so a lost executor's task is
simply run again, and any store that Spark writes to will do. Starts count from the sums of
the partitions, which are as many as there are partitions, and no more is gathered on the driver.

Defined cases: a null or empty text has END alone; a null doc_id comes first, by text, is in the payload and
the result, and has no key; rows that repeat a doc_id lie side by side in the order of their texts' hashes and
a keyed read gives the first; an empty table gives no shards and an empty result; other columns are not read."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, shared_dir, stored
from .encoding import encoder, token_bytes, vocabulary_path

END = 2
SHARD_IDS = 1 << 20
#: Text bytes of a range of documents, which one task encodes; the session's shuffle partitions are the least number of ranges.
PART_BYTES = 1 << 28
BATCH = 512
_SHARDS = ("part int, shard int, lo long, hi long, inner long, width int, docs array<long>, counts array<long>, payload binary, "
           "displace array<int>, prints array<int>, offsets array<long>, lengths array<long>")


def _hash(keys: np.ndarray, seed) -> np.ndarray:
    return mix64(keys.astype(np.int64).view(np.uint64) + mix64(np.atleast_1d(np.asarray(seed, np.uint64)) + np.uint64(0x9E3779B97F4A7C15)))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, np.uint64(1 << 40)) >> np.uint64(33)).astype(np.int32)


def build_mph(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements by bucket, and the slot of each of the distinct keys: hash and displace, largest buckets first."""
    n = len(keys)
    if not n:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    buckets = max(1, n // 4)
    home = (_hash(keys, 0) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    edge = np.searchsorted(home[order], np.arange(buckets + 1))
    displace, slot, taken = np.zeros(buckets, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
    for b in np.argsort(edge[:-1] - edge[1:], kind="stable").tolist():
        mine = order[edge[b] : edge[b + 1]]
        if not len(mine):
            break
        seed = 1
        while True:
            tries = np.arange(seed, seed + 64, dtype=np.uint64)
            at = (_hash(keys[mine][None, :], tries[:, None]) % np.uint64(n)).astype(np.int64)
            free = ~taken[at].any(axis=1)
            if len(mine) > 1:
                s = np.sort(at, axis=1)
                free &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if free.any():
                k = int(np.argmax(free))
                displace[b] = seed + k
                slot[mine] = at[k]
                taken[at[k]] = True
                break
            seed += 64
    return displace, slot


def slots(keys: np.ndarray, displace: np.ndarray, n: int) -> np.ndarray:
    """The slot of each key among n, by two hashes."""
    home = (_hash(keys, 0) % np.uint64(max(1, len(displace)))).astype(np.int64)
    return (_hash(keys, displace[home].astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _shard(part: int, number: int, inner: int, width: int, docs: list, pieces: list[np.ndarray]) -> dict:
    counts = np.array([len(p) for p in pieces], np.int64)
    where = np.cumsum(counts) - counts
    first: dict[int, int] = {}
    for i, d in enumerate(docs):
        if d is not None:
            first.setdefault(d, i)
    keys, rows = np.array(list(first), np.int64), np.array(list(first.values()), np.int64)
    displace, slot = build_mph(keys)
    prints, offsets, lengths = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    prints[slot], offsets[slot], lengths[slot] = fingerprint(keys), where[rows], counts[rows]
    return {"part": part, "shard": number, "lo": int(keys.min()) if len(keys) else None, "hi": int(keys.max()) if len(keys) else None, "inner": inner, "width": width, "docs": docs, "counts": counts, "payload": np.concatenate(pieces).astype(f"<u{width}").tobytes(),
            "displace": displace, "prints": prints, "offsets": offsets, "lengths": lengths}


def write_shards(docs: DataFrame, path: str, vocabulary: str, end: int = END, shard_ids: int = SHARD_IDS) -> None:
    """Encode (doc_id, text) and write the shards to path."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    width = 2 if end < 65536 else 4
    out = to_arrow_schema(StructType.fromDDL(_SHARDS))
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    dealt = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).withColumn("h", F.xxhash64("text"))
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        wide = width if len(token_bytes(vocabulary)) <= 65536 else 4
        keys, pieces, held, number, part, inner = [], [], 0, 0, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                some = batch.slice(at, BATCH)
                part = some.column("part")[0].as_py()
                for d, ids in zip(some.column("doc_id").to_pylist(), enc.encode(some.column("text").to_pylist()), strict=True):
                    if keys and held + len(ids) + 1 > shard_ids:
                        yield pa.RecordBatch.from_pylist([_shard(part, number, inner, wide, keys, pieces)], schema=out)
                        inner += held
                        keys, pieces, held, number = [], [], 0, number + 1
                    keys.append(d)
                    pieces.append(np.append(ids, np.uint32(end)))
                    held += len(ids) + 1
        if keys:
            yield pa.RecordBatch.from_pylist([_shard(part, number, inner, wide, keys, pieces)], schema=out)

    dealt.mapInArrow(run, _SHARDS).write.partitionBy("part").option("compression", "zstd").parquet(path)


def _bases(shards: DataFrame) -> DataFrame:
    """part, before: the ids that lie before each partition. The driver sees one sum a partition."""
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    total, before = 0, []
    for r in sorted(shards.groupBy("part").agg(F.max(F.col("inner") + size).alias("n")).collect(), key=lambda r: r["part"]):
        before.append((r["part"], total))
        total += r["n"]
    return shards.sparkSession.createDataFrame(before, "part int, before long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards' payloads and indexes."""
    shards = spark.read.schema(_SHARDS).parquet(path)
    spots = shards.join(F.broadcast(_bases(shards)), "part").withColumn("base", F.col("before") + F.col("inner"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["payload"], f"<u{row['width']}").astype("<u4")
                counts = np.array(row["counts"], np.int64)
                where = np.cumsum(counts) - counts
                keyed = [i for i, d in enumerate(row["docs"]) if d is not None]
                if keyed:
                    keys = np.array([row["docs"][i] for i in keyed], np.int64)
                    slot = slots(keys, np.array(row["displace"], np.int32), len(row["prints"]))
                    if (np.array(row["prints"], np.int32)[slot] != fingerprint(keys)).any():
                        raise ValueError("a fingerprint of the index differs")
                    # A key that repeats leads to its first document; the others follow it.
                    head = np.concatenate([[True], keys[1:] != keys[:-1]])
                    rows = np.array(keyed, np.int64)[head]
                    where[rows], counts[rows] = np.array(row["offsets"], np.int64)[slot[head]], np.array(row["lengths"], np.int64)[slot[head]]
                crc = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(where.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["docs"], pa.int64()), pa.array(row["base"] + where), pa.array(counts), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spots.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


#: Shards whose first keys may be named in one filter.
NAMED = 1000


def _routed(spark: SparkSession, shards: DataFrame, keys: DataFrame) -> DataFrame:
    """want, part, shard, lo of the shard that a key must be in if it is anywhere; the parts' first keys, one row a part, go with the tasks."""
    ends = shards.where("lo IS NOT NULL").groupBy("part").agg(F.min("lo").alias("lo")).collect()
    order = sorted((r["lo"], r["part"]) for r in ends)
    first, part = np.array([a for a, _ in order], np.int64), np.array([b for _, b in order], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("want").to_numpy()
            at = np.searchsorted(first, want, "right") - 1
            ok = at >= 0
            yield pa.RecordBatch.from_arrays([pa.array(want[ok]), pa.array(part[at[ok]])], names=["want", "part"])

    wanted = keys.select(F.col("doc_id").cast("long").alias("want")).where("want IS NOT NULL").distinct().mapInArrow(run, "want long, part int")
    hit = [r["part"] for r in wanted.select("part").distinct().collect()]
    spans = shards.where(F.col("part").isin(hit)).where("lo IS NOT NULL").select("part", "shard", "lo", "hi")
    # Of shards that share a key the first holds its first document.
    return wanted.join(spans, "part").where("want BETWEEN lo AND hi").groupBy("want", "part").agg(F.min_by(F.struct("shard", "lo"), "shard").alias("s")).select("want", "part", "s.*")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """doc_id, ids of the documents whose doc_id is in keys; only parts and shards that may hold one are read."""
    shards = spark.read.schema(_SHARDS).parquet(path)
    routed = stored(_routed(spark, shards, keys), "routed")
    groups = routed.groupBy("part", "shard").agg(F.collect_set("want").alias("want"))
    some = routed.select("part", "lo").distinct().limit(NAMED + 1).collect()
    parts = sorted({r["part"] for r in some}) if len(some) <= NAMED else [r["part"] for r in routed.select("part").distinct().collect()]
    read = shards.where(F.col("part").isin(parts))
    if 0 < len(some) <= NAMED:
        lows = sorted({r["lo"] for r in some})
        read = read.where(F.col("lo").isin(lows) & F.col("lo").between(lows[0], lows[-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["payload"], f"<u{row['width']}")
                want = np.array(row["want"], np.int64)
                slot = slots(want, np.array(row["displace"], np.int32), len(row["prints"]))
                ok = np.array(row["prints"], np.int32)[slot] == fingerprint(want)
                # A key that is not in the shard passes its fingerprint once in two thousand million: the document itself decides.
                counts = np.array(row["counts"], np.int64)
                place = np.searchsorted(np.cumsum(counts) - counts, np.array(row["offsets"], np.int64)[slot])
                ok &= np.array([row["docs"][p] == w for p, w in zip(place.tolist(), want.tolist(), strict=True)], bool)
                got = [(int(w), ids[row["offsets"][s] : row["offsets"][s] + row["lengths"][s]].tolist()) for w, s in zip(want[ok], slot[ok], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return read.join(groups, ["part", "shard"]).mapInArrow(run, "doc_id long, ids array<int>")


def token_output(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the shards of docs to the shared folder and report each document as read back."""
    path = shared_dir(docs.sparkSession, "token-shards")
    write_shards(docs, path, vocabulary or vocabulary_path())
    return read_documents(docs.sparkSession, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"))
