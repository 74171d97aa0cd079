"""Importance resampling of documents towards the benchmark's features, by external sort-count.

Features are a text's words and pairs of neighbouring words; each falls into one of BUCKETS buckets. One pass over
the texts writes them as streams of packed 16-bit bucket numbers, a row a block of documents, beside the offsets at
which each document begins. The streams are then counted by sorting: a task sorts each stream, takes its run lengths and
merges runs of (bucket, count) as soon as they outgrow MERGE numbers, so what it holds is bounded and what it sends is
at most a row a bucket. A bucket's gain follows from its counts on both sides; the gains, BUCKETS numbers whatever the
data's size, go with the second pass, which gathers them along the streams and sums them between a document's offsets
(np.add.reduceat). Texts are read once and no feature is ever a row of a shuffle.

The draw is a sort by range: rows are numbered inside each range, and the ranges' row counts give the ranks.

Defined cases: a null, empty or wordless text has no features, weight 0 and no rank; h of a null doc_id is that of the
text `7:`, and such a row is drawn after others of its score; rows that repeat a doc_id are documents of their own; equal
rows take neighbouring ranks; an empty documents table gives an empty result, an empty benchmark gives counts t and T of 0;
other columns are not read."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_TABLE, as_bytes, discard, slices, stored

BUCKETS = 10_000
#: Percent of the documents with at least LEAST_WORDS words that are drawn.
RATE = 25
LEAST_WORDS = 20
SEED = 7
#: Bytes of one text that are cut into words at a time.
PIECE = 1 << 20
#: Features from which a block of documents is written.
BLOCK = 1 << 21
#: Numbers of unmerged runs that a counting task holds.
MERGE = 16 * BUCKETS
_STREAM = pa.schema([("doc_id", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("stream", pa.binary())])
_WEIGHED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The text's words, about PIECE bytes at a time."""
    clean, at = text.translate(WORD_TABLE), 0
    while at < len(clean):
        end = clean.find(b" ", at + PIECE)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def buckets(text: bytes | None) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of each word and each pair of neighbours."""
    count, parts, before = 0, [], []
    for words in pieces(text) if text else ():
        single = np.fromiter(map(crc32, words), np.uint32, len(words))
        run = before + words
        lead = map(crc32, itertools.repeat(b" "), map(crc32, run))
        double = np.fromiter(map(crc32, run[1:], lead), np.uint32, max(0, len(run) - 1))
        parts += [(x % np.uint32(BUCKETS)).astype("<u2") for x in (single, double)]
        count, before = count + len(words), run[-1:]
    return count, np.concatenate(parts) if parts else np.empty(0, "<u2")


def streams(texts: DataFrame) -> DataFrame:
    """Blocks of documents: doc_id, n_words and offsets (one more) of each, and the packed bucket stream of all."""

    def run(batches):
        ids, words, parts, size = [], [], [], 0

        def block():
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
            packed = b"".join(p.tobytes() for p in parts)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((ids, words, offsets, packed), _STREAM.types, strict=True)], schema=_STREAM)

        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                n, made = buckets(text)
                ids.append(doc_id)
                words.append(n)
                parts.append(made)
                size += len(made)
                if size >= BLOCK or len(ids) >= 4096:
                    yield block()
                    ids, words, parts, size = [], [], [], 0
        if ids:
            yield block()

    return texts.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id array<long>, n_words array<long>, offsets array<long>, stream binary")


def run_lengths(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of the runs of equal numbers."""
    at = np.flatnonzero(np.concatenate([[len(sorted_values) > 0], sorted_values[1:] != sorted_values[:-1]]))
    return sorted_values[at], np.diff(np.concatenate([at, [len(sorted_values)]]))


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One run of values with their counts from several."""
    values, counts = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order].astype(np.int64)
    at = np.flatnonzero(np.concatenate([[len(values) > 0], values[1:] != values[:-1]]))
    return values[at], np.add.reduceat(counts, at) if len(at) else counts


def counts(blocks: DataFrame, name: str) -> DataFrame:
    """bucket and its number of features."""

    def run(batches):
        runs, held = [], 0
        for batch in batches:
            for packed in batch.column("stream"):
                runs.append(run_lengths(np.sort(np.frombuffer(packed.as_buffer(), "<u2"))))
                held += len(runs[-1][0])
                if held > MERGE:
                    runs = [merged(runs)]
                    held = len(runs[0][0])
        if runs:
            values, sums = merged(runs)
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int32)), pa.array(sums)], names=["bucket", "n"])

    return blocks.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def gains(documents: DataFrame, benchmark: DataFrame) -> np.ndarray:
    """The gain of each bucket from both sides' streams; at most BUCKETS rows come to the driver."""
    both = counts(documents, "s").join(counts(benchmark, "t"), "bucket", "full").na.fill(0)
    s, t = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for row in both.collect():
        s[row["bucket"]], t[row["bucket"]] = row["s"], row["t"]
    top, low = float(s.sum() + BUCKETS), float(t.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(y + 1) * top) / (float(x + 1) * low))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weighed(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight: the floored mean of the gains between a document's offsets."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                stream = np.frombuffer(batch.column("stream")[i].as_buffer(), "<u2")
                offsets = np.asarray(batch.column("offsets")[i].values)
                n = np.diff(offsets)
                full = n > 0
                total = np.zeros(len(n), np.int64)
                if full.any():
                    total[full] = np.add.reduceat(gain[stream], offsets[:-1][full])
                weight = total // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i].values, batch.column("n_words")[i].values, pa.array(n), pa.array(weight)], schema=_WEIGHED)

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def numbered(rows: DataFrame, *order) -> DataFrame:
    """rows with `part` and `at`: ranges of the order, and places within a range. Nothing but a range meets in one task."""

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            more = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(at, at + batch.num_rows))]
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "part", "at"])

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"{schema}, part int, at long")


def resample(docs: DataFrame, benchmark: DataFrame, rate: int = RATE) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of (doc_id, text); rank is null where it is not drawn."""
    spark = docs.sparkSession
    blocks = stored(streams(docs), "streams")
    targets = stored(streams(benchmark.select(F.lit(None).cast("long").alias("doc_id"), "text")), "target-streams")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = stored(weighed(blocks, gains(blocks, targets)).withColumn("score", F.col("weight") + noise), "scored")
    discard(blocks, targets)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    able = stored(numbered(scored.where(F.col("n_words") >= LEAST_WORDS), *order), "numbered")
    sizes = sorted((r["part"], r["n"]) for r in able.groupBy("part").agg(F.count("*").alias("n")).collect())
    before = list(itertools.accumulate((n for _, n in sizes), initial=0))
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "part int, before long")
    drawn = rate * before[-1] // 100
    place = F.col("before") + F.col("at") + 1
    ranked = able.join(F.broadcast(starts), "part").withColumn("rank", F.when(place <= drawn, place))
    others = scored.where(F.col("n_words") < LEAST_WORDS).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(others.select(columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
