"""Chunked streaming over tracks: running statistics with state, and event-time windows with a watermark."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATS = "track long, n long, mean double, least double, most double"


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Count, sum, least and most so far; the state is five numbers whatever the track's length. A null counts as a row and is in no mean."""
    n, seen, total, least, most = state.get if state.exists else (0, 0, 0.0, float("inf"), float("-inf"))
    for f in frames:
        amps = f["amp"].dropna().tolist()
        n, seen, total = n + len(f), seen + len(amps), math.fsum([total, *amps])
        least, most = min([least, *amps]), max([most, *amps])
    state.update((n, seen, total, least, most))
    yield pd.DataFrame({"track": [key[0]], "n": [n], "mean": [total / seen if seen else None], "least": [least if seen else None], "most": [most if seen else None]}).astype({"mean": float, "least": float, "most": float})


def running_stats(stream: DataFrame) -> DataFrame:
    """Running statistics of each track of (track, amp), given again after each batch that changes them; null where a track has no value yet."""
    return stream.groupBy("track").applyInPandasWithState(_update, STATS, "n long, seen long, total double, least double, most double", "update", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and mean of (at, label, amp) in event-time windows; rows later than the watermark are left out."""
    return stream.withWatermark("at", late).groupBy(F.window("at", every), "label").agg(F.count("*").alias("n"), F.round(F.avg("amp"), 6).alias("mean")).select(
        F.col("window.start").alias("start"), "label", "n", "mean")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str, seconds: int | None = None) -> None:
    """Run a streaming frame over all that is there now and write each batch's rows as Parquet with its number.

    seconds: run for so long instead, a batch a second; timers of the processing time need that, as they come without new rows."""

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/number={number}")  # a repeated batch overwrites itself

    writer = stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", checkpoint)
    if seconds is None:
        writer.trigger(availableNow=True).start().awaitTermination()
    else:
        query = writer.trigger(processingTime="1 second").start()
        query.awaitTermination(seconds)
        query.stop()


CHUNKS = "track long, start long, length long, mean double, low long, flushed boolean, pushed long, buffered long, waiting long, refused long"
_CHUNK = Row(*[c.split()[0] for c in CHUNKS.split(", ")])
STATE = "next long, start long, pushed long, refused long, flushed long, reset long, buffer array<double>, seqs array<long>, kinds array<int>, amps array<double>"
DATA, FLUSH, RESET = 0, 1, 2
_STORE = "spark.sql.streaming.stateStore.providerClass"


def stateful(spark: SparkSession) -> SparkSession:
    """A session beside the given one whose streams keep their state in RocksDB, as several states a key need; the given one stays as it is."""
    own = spark.newSession()
    own.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if value := spark.conf.get(name, None):
            own.conf.set(name, value)
    return own


class Chunker(StatefulProcessor):
    """A track's samples, in whatever order they come, given as chunks in the order of seq.

    seq counts a track's samples from 0. State, in one value, so that a track asks and answers once a batch: next seq, start of the buffer, samples pushed, rows refused, last
    seqs of a flush and of a reset, the buffer (less than one chunk) and the rows that wait for a seq before them. A row whose seq has been used, or
    is null or negative, is refused and counted; a flush or reset counts once a seq and waits until all samples before it have come (a reset at seq
    k comes behind sample k, a flush at seq k before it). Where idle milliseconds pass without a row a timer takes the waiting rows as they are and flushes;
    what comes for its gaps later is refused."""

    def __init__(self, chunk: int, overlap: int, least: int, low: float, idle: int | None):
        self.chunk, self.overlap, self.least, self.low, self.idle = chunk, overlap, least, low, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("track", STATE)

    def handleInputRows(self, key, rows, timerValues):
        new, unplaced = [], 0
        for r in rows:
            seq, amp = r["seq"], r["amp"]
            if seq is None or seq < 0:
                unplaced += 1
            else:
                new.append((seq, r["kind"], math.nan if amp is None else amp))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        return self._step(key[0], new, unplaced, gaps=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self._step(key[0], [], 0, gaps=True)

    def _step(self, track: int, new: list, unplaced: int, gaps: bool) -> Iterator[Row]:
        """Use what can be used of the waiting and the new rows; gaps: do not wait for what is missing, and flush."""
        following, start, pushed, refused, flushed, reset, buffer, *early = self.state.get() or (0, 0, 0, 0, -1, -1, [], [], [], [])
        buffer, waiting = list(buffer), list(zip(*early, strict=True))
        refused += unplaced
        rows, early = [], []

        def emit(last: bool) -> None:
            mean = math.fsum(buffer) / len(buffer)
            rows.append(_CHUNK(track, start, len(buffer), None if math.isnan(mean) else mean, sum(abs(x) < self.low for x in buffer), last, pushed, 0, 0, refused))

        # At one seq a flush stands before the sample and a reset behind it.
        for seq, kind, amp in sorted([*waiting, *new], key=lambda r: (r[0], (1, 0, 2)[r[1]])):
            if kind == DATA:
                if seq < following:
                    refused += 1
                elif seq > following and not gaps:
                    early.append((seq, kind, amp))
                else:
                    following, pushed = seq + 1, pushed + 1
                    buffer.append(amp)
                    if len(buffer) == self.chunk:
                        emit(False)
                        buffer, start = buffer[self.chunk - self.overlap :], start + self.chunk - self.overlap
            elif seq <= (flushed if kind == FLUSH else reset):
                refused += 1
            elif not gaps and seq > (following if kind == FLUSH else following - 1):
                early.append((seq, kind, amp))
            elif kind == FLUSH:
                if len(buffer) >= self.least:
                    emit(True)
                buffer, start, flushed = [], start + len(buffer), seq
            else:
                buffer, start, reset = [], pushed, seq
        if gaps:
            if len(buffer) >= self.least:
                emit(True)
            buffer, start = [], start + len(buffer)
        self.state.update((following, start, pushed, refused, flushed, reset, buffer, *([r[k] for r in early] for k in range(3))))
        rows.append(_CHUNK(track, start, 0, 0.0, 0, False, pushed, len(buffer), len(early), refused))
        return iter(rows)


def chunked(stream: DataFrame, chunk: int, overlap: int, least: int = 4, low: float = 20.0, idle: int | None = None) -> DataFrame:
    """Chunks of (track, seq, amp, kind) as they fill: chunk samples each, the last overlap of them kept for the next one.

    A flush gives what is left (least samples or more), a reset forgets it. A row with length 0 tells what was pushed, is buffered,
    waits and was refused. The stream must belong to a session of stateful()."""
    processor = Chunker(chunk, overlap, least, low, idle)
    return stream.groupBy("track").transformWithState(processor, CHUNKS, "Update", "None" if idle is None else "ProcessingTime")


ROWS = "track long, seq long, amp double, kind int"


def replayed(samples: DataFrame, path: str, files: int = 12, per_batch: int = 4) -> DataFrame:
    """A stream of (track, seq, amp, kind) that brings a table's rows in files, per_batch of them a batch, in no order.

    Runs of 16 seqs are dealt to the files by a hash, so a track's samples come in several batches and before their turn; the state restores
    their order. Each track's flush, at the seq behind its last, comes whenever its file does."""
    rows = samples.select(F.col("track").cast("long"), F.col("seq").cast("long"), F.col("amp").cast("double"), F.col("kind").cast("int"))
    ends = rows.groupBy("track").agg((F.max("seq") + 1).alias("seq"), F.lit(0.0).alias("amp"), F.lit(FLUSH).alias("kind")).where("seq IS NOT NULL")
    rows.unionByName(ends).repartition(files, F.expr("seq div 16")).write.mode("append").parquet(path)
    return stateful(samples.sparkSession).readStream.schema(ROWS).option("maxFilesPerTrigger", per_batch).parquet(path)
