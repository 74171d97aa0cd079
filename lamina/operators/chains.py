"""Chains of clusters in allocation tables of 12, 16 and 32 bits: how each ends, in which order it runs, what it reaches.

Links are followed by pointer jumping: each round a cluster's pointer moves to where the one it points to points, so the
distance doubles, and what has not ended after as many steps as there are clusters runs in a loop. Two forms: a table packed in bytes is one row, and the tables of
a whole Arrow batch jump together as arrays (a 16-bit table has 65,536 entries at most); links of tables that are too large
for a row are rows themselves, and each round is a join.

Defined cases: a cluster's own link says its state (END, BAD, FREE, RANGE for a link outside of the table); a table shorter than its
size ends in free entries; null tables have no clusters; chains may meet, and each then has the common clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import octets

STATES = ("END", "BAD", "FREE", "RANGE", "LOOP")
# By bits of an entry, the mark of a bad cluster, the least mark of an end, and the bits that count.
MARKS = {12: (0xFF7, 0xFF8, 0xFFF), 16: (0xFFF7, 0xFFF8, 0xFFFF), 32: (0x0FFFFFF7, 0x0FFFFFF8, 0x0FFFFFFF)}


def packed(entries: Column, bits: int) -> Column:
    """Digits of a 16- or 32-bit table, little-endian."""
    return F.array_join(F.transform(entries, lambda e: octets.digits_little(e, bits // 8)), "")


def unpacked(raw: bytes, size: int, bits: int) -> np.ndarray:
    """The first size entries of a packed table."""
    if bits == 12:
        b = np.frombuffer(raw[: (size * 3 + 1) // 2].ljust((size // 2 + 1) * 3, b"\0"), np.uint8).astype(np.int64).reshape(-1, 3)
        both = np.stack([b[:, 0] | (b[:, 1] & 15) << 8, b[:, 1] >> 4 | b[:, 2] << 4], axis=1)
        return both.ravel()[:size]
    n = bits // 8
    return np.frombuffer(raw[: size * n].ljust(size * n, b"\0"), f"<u{n}").astype(np.int64) & MARKS[bits][2]


class Tables:
    """The clusters of many tables in one numbering: links inside a table become numbers, ends become states."""

    def __init__(self, tables: list[tuple[int, bytes | None]], bits: int):
        bad, end, _ = MARKS[bits]
        parts = [unpacked(raw or b"", size if raw is not None else 0, bits) for size, raw in tables]
        sizes = np.array([len(p) for p in parts], np.int64)
        self.of = np.repeat(np.arange(len(parts)), sizes)
        first = np.cumsum(sizes) - sizes
        link = np.concatenate(parts) if parts else np.empty(0, np.int64)
        self.cluster = np.arange(len(link)) - first[self.of]
        size = sizes[self.of]
        ended = np.select([link >= end, link == bad, link == 0, (link < 2) | (link >= size)], [0, 1, 2, 3], -1)
        self.state = np.where(self.cluster < 2, 3, ended)
        self.next = np.where(self.state >= 0, -1, first[self.of] + link)
        real = (self.cluster >= 2) & (self.next >= 0)
        self.linked = np.zeros(len(link), bool)
        self.linked[self.next[real]] = True
        self.most = int(sizes.max(initial=0))

    def walks(self) -> tuple[np.ndarray, np.ndarray]:
        """For each cluster the clusters of its chain and the number of its state in STATES; a loop has no number of clusters (0)."""
        at, steps, state = self.next.copy(), np.ones(len(self.next), np.int64), self.state.copy()
        reach = 1
        while reach <= self.most and (at >= 0).any():
            open_ = np.flatnonzero(at >= 0)
            to = at[open_]
            steps[open_] += steps[to]
            state[open_], at[open_] = state[to], at[to]
            reach *= 2
        state[at >= 0], steps[at >= 0] = 4, 0
        return steps, state

    def ordered(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, place, cluster) along each start's chain; all chains step together, those at their end drop out.

        Starts whose chain loops must not be among them."""
        start, at, out, k = starts, starts, [], 0
        while len(at):
            out.append((start, np.full(len(at), k), at))
            to = self.next[at]
            start, at, k = start[to >= 0], to[to >= 0], k + 1
        none = np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none)

    def reached(self, starts: np.ndarray) -> np.ndarray:
        """Whether each cluster lies on a chain of one of the starts; a cluster that was seen is not followed again."""
        seen, at = np.zeros(len(self.next), bool), starts
        while len(at):
            seen[at] = True
            to = self.next[at]
            at = np.unique(to[to >= 0])
            at = at[~seen[at]]
        return seen


def _mapped(volumes: DataFrame, bits: int, rows, schema: str) -> DataFrame:
    """rows(tables, volumes of the batch) for each batch of (volume, size, fat); fat in digits."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            size, raw = batch.column("size").to_pylist(), batch.column("raw").to_pylist()
            cols = rows(Tables(list(zip(size, raw, strict=True)), bits), batch.column("volume"))
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)

    return volumes.select("volume", F.col("size").cast("long"), F.unhex("fat").alias("raw")).mapInArrow(run, schema)


def walks(volumes: DataFrame, bits: int) -> DataFrame:
    """volume, start, clusters (null in a loop), state, head (no cluster links to it) of every cluster."""

    def rows(t: Tables, volume: pa.Array) -> list:
        steps, state = t.walks()
        real = np.flatnonzero(t.cluster >= 2)
        clusters = pa.array(steps[real], mask=state[real] == 4)
        return [volume.take(pa.array(t.of[real])), t.cluster[real], clusters, pa.array(np.array(STATES)[state[real]].tolist(), pa.string()), ~t.linked[real]]

    return _mapped(volumes, bits, rows, f"volume {dict(volumes.dtypes)['volume']}, start long, clusters long, state string, head boolean")


def files(volumes: DataFrame, bits: int) -> DataFrame:
    """volume, start, pos, cluster: the clusters of each chain that a head begins and an end mark ends, in their order."""

    def rows(t: Tables, volume: pa.Array) -> list:
        _, state = t.walks()
        start, pos, at = t.ordered(np.flatnonzero((t.cluster >= 2) & ~t.linked & (state == 0)))
        return [volume.take(pa.array(t.of[start])), t.cluster[start], pos, t.cluster[at]]

    return _mapped(volumes, bits, rows, f"volume {dict(volumes.dtypes)['volume']}, start long, pos long, cluster long")


def reached(volumes: DataFrame, bits: int) -> DataFrame:
    """volume, cluster of all that a head's chain holds, however it ends."""

    def rows(t: Tables, volume: pa.Array) -> list:
        at = np.flatnonzero(t.reached(np.flatnonzero((t.cluster >= 2) & ~t.linked)))
        return [volume.take(pa.array(t.of[at])), t.cluster[at]]

    return _mapped(volumes, bits, rows, f"volume {dict(volumes.dtypes)['volume']}, cluster long")


def linked_walks(links: DataFrame, store, bits: int = 32) -> DataFrame:
    """volume, start, clusters, state of every row of (volume, cluster, link, size), for tables of any size: a round is a join.

    store() writes a round's table and reads it again. What has ended is set aside, so a round joins only what is still open."""
    bad, end, counts = MARKS[bits]
    link = F.col("link").bitwiseAND(F.lit(counts).cast("long"))
    state = F.when(link >= end, "END").when(link == bad, "BAD").when(link == 0, "FREE").when((link < 2) | (link >= F.col("size")), "RANGE")
    at = store(links.select("volume", "cluster", state.alias("state"), F.when(state.isNull(), link).alias("to"), F.lit(1).cast("long").alias("steps")))
    most = links.agg(F.max("size")).first()[0] or 0
    reach = 1
    while reach <= most and not at.where("to IS NOT NULL").isEmpty():
        there = at.select("volume", F.col("cluster").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"), F.col("state").alias("end"))
        moved = at.where("to IS NOT NULL").join(there, ["volume", "to"]).select("volume", "cluster", F.col("end").alias("state"), F.col("far").alias("to"), (F.col("steps") + F.col("more")).alias("steps"))
        at = store(at.where("to IS NULL").unionByName(moved))
        reach *= 2
    looped = F.col("to").isNotNull()
    return at.select("volume", F.col("cluster").alias("start"), F.when(~looped, F.col("steps")).alias("clusters"), F.when(looped, "LOOP").otherwise(F.col("state")).alias("state"))
