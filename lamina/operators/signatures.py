"""Masked byte signatures found in one pass: an automaton over all of them, held against whole buffers.

A signature is bytes and a mask; where the mask is 255 the byte is fixed, where it is less only some of its bits are. The longest
run of fixed bytes of each signature goes into an Aho-Corasick automaton (a trie whose missing steps lead to the longest suffix that is still
a beginning), so a byte of a buffer costs one step whatever the number of signatures. What the automaton proposes is then verified
against bytes and mask. A signature without a fixed byte is compared at every place.

Buffers are cut into pieces that overlap by the longest run; the pieces of a batch step through the automaton side by side, so a
step is a table lookup for thousands of places, and a piece reports what ends in its own part. Signatures beyond BLOCK bytes
are dealt to further automata, one pass each, so what a task holds is bounded.

Defined cases: a null or empty buffer and an empty signature hold nothing; equal signatures are each found; a signature longer
than the buffer is not in it; places overlap freely."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Signature bytes of one automaton; its table is at most this many rows.
BLOCK = 1 << 15
#: Bytes of a buffer that one lane reads.
PIECE = 1024
LANES = 1 << 14


def fixed_run(mask: bytes) -> tuple[int, int]:
    """Start and length of the longest run of whole bytes."""
    best, at = (0, 0), 0
    while at < len(mask):
        end = at
        while end < len(mask) and mask[end] == 255:
            end += 1
        if end - at > best[1]:
            best = (at, end - at)
        at = max(end, at + 1)
    return best


class Automaton:
    """Signatures as (bytes, mask) pairs of equal length."""

    def __init__(self, table: list[tuple[bytes, bytes]]):
        self.table = [(np.frombuffer(p, np.uint8) & np.frombuffer(m, np.uint8), np.frombuffer(m, np.uint8)) for p, m in table]
        runs = [fixed_run(m) for _, m in table]
        self.bare = [i for i, (_, n) in enumerate(runs) if not n and len(table[i][0])]
        words = [(table[i][0][a : a + n], i, a) for i, (a, n) in enumerate(runs) if n]
        self.longest = max((len(w) for w, _, _ in words), default=0)
        used = sorted({b for w, _, _ in words for b in w})
        self.classes = np.zeros(256, np.int32)  # class 0: a byte of no signature
        self.classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        steps: list[dict[int, int]] = [{}]
        ends: list[list[tuple[int, int]]] = [[]]  # (signature, bytes from its start to the end of its run)
        for word, i, a in words:
            at = 0
            for b in word:
                at = steps[at].setdefault(int(self.classes[b]), len(steps))
                if at == len(steps):
                    steps.append({})
                    ends.append([])
            ends[at].append((i, a + len(word)))
        self.next = np.zeros((len(steps), width), np.int32)
        fail, self.chain, todo = [0] * len(steps), [0] * len(steps), deque()
        for c, to in steps[0].items():
            self.next[0, c] = to
            todo.append(to)
        while todo:
            at = todo.popleft()
            self.chain[at] = fail[at] if ends[fail[at]] else self.chain[fail[at]]
            self.next[at] = self.next[fail[at]]
            for c, to in steps[at].items():
                fail[to] = int(self.next[fail[at], c])
                self.next[at, c] = to
                todo.append(to)
        self.ends = ends
        self.final = np.array([bool(e) or bool(self.chain[i]) for i, e in enumerate(ends)])

    def _proposed(self, classes: np.ndarray, begin: np.ndarray, own: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place after the run, node) in lanes that read from begin and report from own to stop."""
        state, places, nodes = np.zeros(len(begin), np.int32), [], []
        for t in range(int((stop - begin).max(initial=0))):
            state = self.next[state, classes[begin + t]]
            hit = np.flatnonzero(self.final[state])
            if len(hit):
                at = begin[hit] + t
                hit, at = hit[ok := (at >= own[hit]) & (at < stop[hit])], at[ok]
                places.append(at + 1)
                nodes.append(state[hit])
        none = np.empty(0, np.int64)
        return (np.concatenate(places), np.concatenate(nodes)) if places else (none, none)

    def find(self, buffers: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buffer, signature, offset) of every place of every signature."""
        sizes = np.array([len(b or b"") for b in buffers], np.int64)
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(b or b"" for b in buffers) + bytes(PIECE + self.longest + 1), np.uint8)
        sig, at = [], []
        if self.longest:
            counts = -(-sizes // PIECE)
            of = np.repeat(np.arange(len(sizes)), counts)
            own = starts[of] + (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)) * PIECE
            begin = np.maximum(starts[of], own - self.longest + 1)
            stop = np.minimum(starts[of] + sizes[of], own + PIECE)
            classes = self.classes[data]
            for k in range(0, len(of), LANES):
                lanes = slice(k, k + LANES)
                place, node = self._proposed(classes, begin[lanes], own[lanes], stop[lanes])
                while len(node):
                    for n in np.unique(node).tolist():
                        here = place[node == n]
                        for i, back in self.ends[n]:
                            sig.append(np.full(len(here), i))
                            at.append(here - back)
                    node = np.array(self.chain)[node]
                    place, node = place[node > 0], node[node > 0]
        for i in self.bare:
            span = len(self.table[i][0])
            sig.append(np.full(max(0, len(data) - span), i))
            at.append(np.arange(max(0, len(data) - span)))
        if not sig:
            none = np.empty(0, np.int64)
            return none, none, none
        sig, at = np.concatenate(sig), np.concatenate(at)
        buffer = np.searchsorted(starts, at, "right") - 1
        length = np.array([len(p) for p, _ in self.table])[sig]
        ok = (buffer >= 0) & (at >= 0)
        ok[ok] = at[ok] + length[ok] <= (starts + sizes)[buffer[ok]]
        buffer, sig, at = buffer[ok], sig[ok], at[ok]
        ok = np.zeros(len(at), bool)
        for i in np.unique(sig).tolist():
            p, m = self.table[i]
            mine = np.flatnonzero(sig == i)
            for k in range(0, len(mine), 1 << 16):
                some = mine[k : k + (1 << 16)]
                ok[some] = ((data[at[some][:, None] + np.arange(len(p))[None, :]] & m) == p).all(axis=1)
        return buffer[ok], sig[ok], at[ok] - starts[buffer[ok]]


def _blocks(table: DataFrame) -> Iterator[tuple[list, list[tuple[bytes, bytes]]]]:
    """Names and (bytes, mask) pairs, of about BLOCK bytes at a time."""
    names, pairs, held = [], [], 0
    for row in table.select("sig", "pattern", "mask").toLocalIterator():
        if row["pattern"] is None:
            continue
        pattern = bytes(row["pattern"])
        mask = bytes(row["mask"])[: len(pattern)].ljust(len(pattern), b"\xff") if row["mask"] is not None else b"\xff" * len(pattern)
        names.append(row["sig"])
        pairs.append((pattern, mask))
        held += len(pattern)
        if held >= BLOCK:
            yield names, pairs
            names, pairs, held = [], [], 0
    if names:
        yield names, pairs


def scan(buffers: DataFrame, table: DataFrame, first: bool = True) -> DataFrame:
    """key, sig, offset_at: the places of each signature of (sig, pattern, mask) in each buffer of (key, content).

    first: the first place of each signature in a buffer only. A null mask fixes all bytes."""
    key, name = dict(buffers.dtypes)["key"], dict(table.dtypes)["sig"]
    schema = f"key {key}, sig {name}, offset_at long"
    plain = buffers.select("key", F.col("content").cast("binary").alias("content"))
    out = None
    for names, pairs in _blocks(table):
        automaton, labels = Automaton(pairs), pa.array(names)

        def run(batches, automaton=automaton, labels=labels):
            for batch in batches:
                for k in range(0, batch.num_rows, 1024):
                    some = batch.slice(k, 1024)
                    buffer, sig, at = automaton.find(some.column("content").to_pylist())
                    order = np.lexsort((at, sig, buffer))
                    buffer, sig, at = buffer[order], sig[order], at[order]
                    if first and len(at):
                        head = np.concatenate([[True], (buffer[1:] != buffer[:-1]) | (sig[1:] != sig[:-1])])
                        buffer, sig, at = buffer[head], sig[head], at[head]
                    yield pa.RecordBatch.from_arrays([some.column("key").take(pa.array(buffer)), labels.take(pa.array(sig)), pa.array(at)], names=["key", "sig", "offset_at"])

        found = plain.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else buffers.sparkSession.createDataFrame([], schema)
