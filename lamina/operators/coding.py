"""Streams without a checksum, mended by their marks."""

from __future__ import annotations

from bisect import bisect

import numpy as np

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _sync_errors(a: np.ndarray, sync: bytes) -> np.ndarray:
    """Wrong bits against sync at each byte position that lies before the stream's last len(sync) bytes."""
    n = max(0, len(a) - len(sync))
    return sum((_ONES[a[j : n + j] ^ v].astype(np.int64) for j, v in enumerate(sync)), np.zeros(n, np.int64))


def _places(wrong: np.ndarray, errors: int, size: int, spacing: int, weigh: bool) -> list[int]:
    """Where syncs are: places within errors bits that do not overlap. Of places that do, the first; or, weighed, the one with
    another place exactly spacing bytes before or after it, then the one with the fewest wrong bits, then the first."""
    places, taken = np.flatnonzero(wrong <= errors), []
    if not weigh:
        for i in places.tolist():
            if not taken or i - taken[-1] >= size:
                taken.append(i)
        return taken
    lonely = ~(np.isin(places - spacing, places) | np.isin(places + spacing, places))
    for i in places[np.lexsort((places, wrong[places], lonely))].tolist():
        k = bisect(taken, i)
        if (k == 0 or i - taken[k - 1] >= size) and (k == len(taken) or taken[k] - i >= size):
            taken.insert(k, i)
    return taken


def recover_stream(raw: bytes, sync: bytes, spacing: int, errors: int = 2, least: int = 16, most: int = 64, rounds: int = 11, weigh: bool = False) -> tuple[bytes, int, int]:
    """A byte-aligned stream without a checksum: each place within errors bits of sync becomes sync, from left to right or, where text before a
    sync may look like the start of one, weighed (see _places); then a distance
    between two syncs that differs from spacing bits by more than least and less than most is mended in its middle, by taking bytes out or
    putting zeros in, rounds times at most. The stream, the syncs mended and the distances mended."""
    a = np.frombuffer(raw, np.uint8).copy()
    wrong = _sync_errors(a, sync)
    at = _places(wrong, errors, len(sync), spacing // 8, weigh)
    repairs = int((wrong[at] > 0).sum())
    for i in at:
        a[i : i + len(sync)] = np.frombuffer(sync, np.uint8)
    whole = np.flatnonzero(_sync_errors(a, sync) == 0)
    slip = np.diff(whole) * 8 - spacing
    bad = np.flatnonzero((np.abs(slip) > least) & (np.abs(slip) < most))[:rounds]
    parts, done = [], 0
    for g in bad.tolist():
        place = int(whole[g]) + spacing // 16
        parts.append(a[done:place].tobytes())
        size = int(slip[g]) // 8
        parts.append(bytes(max(0, -size)))
        done = place + max(0, size)
    return b"".join([*parts, a[done:].tobytes()]), repairs, len(bad)
