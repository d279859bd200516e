"""Hashes of all tokens of a slice of texts at once, from prefix sums over their bytes."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18  # bytes handled at a time, some 60 times as many of memory; a token is never cut
_ODD, _MULTIPLIER = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
_BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"


def spread_bits(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers that spreads close ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _byte_values() -> np.ndarray:
    """A random number per byte, the same for a letter's two cases; 0 for blanks."""
    values = spread_bits(np.arange(1, 257, dtype=np.uint64) * _ODD)
    values[0x41:0x5B] = values[0x61:0x7B]
    values[list(_BLANKS)] = 0
    return values


_powers: list[np.ndarray] = []


def _power_arrays(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        steps = max(n, CHUNK)
        _powers[:] = [
            np.cumprod(np.concatenate([[np.uint64(1)], np.full(steps, base, np.uint64)]), dtype=np.uint64)
            for base in (np.uint64(_MULTIPLIER), np.uint64(pow(_MULTIPLIER, -1, 2**64)))
        ]
    return _powers[0], _powers[1]


def _chunk_ends(blank: np.ndarray, borders: np.ndarray) -> list[int]:
    """Ends of chunks of about CHUNK bytes, each at a blank or where a text ends."""
    ends, at, n = [], 0, len(blank)
    while at < n:
        end = min(at + CHUNK, n)
        if end < n:
            back = np.flatnonzero(blank[at:end])
            border = borders[np.searchsorted(borders, end, "right") - 1]
            place = max(at + int(back[-1]) + 1 if len(back) else at, int(border))
            if place <= at:  # one token fills the chunk: go on to its end
                ahead = np.flatnonzero(blank[end:])
                place = min(end + int(ahead[0]) if len(ahead) else n, int(borders[np.searchsorted(borders, end, "left")]))
            end = place
        ends.append(end)
        at = end
    return ends


def token_hashes(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(unsigned 64-bit hash of every token of the texts in turn, number of tokens of each text).

    Tokens are runs of anything but ASCII blanks, with A-Z as a-z. A null text has none.
    """
    bodies = bodies.fill_null(b"")
    if isinstance(bodies, pa.ChunkedArray):
        bodies = bodies.combine_chunks()
    kind = np.int64 if pa.types.is_large_binary(bodies.type) else np.int32
    offsets = np.frombuffer(bodies.buffers()[1], kind, len(bodies) + 1, bodies.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(bodies.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    borders = offsets - offsets[0]
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(bodies), np.int64)
    values = _byte_values()
    blank = values[data] == 0
    hashes, starts, at = [], [], 0
    for end in _chunk_ends(blank, borders):
        part = values[data[at:end]]
        filled = ~blank[at:end]
        edge = np.zeros(end - at + 1, bool)  # where a text begins or ends
        inside = borders[(borders >= at) & (borders <= end)] - at
        edge[inside] = True
        edge[0] = edge[-1] = True
        first = np.flatnonzero(filled & (edge[:-1] | ~np.concatenate([[False], filled[:-1]])))
        last = np.flatnonzero(filled & (edge[1:] | ~np.concatenate([filled[1:], [False]])))
        powers, back = _power_arrays(end - at)
        sums = np.cumsum(part * powers[: end - at], dtype=np.uint64)
        before = np.where(first > 0, sums[first - 1], np.uint64(0))
        found = (sums[last] - before) * back[first]
        hashes.append(spread_bits(found + (last - first).astype(np.uint64) * _ODD))
        starts.append(first + at)
        at = end
    starts = np.concatenate(starts)
    counts = np.diff(np.searchsorted(starts, borders))
    return np.concatenate(hashes), counts
