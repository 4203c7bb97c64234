"""Word hashes of whole Arrow columns with numpy; Spark deals the rows, this runs inside its tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_FOLD = np.zeros(256, np.uint8)
_FOLD[:] = np.arange(256)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are hashed at once; a longer text is taken alone.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all others."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """1, base, base^2 and so on; the longest list made so far is kept."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        out = np.ones(max(n, 1), np.uint64)
        with np.errstate(over="ignore"):
            out[1:] = base
            known = _POWERS[int(base)] = np.multiply.accumulate(out)
    return known[: max(n, 1)]


@dataclass
class Words:
    """The words of rows ``first`` to ``first + rows``: where each stands in ``data``, its hash, and per row the bounds."""

    first: int
    rows: int
    data: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    bounds: np.ndarray  # words of row i are bounds[i]:bounds[i + 1]
    offsets: np.ndarray  # bytes of row i

    @cached_property
    def hash(self) -> np.ndarray:
        return hashes(self.data, self.start, self.stop)


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows on end and the bounds of each row; a null row is empty."""
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``size`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(column: pa.Array, fold: bool, size: int = CHUNK) -> Iterator[Words]:
    """The words of a string column, chunk by chunk; ``fold`` lower-cases A-Z."""
    data, offsets = byte_rows(column)
    for i, j in chunks(offsets, size):
        part = data[offsets[i] : offsets[j]]
        part = _FOLD[part] if fold else part
        own = offsets[i : j + 1] - offsets[i]
        if not len(part):
            none = np.zeros(0, np.int64)
            yield Words(i, j - i, part, none, none, np.zeros(j - i + 1, np.int64), own)
            continue
        inside = ~_SPACE[part]
        before = np.empty(len(part), bool)
        before[0], before[1:] = False, inside[:-1]
        before[own[:-1][own[:-1] < len(part)]] = False
        start = np.flatnonzero(inside & ~before)
        after = np.empty(len(part), bool)
        after[-1], after[:-1] = False, inside[1:]
        ends = own[1:] - 1
        after[ends[ends >= 0]] = False
        stop = np.flatnonzero(inside & ~after) + 1
        yield Words(i, j - i, part, start, stop, np.searchsorted(start, own), own)


#: What is left of an eight-byte lane that holds so many bytes of a word.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hashes(part: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each word part[start:stop].

    Each lane of eight bytes is mixed with a key of its place before lanes are added up, so no order of few letters
    cancels out as it can in a polynomial; words of one length up to eight bytes never share a hash.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    length = stop - start
    lanes = np.maximum((length + 7) >> 3, 1)
    begin = np.cumsum(lanes) - lanes
    seat = np.arange(int(lanes.sum())) - np.repeat(begin, lanes)
    at = np.repeat(start, lanes) + 8 * seat
    padded = np.concatenate([part, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), np.uint64, padded, strides=(1,))
    with np.errstate(over="ignore"):
        keys = mix((np.arange(int(lanes.max()), dtype=np.uint64) + np.uint64(seed << 32)) * _BASE + _BASE)
        total = np.add.reduceat(mix((eight[at] & _LANE[np.clip(np.repeat(stop, lanes) - at, 0, 8)]) + keys[seat]), begin)
        return mix(total + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each word on; the last n - 1 words have none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(hashes) - n + 1, np.uint64)
        for k in range(n):
            out = (out + hashes[k : len(hashes) - n + 1 + k]) * _BASE
        return mix(out)


def gram_rows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row (from 0 in the chunk) of every run of n words that stays in its row."""
    row = np.repeat(np.arange(w.rows), np.diff(w.bounds))
    g = grams(w.hash, n)
    same = row[: len(g)] == row[n - 1 :] if len(g) else np.zeros(0, bool)
    return g[same], row[: len(g)][same]
