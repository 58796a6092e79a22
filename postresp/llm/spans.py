"""Vectorised words, lines and hashes over many texts laid back to back.

A batch of texts is one byte array plus offsets; words and lines are pairs of
start and end positions.  Hashes are polynomial in the bytes (wrapping 64-bit
arithmetic over a fixed random value per byte), so the hash of any stretch
comes from two prefix sums.
"""

from __future__ import annotations

import numpy as np

from postresp.llm.common import SPACES, mix64

_BASE = np.uint64(0x9E3779B97F4A7C15)                     # odd: it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n-1 of the base and of its inverse (kept and grown per worker)."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            _powers[name] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64))])
    return _powers["up"][:n], _powers["down"][:n]


class Hashes:
    """Prefix sums from which any stretch's hash is read."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    @classmethod
    def of_bytes(cls, raw: np.ndarray) -> Hashes:
        return cls(_VALUE[raw])

    def plain(self, starts, ends) -> np.ndarray:
        """Equal stretches give equal values; not yet mixed."""
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64(self.plain(starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; a word never crosses texts."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~IS_SPACE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[edge] = solid[edge]
    stops[edge - 1] = solid[edge - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def line_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (without the line feed) of all lines of non-empty texts."""
    full = offsets[:-1] < offsets[1:]
    feeds = np.flatnonzero(raw == 10)
    starts = np.concatenate([offsets[:-1][full], feeds + 1])
    ends = np.concatenate([feeds, offsets[1:][full]])
    return np.sort(starts, kind="stable"), np.sort(ends, kind="stable")


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the text each position belongs to."""
    return np.searchsorted(offsets, starts, side="right") - 1


def counts_per(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights=weights, minlength=n).astype(np.int64)


def repeated(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (owner, key): is it found twice or more; is there an earlier one."""
    many, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    if len(key):
        order = np.lexsort((key, owner))
        same = (owner[order][1:] == owner[order][:-1]) & (key[order][1:] == key[order][:-1])
        later[order[1:]] = same
        many[order[1:]] = same
        many[order[:-1]] |= same
    return many, later
