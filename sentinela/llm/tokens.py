"""Words, word hashes and Rabin-Karp window hashes of many texts at once, as numpy arrays.

A word is a run of anything but space and U+0009 to U+000D. Hashes are polynomials modulo 2**64 with an odd base, taken
from prefix sums: the hash of a stretch is the difference of two sums, times the inverse power of its start.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        m = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: all bits of the result depend on all bits of `h`."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def salts(n: np.ndarray) -> np.ndarray:
    """A value for each number, to be added to hashes that count within one text only; unlike the hash of any short stretch."""
    return mix(n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x632BE59BD9B4E019))


def stretch_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair; equal stretches have equal hashes wherever they lie."""
    n = len(values)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of texts data[at[i]:at[i + 1]], and the first word of each text (n + 1 values)."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return stretch_hashes(data, starts, ends)


def window_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every window of `width` consecutive words within one text."""
    count = len(words) - width + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(of[:count] == of[width - 1 :])
    return at, stretch_hashes(words, at, at + width)


def joined_words(data: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words of each text that are not `gone`, joined by one space, and the n + 1 offsets of the texts."""
    kept = np.flatnonzero(~gone)
    sizes = ends[kept] - starts[kept]
    cut = np.searchsorted(kept, first)
    spaced = np.ones(len(kept), np.int64)
    spaced[cut[1:][cut[1:] > cut[:-1]] - 1] = 0  # none after the last word of a text
    upto = np.concatenate([[0], np.cumsum(sizes + spaced)])
    out = np.full(int(upto[-1]), 32, np.uint8)
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts[kept]] += 1
    edges[ends[kept]] -= 1
    place = np.zeros(len(out) + 1, np.int8)
    place[upto[:-1]] += 1
    np.add.at(place, upto[:-1] + sizes, -1)
    out[np.cumsum(place[:-1], dtype=np.int8) > 0] = data[np.cumsum(edges[:-1], dtype=np.int8) > 0]
    return out, upto[cut]
