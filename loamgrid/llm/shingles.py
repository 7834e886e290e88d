"""Hashed word shingles and MinHash signatures in numpy, many texts at a time."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
WORD_BYTES = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base)]))
    return up(BASE), up(INVERSE)


def run_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of the bytes from each begin to its end, whatever their number: differences of rolling sums."""
    up, down = _powers(1 << max(20, int(len(data)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    return mixed((sums[ends] - sums[begins]) * down[begins])


def _batch(texts: list[str], k: int) -> Iterator[np.ndarray]:
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = WORD_BYTES[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    begins, ends = edges[::2], edges[1::2]
    words = run_hashes(data, begins, ends)
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    n_words = np.bincount(np.searchsorted(text_ends, begins, side="right"), minlength=len(raw)) if len(begins) else np.zeros(len(raw), int)
    rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        rolled = rolled * BASE + words[j : len(words) - k + 1 + j]
    rolled = mixed(rolled)
    at = 0
    for n in n_words.tolist():
        if n >= k:
            yield np.unique(rolled[at : at + n - k + 1])
        elif n:
            one = np.full(1, n, np.uint64)
            for w in words[at : at + n]:
                one = one * BASE + w
            yield mixed(one)
        else:
            yield np.zeros(0, np.uint64)
        at += n


def shingle_sets(texts: list[str], k: int = 5, most_bytes: int = 1 << 20) -> list[np.ndarray]:
    """The sorted hashes of the k-word shingles of each text.

    Words are runs of letters and digits in lower case. A text of fewer than k words has one shingle, all its words; one without words has none.
    """
    out, group, size = [], [], 0
    for t in texts:
        if group and size + len(t) > most_bytes:
            out += _batch(group, k)
            group, size = [], 0
        group.append(t)
        size += len(t)
    return out + (list(_batch(group, k)) if group else [])


@functools.cache
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**64, n, np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, np.uint64)


def signature(shingles: np.ndarray, n: int = 128, rows: int = 2048) -> np.ndarray:
    """n MinHash values of a set that isn't empty, the upper 32 bits of each."""
    a, b = _multipliers(n)
    least = np.full(n, np.uint64(2**64 - 1))
    for k in range(0, len(shingles), rows):
        np.minimum(least, (shingles[k : k + rows, None] * a + b).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(">u4")
