"""Hashes of words and word n-grams of a text, over arrays of its bytes."""

from __future__ import annotations

import numpy as np

#: A long text is hashed in blocks of about this many bytes, cut between words.
BLOCK = 1 << 20
_BASE, _STEP, _LENGTH = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: White space and ASCII punctuation.
PUNCTUATION = _SPACE.copy()
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_powers = np.ones(1, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * (_powers[-1:] * _BASE)])
    return _powers


def _block_words(raw: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = _LOWER[raw]
    inside = np.zeros(len(raw) + 2, dtype=bool)
    np.logical_not(between[low], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts, ends
    lengths = ends - starts
    at = np.flatnonzero(inside[1:-1])
    place = at - np.repeat(starts, lengths)
    values = (low[at].astype(np.uint64) + np.uint64(1)) * _power_table(int(lengths.max()))[place]
    sums = np.add.reduceat(values, np.cumsum(lengths) - lengths)
    return mixed(sums + lengths.astype(np.uint64) * _LENGTH), starts, ends


def words(text: bytes, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word ``[^\\x20\\x09-\\x0D]+``, A-Z taken as lower case.

    ``between`` marks the bytes that part words, white space unless told otherwise.
    """
    raw = np.frombuffer(text, dtype=np.uint8)
    if len(raw) <= BLOCK:
        return _block_words(raw, between)
    parts, start = [], 0
    while start < len(raw):
        end = min(start + BLOCK, len(raw))
        while end < len(raw) and not between[raw[end]]:
            blank = np.flatnonzero(between[raw[end : end + BLOCK]])
            end = end + int(blank[0]) if len(blank) else min(end + BLOCK, len(raw))
        h, s, e = _block_words(raw[start:end], between)
        parts.append((h, s + start, e + start))
        start = end
    return tuple(np.concatenate(x) for x in zip(*parts))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; of the whole sequence if it is shorter; none without words."""
    k = min(n, len(hashes))
    if k == 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(len(hashes) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        total = total * _STEP + hashes[j : len(hashes) - k + 1 + j]
    return mixed(total)
