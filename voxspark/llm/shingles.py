"""Hashed word shingles of whole texts, vectorised over bytes.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A shingle is a 64-bit
hash of consecutive words; a text with fewer words than that is one shingle of its whole sequence.
Only arrays of one block of a text are held at a time.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np

BLOCK = 1 << 20
WHITE = re.compile(rb"[\x20\x09-\x0D]")
_U = np.uint64
_TABLE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_TABLE[65:91] = _TABLE[97:123]
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_ORDER = np.random.default_rng(11).integers(0, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, _U), np.full(size, pow(_BASE, -1, 2**64), _U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _block_words(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~_IS_WHITE[b], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(1 << max(10, (len(b) - 1).bit_length()))
    total = np.concatenate([np.zeros(1, _U), np.cumsum(_TABLE[b] * up[: len(b)], dtype=_U)])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))


def word_hashes(text: str) -> np.ndarray:
    """One hash for each word, in order."""
    data = text.encode("utf-8", "surrogatepass")
    cuts = [0]
    while len(data) - cuts[-1] > BLOCK and (m := WHITE.search(data, cuts[-1] + BLOCK)):
        cuts.append(m.start())
    parts = [_block_words(data[a:b]) for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True) if b > a]
    return np.concatenate(parts) if parts else np.empty(0, _U)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes; empty for a text without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(words, len(w))
    found = np.zeros(len(w) - k + 1, _U)
    for j in range(k):
        found += w[j : j + len(found)] * _ORDER[j]
    return np.unique(mix(found + _U(k)))
