"""Minimal perfect hash functions over 128-bit keys: a cascade of collision-free bit arrays, ranked by population count.

Every level hashes the keys left over into a bit array; positions hit by exactly one key are set, the others go on to
the next level. The slot of a key is the number of set bits before its own, so n keys fill slots 0..n-1 without gaps
and a lookup reads a few words however many keys there are.
"""

from __future__ import annotations

import io

import numpy as np

_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


def _at(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(h1 + h2 * np.uint64(2 * level + 1) + _C * np.uint64(level + 1)) % np.uint64(bits)


class PerfectHash:
    """``slots`` maps keys to 0..n-1 for members; any other key gets -1 or some slot, so callers compare what the slot stores."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, gamma: float = 1.7) -> PerfectHash:
        """Keys must be distinct as pairs."""
        sizes, words, level = [], [], 0
        while len(h1):
            bits = max(64, int(gamma * len(h1)) // 64 * 64 + 64)
            at = _at(h1, h2, level, bits)
            alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
            sizes.append(bits)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = ~alone[at.astype(np.int64)]
            h1, h2, level = h1[left], h2[left], level + 1
            if level > 200:
                raise ValueError("equal keys")
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, "<u8"))

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, open_, base = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
        for level, bits in enumerate(self.sizes.tolist()):
            at = _at(h1[open_], h2[open_], level, bits)
            word, bit = (at >> np.uint64(6)).astype(np.int64) + base, at & np.uint64(63)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[open_[hit]] = self.ranks[word[hit]] + below
            open_, base = open_[~hit], base + bits // 64
        return out


def dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def load(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}
