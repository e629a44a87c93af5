"""Minimal perfect hashing of 64-bit keys by cascading bit sets, vectorised in numpy.

Level by level, every key that is alone at its place in a bit set of the level takes that place; the others go on to the
next level. A key's slot is the number of set bits before its bit, so the slots of n keys are exactly 0 to n - 1. With
a 32-bit fingerprint stored for each slot, a key that was not indexed is found out, but for one in four billion.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bits of a level for each key that reaches it.
GAMMA = 2


def mix(keys: np.ndarray, salt: int) -> np.ndarray:
    """A bijection of 64-bit keys (the finaliser of SplitMix64), so distinct keys part at some level."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1_000_003) >> np.uint64(32)).astype(np.uint32)


@dataclass
class PerfectHash:
    words: np.ndarray  # the levels' bits, 64 a word
    ranks: np.ndarray  # set bits before each word
    sizes: np.ndarray  # bits of each level, multiples of 64
    prints: np.ndarray  # fingerprint by slot

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct 64-bit integers."""
        rest, levels, sizes = np.asarray(keys, np.int64), [], []
        while len(rest):
            size = -(-GAMMA * len(rest) // 64) * 64
            at = (mix(rest, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            rest = rest[~alone[at]]
        words = np.concatenate(levels) if levels else np.zeros(0, "<u8")
        counts = np.bitwise_count(words).astype(np.uint32)
        index = PerfectHash(words, np.cumsum(counts, dtype=np.uint32) - counts, np.array(sizes, "<u4"), np.zeros(len(keys), "<u4"))
        index.prints[index._slots(keys)] = fingerprint(np.asarray(keys, np.int64))
        return index

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.int64)
        slots, base = np.full(len(keys), -1, np.int64), 0
        todo = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            bit = base + (mix(keys[todo], level) % np.uint64(size)).astype(np.int64)
            word, shift = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> shift & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1)))
            slots[todo[hit]] = self.ranks[bit >> 6][hit].astype(np.int64) + below[hit]
            todo, base = todo[~hit], base + size
        return slots

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the stored fingerprint says that it was not indexed."""
        found = self._slots(keys)
        ok = found >= 0
        ok[ok] = self.prints[found[ok]] == fingerprint(np.asarray(keys, np.int64))[ok]
        return np.where(ok, found, -1)

    def parts(self) -> dict[str, bytes]:
        return {"mph_words": self.words.astype("<u8").tobytes(), "mph_ranks": self.ranks.astype("<u4").tobytes(), "mph_sizes": self.sizes.astype("<u4").tobytes(), "mph_prints": self.prints.astype("<u4").tobytes()}

    @staticmethod
    def load(row: dict) -> PerfectHash:
        return PerfectHash(np.frombuffer(row["mph_words"], "<u8"), np.frombuffer(row["mph_ranks"], "<u4"), np.frombuffer(row["mph_sizes"], "<u4"), np.frombuffer(row["mph_prints"], "<u4"))
