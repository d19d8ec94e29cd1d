"""A lookup table from pairs of symbols to numbers, for whole arrays of pairs at once."""

from __future__ import annotations

import numpy as np

#: The rank of a pair that cannot merge.
NO_RANK = np.int32(0x7FFFFFFF)


class PairTable:
    """Open addressing with linear probing; symbols are below 2**20, a negative symbol pairs with nothing."""

    def __init__(self, left: list[int], right: list[int], rank: list[int]):
        n = len(rank)
        self.bits = max(12, (4 * n).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NO_RANK, np.int32)
        key, value = np.array(left, np.int64) << 20 | np.array(right, np.int64), np.array(rank, np.int32)
        slot = self._slot(key)
        waiting = np.arange(n)
        while len(waiting):
            free = waiting[self.keys[slot[waiting]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[slot[placed]], self.ranks[slot[placed]] = key[placed], value[placed]
            waiting = np.setdiff1d(waiting, placed)
            taken = self.keys[slot[waiting]] != -1
            slot[waiting[taken]] = (slot[waiting[taken]] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NO_RANK where there is none."""
        key = left.astype(np.int64) << 20 | right
        slot = self._slot(key)
        found = self.keys[slot]
        rank = self.ranks[slot]
        other = np.flatnonzero(found != key)
        if len(other):
            rank[other] = NO_RANK
            other = other[(found[other] != -1) & (key[other] >= 0)]
            while len(other):
                slot[other] = (slot[other] + 1) & ((1 << self.bits) - 1)
                found = self.keys[slot[other]]
                hit = found == key[other]
                rank[other[hit]] = self.ranks[slot[other[hit]]]
                other = other[~hit & (found != -1)]
        return rank


def padded(pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of pieces in rows of ``width``, and which of them count."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(len(pieces), width)
    return raw, np.arange(width) < lengths[:, None]
