"""Minimal perfect hashing of integer keys."""

from __future__ import annotations

import numpy as np

from hourloom.llm.pieces import FACTOR, mixed

#: Bits per key that is still without a place; more bits mean fewer levels.
ROOM = 2


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(keys.astype(np.uint64) + np.uint64(level + 1) * FACTOR) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Maps n distinct keys to 0 ... n - 1.

    On each level the keys that are left are hashed into a bit array; those alone at their place have found it (its bit
    is set), the others go to the next level.  A key's number is the rank of its bit.  A key that was not entered may
    get a number too, so the stored key at that number must be compared.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = [np.cumsum(bits, dtype=np.int32) - 1 for bits in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], np.asarray(keys)
        while len(left):
            size = 64 * -(-ROOM * len(left) // 64)
            places = _places(left, len(levels), size)
            hits = np.bincount(places, minlength=size)
            levels.append(hits == 1)
            left = left[hits[places] != 1]
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for keys that cannot have been entered."""
        out = np.full(len(keys), -1, np.int64)
        waiting, base = np.arange(len(keys)), 0
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            places = _places(keys[waiting], level, len(bits))
            hit = bits[places]
            out[waiting[hit]] = base + rank[places[hit]]
            waiting, base = waiting[~hit], base + int(rank[-1]) + 1
        return out

    def to_bytes(self) -> tuple[list[int], bytes]:
        return [len(bits) for bits in self.levels], b"".join(np.packbits(bits).tobytes() for bits in self.levels)

    @classmethod
    def from_bytes(cls, sizes: list[int], data: bytes) -> PerfectHash:
        bits = np.unpackbits(np.frombuffer(data, np.uint8)).astype(bool)  # sizes are multiples of 64
        return cls(np.split(bits, np.cumsum(sizes)[:-1]) if sizes else [])
