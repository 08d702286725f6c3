"""A minimal perfect hash over 128-bit keys, built and probed with whole numpy arrays.

Level by level, keys that land alone in a bit array of that level stay there; the others go on to the next level.
A key's index is the rank of its bit over all levels.
"""

from __future__ import annotations

import struct

import numpy as np

_GOLDEN = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit sways each output bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = _U((level + 1) * _GOLDEN & 0xFFFFFFFFFFFFFFFF)
    return mix(hi ^ mix(lo + seed)) % _U(size)


class PerfectHash:
    """`index(hi, lo)` gives each key of the build its own number below their count; other keys get any number or -1."""

    def __init__(self, levels: list[np.ndarray], sizes: list[int]):
        self.levels, self.sizes = levels, sizes  # packed bits and their number
        counts = [np.concatenate(([0], np.cumsum(np.bitwise_count(b).astype(np.int64)))) for b in levels]
        starts = np.concatenate(([0], np.cumsum([c[-1] for c in counts]))).astype(np.int64)
        self.ranks = [c + s for c, s in zip(counts, starts)]
        self.n = int(starts[-1])

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray, room: float = 1.5) -> PerfectHash:
        """Keys have to be distinct."""
        hi, lo = hi.astype(_U), lo.astype(_U)
        levels, sizes = [], []
        while len(hi):
            size = max(8, int(room * len(hi)) + 7 & ~7)
            at = _place(hi, lo, len(levels), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone))
            sizes.append(size)
            stay = alone[at]
            hi, lo = hi[~stay], lo[~stay]
            if len(levels) > 200:
                raise ValueError("keys repeat")
        return cls(levels, sizes)

    def index(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        hi, lo = hi.astype(_U), lo.astype(_U)
        out = np.full(len(hi), -1, np.int64)
        open_ = np.arange(len(hi))
        for level, (bits, size) in enumerate(zip(self.levels, self.sizes)):
            if not len(open_):
                break
            at = _place(hi[open_], lo[open_], level, size).astype(np.int64)
            byte, bit = at >> 3, at & 7
            cell = bits[byte]
            hit = (cell >> (7 - bit).astype(np.uint8)) & 1 == 1
            before = np.bitwise_count(cell >> (8 - bit).astype(np.uint16)).astype(np.int64)
            out[open_[hit]] = (self.ranks[level][byte] + before)[hit]
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> bytes:
        return struct.pack(f"<I{len(self.sizes)}Q", len(self.sizes), *self.sizes) + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        (n,) = struct.unpack_from("<I", raw)
        sizes = list(struct.unpack_from(f"<{n}Q", raw, 4))
        at, levels = 4 + 8 * n, []
        for s in sizes:
            levels.append(np.frombuffer(raw, np.uint8, s // 8, at))
            at += s // 8
        return cls(levels, sizes)
