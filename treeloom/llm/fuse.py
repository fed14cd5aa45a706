"""Static three-way binary-fuse filters over 64-bit keys, with 16-bit fingerprints (numpy)."""

from __future__ import annotations

import numpy as np

from .kernels import U64, mix

_MAX_SEED = 64


def _segment_length(n: int) -> int:
    return 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))


class FuseFilter:
    """Says True for every key it was built from, and for about 1 of 65,536 others."""

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """The three slots of each key, in consecutive segments, and its fingerprint."""
        with np.errstate(over="ignore"):
            h = mix(keys ^ mix(np.full(1, seed, U64) + U64(0x9E3779B97F4A7C15)))
        first = ((h >> U64(32)) * U64(segments)) >> U64(32)
        low = U64(segment - 1)
        base = (first * U64(segment)).astype(np.int64)
        a = base + (h & low).astype(np.int64)
        g = mix(h)
        b = base + segment + (g & low).astype(np.int64)
        c = base + 2 * segment + ((g >> U64(20)) & low).astype(np.int64)
        return np.stack([a, b, c]), ((g >> U64(48)) ^ (h & U64(0xFFFF))).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Peel all keys with a slot of their own, round by round; then fill slots in reverse."""
        keys = np.unique(keys.astype(U64))
        n = len(keys)
        segment = _segment_length(n)
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        segments = max(1, int(np.ceil(n * factor / segment)) - 2)
        for seed in range(_MAX_SEED):
            size = (segments + 2) * segment
            slots, fp = cls._slots(keys, seed, segment, segments)
            count = np.bincount(slots.ravel(), minlength=size)
            owner = np.zeros(size, np.int64)  # xor of the keys (by number) at each slot
            for s in slots:
                np.bitwise_xor.at(owner, s, np.arange(n))
            rounds: list[tuple[np.ndarray, np.ndarray]] = []
            left, todo = n, np.flatnonzero(count == 1)
            while len(todo):
                key, pick = np.unique(owner[todo], return_index=True)
                rounds.append((key, todo[pick]))
                left -= len(key)
                touched = slots[:, key]
                for s in touched:
                    np.subtract.at(count, s, 1)
                    np.bitwise_xor.at(owner, s, key)
                flat = np.unique(touched)
                todo = flat[count[flat] == 1]
            if not left:
                break
            segments += max(1, segments // 16)  # another seed and a little more room
        else:
            raise RuntimeError("no filter found")
        table = np.zeros(size, np.uint16)
        for key, slot in reversed(rounds):
            a, b, c = slots[:, key]
            table[slot] = 0
            table[slot] = fp[key] ^ table[a] ^ table[b] ^ table[c]
        return cls(seed, segment, segments, table)

    def __contains__(self, key: int) -> bool:
        return bool(self.holds(np.array([key], U64))[0])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        (a, b, c), fp = self._slots(keys.astype(U64), self.seed, self.segment, self.segments)
        return (self.table[a] ^ self.table[b] ^ self.table[c]) == fp

    def dump(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], "<i8").tobytes() + self.table.astype("<u2").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> FuseFilter:
        seed, segment, segments = np.frombuffer(raw, "<i8", 3).tolist()
        return cls(seed, segment, segments, np.frombuffer(raw, "<u2", offset=24))
