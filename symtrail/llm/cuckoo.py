"""A cuckoo filter over 64-bit keys: batched inserts and lookups, deletions, a bytes form."""

from __future__ import annotations

import struct

import numpy as np

SLOTS, KICKS = 4, 200
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


class CuckooFilter:
    """Sixteen-bit fingerprints in buckets of four slots at first, which widen rather than fail.

    A key that was inserted is always found. One that was not is found with a chance of about
    twice the slots in 65,535. delete() takes keys that were inserted.
    """

    def __init__(self, expected: int = 64):
        self.table = self._empty(expected)

    @staticmethod
    def _empty(expected: int) -> np.ndarray:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, expected) / (SLOTS * 0.85)))))
        return np.zeros((buckets, SLOTS), np.uint16)

    @staticmethod
    def _print_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = _mix(keys)
        return (mixed % np.uint64(65535) + np.uint64(1)).astype(np.uint16), (mixed >> np.uint64(20)).astype(np.int64)

    @staticmethod
    def _other(bucket: np.ndarray, prints: np.ndarray, size: int) -> np.ndarray:
        return (bucket ^ (_mix(prints) >> np.uint64(7)).astype(np.int64)) & (size - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, spot = self._print_of(keys)
        one = spot & (len(self.table) - 1)
        two = self._other(one, prints, len(self.table))
        return (self.table[one] == prints[:, None]).any(1) | (self.table[two] == prints[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> None:
        """Keys that are not in the filter yet. Each takes a slot, so each can be deleted again."""
        prints, spot = self._print_of(np.asarray(keys))
        left = self._insert_into(self.table, prints, spot & (len(self.table) - 1))
        while len(left[0]):  # a displaced print has lost its key, but not its buckets: these widen
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
            left = self._insert_into(self.table, *left)

    def _insert_into(self, t: np.ndarray, prints: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places the prints in rounds over all of them at once; returns those left over."""
        rng, size = np.random.default_rng(len(prints)), len(t)
        for kick in range(KICKS):
            for _ in range(2):
                if not len(prints):
                    return prints, bucket
                order = np.argsort(bucket, kind="stable")
                prints, bucket = prints[order], bucket[order]
                rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
                free = np.argsort(t[bucket] != 0, axis=1, kind="stable")  # free slots come first
                fits = rank < (t[bucket] == 0).sum(1)
                t[bucket[fits], free[fits, rank[fits]]] = prints[fits]
                prints, bucket = prints[~fits], bucket[~fits]
                bucket = self._other(bucket, prints, size)
            if len(prints) and kick < KICKS - 1:  # one print a bucket takes the place of another, which moves on
                _, first = np.unique(bucket, return_index=True)
                slot = rng.integers(0, t.shape[1], len(first))
                evicted = t[bucket[first], slot].copy()
                t[bucket[first], slot] = prints[first]
                prints[first] = evicted
                live = prints != 0
                prints, bucket = prints[live], bucket[live]
                bucket = self._other(bucket, prints, size)
        return prints, bucket

    def delete(self, keys: np.ndarray) -> None:
        t = self.table
        prints, spot = self._print_of(np.asarray(keys))
        one = spot & (len(t) - 1)
        two = self._other(one, prints, len(t))
        for p, *buckets in zip(prints, one, two, strict=True):
            for b in buckets:
                if (at := np.flatnonzero(t[b] == p)).size:
                    t[b, at[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return struct.pack("<II", *self.table.shape) + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        self, shape = cls.__new__(cls), struct.unpack_from("<II", data)
        self.table = np.frombuffer(data, np.uint16, offset=8).reshape(shape).copy()
        return self
