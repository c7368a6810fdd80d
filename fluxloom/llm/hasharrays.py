"""Sorted hash arrays: whole numbers in columns beside ascending keys, packed into bytes, opened as memory maps."""

from __future__ import annotations

import tempfile

import numpy as np

KEY_BITS = 56
MASK = np.uint64((1 << KEY_BITS) - 1)


def _planes(numbers: np.ndarray) -> bytes:
    """Width in bytes of the largest number, then the lowest byte of all, the next byte of all, and so on."""
    width = max((int(numbers.max(initial=0)).bit_length() + 7) // 8, 1)
    raw = np.ascontiguousarray(numbers, "<u8").view(np.uint8).reshape(-1, 8)
    return bytes([width]) + np.ascontiguousarray(raw[:, :width].T).tobytes()


def pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """``keys`` ascending, stored as differences; ``columns`` as they are. Every number takes as few bytes as the largest needs."""
    steps = np.diff(keys, prepend=keys.dtype.type(0))
    return b"".join([len(keys).to_bytes(8, "little"), *(_planes(x) for x in (steps, *columns))])


def unpack(content: bytes) -> list[np.ndarray]:
    """What was packed: keys first."""
    n, at, out = int.from_bytes(content[:8], "little"), 8, []
    while at < len(content):
        width = content[at]
        raw = np.zeros((n, 8), np.uint8)
        raw[:, :width] = np.frombuffer(content, np.uint8, width * n, at + 1).reshape(width, n).T
        out.append(raw.view("<u8").ravel())
        at += 1 + width * n
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the hash space, so ascending keys have ascending shards."""
    return ((keys >> np.uint64(16)) * np.uint64(shards) >> np.uint64(KEY_BITS - 16)).astype(np.int64)


def by_shard(shards: int, keys: np.ndarray, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    """(shard, packed part) of every shard that ascending ``keys`` have entries in."""
    if not len(keys):
        return []
    of = shard_of(keys, shards)
    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(keys)]
    return [(int(of[a]), pack(keys[a:z], *(c[a:z] for c in columns))) for a, z in zip(cuts, cuts[1:])]


def summed(keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, ascending, and the sum of every column over each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return [keys[at], *(np.add.reduceat(c[order], at) if len(at) else c for c in columns)]


class MappedShard:
    """One shard, its arrays in a file of the task's own that is mapped, not read, and gone when the shard is dropped."""

    def __init__(self, content: bytes | None, columns: int):
        arrays = unpack(content) if content is not None else [np.zeros(0, np.uint64)] * (columns + 1)
        self.n = len(arrays[0])
        self.maps = arrays
        if self.n:
            self._file = tempfile.TemporaryFile()
            for array in arrays:
                self._file.write(array.tobytes())
            self._file.flush()
            self.maps = [np.memmap(self._file, "<u8", "r", 8 * self.n * k, (self.n,)) for k in range(len(arrays))]

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        """The columns at ``keys``; zero where a key is not in the shard."""
        at = np.minimum(np.searchsorted(self.maps[0], keys), max(self.n - 1, 0))
        if not self.n:
            return [np.zeros(len(keys), np.uint64) for _ in self.maps[1:]]
        known = self.maps[0][at] == keys
        return [np.where(known, column[at], np.uint64(0)) for column in self.maps[1:]]
