"""Token shards as wavelet matrices: one compressed file with access, counting and occurrence lookup.

Layout of a shard, all numbers little-endian:

* ``FWM1``, then as 64-bit numbers: tokens, documents, bits per token, tokens per block;
* per plane, highest bit first: zeros in the plane, then per block the place of its bytes in the body and the ones
  before it (64-bit each), then one closing place;
* four places (64-bit) of the document section: ids, null marks, lengths, end;
* the body: per plane and block Zstandard frames of the plane's bits (lowest bit of a byte first), then the document
  section, also in frames.

Plane ``k`` holds bit ``k`` of every token in the order left by the planes above: each of them moves its zeros, in
order, before its ones. Rank and select decompress one block per plane and count inside it.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import zstandard

MAGIC = b"FWM1"
BLOCK_TOKENS = 1 << 16
HEAD = struct.Struct("<4s4Q")


def _frames(bits: np.ndarray, block: int, pack) -> tuple[list[bytes], np.ndarray]:
    frames, ones = [], []
    for at in range(0, max(len(bits), 1), block):
        part = bits[at : at + block]
        ones.append(int(np.count_nonzero(part)))
        frames.append(pack(np.packbits(part, bitorder="little").tobytes()))
    return frames, np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u8")


def build(tokens: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, block: int = BLOCK_TOKENS) -> bytes:
    """A shard of the documents' tokens, one after the other."""
    pack = zstandard.ZstdCompressor(level=1).compress
    width = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
    order = tokens.astype(np.uint16 if width <= 16 else np.uint32)
    directory, body, place = [], [], 0

    def put(frame: bytes) -> int:
        nonlocal place
        body.append(frame)
        place += len(frame)
        return place - len(frame)

    for bit in range(width - 1, -1, -1):
        bits = (order >> order.dtype.type(bit) & order.dtype.type(1)).view(np.uint8)[:: order.itemsize].astype(bool)
        frames, before = _frames(bits, block, pack)
        first = [put(frame) for frame in frames]
        zeros = order[np.flatnonzero(~bits)]
        order = np.concatenate([zeros, order[np.flatnonzero(bits)]])
        table = np.empty((len(frames), 2), "<u8")
        table[:, 0], table[:, 1] = first, before
        directory.append(struct.pack("<Q", len(zeros)) + table.tobytes() + struct.pack("<Q", place))
    known = np.array([x is not None for x in doc_ids], bool)
    ids = np.array([x or 0 for x in doc_ids], "<i8")
    section = [put(pack(ids.tobytes())), put(pack(np.packbits(known).tobytes())),
               put(pack(np.asarray(lengths, "<u8").tobytes())), place]
    head = HEAD.pack(MAGIC, len(tokens), len(doc_ids), width, block)
    return head + b"".join(directory) + struct.pack("<4Q", *section) + b"".join(body)


class WaveletShard:
    """Reads a shard; only the blocks that a question touches are decompressed."""

    def __init__(self, data: bytes):
        magic, self.n, self.n_docs, self.width, self.block = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("no token shard")
        self.data, at = data, HEAD.size
        blocks = max(1, -(-self.n // self.block))
        self.zeros, self.places, self.before = [], [], []
        for _ in range(self.width):
            self.zeros.append(struct.unpack_from("<Q", data, at)[0])
            table = np.frombuffer(data, "<u8", 2 * blocks, at + 8).reshape(-1, 2)
            at += 8 + 16 * blocks
            self.places.append([*table[:, 0].tolist(), struct.unpack_from("<Q", data, at)[0]])
            self.before.append(table[:, 1].tolist())
            at += 8
        self.section = struct.unpack_from("<4Q", data, at)
        self.body = at + 32
        self._block = lru_cache(maxsize=4 * self.width)(self._read_block)

    def _unpack(self, start: int, stop: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.data[self.body + start : self.body + stop])

    def _read_block(self, plane: int, k: int) -> np.ndarray:
        raw = self._unpack(self.places[plane][k], self.places[plane][k + 1])
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=min(self.block, self.n - k * self.block), bitorder="little")

    def _plane(self, plane: int) -> np.ndarray:
        raw = b"".join(self._unpack(a, z) for a, z in zip(self.places[plane], self.places[plane][1:]))
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        k, rest = divmod(i, self.block)
        return self.before[plane][k] + int(np.count_nonzero(self._block(plane, k)[:rest]))

    def access(self, i: int) -> int:
        """The token at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for plane in range(self.width):
            k, rest = divmod(i, self.block)
            bit = int(self._block(plane, k)[rest])
            ones = self._ones(plane, i)
            i = self.zeros[plane] + ones if bit else i - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        for plane in range(self.width):
            a, z = self._ones(plane, start), self._ones(plane, stop)
            if token >> (self.width - 1 - plane) & 1:
                start, stop = self.zeros[plane] + a, self.zeros[plane] + z
            else:
                start, stop = start - a, stop - z
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of the token among places ``start`` to ``stop`` (exclusive)."""
        stop = self.n if stop is None else min(stop, self.n)
        if token < 0 or token >> self.width or start >= stop:
            return 0
        a, z = self._range(token, start, stop)
        return z - a

    def locate(self, token: int, k: int) -> int:
        """Place of the ``k``-th occurrence (from 0)."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, 0, self.n)[0] + k
        for plane in range(self.width - 1, -1, -1):
            one = token >> (self.width - 1 - plane) & 1
            i = self._select(plane, one, i - self.zeros[plane] if one else i)
        return i

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Place of the ``k``-th one or zero of a plane."""
        before = self.before[plane]
        low, high = 0, len(before) - 1
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if (before[mid] if bit else mid * self.block - before[mid]) <= k else (low, mid - 1)
        k -= before[low] if bit else low * self.block - before[low]
        return low * self.block + int(np.flatnonzero(self._block(plane, low) == bit)[k])

    def tokens(self) -> np.ndarray:
        """All tokens, in order."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        order = np.zeros(self.n, kind)
        for plane in range(self.width - 1, -1, -1):
            bits, above = self._plane(plane), np.empty(self.n, kind)
            above[np.flatnonzero(~bits)] = order[: self.zeros[plane]]
            above[np.flatnonzero(bits)] = order[self.zeros[plane] :]
            above |= bits.astype(kind) << kind(self.width - 1 - plane)
            order = above
        return order

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids and numbers of tokens, in order."""
        a, b, c, d = self.section
        ids = np.frombuffer(self._unpack(a, b), "<i8").tolist()
        known = np.unpackbits(np.frombuffer(self._unpack(b, c), np.uint8), count=self.n_docs).tolist()
        return [x if k else None for x, k in zip(ids, known)], np.frombuffer(self._unpack(c, d), "<u8").astype(np.int64)
