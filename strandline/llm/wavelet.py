"""A wavelet matrix: a sequence of ids as bit-planes with rank and select.

Plane k holds one bit of each id, the highest first, in an order in which each plane
before has put its zeros before its ones, keeping the order among equals. Beside each
plane stands how many ones precede every block of 512 bits, so that a rank is a lookup
and a count within a block.
"""

from __future__ import annotations

import hashlib
import json
import struct

import numpy as np
import zstandard

MAGIC = b"SLWM0001"
BLOCK = 512


class WaveletMatrix:
    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray] | None = None):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.ranks = ranks or [self._blocks(p) for p in planes]

    @staticmethod
    def _blocks(plane: np.ndarray) -> np.ndarray:
        whole = np.zeros(-(-len(plane) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        whole[: len(plane)] = plane
        ones = np.bitwise_count(whole.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
        return np.concatenate((np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)))

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        bits = bits or max(1, int(ids.max()).bit_length() if len(ids) else 1)
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for k in range(bits - 1, -1, -1):
            bit = (now & now.dtype.type(1 << k)) != 0
            planes.append(np.packbits(bit))
            low = now[~bit]
            zeros.append(len(low))
            now = np.concatenate((low, now[bit]))
        return cls(len(ids), planes, zeros)

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 3]) >> (7 - (i & 7)) & 1

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before position i."""
        at = i // BLOCK
        tail = self.planes[k][at * BLOCK // 8 : (i + 7) // 8]
        bits = np.unpackbits(tail)[: i - at * BLOCK]
        return int(self.ranks[k][at]) + int(bits.sum())

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for k in range(len(self.planes)):
            bit, ones = self._bit(k, i), self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, symbol: int, low: int, high: int) -> tuple[int, int]:
        for k in range(len(self.planes)):
            a, b = self._ones(k, low), self._ones(k, high)
            low, high = (self.zeros[k] + a, self.zeros[k] + b) if symbol >> (len(self.planes) - 1 - k) & 1 else (low - a, high - b)
        return low, high

    def count(self, symbol: int, low: int = 0, high: int | None = None) -> int:
        """How often the id stands in positions low to high - 1."""
        if symbol >> len(self.planes):
            return 0
        a, b = self._range(symbol, low, self.n if high is None else high)
        return b - a

    def select(self, symbol: int, k: int) -> int:
        """The position of occurrence k (from 0) of the id, or -1."""
        if symbol >> len(self.planes):
            return -1
        low, high = self._range(symbol, 0, self.n)
        if k < 0 or low + k >= high:
            return -1
        at = low + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = symbol >> (len(self.planes) - 1 - level) & 1
            at = self._find(level, at - self.zeros[level] if one else at, bool(one))
        return at

    def _find(self, k: int, nth: int, ones: bool) -> int:
        """The position of the nth one (or zero) of plane k."""
        ranks = self.ranks[k].astype(np.int64)
        before = ranks if ones else np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(before, nth, side="right")) - 1
        bits = np.unpackbits(self.planes[k][block * BLOCK // 8 : (block + 1) * BLOCK // 8])[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == ones)[nth - int(before[block])])

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up."""
        bits = len(self.planes)
        now = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for k in range(bits - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.n).view(bool)
            out = np.empty_like(now)
            out[~one] = now[: self.zeros[k]]
            out[one] = now[self.zeros[k] :] | now.dtype.type(1 << (bits - 1 - k))
            now = out
        return now


def dump(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, bits: int | None = None) -> bytes:
    """A shard file: magic, header with sizes, then each part compressed: lengths, planes and their ranks."""
    w = WaveletMatrix.build(ids, bits)
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [pack(lengths.astype("<i8").tobytes())] + [pack(p.tobytes()) for p in w.planes] + [pack(r.astype("<u4").tobytes()) for r in w.ranks]
    body = b"".join(parts)
    head = {"n": w.n, "zeros": w.zeros, "docs": doc_ids, "parts": [len(p) for p in parts], "sha1": hashlib.sha1(body).hexdigest()}
    packed = pack(json.dumps(head).encode())
    return MAGIC + struct.pack("<Q", len(packed)) + packed + body


def load(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix, document ids and lengths of a shard file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    open_ = zstandard.ZstdDecompressor().decompress
    (size,) = struct.unpack("<Q", data[8:16])
    head = json.loads(open_(data[16 : 16 + size]))
    body = memoryview(data)[16 + size :]
    if hashlib.sha1(body).hexdigest() != head["sha1"]:
        raise ValueError("a token file is damaged")
    parts, at = [], 0
    for n in head["parts"]:
        parts.append(open_(body[at : at + n]))
        at += n
    bits = len(head["zeros"])
    planes = [np.frombuffer(p, np.uint8) for p in parts[1 : 1 + bits]]
    ranks = [np.frombuffer(p, "<u4") for p in parts[1 + bits :]]
    return WaveletMatrix(head["n"], planes, head["zeros"], ranks), head["docs"], np.frombuffer(parts[0], "<i8")
