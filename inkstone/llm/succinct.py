"""Bit-packed arrays and Elias-Fano sequences over bytes that may be mapped from a file; all access is vectorised."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_ONES_BEFORE = np.array([[bin(b & ((1 << k) - 1)).count("1") for k in range(9)] for b in range(256)], np.uint8)
#: The place of the k-th set bit of a byte.
_SELECT = np.array([[([i for i in range(8) if b >> i & 1] + [8] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)
_BLOCK = 8  # 64-bit words a directory entry covers


def _bits(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after another, and eight spare bytes."""
    out = []
    step = 1 << 19  # a multiple of 8, so that pieces end at whole bytes
    for i in range(0, len(values), step):
        v = np.ascontiguousarray(values[i : i + step].astype("<u8"))
        bits = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
        out.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
    return b"".join(out) + bytes(8)


def _aligned(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


class Packed:
    """Integers of ``width`` bits (up to 56) each."""

    def __init__(self, width: int, n: int, data: np.ndarray) -> None:
        self.width, self.n = width, n
        self._words = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
        self._mask = U64((1 << width) - 1)

    @staticmethod
    def encode(values: np.ndarray, width: int | None = None) -> bytes:
        if width is None:
            width = int(values.max(initial=0)).bit_length()
        return _aligned(np.array([width, len(values)], "<i8").tobytes() + _bits(values, width))

    @classmethod
    def decode(cls, data: np.ndarray) -> Packed:
        width, n = np.array(data[:16]).view("<i8").tolist()
        return cls(width, n, data[16:])

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U64)
        at = i.astype(np.int64) * self.width
        return (self._words[at >> 3] >> (at & 7).astype(U64)) & self._mask


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary with a directory of ones by block."""

    def __init__(self, n: int, low: Packed, high: np.ndarray, directory: np.ndarray) -> None:
        self.n, self.low, self._high, self._ones = n, low, high, directory
        self._zeros = np.arange(len(directory)) * (64 * _BLOCK) - directory.astype(np.int64)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        n = len(values)
        values = values.astype(U64)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        high = (values >> U64(width)).astype(np.int64) + np.arange(n)
        words = (int(high[-1]) if n else 0) // 64 + 2
        words += -words % _BLOCK
        bits = np.zeros(words * 64, np.uint8)
        bits[high] = 1
        packed = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed).reshape(-1, _BLOCK).sum(axis=1, dtype=np.int64))])
        head = np.array([n, width, words, len(ones)], "<i8").tobytes()
        return _aligned(head + ones.astype("<i8").tobytes() + packed.tobytes() + Packed.encode(values, width))

    @classmethod
    def decode(cls, data: np.ndarray) -> EliasFano:
        n, _, words, blocks = np.array(data[:32]).view("<i8").tolist()
        a, b = 32 + 8 * blocks, 32 + 8 * blocks + 8 * words
        return cls(n, Packed.decode(data[b:]), data[a:b].view("<u8"), data[32:a].view("<i8"))

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The place of the k-th (from 0) one or zero among the high bits."""
        directory = self._ones if one else self._zeros
        block = np.searchsorted(directory, k, side="right") - 1
        left = k - directory[block]
        words = self._high[block[:, None] * _BLOCK + np.arange(_BLOCK)]
        words = words if one else ~words
        count = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        word = (count <= left[:, None]).sum(axis=1)
        row = np.arange(len(k))
        left = left - np.where(word > 0, count[row, word - 1], 0)
        octets = np.ascontiguousarray(words[row, word]).view(np.uint8).reshape(-1, 8)
        count = np.cumsum(np.bitwise_count(octets), axis=1, dtype=np.int64)
        octet = (count <= left[:, None]).sum(axis=1)
        left = left - np.where(octet > 0, count[row, octet - 1], 0)
        return (block * _BLOCK + word) * 64 + octet * 8 + _SELECT[octets[row, octet], left]

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int64)
        if not len(i):
            return np.zeros(0, U64)
        return ((self._select(i, True) - i).astype(U64) << U64(self.low.width)) | self.low[i]

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of each value in a sequence without repeats."""
        values = values.astype(U64)
        if not len(values) or not self.n:
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        high, low = (values >> U64(self.low.width)).astype(np.int64), values & U64((1 << self.low.width) - 1)
        most = len(self._high) * 64 - self.n  # zeros
        inside = high < most
        h = np.where(inside, high, 0)
        first = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) + 1 - h, 0)
        end = np.minimum(self._select(h, False) - h, self.n)
        place, found = search(self.low, np.where(inside, first, 0), np.where(inside, end, 0), low)
        return place, found


def search(packed: Packed, first: np.ndarray, end: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value, the place of its successor among packed[first:end], which ascend, and whether it equals it."""
    lo, hi = first.astype(np.int64), end.astype(np.int64)
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        less = packed[mid] < values[live]
        lo[live] = np.where(less, mid + 1, lo[live])
        hi[live] = np.where(less, hi[live], mid)
        live = live[lo[live] < hi[live]]
    found = lo < end
    at = np.flatnonzero(found)
    found[at] = packed[lo[at]] == values[at]
    return lo, found


def sections(*parts: bytes) -> bytes:
    """Several encodings in one file."""
    parts = tuple(_aligned(p) for p in parts)
    return np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def split_sections(data: np.ndarray) -> list[np.ndarray]:
    n = int(np.array(data[:8]).view("<i8")[0])
    size = np.array(data[8 : 8 + 8 * n]).view("<i8")
    ends = 8 + 8 * n + np.cumsum(size)
    return [data[e - s : e] for e, s in zip(ends.tolist(), size.tolist())]
