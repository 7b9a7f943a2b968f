"""Vectorised word and n-gram hashing over Arrow string arrays.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII bytes of the lower-cased text; everything else
separates.  Words never cross documents.  A null text is an empty text: it has no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _a, _b in ((48, 57), (65, 90), (97, 122)):
    _WORD[_a : _b + 1] = True
_KIND = np.where(_WORD, 1, 2).astype(np.uint8)
_KIND[:33] = 0
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=U64)
_C1, _C2, _C3 = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xC2B2AE3D27D4EB4F)
_S32 = U64(32)
LONG_WORD = 64
try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None

#: Texts are hashed in slices of about so many bytes, which bounds the worker's memory; one longer text is a slice.
SLICE_BYTES = 4 << 20


class Words(NamedTuple):
    """Words of a slice of documents: hashes, byte spans in ``data``, and where each document's words begin."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # len(documents) + 1
    data: np.ndarray
    offsets: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S32)) * _C2
    h = (h ^ (h >> _S32)) * _C2
    return h ^ (h >> _S32)


def one_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another (eight zero bytes follow) and the offset of each."""
    texts = pc.fill_null(one_array(texts), "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    out = np.zeros(last - first + 8, np.uint8)
    if last > first:
        out[:-8] = np.frombuffer(data, np.uint8, last - first, first)
    return out, offsets - first


def lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(one_array(texts))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, eight bytes a step; ``data`` ends in eight spare bytes."""
    size = ends - starts
    h = mix(size.astype(U64) * _C1 + _C3)
    if not len(starts):
        return h
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    live = np.flatnonzero(size <= LONG_WORD)
    k = 0
    while len(live):
        left = size[live] - k
        part = eight[starts[live] + k] & _MASK[np.minimum(left, 8)]
        h[live] = mix((h[live] ^ part) * _C1 + _C3)
        k += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 7)
    return h


def _runs(texts: pa.Array, kinds: np.ndarray) -> Words:
    """Maximal runs of bytes of one kind; kind 0 separates."""
    data, offsets = flat(texts)
    n = len(data) - 8
    kind = kinds[data[:n]]
    edge = np.ones(n + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    inside = kind[starts] != 0 if n else np.zeros(0, bool)
    starts, ends = starts[inside], ends[inside]
    return Words(word_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, offsets), data, offsets)


def words(texts: pa.Array) -> Words:
    """Words of every text."""
    return _runs(lower(texts), _WORD.astype(np.uint8))


def word_puncts(texts: pa.Array) -> Words:
    """Words and, as units of their own, runs of other visible characters; case counts."""
    return _runs(texts, _KIND)


def grams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words within a unit, and where each unit's runs begin. A unit of 1 to n - 1 words has
    one run, all its words."""
    size = np.diff(bounds)
    count = np.where(size >= n, size - n + 1, (size > 0).astype(size.dtype))
    out = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    at = np.repeat(bounds[:-1] - out[:-1], count) + np.arange(out[-1])
    if n == 1:
        return hashes[at], out
    padded = np.concatenate([hashes, np.zeros(n, U64)])
    h = np.full(len(at), n, U64)
    for k in range(n):
        h = mix(h * _C1 + padded[at + k])
    for u in np.flatnonzero((size > 0) & (size < n)):
        v = np.full(1, 0x5851F42D4C957F2D, U64)
        for w in hashes[bounds[u] : bounds[u + 1]]:
            v = mix(v * _C1 + w)
        h[out[u]] = v[0]
    return h, out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; ``np.unique`` hashes where it need not sort, which is far slower on 64-bit integers."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    return values[keep]


def unit_sets(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each unit in ascending order, and where each unit's begin."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    bits = U64(max(1, n.bit_length()))
    order = np.argsort((owner.astype(U64) << (U64(64) - bits)) | (values >> bits))
    values, owner = values[order], owner[order]
    same = owner[1:] == owner[:-1]
    if (same & (values[1:] < values[:-1])).any():  # values of a unit that agree in all but their last bits
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    out = np.zeros(len(bounds), np.int64)
    np.cumsum(np.bincount(owner, minlength=n), out=out[1:])
    return values, out


def set_hash(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each unit's set of values (order does not matter); 0 for an empty one."""
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(mix(values * _C3 + _C1), out=sums[1:])
    xors = np.zeros(len(bounds) - 1, U64)
    size = np.diff(bounds)
    full = np.flatnonzero(size > 0)
    if len(full):
        xors[full] = np.bitwise_xor.reduceat(mix(values ^ _C2), bounds[:-1][full])
    h = mix((sums[bounds[1:]] - sums[bounds[:-1]]) * _C1 + mix(xors + size.astype(U64)))
    return np.where(size > 0, np.maximum(h, U64(1)), U64(0))


def release() -> None:
    """Gives freed memory back to the system: a worker lives on, and its neighbours share the executor's memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a piece take about ``most`` bytes; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        i, done = 0, 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(i, j - i)
            done, i = int(ends[j - 1]), j
    release()
