"""Columns of integers packed into binary values, each in as many bytes as its largest needs.

Shuffles between numeric stages carry a few such values per task and shard in place of a row per number: map tasks
combine first, rows cost no header, and reducers work on whole arrays.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def pack(*columns: np.ndarray) -> bytes:
    """Equally long columns of 64-bit integers (or what fits them)."""
    n, out = len(columns[0]), []
    head = [n, len(columns)]
    for c in columns:
        c = np.ascontiguousarray(c).astype(np.int64, copy=False).view(np.uint64) if c.dtype != np.uint64 else np.ascontiguousarray(c)
        width = (int(c.max()).bit_length() + 7) // 8 if n else 0
        head.append(width)
        out.append(c.view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
    return b"".join([np.array(head, "<i8").tobytes(), *out])


def unpack(blob: bytes) -> list[np.ndarray]:
    """The columns as unsigned 64-bit integers; view them as int64 where they may be negative."""
    n, k = np.frombuffer(blob, "<i8", 2)
    widths = np.frombuffer(blob, "<i8", k, 16)
    at, out = 16 + 8 * int(k), []
    for width in widths.tolist():
        c = np.zeros((n, 8), np.uint8)
        c[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
        at += int(n) * width
        out.append(c.view(np.uint64).ravel())
    return out


def unpack_all(blobs: Iterable[bytes]) -> list[np.ndarray]:
    """Blobs of the same columns, one after another."""
    return [np.concatenate(c) for c in zip(*(unpack(b) for b in blobs))]


def split(shard: np.ndarray, *columns: np.ndarray) -> Iterable[tuple[int, bytes]]:
    """(shard, blob) of the rows of each shard, in the order they have."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else np.zeros(0, int)
    columns = tuple(c[order] for c in columns)
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(shard[a]), pack(*(c[a:b] for c in columns))


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
