"""What can be wrong with a document: one class per kind, none of which stops a job."""

from __future__ import annotations

import struct


class DocumentError(ValueError):
    """Damage that could change what the document says; the row carries its class and message."""


class NotCompound(DocumentError):
    pass


class CorruptCompound(DocumentError):
    pass


class TooLarge(DocumentError):
    pass


class NotWordDocument(DocumentError):
    pass


class UnsupportedVersion(DocumentError):
    pass


class NeedsPassword(DocumentError):
    pass


class WrongPassword(DocumentError):
    pass


class CorruptDocument(DocumentError):
    pass


def take(data: bytes, fmt: str, at: int) -> tuple:
    """Little-endian fields at a place; damage where the data end before."""
    try:
        return struct.unpack_from("<" + fmt, data, at)
    except struct.error as e:
        raise CorruptDocument(f"{len(data)} bytes hold no {fmt} at {at}") from e


def part(data: bytes, at: int, size: int) -> bytes:
    if at < 0 or size < 0 or at + size > len(data):
        raise CorruptDocument(f"{len(data)} bytes hold no {size} at {at}")
    return data[at : at + size]
