"""Passwords of documents: XOR obfuscation and RC4 in blocks, vectorised over a stream.

Both published schemes re-key RC4 every 512 bytes, so all blocks of a stream are independent: one numpy step advances all
of them together.
"""

from __future__ import annotations

import hashlib
import hmac
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from .errors import CorruptDocument, NeedsPassword, UnsupportedVersion, WrongPassword, part, take

BLOCK, CLEAR = 512, 68
#: Blocks from which all are advanced together.
FEW = 128
_PAD = bytes.fromhex("BBFFFFBAFFFFB98000BE0F00BF0F00")


def _lfsr(value: int) -> int:
    """One step of the 16-bit register with polynomial x^16 + x^12 + x^5 + 1."""
    return (value << 1 & 0xFFFF) ^ (0x1021 if value & 0x8000 else 0)


def _narrow(password: str) -> bytes:
    units = np.frombuffer(password.encode("utf-16-le"), "<u2")[:15]
    return bytes(int(u & 0xFF or u >> 8) for u in units)


def xor_key(password: bytes) -> int:
    """The key is that register: started at 0xFFFF, run over as many zero bytes, and seven bits of each character from
    the last to the first."""
    key = 0xFFFF
    for _ in range(8 * len(password)):
        key = _lfsr(key)
    tap = 0x1021
    for c in reversed(password):
        for bit in range(8):
            if bit < 7 and c >> bit & 1:
                key ^= tap
            tap = _lfsr(tap)
    return key


def xor_verifier(password: bytes) -> int:
    h = 0
    for c in reversed(password):
        h = (h >> 14 & 1 | h << 1 & 0x7FFF) ^ c
    return (h >> 14 & 1 | h << 1 & 0x7FFF) ^ len(password) ^ 0xCE4B


def xor_check(password: str) -> int:
    """The 32-bit value that the header keeps."""
    p = _narrow(password)
    return xor_key(p) << 16 | xor_verifier(p)


def xor_stream(data: bytes, password: str, clear: int = 0) -> bytes:
    """Obfuscates and restores: zero bytes, and those that would become zero, stay."""
    p = _narrow(password)
    key = xor_key(p)
    pads = np.frombuffer((p + _PAD)[:16], np.uint8) ^ np.array([key & 0xFF, key >> 8] * 8, np.uint8)
    pads = pads >> 1 | pads << 7
    raw = np.frombuffer(data, np.uint8)
    other = raw ^ np.resize(pads, len(raw))
    keep = (raw == 0) | (other == 0) | (np.arange(len(raw)) < clear)
    return np.where(keep, raw, other).tobytes()


@lru_cache(maxsize=4096)
def _pad(key: bytes, size: int) -> bytes:
    """What RC4 adds to a block, for streams too short to be worth a numpy call a step. The streams of a document number their
    blocks alike, and documents may share a salt: blocks of one key have one keystream."""
    box, b = list(range(256)), 0
    for a, k in enumerate((key * (256 // len(key) + 1))[:256]):
        x = box[a]
        b = b + x + k & 255
        box[a], box[b] = box[b], x
    b, out = 0, bytearray(size)
    for n in range(size):
        a = n + 1 & 255
        x = box[a]
        b = b + x & 255
        box[a] = y = box[b]
        box[b] = x
        out[n] = box[x + y & 255]
    return bytes(out)


def _keystream(key: bytes, block: bytes) -> bytes:
    """RC4 of one block by itself."""
    return rc4_blocks(block, [key], len(block))


def rc4_blocks(data: bytes, keys: list[bytes], size: int = BLOCK) -> bytes:
    """RC4 of every block of ``data`` under its own key."""
    n = len(keys)
    if n < FEW:
        return (np.frombuffer(data, np.uint8) ^ np.frombuffer(b"".join(_pad(k, size) for k in keys), np.uint8)[: len(data)]).tobytes()
    rows = np.arange(n)
    key = np.array([np.frombuffer(k, np.uint8) for k in keys], np.int64)
    s = np.tile(np.arange(256, dtype=np.uint8), (n, 1))
    j = np.zeros(n, np.int64)
    for i in range(256):
        j = (j + s[:, i] + key[:, i % key.shape[1]]) & 255
        s[rows, j], s[:, i] = s[:, i].copy(), s[rows, j]
    out = np.zeros((n, size), np.uint8)
    j[:] = 0
    for k in range(min(size, len(data))):
        i = (k + 1) & 255
        j = (j + s[:, i]) & 255
        s[rows, j], s[:, i] = s[:, i].copy(), s[rows, j]
        out[:, k] = s[rows, (s[:, i].astype(np.int64) + s[rows, j]) & 255]
    raw = np.frombuffer(data, np.uint8)
    return (raw ^ out.ravel()[: len(raw)]).tobytes()


def _blocks(data: bytes, key_of: Callable[[int], bytes]) -> bytes:
    return rc4_blocks(data, [key_of(k) for k in range(-(-len(data) // BLOCK))])


def md5_key(password: str, salt: bytes) -> Callable[[int], bytes]:
    wide = password[:255].encode("utf-16-le")
    first = hashlib.md5(wide).digest()[:5]
    seed = hashlib.md5(16 * (first + salt)).digest()[:5]
    return lambda block: hashlib.md5(seed + struct.pack("<I", block)).digest()


def sha1_key(password: str, salt: bytes, bits: int) -> Callable[[int], bytes]:
    seed = hashlib.sha1(salt + password.encode("utf-16-le")).digest()

    def key(block: int) -> bytes:
        k = hashlib.sha1(seed + struct.pack("<I", block)).digest()[: bits // 8]
        return k + bytes(11) if bits == 40 else k

    return key


def rc4_header(password: str, salt: bytes, verifier: bytes) -> bytes:
    """The header of MD5-keyed RC4, as it opens the table stream."""
    key = md5_key(password, salt)
    return struct.pack("<HH", 1, 1) + salt + rc4_blocks(verifier + hashlib.md5(verifier).digest(), [key(0)])


def capi_header(password: str, salt: bytes, verifier: bytes, bits: int = 128) -> bytes:
    """The header of SHA-1-keyed RC4."""
    key = sha1_key(password, salt, bits)
    info = struct.pack("<IIIIIIII", 4, 0, 0x6801, 0x8004, bits, 1, 0, 0) + "RC4\0".encode("utf-16-le")
    locked = rc4_blocks(verifier + hashlib.sha1(verifier).digest(), [key(0)])
    return struct.pack("<HHII", 4, 2, 4, len(info)) + info + struct.pack("<I", 16) + salt + locked[:16] + struct.pack("<I", 20) + locked[16:]


def _opened(header: bytes, password: str) -> Callable[[int], bytes]:
    version = take(header, "HH", 0)
    if version == (1, 1):
        key = md5_key(password, part(header, 4, 16))
        plain, digest = rc4_blocks(part(header, 20, 32), [key(0)]), hashlib.md5
    elif version[0] in (2, 3, 4) and version[1] == 2:
        size = take(header, "I", 8)[0]
        _, _, cipher, hashing, bits = take(header, "IIIII", 12)
        if cipher not in (0, 0x6801) or hashing not in (0, 0x8004):
            raise UnsupportedVersion(f"cipher {cipher:#x} with hash {hashing:#x}")
        bits = bits or 40
        if bits % 8 or not 40 <= bits <= 128:
            raise CorruptDocument(f"a key of {bits} bits")
        at = 12 + size
        key = sha1_key(password, part(header, at + 4, 16), bits)
        plain, digest = rc4_blocks(part(header, at + 20, 16) + part(header, at + 40, 20), [key(0)]), hashlib.sha1
    else:
        raise UnsupportedVersion(f"encryption {version}")
    if not hmac.compare_digest(digest(plain[:16]).digest(), plain[16:]):
        raise WrongPassword("the password does not open the document")
    return key


def unlock(flags: int, stored: int, password: str | None, word: bytes, tables: bytes, data: bytes) -> tuple[bytes, bytes, bytes]:
    """The three streams in clear. ``flags`` and ``stored`` are the header's: how it is locked, and the verifier or the
    size of the header of the table stream."""
    if not flags & 0x100:
        return word, tables, data
    if password is None:
        raise NeedsPassword("the document is encrypted")
    if flags & 0x8000:
        if xor_check(password) != stored:
            raise WrongPassword("the password does not open the document")
        return xor_stream(word, password, CLEAR), xor_stream(tables, password), xor_stream(data, password)
    key = _opened(part(tables, 0, stored), password)
    return word[:CLEAR] + _blocks(word, key)[CLEAR:], tables[:stored] + _blocks(tables, key)[stored:], _blocks(data, key)
