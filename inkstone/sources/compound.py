"""Compound files: sectors, allocation chains and a directory tree in one file, read and built.

Versions 3 (512-byte sectors) and 4 (4096). A chain is followed at most once through any sector, so that damage ends in
an error and not in a loop.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from .errors import CorruptCompound, NotCompound, TooLarge

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
FREE, END, FAT, DIFAT = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC
MINI_CUTOFF, MINI = 4096, 64
MAX_FILE, MAX_STREAM, MAX_ENTRIES, MAX_DEPTH = 512 << 20, 256 << 20, 1_000_000, 128
KINDS = {1: "storage", 2: "stream", 5: "root"}


@dataclass(frozen=True)
class Entry:
    path: str
    kind: str
    size: int
    start: int


class Compound:
    """Entries by path, in the order of the tree, and the bytes of any stream."""

    def __init__(self, data: bytes, max_file: int = MAX_FILE, max_stream: int = MAX_STREAM, max_entries: int = MAX_ENTRIES) -> None:
        if len(data) > max_file:
            raise TooLarge(f"a file of {len(data)} bytes")
        if data[:8] != MAGIC:
            raise NotCompound("no compound file signature")
        if len(data) < 512:
            raise CorruptCompound("the header is cut off")
        self.max_stream, self.repairs = max_stream, []
        major, order, shift, mini_shift = struct.unpack_from("<HHHH", data, 26)
        if (major, shift) not in ((3, 9), (4, 12)) or order != 0xFFFE or mini_shift != 6:
            raise CorruptCompound(f"version {major}, byte order {order:#x}, sector shifts {shift} and {mini_shift}")
        self.major, self.sector = major, 1 << shift
        self.n_fat, first_dir, _, cutoff, mini_fat, n_mini_fat, difat, n_difat = struct.unpack_from("<IIIIIIII", data, 44)
        if cutoff != MINI_CUTOFF:
            raise CorruptCompound(f"mini stream cutoff {cutoff}")
        body = data[self.sector :]
        if len(body) % self.sector:  # some writers leave out the end of the last sector
            body += bytes(-len(body) % self.sector)
            self.repairs.append("last sector padded")
        self.body, self.count = body, len(body) // self.sector
        self.fat = self._table(self._fat_sectors(data, difat, n_difat))
        mini = self._chain(mini_fat, self.fat) if n_mini_fat and mini_fat != END else []
        self.mini_fat = self._table(mini)
        self.entries: dict[str, Entry] = {}
        self._read_directory(first_dir, max_entries)
        root = self.entries[""]
        self.mini_stream = self._join(self._chain(root.start, self.fat), root.size) if root.size else b""

    def _at(self, sector: int) -> bytes:
        if not 0 <= sector < self.count:
            raise CorruptCompound(f"sector {sector} of {self.count}")
        return self.body[sector * self.sector : (sector + 1) * self.sector]

    def _table(self, sectors: list[int]) -> np.ndarray:
        return np.frombuffer(b"".join(self._at(s) for s in sectors), "<u4")

    def _fat_sectors(self, data: bytes, difat: int, n_difat: int) -> list[int]:
        out = [s for s in struct.unpack_from("<109I", data, 76) if s != FREE]
        seen = set()
        while difat not in (END, FREE):
            if difat in seen or len(seen) > self.count:
                raise CorruptCompound("the chain of allocation sectors loops")
            seen.add(difat)
            *own, difat = struct.unpack(f"<{self.sector // 4}I", self._at(difat))
            out += [s for s in own if s != FREE]
        if len(seen) != n_difat or len(out) < self.n_fat:
            raise CorruptCompound(f"{len(out)} allocation sectors by {len(seen)} lists; the header says {self.n_fat} by {n_difat}")
        return out[: self.n_fat]

    def _chain(self, start: int, table: np.ndarray) -> list[int]:
        out, at = [], start
        while at != END:
            if at >= len(table) or len(out) > len(table):
                raise CorruptCompound(f"a chain from sector {start} leaves the table or loops")
            out.append(at)
            at = int(table[at])
        return out

    def _join(self, sectors: list[int], size: int) -> bytes:
        if size > len(sectors) * self.sector:
            raise CorruptCompound(f"{size} bytes in {len(sectors)} sectors")
        return b"".join(self._at(s) for s in sectors)[:size]

    def _read_directory(self, first: int, max_entries: int) -> None:
        raw = b"".join(self._at(s) for s in self._chain(first, self.fat))
        n = len(raw) // 128
        if n > max_entries:
            raise TooLarge(f"{n} directory entries")
        rows = []
        for i in range(n):
            name, size, kind, _, left, right, child = struct.unpack_from("<64sHBBIII", raw, 128 * i)
            start, length = struct.unpack_from("<IQ", raw, 128 * i + 116)
            if self.major == 3:
                length &= 0xFFFFFFFF
            rows.append((name[: max(0, size - 2)].decode("utf-16-le", "replace"), kind, left, right, child, start, length))
        if not rows or rows[0][1] != 5:
            raise CorruptCompound("the directory has no root")
        if rows[0][0] != "Root Entry":
            self.repairs.append("root renamed")
        self.entries[""] = Entry("", "root", rows[0][6], rows[0][5])
        seen = {0}
        # An in-order walk without recursion: the tree of a storage, then the trees below it.
        todo = [("", rows[0][4], 0)]
        while todo:
            prefix, top, depth = todo.pop()
            if depth > MAX_DEPTH:
                raise CorruptCompound("storages are nested too deeply")
            stack, at = [], top
            while stack or at < n:
                while at < n:
                    if at in seen:
                        raise CorruptCompound("the directory tree loops")
                    seen.add(at)
                    stack.append(at)
                    at = rows[at][2]
                at = stack.pop()
                name, kind, _, right, child, start, length = rows[at]
                if kind not in (1, 2):
                    self.repairs.append("stale sibling")
                else:
                    path = f"{prefix}/{name}" if prefix else name
                    if path in self.entries:
                        raise CorruptCompound(f"two entries are called {path}")
                    self.entries[path] = Entry(path, KINDS[kind], length, start)
                    if kind == 1:
                        todo.append((path, child, depth + 1))
                at = right

    def read(self, path: str) -> bytes:
        e = self.entries.get(path)
        if e is None or e.kind != "stream":
            raise CorruptCompound(f"no stream {path}")
        if e.size > self.max_stream:
            raise TooLarge(f"a stream of {e.size} bytes")
        if not e.size:
            return b""
        if e.size >= MINI_CUTOFF:
            return self._join(self._chain(e.start, self.fat), e.size)
        sectors = self._chain(e.start, self.mini_fat)
        if e.size > len(sectors) * MINI or max(sectors, default=0) * MINI >= max(1, len(self.mini_stream)):
            raise CorruptCompound(f"{path} lies outside the mini stream")
        return b"".join(self.mini_stream[s * MINI : (s + 1) * MINI] for s in sectors)[: e.size]

    def storage(self, path: str) -> dict[str, bytes]:
        """All streams below a storage, by path within it."""
        return {p[len(path) + 1 :]: self.read(p) for p, e in self.entries.items() if p.startswith(f"{path}/") and e.kind == "stream"}


def build(streams: dict[str, bytes], sector: int = 512) -> bytes:
    """A compound file of the given streams; storages follow from the paths."""
    names = {""}
    for path in streams:
        parts = path.split("/")
        names.update("/".join(parts[:k]) for k in range(1, len(parts) + 1))
    order = ["", *sorted(names - {""})]
    number = {p: i for i, p in enumerate(order)}
    children: dict[str, list[str]] = {p: [] for p in order}
    for p in order[1:]:
        children[p.rpartition("/")[0]].append(p)
    none = FREE
    left, right, child = [none] * len(order), [none] * len(order), [none] * len(order)

    def balanced(some: list[str]) -> int:
        if not some:
            return none
        k = len(some) // 2
        i = number[some[k]]
        left[i], right[i] = balanced(some[:k]), balanced(some[k + 1 :])
        return i

    for p, own in children.items():
        own.sort(key=lambda x: (len(x.rpartition("/")[2].encode("utf-16-le")), x.rpartition("/")[2].upper()))
        child[number[p]] = balanced(own)

    table: list[int] = []
    body: list[bytes] = []

    def chain(data: bytes) -> int:
        n = -(-len(data) // sector)
        if not n:
            return END
        first = len(table)
        table.extend([*range(first + 1, first + n), END])
        body.append(data + bytes(-len(data) % sector))
        return first

    starts, mini, mini_table = {}, b"", []
    for p, data in streams.items():
        if len(data) >= MINI_CUTOFF:
            starts[p] = chain(data)
        elif data:
            n = -(-len(data) // MINI)
            starts[p] = len(mini_table)
            mini_table += [*range(len(mini_table) + 1, len(mini_table) + n), END]
            mini += data + bytes(-len(data) % MINI)
        else:
            starts[p] = END
    root_start = chain(mini)
    mini_raw = struct.pack(f"<{len(mini_table)}I", *mini_table)
    mini_raw += b"\xff" * (-len(mini_raw) % sector)
    mini_start = chain(mini_raw)
    rows = []
    for i, p in enumerate(order):
        name = ("Root Entry" if not p else p.rpartition("/")[2]).encode("utf-16-le") + b"\0\0"
        kind = 5 if not p else 2 if p in streams else 1
        size, start = (len(mini), root_start) if not p else (len(streams.get(p, b"")), starts.get(p, 0))
        rows.append(struct.pack("<64sHBBIII16sIQQIQ", name, len(name), kind, 1, left[i], right[i], child[i], b"", 0, 0, 0, start, size))
    blank = struct.pack("<64sHBBIII16sIQQIQ", b"", 0, 0, 0, none, none, none, b"", 0, 0, 0, 0, 0)
    rows += [blank] * (-len(rows) % (sector // 128))
    first_dir = chain(b"".join(rows))
    each = sector // 4
    n_fat, n_difat = 0, 0
    while (need := -(-(len(table) + n_fat + n_difat) // each)) > n_fat or n_difat < -(-max(0, need - 109) // (each - 1)):
        n_fat, n_difat = max(n_fat, need), -(-max(0, max(n_fat, need) - 109) // (each - 1))
    fat_at = [len(table) + k for k in range(n_fat)]
    difat_at = [len(table) + n_fat + k for k in range(n_difat)]
    table += [FAT] * n_fat + [DIFAT] * n_difat
    table += [FREE] * (n_fat * each - len(table))
    body.append(struct.pack(f"<{len(table)}I", *table))
    rest = fat_at[109:]
    for k in range(n_difat):
        own = rest[k * (each - 1) : (k + 1) * (each - 1)]
        body.append(struct.pack(f"<{each}I", *own, *[FREE] * (each - 1 - len(own)), difat_at[k + 1] if k + 1 < n_difat else END))
    head = struct.pack("<8s16sHHHHHHIIIIIIIIII", MAGIC, b"", 0x3E, 3 if sector == 512 else 4, 0xFFFE, sector.bit_length() - 1, 6, 0, 0, 0 if sector == 512 else len(rows) * 128 // sector, n_fat, first_dir, 0, MINI_CUTOFF, mini_start if mini else END, len(mini_raw) // sector, difat_at[0] if n_difat else END, n_difat)
    head += struct.pack("<109I", *fat_at[:109], *[FREE] * (109 - min(109, n_fat)))
    return head + bytes(sector - len(head)) + b"".join(body)
