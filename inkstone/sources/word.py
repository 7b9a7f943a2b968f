"""The binary document: header, piece table, formatting pages and the tables beside the text, from the published format.

Everything here is a function of bytes; nothing keeps state between documents.
"""

from __future__ import annotations

import codecs
import re
import struct
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from inkstone.functions.dims import NUMBER_FORMATS
from inkstone.functions.scalars import NARROW_HEADERS

from . import modifiers as M
from .errors import CorruptDocument, NotWordDocument, TooLarge, UnsupportedVersion, part, take

STORIES = ("main", "footnotes", "headers", "macros", "comments", "endnotes", "textboxes", "header_textboxes")
_COUNTS = (3, 4, 5, 6, 7, 8, 9, 10)  # where the header counts the characters of each
SLOTS = {
    "styles": 1, "footnote_refs": 2, "footnote_texts": 3, "comment_refs": 4, "comment_texts": 5, "sections": 6, "headers": 11, "char_pages": 12, "para_pages": 13, "fonts": 15, "fields_main": 16, "fields_headers": 17, "fields_footnotes": 18,
    "fields_comments": 19, "bookmark_names": 21, "bookmark_starts": 22, "bookmark_ends": 23, "settings": 31, "pieces": 33, "comment_owners": 36, "comment_tags": 37, "comment_starts": 42, "comment_ends": 43, "shapes_main": 40, "shapes_headers": 41, "endnote_refs": 46, "endnote_texts": 47, "fields_endnotes": 48, "drawing": 50,
    "textbox_texts": 56, "fields_textboxes": 57, "header_textbox_texts": 58, "fields_header_textboxes": 59, "lists": 73, "list_uses": 74, "list_names": 91,
}
#: One-byte text is Latin-1 but for these.
_BYTES = {0x82: 0x201A, 0x83: 0x0192, 0x84: 0x201E, 0x85: 0x2026, 0x86: 0x2020, 0x87: 0x2021, 0x88: 0x02C6, 0x89: 0x2030, 0x8A: 0x0160, 0x8B: 0x2039, 0x8C: 0x0152, 0x91: 0x2018, 0x92: 0x2019, 0x93: 0x201C, 0x94: 0x201D, 0x95: 0x2022, 0x96: 0x2013, 0x97: 0x2014, 0x98: 0x02DC, 0x99: 0x2122, 0x9A: 0x0161, 0x9B: 0x203A, 0x9C: 0x0153, 0x9F: 0x0178}
_CHAIN = 32
_NARROW = "".join(chr(_BYTES.get(b, b)) for b in range(256))
_TO_NARROW = codecs.charmap_build(_NARROW)


def narrow(text: str) -> bytes | None:
    """A byte a character, where that holds the text."""
    try:
        return codecs.charmap_encode(text, "strict", _TO_NARROW)[0]
    except UnicodeEncodeError:
        return None


@dataclass(frozen=True)
class Header:
    version: int
    language: int
    flags: int
    stored: int
    counts: dict[str, int]
    slots: dict[str, tuple[int, int]]

    @property
    def table(self) -> str:
        return "1Table" if self.flags & 0x200 else "0Table"


def header(word: bytes) -> Header:
    if len(word) < 34 or take(word, "H", 0)[0] != 0xA5EC:
        raise NotWordDocument("the main stream does not open as a document")
    _, version, _, language, _, flags, _, stored = take(word, "HHHHHHHI", 0)
    if version < 0x00C1:
        raise UnsupportedVersion(f"format version {version:#06x}")
    return Header(version, language, flags, stored, {}, {})


def full_header(word: bytes) -> Header:
    """The header with its counts and slots: these are in clear only once the stream is."""
    base = header(word)
    words = take(word, "H", 32)[0]
    longs_at = 34 + 2 * words
    longs = take(word, "H", longs_at)[0]
    if words < 14 or longs < 11:
        raise CorruptDocument("the header is too short")
    values = take(word, f"{longs}i", longs_at + 2)
    if any(values[k] < 0 for k in _COUNTS):
        raise CorruptDocument("a story has a negative length")
    pairs_at = longs_at + 2 + 4 * longs
    pairs = take(word, "H", pairs_at)[0]
    if pairs <= SLOTS["pieces"]:
        raise CorruptDocument("the header has no place for the piece table")
    slots = {name: take(word, "II", pairs_at + 2 + 8 * k) for name, k in SLOTS.items() if k < pairs}
    return Header(base.version, base.language, base.flags, base.stored, dict(zip(STORIES, (values[k] for k in _COUNTS))), slots)


def slot(h: Header, tables: bytes, name: str) -> bytes:
    at, size = h.slots.get(name, (0, 0))
    return part(tables, at, size) if size else b""


def plc(data: bytes, each: int) -> tuple[list[int], list[bytes]]:
    """Positions, one more than the fixed-size records between them."""
    if not data:
        return [], []
    if (len(data) - 4) % (4 + each):
        raise CorruptDocument(f"{len(data)} bytes are no table of records of {each}")
    n = (len(data) - 4) // (4 + each)
    at = 4 * (n + 1)
    cps = list(take(data, f"{n + 1}i", 0))
    if any(b < a for a, b in zip(cps, cps[1:])):
        raise CorruptDocument("positions go backwards")
    return cps, [data[at + each * k : at + each * (k + 1)] for k in range(n)]


@dataclass(frozen=True)
class Piece:
    start: int
    end: int
    offset: int
    narrow: bool
    prm: int


def pieces(clx: bytes) -> tuple[list[Piece], list[list[tuple[int, bytes]]]]:
    """The pieces in order, and the modifier lists that they may name."""
    at, shared = 0, []
    while at < len(clx) and clx[at] == 1:
        size = take(clx, "H", at + 1)[0]
        if size > 0x3FA2:
            raise CorruptDocument("a modifier list is too long")
        shared.append(M.split(part(clx, at + 3, size)))
        at += 3 + size
    if at >= len(clx) or clx[at] != 2:
        raise CorruptDocument("there is no piece table")
    size = take(clx, "I", at + 1)[0]
    cps, records = plc(part(clx, at + 5, size), 8)
    if not records or cps[0] != 0 or any(a >= b for a, b in zip(cps, cps[1:])):
        raise CorruptDocument("pieces do not cover the text from its start")
    out = []
    for k, r in enumerate(records):
        _, fc, prm = struct.unpack("<HIH", r)
        narrow = bool(fc & 0x40000000)
        fc &= 0x3FFFFFFF
        out.append(Piece(cps[k], cps[k + 1], fc // 2 if narrow else fc, narrow, prm))
    return out, shared


def units(word: bytes, table: list[Piece]) -> str:
    """All text, one element for each UTF-16 unit, surrogates by themselves: positions are places in it."""
    out = []
    for p in table:
        raw = part(word, p.offset, (p.end - p.start) * (1 if p.narrow else 2))
        if p.narrow:
            out.append(codecs.charmap_decode(raw, "strict", _NARROW)[0])
            continue
        wide = raw.decode("utf-16-le", "surrogatepass")
        if len(wide) != p.end - p.start:  # pairs take two places
            wide = "".join(map(chr, struct.unpack(f"<{p.end - p.start}H", raw)))
        out.append(wide)
    return "".join(out)


def joined(text: str) -> tuple[str, int]:
    """Text of units with surrogates paired; lone ones become U+FFFD, and are counted."""
    if not any("\ud800" <= c <= "\udfff" for c in text):
        return text, 0
    whole = text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass")
    lone = sum("\ud800" <= c <= "\udfff" for c in whole)
    return "".join("�" if "\ud800" <= c <= "\udfff" else c for c in whole), lone


def _pairs(codes: str, names: str) -> dict[int, int]:
    return dict(zip((int(c, 16) for c in codes.split()), (int(n, 16) for n in names.split())))


#: What the modifiers that a piece can carry itself are called elsewhere: breaks, paragraphs, characters.
_SINGLE = (
    _pairs("00 04 05 07 08 09 0C 0D 0E 0F", "2879 2602 2461 2405 2406 2407 260A 2470 240C 2471")
    | _pairs("18 19 1D 25 2C 32 33 35 36 37 38 39 3A 78", "2416 2417 261B 2423 242A 2430 2431 2433 2434 2435 2436 2437 2438 2640")
    | _pairs("43 47 4B 4D 4E 4F 50 51 53 5E 62 68 73 74 75 76", "0802 0806 080A 2A0C 0858 2859 0811 0818 2A33 2A3E 2A42 2A48 2A53 0854 0855 0856")
)


def single(prm: int) -> list[tuple[int, bytes]]:
    """The one modifier that a piece can carry itself, of those that character formatting has."""
    named = {0x55 + k: 0x0835 + k for k in range(8)} | _SINGLE
    code, value = prm >> 1 & 0x7F, prm >> 8
    return [(named[code], bytes([value]))] if code in named else []


@dataclass
class Run:
    """A range of bytes of the main stream with its modifiers; paragraphs have a style as well."""

    start: int
    end: int
    mods: list[tuple[int, bytes]]
    style: int = 0


def formatting(word: bytes, index: bytes, data: bytes, paragraphs: bool) -> list[Run]:
    """The runs of all formatting pages, clipped to the range that the index gives each page."""
    bounds, records = plc(index, 4)
    out = []
    for low, high, r in zip(bounds, bounds[1:], records):
        page = part(word, 512 * (struct.unpack("<I", r)[0] & 0x3FFFFF), 512)
        n = page[511]
        width = 13 if paragraphs else 1
        if 4 * (n + 1) + width * n > 511:
            raise CorruptDocument("a formatting page has too many runs")
        fcs = take(page, f"{n + 1}I", 0)
        for k in range(n):
            at, style, grpprl = 2 * page[4 * (n + 1) + width * k], 0, b""
            if at and paragraphs:
                size = 2 * page[at] - 1 if page[at] else 2 * take(page, "B", at + 1)[0]
                body = part(page, at + 1 + (not page[at]), size)
                style, grpprl = take(body, "H", 0)[0], body[2:]
            elif at:
                grpprl = part(page, at + 1, page[at])
            mods = _direct(M.split(grpprl), data)
            start, end = max(fcs[k], low), min(fcs[k + 1], high)
            if start < end:
                out.append(Run(start, end, mods, style))
    out.sort(key=lambda x: x.start)
    if any(a.end > b.start for a, b in zip(out, out[1:])):
        raise CorruptDocument("formatting runs overlap")
    return out


def _direct(mods: list[tuple[int, bytes]], data: bytes) -> list[tuple[int, bytes]]:
    """Modifiers kept in the data stream in place of the reference to them; the list stands for all that follows."""
    seen = set()
    while True:
        at = next((i for i, m in enumerate(mods) if m[0] in (0x6646, 0x6645)), None)
        if at is None:
            return mods
        place = struct.unpack("<I", mods[at][1])[0]
        if place in seen or len(seen) >= _CHAIN:
            raise CorruptDocument("modifier lists refer to each other")
        seen.add(place)
        mods = mods[:at] + M.split(part(data, place + 2, take(data, "H", place)[0]))


def to_positions(runs: list[Run], table: list[Piece]) -> list[tuple[int, int, Run, Piece]]:
    """Every non-empty overlap of a run and a piece, in positions: both sides are sorted, so one pass merges them."""
    by_offset = sorted(table, key=lambda p: p.offset)
    starts = [r.start for r in runs]
    out = []
    for p in by_offset:
        width = 1 if p.narrow else 2
        end = p.offset + width * (p.end - p.start)
        i = max(0, bisect_right(starts, p.offset) - 1)
        while i < len(runs) and runs[i].start < end:
            a, b = max(runs[i].start, p.offset), min(runs[i].end, end)
            if a < b:
                if (a - p.offset) % width or (b - p.offset) % width:
                    raise CorruptDocument("a formatting run splits a character")
                out.append((p.start + (a - p.offset) // width, p.start + (b - p.offset) // width, runs[i], p))
            i += 1
    out.sort(key=lambda x: x[0])
    return out


@dataclass
class Style:
    number: int
    kind: str
    name: str
    based_on: int | None
    next: int
    chp: list = field(default_factory=list)
    pap: list = field(default_factory=list)
    tap: list = field(default_factory=list)
    when: dict = field(default_factory=dict)


#: Where in a table a part of its style holds.
CONDITIONS = {1: "firstRow", 2: "lastRow", 4: "firstCol", 8: "lastCol", 16: "band1Vert", 32: "band2Vert", 64: "band1Horz", 128: "band2Horz", 256: "neCell", 512: "nwCell", 1024: "seCell", 2048: "swCell"}


def styles(data: bytes) -> dict[int, Style]:
    if not data:
        return {}
    size = take(data, "H", 0)[0]
    count, base = take(data, "HH", 2)
    out, at = {}, 2 + size
    for number in range(count):
        length = take(data, "H", at)[0]
        std = part(data, at + 2, length)
        at += 2 + length + (length & 1)
        if not length:
            continue
        _, kinds, more = take(std, "HHH", 0)
        kind = {1: "paragraph", 2: "character", 3: "table", 4: "numbering"}.get(kinds & 15)
        if kind is None:
            raise CorruptDocument(f"a style of kind {kinds & 15}")
        n = take(std, "H", base)[0]
        name = part(std, base + 2, 2 * n).decode("utf-16-le", "replace")
        place, parts = base + 4 + 2 * n, []
        for _ in range(more & 15):
            upx = take(std, "H", place)[0]
            parts.append(part(std, place + 2, upx))
            place += 2 + upx + (upx & 1)
        s = Style(number, kind, name, None if kinds >> 4 == 0xFFF else kinds >> 4, more >> 4)
        if kind == "paragraph":
            s.pap, s.chp = M.split(parts[0][2:]) if parts else [], M.split(parts[1]) if len(parts) > 1 else []
        elif kind == "character" and parts:
            s.chp = M.split(parts[0])
        elif kind == "table" and len(parts) > 2:
            s.tap, s.pap, s.chp = M.split(parts[0]), M.split(parts[1][2:]), M.split(parts[2])
            for name, opcode in (("tap", 0xD662), ("pap", 0xC66C), ("chp", 0xCA85)):
                mods = getattr(s, name)
                for code, b in mods:
                    if code == opcode:
                        when = take(b, "H", 0)[0]
                        if when not in CONDITIONS:
                            raise CorruptDocument(f"a table style has condition {when:#06x}")
                        s.when.setdefault(CONDITIONS[when], {}).setdefault(name, []).extend(M.split(b[2:]))
                setattr(s, name, [m for m in mods if m[0] != opcode])
        out[number] = s
    return out


def resolved(sheet: dict[int, Style], unknown: set[int]) -> dict[int, tuple[dict, dict]]:
    """Character and paragraph properties of every style over those that it is based on."""
    out: dict[int, tuple[dict, dict]] = {}
    for number in sheet:
        line, at = [], number
        while at is not None and at in sheet and at not in out:
            if at in line:
                raise CorruptDocument("styles are based on each other")
            line.append(at)
            at = sheet[at].based_on
        for k in reversed(line):
            chp, pap = out.get(sheet[k].based_on, ({}, {}))
            out[k] = M.fold_character(sheet[k].chp, chp, chp, unknown), M.fold_paragraph(sheet[k].pap, pap, unknown)
    return out


def strings(data: bytes) -> list[str]:
    """A table of wide strings."""
    if not data:
        return []
    wide, count, extra = take(data, "HHH", 0)
    if wide != 0xFFFF:
        raise CorruptDocument("a table of narrow strings")
    out, at = [], 6
    for _ in range(count):
        n = take(data, "H", at)[0]
        out.append(part(data, at + 2, 2 * n).decode("utf-16-le", "replace"))
        at += 2 + 2 * n + extra
    return out


_NOT_XML = re.compile("[^\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def fonts(data: bytes) -> list[str]:
    if not data:
        return []
    count, _ = take(data, "HH", 0)
    out, at = [], 4
    for _ in range(count):
        size = take(data, "B", at)[0]
        record = part(data, at + 1, size)
        names = record[39:].decode("utf-16-le", "replace").split("\0")
        out.append(next((n for n in names if n and not _NOT_XML.search(n)), f"Font{len(out)}"))
        at += 1 + size
    return out


def bookmarks(names: bytes, starts: bytes, ends: bytes) -> list[dict]:
    named = strings(names)
    a, records = plc(starts, 4)
    b, _ = plc(ends, 0) if ends else ([], [])
    if len(records) != len(named) or (named and len(b) != len(named) + 1):
        raise CorruptDocument("bookmarks have more names than places")
    out, used = [], set()
    for k, r in enumerate(records):
        i = struct.unpack("<H", r[:2])[0]
        if i >= len(named):
            raise CorruptDocument("a bookmark has no end")
        bits = struct.unpack("<H", r[2:4])[0]
        first, limit = (bits & 127, bits >> 8 & 63) if bits >> 15 else (None, None)
        if i in used or bits & 0x80 or (first is not None and first >= limit):
            raise CorruptDocument("a bookmark has another's end, or columns that are none")
        used.add(i)
        out.append({"name": named[k], "cp_start": min(a[k], b[i]), "cp_end": max(a[k], b[i]), "column_first": first, "column_last": None if limit is None else limit - 1})
    return out


def notes(refs: bytes, texts: bytes, each: int = 2) -> list[dict]:
    """The i-th reference with the i-th text."""
    places, records = plc(refs, each)
    if not records:
        return []
    bounds, _ = plc(texts, 0)
    if len(bounds) != len(records) + 2:  # the last position closes no text
        raise CorruptDocument(f"{len(records)} references to {max(0, len(bounds) - 2)} notes")
    return [{"ref_cp": places[k], "text_start": bounds[k], "text_end": bounds[k + 1], "raw": r} for k, r in enumerate(records)]


def comment_ranges(tags: bytes, starts: bytes, ends: bytes, tally: Counter) -> dict[int, tuple[int, int]]:
    """What part of the text each tag marks; a part that is empty is dropped."""
    if not (tags or starts or ends):
        return {}
    wide, count, extra = take(tags, "HHH", 0)
    if wide != 0xFFFF or extra != 10:
        raise CorruptDocument("the tags of comments are no table of them")
    named, at = [], 6
    for _ in range(count):
        n = take(tags, "H", at)[0]
        named.append(take(tags, "Hii", at + 2 + 2 * n)[1])
        at += 2 + 2 * n + extra
    a, records = plc(starts, 4)
    b, _ = plc(ends, 0)
    if not len(named) == len(records) == len(b) - 1 or len(set(named)) != len(named):
        raise CorruptDocument("comments have more tags than places")
    out, used = {}, set()
    for k, r in enumerate(records):
        i, bits = struct.unpack("<HH", r)
        if i >= len(records) or i in used or bits & 0x8080:
            raise CorruptDocument("the place of a comment has no end of its own")
        used.add(i)
        if a[k] < b[i]:
            out[named[k]] = a[k], b[i]
        else:
            tally["EMPTY_ANNOTATION_BOOKMARK_SKIPPED"] += 1
    return out


def comments(refs: bytes, texts: bytes, owners: bytes, ranges: dict[int, tuple[int, int]] | None = None, tally: Counter | None = None) -> list[dict]:
    authors, at = [], 0
    while at + 2 <= len(owners):
        n = take(owners, "H", at)[0]
        if n >= 56:
            raise CorruptDocument("an author's name is too long")
        authors.append(part(owners, at + 2, 2 * n).decode("utf-16-le", "replace"))
        at += 2 + 2 * n
    if len(authors) > len(set(authors)):
        raise CorruptDocument("an author is there twice")
    out = notes(refs, texts, 30)
    for c in out:
        n, who = take(c["raw"], "H", 0)[0], take(c["raw"], "H", 20)[0]
        if n > 9 or who >= len(authors):
            raise CorruptDocument("a comment has no author")
        tag = take(c["raw"], "i", 26)[0]
        place = (ranges or {}).get(tag)
        if tag != -1 and place is None and tally is not None:
            tally["MISSING_ANNOTATION_BOOKMARK_SKIPPED"] += 1
        c |= {"initials": c["raw"][2 : 2 + 2 * n].decode("utf-16-le", "replace"), "author": authors[who], "range_start": place and place[0], "range_end": place and place[1]}
    return out


def boundaries(ranges: list[tuple[int, int, int]]) -> list[tuple[int, str, int]]:
    """(position, start or end, number) of (number, start, end) ranges in the order in which marks are written: at a position
    ends come before starts, each by number, and an empty range is a start and its end."""
    out = []
    for n, a, b in ranges:
        out += [(a, 1, n, 0, "start"), (b, 1 if a == b else 0, n, 1, "end")]
    return [(cp, what, n) for cp, _, n, _, what in sorted(out)]


def sections(data: bytes, word: bytes, unknown: set[int], language: int = 0, limit: int | None = None, tally: Counter | None = None) -> list[dict]:
    """Sections with what each says over the defaults: margins of an inch, and headers where the language has them."""
    cps, records = plc(data, 12)
    out = []
    edge = 567 if language == 1063 else 708 if language in NARROW_HEADERS else 720
    for k, r in enumerate(records):
        at = struct.unpack("<i", r[2:6])[0]
        mods = M.split(part(word, at + 2, take(word, "H", at)[0])) if at != -1 else []
        props = M.fold_section(mods, unknown)
        if tally is not None and any(m not in props for m in M.MARGINS):
            tally["SECTION_MARGIN_DEFAULTED"] += 1
        if "grid_type" in props and "grid_line_pitch_twips" not in props:
            del props["grid_type"]
            if tally is not None:
                tally["SECTION_GRID_INCOMPLETE"] += 1
        props = M.MARGINS | {"header_twips": edge, "footer_twips": edge} | props
        own = {"cp_start": cps[k], "cp_end": cps[k + 1] if limit is None else min(cps[k + 1], limit), "props": props}
        if out and out[-1]["cp_start"] == own["cp_start"] and own["cp_start"] == own["cp_end"]:
            if out[-1]["props"] != own["props"]:
                raise CorruptDocument("two sections of one place differ")
            out.pop()
            if tally is not None:
                tally["SECTION_DUPLICATE_CP_REPAIRED"] += 1
        out.append(own)
    return out


def fields(data: bytes) -> list[tuple[int, int, int]]:
    """(position, mark, flags) of every field character."""
    cps, records = plc(data, 2)
    return [(cps[k], r[0] & 31, r[1]) for k, r in enumerate(records)]


def shapes(data: bytes, story: str) -> list[dict]:
    cps, records = plc(data, 26)
    out = {}
    for k, r in enumerate(records):
        number, left, top, right, bottom, flags, _ = struct.unpack("<iiiiiHi", r)
        own = {"story": story, "anchor_cp": cps[k], "shape_id": number, "l": min(left, right), "t": min(top, bottom), "r": max(left, right), "b": max(top, bottom), "wrap": flags >> 5 & 15, "behind": bool(flags >> 14 & 1)}
        own |= {"x_from": ("margin", "page", "text", "text")[flags >> 1 & 3], "y_from": ("margin", "page", "text", "text")[flags >> 3 & 3], "side": flags >> 9 & 15, "locked": bool(flags >> 15 & 1)}
        out.setdefault(number, own)
    return sorted(out.values(), key=lambda s: (s["anchor_cp"], s["shape_id"]))


def _level(data: bytes, at: int, level: int, tally: Counter) -> tuple[dict, int]:
    """A level of a list and where it ends. Its text has a number of a level where the level's placeholders say so."""
    start, kind, flags = take(data, "iBB", at)
    holes, follow = part(data, at + 6, 9), data[at + 15]
    chp, pap, restart = take(data, "BBB", at + 24)
    if flags & 3 == 3 or follow > 2 or (kind not in (23, 255) and not 0 <= start <= 0x7FFF):
        raise CorruptDocument("a level of a list is of no kind")
    format_ = NUMBER_FORMATS.get(kind)
    if format_ is None:
        tally["LIST_NUMBER_FORMAT_APPROXIMATED"] += 1
    unknown: set[int] = set()
    body = at + 28
    paragraph = M.fold_paragraph(M.split(part(data, body, pap)), {}, unknown)
    character = M.fold_character(M.split(part(data, body + pap, chp)), {}, {}, unknown)
    if unknown:
        tally["UNSUPPORTED_LIST_LEVEL_SPRMS"] += len(unknown)
    size = take(data, "H", body + pap + chp)[0]
    raw = take(data, f"{size}H", body + pap + chp + 2)
    active = holes.split(b"\0")[0]
    if len(active) > level + 1 or list(active) != sorted(set(active)) or any(holes[len(active) :]):
        raise CorruptDocument("the numbers in a list's text are out of order")
    if kind == 23 and (active or size != 1):
        raise CorruptDocument("a bullet is other than one character")
    text = ""
    for k, unit in enumerate(raw, 1):
        if k in active and unit > level:
            raise CorruptDocument("a list's text has the number of a deeper level")
        text += f"%{unit + 1}" if k in active else chr(unit)
    if any(k > size for k in active):
        raise CorruptDocument("a list's text is shorter than its numbers")
    own = {"start": 1 if kind in (23, 255) else start, "format": kind, "text": joined(text)[0], "align": ("left", "center", "right")[flags & 3], "suffix": ("tab", "space", "nothing")[follow], "legal": bool(flags & 4), "restart_after": restart if flags & 8 else None, "chp": character, "pap": paragraph}
    return own, body + pap + chp + 2 + 2 * size


def lists(data: bytes, uses: bytes, names: bytes = b"", tally: Counter | None = None) -> tuple[list[dict], list[dict]]:
    """Abstract lists with their levels and names, and the lists that paragraphs name (from 1) with what they override."""
    tally = Counter() if tally is None else tally
    if not data:
        if uses or names:
            raise CorruptDocument("lists are used and none is defined")
        return [], []
    n = take(data, "H", 0)[0]
    out, at = [], 2 + 28 * n
    called = strings(names) if names else []
    if len(called) > n:
        tally["EXTRA_LIST_NAMES_IGNORED"] += 1
    folded = [x.casefold() for x in called if x]
    if len(set(folded)) != len(folded):
        raise CorruptDocument("two lists have one name")
    # Levels follow the table itself, past the size that the header gives it.
    for k in range(n):
        number = take(data, "i", 2 + 28 * k)[0]
        flags = data[2 + 28 * k + 26]
        own = []
        for level in range(1 if flags & 1 else 9):
            made, at = _level(data, at, level, tally)
            own.append(made)
        out.append({"list_id": number, "name": called[k] if k < len(called) and called[k] else None, "kind": "singleLevel" if flags & 1 else "hybridMultilevel" if flags & 16 else "multilevel", "levels": own})
    known = {x["list_id"]: x for x in out}
    if len(known) != n or -1 in known:
        raise CorruptDocument("two lists have one number")
    used, count = [], take(uses, "I", 0)[0] if uses else 0
    at = 4 + 16 * count
    for k in range(count):
        number = take(uses, "i", 4 + 16 * k)[0]
        if number not in known:
            raise CorruptDocument(f"list {number} is not defined")
        changes = uses[4 + 16 * k + 12]
        if changes > 9:
            raise CorruptDocument("a list overrides more levels than there are")
        at += 4  # the place of the first paragraph that uses it
        overrides: dict[int, dict] = {}
        for _ in range(changes):
            start, flags = take(uses, "iI", at)
            at += 8
            level = flags & 15
            if level in overrides or level >= len(known[number]["levels"]):
                raise CorruptDocument("a list overrides a level twice, or one that it lacks")
            made = None
            if flags & 0x20:
                made, at = _level(uses, at, level, tally)
            overrides[level] = {"level": level, "start": start if flags & 0x10 and made is None else None, "replaced": made}
        used.append({"id": k + 1, "list_id": number, "overrides": list(overrides.values())})
    return out, used


def settings(data: bytes, version: int = 0xD9) -> tuple[dict, set[str]]:
    """Settings of the whole document, as far as its table goes, and codes of what was repaired."""
    n, out, said = len(data), {}, set()
    if n < 2:
        return {}, said
    get = lambda fmt, at, least: take(data, fmt, at)[0] if n >= least else None
    first, more = take(data, "H", 0)[0], get("I", 4, 8)
    out["facing_pages"] = bool(first & 1)
    tab = get("H", 10, 12)
    if tab is not None and tab > 32767:
        raise CorruptDocument("default tab stops are out of range")
    out |= {"default_tab_twips": tab, "hyphenation_zone_twips": get("H", 14, 16), "consecutive_hyphens": get("H", 16, 18)}
    out["gutter_at_top"] = bool((get("H", 82, 84) or 0) >> 15)
    modes = []
    if more is not None:
        bit = lambda k: bool(more >> k & 1)
        out |= {"mirror_margins": bit(21), "auto_hyphenation": bit(12), "no_caps_hyphenation": not bit(11), "track_changes": bit(15)}
        only = bool((get("I", 594, 598) or 0) & 1) and version >= 0x010C
        modes = [m for m, on in (("trackedChanges", bit(30)), ("forms", bit(25)), ("readOnly" if only else "comments", bit(20))) if on]
    protection, conflict = modes[0] if modes else None, len(modes) > 1
    if version >= 0x010C and (late := get("H", 598, 600)) is not None and late & 8:
        kind = late >> 4 & 7
        if kind not in (0, 1, 2, 3, 7):
            raise CorruptDocument("a document is protected in no way")
        protection, conflict = dict(enumerate("trackedChanges comments forms readOnly".split())).get(kind), False
    if conflict:
        said.add("PROTECTION_MODE_CONFLICT")
    if protection == "trackedChanges" and out.get("track_changes") is False:
        out["track_changes"] = True
        said.add("TRACK_REVISIONS_REPAIRED")
    out |= {"protection": protection, "protection_key": get("I", 78, 82) or None}
    restarts = ("continuous", "eachSect", "eachPage")
    old = version <= 0xD9
    for kind, at, least, place_at, places, formats in (("footnote", 2, 4, 0, {0: "sectEnd", 1: "pageBottom", 2: "beneathText"}, 492), ("endnote", 52, 54, 54, {0: "sectEnd", 3: "docEnd"}, 494)):
        numbering = get("H", at, least)
        if numbering is not None:
            out[f"{kind}_start"] = numbering >> 2
            if old:
                if numbering & 3 == 3:
                    raise CorruptDocument(f"{kind}s restart in no way")
                out[f"{kind}_restart"] = restarts[numbering & 3]
        code = get("H", formats, 496)
        if code is not None:
            if code not in NUMBER_FORMATS and old:
                raise CorruptDocument(f"{kind}s have a number format of no kind")
            out[f"{kind}_format"] = NUMBER_FORMATS.get(code)
        if kind == "footnote" and not old:
            continue
        where = get("H", place_at, place_at + 2)
        if where is not None:
            value = where >> 5 & 3 if kind == "footnote" else where & 3
            if value not in places:
                raise CorruptDocument(f"{kind}s stand nowhere")
            out[f"{kind}_position"] = places[value]
    options = get("I", 84, 88)
    if options is not None:
        out["adjust_line_height"] = not options & 8
    return {k: v for k, v in out.items() if v is not None}, said


def fallbacks(props: dict, of: dict) -> dict:
    """A section's note numbering over the document's."""
    return {k: v for k, v in of.items() if k.startswith(("footnote_", "endnote_"))} | props


_PROPS = {2: "title", 3: "subject", 4: "author", 5: "keywords", 6: "comments", 8: "last_author", 9: "revision", 11: "printed", 12: "created", 13: "modified"}


def iso_time(ticks: int) -> str | None:
    """100-nanosecond ticks since 1601; none for 0."""
    return (datetime(1601, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=ticks // 10_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ") if ticks else None


def summary(data: bytes) -> dict[str, str]:
    """Titles, names and times of the property set."""
    if not data:
        return {}
    if len(data) > 2 << 20:
        raise TooLarge(f"a property set of {len(data)} bytes")
    if take(data, "H", 0)[0] != 0xFFFE:
        raise CorruptDocument("no property set")
    at = take(data, "I", 44)[0]
    _, n = take(data, "II", at)
    places = dict(take(data, "II", at + 8 + 8 * k) for k in range(n))
    page = 1252
    if 1 in places and take(data, "I", at + places[1])[0] == 2:
        page = take(data, "H", at + places[1] + 4)[0]
    encoding = {65001: "utf-8", 1200: "utf-16-le", 10000: "mac-roman"}.get(page, f"cp{page}")
    out, ends = {}, sorted(places.values()) + [take(data, "I", at)[0]]
    for number, place in places.items():
        if number not in _PROPS:
            continue
        room = ends[bisect_right(ends[:-1], place)] - place  # a value ends where the next begins
        kind = take(data, "I", at + place)[0] & 0xFFFF
        value = None
        if kind == 0x40:
            value = iso_time(take(data, "Q", at + place + 4)[0])
        elif kind in (0x1E, 0x1F):
            size = take(data, "I", at + place + 4)[0] * (2 if kind == 0x1F else 1)
            if 8 + size > room:
                raise CorruptDocument("a property runs into the next")
            raw = part(data, at + place + 8, size)
            try:
                value = raw.decode("utf-16-le" if kind == 0x1F else encoding, "replace").split("\0")[0]
            except LookupError:
                value = raw.decode("cp1252", "replace").split("\0")[0]
        if value:
            out[_PROPS[number]] = value
    return out


def build_summary(values: dict[str, str | int]) -> bytes:
    """A property set in UTF-8: strings, or ticks for times."""
    numbers = {v: k for k, v in _PROPS.items()}
    body = [(1, struct.pack("<IHH", 2, 65001, 0))]
    for k, v in values.items():
        if isinstance(v, int):
            body.append((numbers[k], struct.pack("<IQ", 0x40, v)))
        else:
            raw = v.encode() + b"\0"
            body.append((numbers[k], struct.pack("<II", 0x1E, len(raw)) + raw + bytes(-len(raw) % 4)))
    at, index, values_ = 8 + 8 * len(body), b"", b""
    for number, raw in body:
        index += struct.pack("<II", number, at + len(values_))
        values_ += raw
    section = struct.pack("<II", 8 + len(index) + len(values_), len(body)) + index + values_
    return struct.pack("<HHI16sI16sI", 0xFFFE, 0, 0, b"", 1, bytes.fromhex("E0859FF2F94F6810AB9108002B27B3D9"), 48) + section
