"""Documents made from text, for round trips and tests: header, piece table, formatting pages and what a case asks for."""

from __future__ import annotations

import re
import struct

from . import ciphers, compound
from .word import _COUNTS, SLOTS, STORIES, build_summary
from .word import narrow as word_narrow

TEXT_AT = 1024


def _plc(cps: list[int], records: list[bytes]) -> bytes:
    return struct.pack(f"<{len(cps)}i", *cps) + b"".join(records)


def wide_strings(values: list[str]) -> bytes:
    return struct.pack("<HHH", 0xFFFF, len(values), 0) + b"".join(struct.pack("<H", len(v)) + v.encode("utf-16-le") for v in values)


def style(name: str, kind: int = 1, based_on: int = 0xFFF, chp: bytes = b"", pap: bytes = b"", next_: int = 0) -> bytes:
    """One definition of a style sheet."""
    parts = [struct.pack("<H", 0) + pap, chp] if kind == 1 else [chp] if kind == 2 else []
    body = struct.pack("<HHHHH", 0xFFE, kind | based_on << 4, len(parts) | next_ << 4, 0, 0)
    body += struct.pack("<H", len(name)) + name.encode("utf-16-le") + b"\0\0"
    for p in parts:
        body += struct.pack("<H", len(p)) + p + b"\0" * (len(p) & 1)
    return struct.pack("<H", len(body)) + body + b"\0" * (len(body) & 1)


def style_sheet(definitions: list[bytes]) -> bytes:
    return struct.pack("<HHHHHHHHHH", 18, len(definitions), 10, 1, 15, 0, 0, 0, 0, 0) + b"".join(definitions)


def _pages(runs: list[tuple[int, int, int, bytes]], paragraphs: bool) -> list[tuple[int, int, bytes]]:
    """(first byte, last byte, page) of formatting pages for (start, end, style, modifiers) in bytes of the stream."""
    out, i = [], 0
    while i < len(runs):
        page, low, k, width = bytearray(512), 510, 0, 13 if paragraphs else 1
        bodies = []
        while i + k < len(runs):
            _, _, number, mods = runs[i + k]
            if paragraphs:
                own = struct.pack("<H", number) + mods
                own = bytes([(len(own) + 1) // 2]) + own if len(own) & 1 else bytes([0, len(own) // 2]) + own
            else:
                own = bytes([len(mods)]) + mods if mods else b""
            at = (low - len(own)) & ~1 if own else 0
            if (at or low) < 4 * (k + 2) + width * (k + 1):
                break
            if own:
                page[at : at + len(own)] = own
                low = at
            bodies.append(at // 2)
            k += 1
        fcs = [r[0] for r in runs[i : i + k]] + [runs[i + k - 1][1]]
        struct.pack_into(f"<{k + 1}I", page, 0, *fcs)
        for j, b in enumerate(bodies):
            page[4 * (k + 1) + width * j] = b
        page[511] = k
        out.append((fcs[0], fcs[-1], bytes(page)))
        i += k
    return out


def field_table(text: str, flags: int = 0) -> bytes:
    """The table of the field marks of a text: types of links, ends with what the marks themselves say and ``flags``."""
    marks, stack, records = [], [], []
    for m in re.finditer("[\x13\x14\x15]", text):
        c = ord(m[0])
        if c == 0x13:
            stack.append(False)
            records.append(bytes([c, 88]))
        elif not stack:
            continue
        elif c == 0x14:
            stack[-1] = True
            records.append(bytes([c, 255]))
        else:
            parted = stack.pop()
            records.append(bytes([c, flags | 0x80 * parted | 0x40 * bool(stack)]))
        marks.append(len(text[: m.start()].encode("utf-16-le", "surrogatepass")) // 2)
    size = len(text.encode("utf-16-le", "surrogatepass")) // 2 if marks else 0
    return _plc([*marks, size + 1], records) if marks and not stack else b""


def document(
    text: str | list[str],
    stories: dict[str, str] | None = None,
    char_runs: list[tuple[int, int, bytes]] = (),
    para_runs: list[tuple[int, int, int, bytes]] = (),
    tables: dict[str, bytes] | None = None,
    streams: dict[str, bytes] | None = None,
    password: str | None = None,
    cipher: str = "xor",
    use_1table: bool = True,
    section_mods: list[tuple[int, int, bytes]] = (),
    summary: dict | None = None,
    prms: list[int] = (),
    shared: list[bytes] = (),
    sector: int = 512,
) -> bytes:
    """The bytes of a document. ``text`` may come in pieces; runs are in character positions (UTF-16 units)."""
    parts = [text] if isinstance(text, str) else list(text)
    sizes = {"main": sum(len(p) if p.isascii() else len(p.encode("utf-16-le", "surrogatepass")) // 2 for p in parts)}
    for s in STORIES[1:]:
        if stories and s in stories:
            parts.append(stories[s])
            sizes[s] = len(stories[s].encode("utf-16-le", "surrogatepass")) // 2
    body, cps, pcds, places = b"", [0], [], []
    for k, p in enumerate(parts):
        if not p:
            continue
        raw = word_narrow(p)
        narrow = raw is not None
        if not narrow:
            raw = p.encode("utf-16-le", "surrogatepass")
        body += b"\0" * (len(body) & 1)
        at = TEXT_AT + len(body)
        cps.append(cps[-1] + len(raw) // (1 if narrow else 2))
        pcds.append(struct.pack("<HIH", 0, at * 2 | 0x40000000 if narrow else at, prms[k] if k < len(prms) else 0))
        places.append((cps[-2], cps[-1], at, 1 if narrow else 2))
        body += raw
    if not pcds:
        cps, pcds = [0, 1], [struct.pack("<HIH", 0, TEXT_AT * 2 | 0x40000000, 0)]
        body, places, sizes["main"] = b"\r", [(0, 1, TEXT_AT, 1)], 1
    word = bytearray(TEXT_AT) + body
    table: dict[str, bytes] = dict(tables or {})
    clx = b"".join(b"\x01" + struct.pack("<H", len(m)) + m for m in shared) + b"\x02" + struct.pack("<I", len(_plc(cps, pcds))) + _plc(cps, pcds)

    def in_bytes(runs: list[tuple]) -> list[tuple[int, int, int, bytes]]:
        out = []
        for a, b, *rest in runs:
            for s, e, at, width in places:
                lo, hi = max(a, s), min(b, e)
                if lo < hi:
                    out.append((at + (lo - s) * width, at + (hi - s) * width, rest[0] if len(rest) == 2 else 0, rest[-1]))
        return sorted(out)

    for name, runs, paragraphs in (("char_pages", char_runs, False), ("para_pages", para_runs, True)):
        pages = _pages(in_bytes(list(runs)), paragraphs)
        if not pages:
            continue
        bounds, numbers = [pages[0][0]], []
        for _, last, page in pages:
            word += bytes(-len(word) % 512)
            numbers.append(struct.pack("<I", len(word) // 512))
            word += page
            bounds.append(last)
        table[name] = struct.pack(f"<{len(bounds)}I", *bounds) + b"".join(numbers)
    if section_mods:
        seds = []
        for _, _, mods in section_mods:
            seds.append(struct.pack("<HiHI", 0, len(word), 0, 0))
            word += struct.pack("<H", len(mods)) + mods
        table["sections"] = _plc([section_mods[0][0], *(s[1] for s in section_mods)], seds)
    table["pieces"] = clx
    whole = "".join([text] if isinstance(text, str) else text)
    if "fields_main" not in table and (made := field_table(whole)):
        table["fields_main"] = made
    blob, slots = bytearray(), {}
    lead = {"rc4": ciphers.rc4_header, "capi": ciphers.capi_header}.get(cipher)
    head = lead(password, b"saltsaltsaltsalt", b"verifierverifier") if password is not None and lead else b""
    blob += head
    for name, data in table.items():
        slots[name] = (len(blob), len(data))
        blob += data
    if "lists" in slots:  # levels lie past the size that the header gives
        slots["lists"] = (slots["lists"][0], 2 + 28 * struct.unpack_from("<H", table["lists"])[0])
    flags = 0x0200 * use_1table
    stored = 0
    if password is not None:
        flags |= 0x0100 | (0x8000 if cipher == "xor" else 0)
        stored = ciphers.xor_check(password) if cipher == "xor" else len(head)
    struct.pack_into("<HHHHHHHI", word, 0, 0xA5EC, 0x00C1, 0, 0x0409, 0, flags, 0x00BF, stored)
    struct.pack_into("<H", word, 32, 14)
    struct.pack_into("<H", word, 62, 22)
    for s, k in zip(STORIES, _COUNTS):
        struct.pack_into("<i", word, 64 + 4 * k, sizes.get(s, 0))
    struct.pack_into("<H", word, 152, 93)
    for name, pair in slots.items():
        struct.pack_into("<II", word, 154 + 8 * SLOTS[name], *pair)
    word_, blob_ = bytes(word) + bytes(max(0, 4096 - len(word))), bytes(blob) + bytes(max(0, 4096 - len(blob)))
    extra = dict(streams or {})
    if password is not None:
        if cipher == "xor":
            word_, blob_ = ciphers.xor_stream(word_, password, ciphers.CLEAR), ciphers.xor_stream(blob_, password)
        else:
            key = ciphers.md5_key(password, b"saltsaltsaltsalt") if cipher == "rc4" else ciphers.sha1_key(password, b"saltsaltsaltsalt", 128)
            word_ = word_[: ciphers.CLEAR] + ciphers._blocks(word_, key)[ciphers.CLEAR :]
            blob_ = head + ciphers._blocks(blob_, key)[len(head) :]
    if summary:
        extra["\x05SummaryInformation"] = build_summary(summary)
    return compound.build({"WordDocument": word_, ("1Table" if use_1table else "0Table"): blob_, **extra}, sector)
