"""One pass over a story: control characters become paragraphs, runs, fields, references; markers become tables."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from inkstone.functions.dims import ACTIVE, LIVE, TARGET

from .errors import CorruptDocument

MAX_TABLES = 64
_LEGAL = lambda c: c in "\t\n\r" or " " <= c <= "퟿" or "" <= c <= "�" or c >= "\U00010000"
_PLAIN = re.compile("[ -\ud7ff\ue000-\ufffd]+")


class Spans:
    """Sorted, disjoint spans; the value at a position, or the default in a gap."""

    def __init__(self, spans: list[tuple[int, int, dict]], default: dict) -> None:
        self.spans, self.default = spans, default
        self.starts = [s[0] for s in spans]

    def at(self, cp: int) -> dict:
        i = bisect_right(self.starts, cp) - 1
        return self.spans[i][2] if i >= 0 and cp < self.spans[i][1] else self.default


    def until(self, cp: int) -> tuple[dict, int]:
        """The value at a position and where the next one may differ."""
        i = bisect_right(self.starts, cp) - 1
        if i >= 0 and cp < self.spans[i][1]:
            return self.spans[i][2], self.spans[i][1]
        return self.default, self.starts[i + 1] if i + 1 < len(self.starts) else 1 << 62


@dataclass
class Paragraph:
    cp_start: int
    cp_end: int
    props: dict
    depth: int
    mark: str | None  # what ends here beside the paragraph: a cell or a row
    runs: list[dict] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "".join(r["text"] for r in self.runs if r["kind"] == "text")


@dataclass
class Open:
    """A field that is open; its marks are runs that stay only if the field does."""

    begin: dict
    instruction: str = ""
    separator: dict | None = None
    separator_cp: int | None = None
    visible: bool = True
    paragraphs: int = 0
    flat: bool = False


@dataclass(frozen=True)
class Names:
    """What fields may point to, in one case."""

    bookmarks: frozenset[str] = frozenset()
    styles: frozenset[str] = frozenset()
    lists: frozenset[str] = frozenset()


#: Fields whose result, once it spans paragraphs, is kept as the text it is.
_LONG = ("INDEX", "TOA", "TOC")
#: Fields that keep binary data, which is no text, in their instructions.
BINARY = frozenset("HYPERLINK NOTEREF PAGEREF REF".split())


def kind_of(instruction: str) -> str:
    """The first word in capitals; formulas are ``=``."""
    words = instruction.split(None, 1)
    return "" if not words else "=" if words[0].startswith("=") else words[0].upper()


def argument(instruction: str) -> str | None:
    """The first argument, quoted or not; none if a switch comes first."""
    words = instruction.split(None, 1)
    rest = words[1].lstrip() if len(words) == 2 else ""
    if not rest or rest[0] == "\\":
        return None
    if rest[0] != '"':
        return rest.split(None, 1)[0]
    m = re.match(r'"((?:[^"\\]|\\.)*)"', rest, re.S)
    return re.sub(r"\\(.)", r"\1", m[1], flags=re.S) or None if m else None


def safe_link(instruction: str, bookmarks: frozenset[str]) -> bool:
    """Whether a link goes to the web, to a mail address or to a bookmark that is there, and so may stay a link."""
    target = argument(instruction)
    if target is None:
        words = instruction.split()
        return len(words) == 3 and words[1].lower() == "\\l" and words[2].strip('"').casefold() in bookmarks
    if any(c.isspace() or c < " " for c in target):
        return False
    try:
        parts = urlsplit(target)
    except ValueError:
        return False
    return parts.scheme in ("http", "https") and bool(parts.netloc) or parts.scheme == "mailto" and bool(parts.path or parts.netloc)


def classify(instruction: str, names: Names) -> tuple[str, str]:
    """(type, fate) of a field: live ones stay fields, others keep the text that they had."""
    kind, to = kind_of(instruction), argument(instruction)
    if kind in LIVE:
        return kind, "live"
    if kind == "HYPERLINK":
        return kind, "live" if safe_link(instruction, names.bookmarks) else "unsafe"
    if kind in TARGET:
        known = {"SEQ": None, "STYLEREF": names.styles, "LISTNUM": names.lists}.get(kind, names.bookmarks)
        return kind, "live" if to is not None and (known is None or to.casefold() in known) else "broken"
    return kind, "active" if kind in ACTIVE else "flattened"


def field_ends(entries: list[tuple[int, int, int]], text: str, start: int, length: int, special, tally: Counter) -> dict[int, int]:  # noqa: ANN001
    """The flags of every field's end, by position, from the table of a story's field marks: each has to be the character
    that the story has there, in an order that nests. What only flags say is repaired and counted."""
    out: dict[int, int] = {}
    stack: list[bool] = []
    for k, (cp, mark, flags) in enumerate(entries):
        at = start + cp
        if cp >= length or (k and cp <= entries[k - 1][0]) or mark not in (0x13, 0x14, 0x15) or text[at] != chr(mark):
            raise CorruptDocument(f"field mark {k} is not in the text")
        if not special(at):
            tally["FIELD_CHARACTER_SPECIAL_MISSING"] += 1
        if mark == 0x13:
            tally["UNKNOWN_FIELD_TYPES"] += not 1 <= flags <= 95
            stack.append(False)
            continue
        if not stack or (mark == 0x14 and stack[-1]):
            raise CorruptDocument(f"field mark {k} belongs to no field")
        if mark == 0x14:
            stack[-1] = True
            continue
        parted = stack.pop()
        tally["FIELD_NESTING_FLAG_INCONSISTENT"] += bool(flags & 0x40) != bool(stack)
        tally["FIELD_SEPARATOR_FLAG_REPAIRED"] += bool(flags & 0x80) != parted
        tally["FIELD_END_FLAGS_APPROXIMATED"] += bool(flags & 0x23)
        out[at] = flags
    if stack:
        raise CorruptDocument("a field does not end")
    for code in [c for c, n in tally.items() if not n]:
        del tally[code]
    return out


def binary_fields(text: str, start: int, end: int) -> dict[int, str]:
    """The type of the field around each U+0001 that lies in one."""
    out: dict[int, str] = {}
    stack: list[list] = []
    for m in re.finditer("[\x13\x14\x15\x01]", text[start:end]):
        at, c = start + m.start(), m[0]
        if stack and not stack[-1][1]:
            stack[-1][0] += text[stack[-1][2] : at]
            stack[-1][2] = at + 1
        if c == "\x13":
            stack.append(["", False, at + 1])
        elif not stack:
            continue
        elif c == "\x14":
            stack[-1][1] = True
        elif c == "\x15":
            stack.pop()
            if stack:
                stack[-1][2] = at + 1
        else:
            out[at] = kind_of("".join(x for x in stack[-1][0] if x >= " ")) or "UNKNOWN"
    return out


@dataclass(frozen=True)
class Place:
    """What a story's positions stand for, and what its fields may point to."""

    chars: Spans
    paras: Spans
    refs: dict[int, tuple[str, int]]
    names: Names
    sections: frozenset[int]
    ends: dict[int, int]
    objects: dict[int, int]
    ignored: frozenset[int]


def read(text: str, start: int, end: int, where: Place, tally: Counter) -> tuple[list[Paragraph], list[dict]]:
    """Paragraphs of text[start:end] (one element a UTF-16 unit) and its fields; ``tally`` gets what was not kept."""
    chars, paras, refs = where.chars, where.paras, where.refs
    out: list[Paragraph] = []
    found: list[dict] = []
    stack: list[Open] = []
    runs: list[dict] = []
    begun = at = start
    hidden = 0  # fields without a separator so far: what they hold is no text
    marked = sorted(refs)

    def add(kind: str, value: str, cp: int, props: dict | None = None) -> dict:
        props = chars.at(cp) if props is None else props
        if runs and kind == "text" and runs[-1]["kind"] == "text" and (runs[-1]["props"] is props or runs[-1]["props"] == props):
            runs[-1]["text"] += value
            return runs[-1]
        runs.append({"kind": kind, "text": value, "props": props, "cp": cp})
        return runs[-1]

    def close(stop: int, cp: int, mark: str | None = None) -> None:
        nonlocal begun, runs
        props = paras.at(cp)
        depth = props.get("table_depth", 1 if props.get("in_table") else 0)
        if depth > MAX_TABLES:
            tally["TABLE_DEPTH_CLAMPED"] += 1
            depth = MAX_TABLES
        out.append(Paragraph(begun, stop, props, depth, mark, runs))
        begun, runs = stop, []

    def inside(f: Open) -> list[dict]:
        """The runs of a field's result."""
        whole = [r for p in out[f.paragraphs :] for r in p.runs] + runs
        first = next((k for k, r in enumerate(whole) if r is f.separator), len(whole))
        return whole[first + 1 :]

    def ended(f: Open, cp: int) -> None:
        kind, fate = classify(f.instruction, where.names)
        flags = where.ends.get(cp)
        spans = len(out) > f.paragraphs and kind in _LONG and f.separator is not None
        flat = spans or any(p.flat for p in stack)
        number = where.objects.get(f.separator_cp) if f.separator_cp is not None else None
        if kind == "EMBED" and number is not None and flags is not None and not flat:
            fate = "embedded"
        elif fate == "live" and (flags is None or flat):
            fate = "undeclared" if flags is None else "flattened"
        live = fate == "live" and f.visible
        said = f.instruction.strip()
        if kind == "FTNREF":
            said = "NOTEREF" + said[6:]
        state = {"locked": bool(flags and flags & 0x10), "dirty": bool(flags and flags & 0x0C)}
        if fate == "embedded" or (flags and flags & 0x20 and f.separator is not None):
            preview = None
            for r in inside(f):  # a private result is dropped, and an object takes the place of what it showed
                if r["kind"] == "picture" and preview is None:
                    preview = r["text"]
                r["kind"] = None
            if fate == "embedded" and f.visible:
                name = argument(f.instruction)
                add("object", str(number), cp, {k: v for k, v in (("prog_id", name if name and _PROG.fullmatch(name) else None), ("preview", preview)) if v is not None})
        if spans:
            for r in inside(f):  # with the fields in it
                if r["kind"] in _MARKS:
                    r["kind"] = None
            nested = [x for x in found if x["live"] and x["begin_cp"] > f.begin["cp"]]
            for x in nested:
                x["live"], x["fate"] = False, "flattened"
                tally["FIELD_FLATTENED"] += 1
        if live:
            f.begin |= {"text": said, "props": f.begin["props"] | {k: v for k, v in state.items() if v}}
            add("field_end", "", cp)
        else:
            f.begin["kind"] = None
            if f.separator is not None:
                f.separator["kind"] = None
            if fate != "live":
                tally[f"FIELD_{fate.upper()}"] += 1
        found.append({"begin_cp": f.begin["cp"], "sep_cp": f.separator_cp, "end_cp": cp, "depth": len(stack) + 1, "field_type": kind, "instruction": said, "live": fate == "live", "fate": fate, **state})

    while at < end:
        if at not in refs and not hidden:
            props, stop = chars.until(at)
            nth = bisect_right(marked, at)
            plain = None if "symbol" in props else _PLAIN.match(text, at, min(end, stop, marked[nth] if nth < len(marked) else end))
            if plain:  # ordinary characters of one format, at once
                add("text", plain[0], at, props)
                at = plain.end()
                continue
        c, cp = text[at], at
        at += 1
        if "\ud800" <= c <= "\udbff" and at < end and "\udc00" <= text[at] <= "\udfff":
            c = chr(0x10000 + (ord(c) - 0xD800 << 10) + ord(text[at]) - 0xDC00)
            at += 1
        elif "\ud800" <= c <= "\udfff":
            tally["INVALID_UTF16"] += 1
            c = "�"
        if c == "\x13":
            mark = {"kind": "field_begin", "text": "", "props": chars.at(cp), "cp": cp}
            stack.append(Open(mark, visible=not hidden, paragraphs=len(out)))
            if not hidden:
                runs.append(mark)
            hidden += 1
            continue
        if c == "\x14" and stack:
            if stack[-1].separator_cp is None:
                hidden -= 1
                stack[-1].separator_cp = cp
                stack[-1].separator = {"kind": "field_separator", "text": "", "props": chars.at(cp), "cp": cp}
                if not hidden:
                    runs.append(stack[-1].separator)
            continue
        if c == "\x15" and stack:
            f = stack.pop()
            hidden -= f.separator_cp is None
            ended(f, cp)
            continue
        if cp in where.ignored:
            continue
        if hidden:
            if _LEGAL(c):
                next(f for f in reversed(stack) if f.separator_cp is None).instruction += c
            else:
                tally["UNSUPPORTED_CONTROL_CHARACTER"] += 1
            continue
        if cp in refs:
            kind, number = refs[cp]
            props = chars.at(cp)
            add(kind, str(number), cp, props | {"custom_mark": c} if kind in ("footnote", "endnote") and c >= " " else props)
            continue
        if c == "\r":
            props = paras.at(cp)
            close(at, cp, "row" if props.get("inner_row_end") else "cell" if props.get("inner_cell_end") else None)
        elif c == "\x07":
            props = paras.at(cp)
            if props.get("in_table") or props.get("table_depth"):
                close(at, cp, "row" if props.get("row_end") else "cell")
            else:
                tally["TABLE_MARKER_DEFERRED"] += 1
                add("text", "￼", cp)
        elif c == "\f":
            if at in where.sections:
                close(at, cp)
            else:
                add("page_break", "", cp)
        elif c == "\t":
            add("tab", "", cp)
        elif c in "\n\v":
            add("break", "", cp)
        elif c == "\x1e":
            add("no_break_hyphen", "", cp)
        elif c == "\x1f":
            add("soft_hyphen", "", cp)
        elif c in "\x03\x04" and chars.at(cp).get("special"):
            add("separator" if c == "\x03" else "continuation_separator", "", cp)
        elif c in "\x01\x02\x08":
            tally["NOTE_REFERENCE_DEFERRED" if c == "\x02" else "OBJECT_ANCHOR_DEFERRED"] += 1
            add("text", "￼", cp)
        elif ":" in (symbol := chars.at(cp).get("symbol", "")):
            add("symbol", symbol, cp)
        elif not _LEGAL(c):
            tally["UNSUPPORTED_CONTROL_CHARACTER"] += 1
            add("text", "�", cp)
        else:
            add("text", c, cp)
    if stack:
        tally["FIELD_NOT_CLOSED"] += len(stack)
        for f in stack:
            f.begin["kind"] = None
            if f.separator is not None:
                f.separator["kind"] = None
    if runs or not out or begun < end:
        close(end, max(start, end - 1))
    if found or stack:
        for p in out:
            p.runs = settled(p.runs)
    return out, found


_MARKS = ("field_begin", "field_separator", "field_end")
_PROG = re.compile(r"[A-Za-z.][A-Za-z0-9.]{0,38}")


def settled(runs: list[dict]) -> list[dict]:
    """The runs that stay, texts of one format that meet now as one."""
    out: list[dict] = []
    for r in runs:
        if r["kind"] is None:
            continue
        if out and r["kind"] == out[-1]["kind"] == "text" and r["props"] == out[-1]["props"]:
            out[-1] = out[-1] | {"text": out[-1]["text"] + r["text"]}
        else:
            out.append(r)
    return out


def assemble(items: list[Paragraph], tally: Counter) -> list[dict]:
    """Nodes in document order with their paths: paragraphs, tables, rows, cells. What cannot be a table stays a row of
    paragraphs, and is counted."""
    nodes: list[dict] = []

    def node(kind: str, path: list[int], item: Paragraph | None = None) -> None:
        nodes.append({"kind": kind, "path": path, "item": item})

    def flat(some: list[Paragraph], path: list[int], first: int) -> int:
        for item in some:
            node("paragraph", [*path, first], item)
            first += 1
        return first

    def level(some: list[Paragraph], path: list[int], depth: int) -> None:
        nth, i = 0, 0
        while i < len(some):
            if some[i].depth <= depth:
                nth, i = flat(some[i : i + 1], path, nth), i + 1
                continue
            j = i
            while j < len(some) and some[j].depth > depth:
                j += 1
            group, i = some[i:j], j
            rows = cut(group, "row", depth + 1)
            split = [cut(r[:-1], "cell", depth + 1) for r in rows or []]
            if rows is None or not all(split):
                tally["TABLE_FLATTENED"] += 1
                nth = flat(group, path, nth)
                continue
            node("table", [*path, nth])
            for r, (row, cells) in enumerate(zip(rows, split)):
                node("row", [*path, nth, r], row[-1])
                for c, cell in enumerate(cells):
                    node("cell", [*path, nth, r, c])
                    level(cell, [*path, nth, r, c], depth + 1)
            nth += 1

    def cut(group: list[Paragraph], mark: str, depth: int) -> list[list[Paragraph]] | None:
        out: list[list[Paragraph]] = [[]]
        for item in group:
            out[-1].append(item)
            if item.mark == mark and item.depth == depth:
                out.append([])
        return out[:-1] if not out[-1] else None

    level(items, [], 0)
    return nodes
