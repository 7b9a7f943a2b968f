"""Borders, shading, and table rows: their definition, edits of ranges of their cells, and the row that comes of it.

A border is ``style:size:color:space`` with ``:shadow`` and ``:frame`` where they are set, a shading
``pattern:foreground:background``; so both are values of a property map. A row is a dict; each edit gives a new one.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

from inkstone.functions.dims import BORDERS, PALETTE, SHADES

from .errors import CorruptDocument, take

CELL_SIDES = ("top", "left", "bottom", "right")
_ROW_SIDES = (*CELL_SIDES, "inside_horizontal", "inside_vertical")
_EDGES = (*CELL_SIDES, "diagonal_down", "diagonal_up")
FLOWS = dict(zip((0, 1, 3, 4, 5), "lrTb tbRl btLr lrTbV tbRlV".split()))
_MERGED, _ALIGNED = dict(zip((1, 3), ("continue", "restart"))), (None, "center", "bottom", None)
WIDTHS = ("nil", "auto", "pct", "dxa")
MAX_CELLS, MAX_TWIPS = 63, 31680
_LOOK = ("first_row", "last_row", "first_column", "last_column", "no_row_bands", "no_column_bands")


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise CorruptDocument(what)


def _palette(index: int) -> str:
    return PALETTE[index] if index < len(PALETTE) else "auto"


def colour(b: bytes) -> str | None:
    """RRGGBB, ``auto``, or nothing for a colour that is not given."""
    return None if b == b"\xff" * 4 else "auto" if b[3] == 255 else b[:3].hex().upper()


def _line(code: int, size: int, color: str, flags: int) -> str | None:
    style = BORDERS.get(code, "-")
    if code in (0, 255) or style == "-":
        return None
    return f"{style}:{max(size, 2)}:{color}:{flags & 31}" + ":shadow" * bool(flags & 32) + ":frame" * bool(flags & 64)


def border(b: bytes) -> str | None:
    """A border in four bytes (palette colour) or eight (any colour); nothing where none is drawn."""
    _check(len(b) in (4, 8), f"a border of {len(b)} bytes")
    if b[-4:] == b"\xff" * 4:
        return None
    if len(b) == 4:
        return _line(b[1], b[0], _palette(b[2]), b[3])
    return _line(b[5], b[4], colour(b[:4]) or "auto", b[6])


def shading(b: bytes) -> tuple[str | None, bool]:
    """A shading in two bytes (palette colours) or ten; and whether it is only an approximation."""
    _check(len(b) in (2, 10), f"a shading of {len(b)} bytes")
    if len(b) == 2:
        value = struct.unpack("<H", b)[0]
        if value in (0, 0xFFFF):
            return None, False
        front, back, pattern = value & 31, value >> 5 & 31, value >> 10
        return f"{SHADES.get(pattern, 'clear')}:{_palette(front)}:{_palette(back)}", pattern not in SHADES or max(front, back) > 16
    pattern = struct.unpack_from("<H", b, 8)[0]
    front, back = colour(b[:4]) or "auto", colour(b[4:8]) or "auto"
    if pattern == 0xFFFF or (pattern == 0 and front == back == "auto"):
        return None, False
    return (f"{SHADES[pattern]}:{front}:{back}", False) if pattern in SHADES else (None, True)


def _many(b: bytes, each: int, most: int) -> list[bytes]:
    _check(len(b) % each == 0 and len(b) // each <= most, "a list of cell values has a wrong size")
    return [b[k : k + each] for k in range(0, len(b), each)]


def definition(b: bytes) -> dict:
    """Edges and cells of a row."""
    n = take(b, "B", 0)[0]
    _check(n <= MAX_CELLS, f"a row of {n} cells")
    edges = list(take(b, f"{n + 1}h", 1))
    _check(all(x <= y for x, y in zip(edges, edges[1:])), "the edges of a row go backwards")
    rest, cells = b[1 + 2 * (n + 1) :], []
    _check(len(rest) % 20 == 0, "the cells of a row are cut short")
    for k in range(n):
        if 20 * k >= len(rest):
            cells.append({})
            continue
        bits, width = struct.unpack_from("<HH", rest, 20 * k)
        flow = bits >> 2 & 7
        _check(flow in FLOWS, f"a cell has text flow {flow}")
        own = {
            "width": width if bits >> 9 & 7 == 3 else None,
            "merge": (None, "continue", "restart", "restart")[bits & 3],
            "vertical_merge": _MERGED.get(bits >> 5 & 3),
            "flow": FLOWS[flow] if flow else None,
            "align": _ALIGNED[bits >> 7 & 3],
            "fit_text": bool(bits & 0x1000) or None,
            "no_wrap": bool(bits & 0x2000) or None,
            "hide_mark": bool(bits & 0x4000) or None,
        }
        for side, at in zip(CELL_SIDES, range(4, 20, 4)):
            own[f"border_{side}"] = border(rest[20 * k + at : 20 * k + at + 4])
        cells.append({key: v for key, v in own.items() if v is not None})
    return {"edges": edges, "cells": cells}


_PER_CELL = ("shadings", *(f"colors_{side}" for side in CELL_SIDES))


def _widths(row: dict) -> list[int]:
    edges = row.get("edges", [])
    return [b - a for a, b in zip(edges, edges[1:])]


def _resized(row: dict, widths: list[int], cells: list[dict]) -> dict:
    _check(all(w >= 0 for w in widths) and sum(widths) <= MAX_TWIPS, "the columns of a row are too wide")
    edges = [row["edges"][0] if row.get("edges") else 0]
    for w in widths:
        edges.append(edges[-1] + w)
    return row | {"edges": edges, "cells": cells}


def _inserted(row: dict, b: bytes) -> dict:
    first, count, width = struct.unpack("<BBH", b)
    widths, cells = _widths(row), list(row.get("cells", []))
    _check(0 < count and first <= len(widths) and len(widths) + count <= MAX_CELLS, "cells are inserted outside of a row")
    widths[first:first], cells[first:first] = [width] * count, [{}] * count
    out = _resized(row, widths, cells)
    for name in _PER_CELL:
        if name in row:
            out[name] = [*row[name][:first], *[None] * count, *row[name][first:]]
    for name in ("margins", "widths"):
        if name in row:
            out[name] = [(a + count if first <= a else a, z + count if first < z else z, *rest) for a, z, *rest in row[name]]
    return out


def _deleted(row: dict, b: bytes) -> dict:
    first, limit = b[0], b[1]
    widths, cells = _widths(row), list(row.get("cells", []))
    _check(first < limit <= len(widths) and limit - first < len(widths), "cells are deleted outside of a row")
    del widths[first:limit], cells[first:limit]
    out = _resized(row, widths, cells)
    for name in _PER_CELL:
        if name in row:
            out[name] = [*row[name][:first], *row[name][limit:]]
    moved = lambda i: i if i <= first else max(first, i - (limit - first))
    for name in ("margins", "widths"):
        if name in row:
            out[name] = [(moved(a), moved(z), *rest) for a, z, *rest in row[name] if moved(a) < moved(z)]
    return out


def _changed(row: dict, first: int, limit: int, **new: str | bool | None) -> dict:
    """Cells first to limit - 1 with other values; None takes one away."""
    cells = list(row.get("cells", []))
    _check(first < limit <= len(cells), "a range of cells lies outside of its row")
    for k in range(first, limit):
        cells[k] = {key: v for key, v in (cells[k] | new).items() if v is not None}
    return row | {"cells": cells}


def _columns(row: dict, b: bytes) -> dict:
    first, limit, width = struct.unpack("<BBH", b)
    widths = _widths(row)
    _check(first < limit <= len(widths), "a range of columns lies outside of its row")
    widths[first:limit] = [width] * (limit - first)
    return _resized(row, widths, list(row["cells"]))


def _merged(row: dict, b: bytes) -> dict:
    return _changed(_changed(row, b[0], b[1], merge="continue"), b[0], b[0] + 1, merge="restart")


def _flowed(row: dict, b: bytes) -> dict:
    first, limit, flow = struct.unpack("<BBH", b)
    _check(flow in FLOWS, f"cells have text flow {flow}")
    return _changed(row, first, limit, flow=FLOWS[flow])


def _vertical(row: dict, b: bytes) -> dict:
    _check(len(b) == 2 and b[1] in (0, 1, 3), "a vertical merge of no kind")
    return _changed(row, b[0], b[0] + 1, vertical_merge=_MERGED.get(b[1]))


def _aligned(row: dict, b: bytes) -> dict:
    _check(len(b) == 3 and b[2] < 3, "a vertical alignment of no kind")
    return _changed(row, b[0], b[1], align=(None, "center", "bottom")[b[2]])


def _flag(name: str) -> Callable[[dict, bytes], dict]:
    def edit(row: dict, b: bytes) -> dict:
        _check(len(b) == 3 and b[2] < 2, "a flag of cells is neither set nor clear")
        return _changed(row, b[0], b[1], **{name: bool(b[2])})

    return edit


def _shaded(step: int) -> Callable[[dict, bytes], tuple[dict, bool]]:
    def edit(row: dict, b: bytes) -> tuple[dict, bool]:
        value, rough = shading(b[2:])
        n = len(row.get("cells", []))
        _check(b[0] < b[1] <= n, "a shading lies outside of its row")
        shades = list(row.get("shadings", []))
        shades += [None] * (n - len(shades))
        for k in range(b[0], b[1], step):
            shades[k] = value
        return row | {"shadings": shades}, rough

    return edit


def _segment(first: int, each: int, most: int) -> Callable[[dict, bytes], tuple[dict, bool]]:
    """Shadings of a row's cells from the ``first`` on."""

    def edit(row: dict, b: bytes) -> tuple[dict, bool]:
        made = [shading(x) for x in _many(b, each, most)]
        shades = list(row.get("shadings", [])) if first else []
        shades += [None] * (first + len(made) - len(shades))
        shades[first : first + len(made)] = [m[0] for m in made]
        return row | {"shadings": shades}, any(m[1] for m in made)

    return edit


def _bordered(row: dict, b: bytes) -> dict:
    _check(len(b) in (7, 11) and 0 < b[2] < 64, "cell borders without sides")
    value = border(b[3:])
    return _changed(row, b[0], b[1], **{f"border_{side}": value for k, side in enumerate(_EDGES) if b[2] >> k & 1})


def _around(row: dict, b: bytes) -> dict:
    each = len(b) // 6
    _check(len(b) in (24, 48), "a table has other than six borders")
    return row | {f"border_{side}": border(b[each * k : each * (k + 1)]) for k, side in enumerate(_ROW_SIDES)}


def _colours(side: str) -> Callable[[dict, bytes], dict]:
    return lambda row, b: row | {f"colors_{side}": [colour(x) for x in _many(b, 4, MAX_CELLS)]}


def _margin(row: dict, b: bytes, default: bool) -> dict:
    _check(len(b) == 6, "a cell margin has other than six bytes")
    first, limit, sides, kind, width = struct.unpack("<BBBBH", b)
    _check(first <= limit <= MAX_CELLS and 0 < sides < 16 and kind in (0, 3) and width <= MAX_TWIPS and (kind or not width), "a cell margin of no kind")
    names, value = tuple(s for k, s in enumerate(CELL_SIDES) if sides >> k & 1), width if kind else None
    if default:
        return row | {"default_margins": row.get("default_margins", {}) | dict.fromkeys(names, value)}
    return row | {"margins": [*row.get("margins", []), (first, limit, names, value)]}


def _spacing(row: dict, b: bytes) -> dict:
    _check(len(b) == 6 and b[:3] == b"\x00\x01\x0f" and b[3] in (0, 3, 0x13), "a cell spacing of no kind")
    width = struct.unpack_from("<H", b, 4)[0]
    _check(width <= 15840 and (b[3] or not width), "a cell spacing out of range")
    return row | {"spacing_twips": width}


def _cell_width(row: dict, b: bytes) -> dict | None:
    _check(len(b) == 5 and b[0] < b[1] <= MAX_CELLS, "a cell width lies outside of any row")
    width = struct.unpack_from("<H", b, 3)[0]
    if b[2] != 3:  # a share of the table is dropped where a grid is there
        return row if b[2] == 2 and len(row.get("edges", [])) > 1 else None
    _check(width <= MAX_TWIPS, "a cell is too wide")
    return row | {"widths": [*row.get("widths", []), (b[0], b[1], width)]}


def _width(name: str, most_pct: int) -> Callable[[dict, bytes], dict]:
    def edit(row: dict, b: bytes) -> dict:
        kind, width = struct.unpack("<BH", b)
        _check(kind < 4 and width <= {2: most_pct, 3: MAX_TWIPS}.get(kind, 0 if name == "width" or kind else 1 << 16), f"a {name} of no kind")
        return row | {name: width if kind else 0, f"{name}_type": WIDTHS[kind]}

    return edit


def _indent(row: dict, b: bytes) -> dict:
    kind, width = struct.unpack("<Bh", b)
    _check(kind == 3 or (kind < 2 and not width), "a table indent of no kind")
    return row | {"left_twips": width if kind == 3 else None}


def _look(row: dict, b: bytes) -> dict:
    flags = struct.unpack("<hH", b)[1]
    _check(not flags & 0xF800, "a table look has flags that are none")
    return row | {f"look_{name}": bool(flags >> 5 + k & 1) for k, name in enumerate(_LOOK)}


def _height(row: dict, b: bytes) -> dict:
    value = struct.unpack("<h", b)[0]
    return row | {"height_twips": abs(value) or None, "height_rule": "exact" if value < 0 else "atLeast"}


ANCHORS = (("margin", "page", "text", None), ("text", "margin", "page", None))  # of the vertical and of the horizontal place
_ACROSS, _DOWN = ({-4 * k & 0xFFFF: name for k, name in enumerate(names.split())} for names in ("left center right inside outside", "inline top center bottom inside outside"))


def position(b: bytes, axis: str) -> dict:
    """A place on the page: an alignment, or twips that are stored one up."""
    raw, value = struct.unpack("<H", b)[0], struct.unpack("<h", b)[0] - 1
    named = (_ACROSS if axis == "x" else _DOWN).get(raw)
    _check(named is not None or abs(value) <= MAX_TWIPS, "a place outside of any page")
    return {f"{axis}_align": named, f"{axis}_twips": None if named else value}


def anchors(b: bytes) -> dict:
    return {"y_anchor": ANCHORS[0][b[0] >> 4 & 3], "x_anchor": ANCHORS[1][b[0] >> 6 & 3]}


def _placed(axis: str) -> Callable[[dict, bytes], dict]:
    return lambda row, b: row | position(b, axis)


def _distance(side: str) -> Callable[[dict, bytes], dict]:
    def edit(row: dict, b: bytes) -> dict:
        value = struct.unpack("<H", b)[0]
        _check(value <= MAX_TWIPS, "a table is too far from its text")
        return row | {f"distance_{side}_twips": value}

    return edit


def _style_border(side: str) -> Callable[[dict, bytes], dict]:
    return lambda row, b: row | {f"style_border_{side}": border(b)}


def _one_shade(name: str) -> Callable[[dict, bytes], tuple[dict, bool]]:
    def edit(row: dict, b: bytes) -> tuple[dict, bool]:
        value, rough = shading(b)
        return row | {name: value}, rough

    return edit


#: What each modifier of a row does to it. An edit gives the new row, with whether it was approximated, or nothing.
EDITS: dict[int, Callable] = {
    0xD608: lambda row, b: row | definition(b), 0x7621: _inserted, 0x5622: _deleted, 0x7623: _columns, 0x5624: _merged, 0x5625: lambda row, b: _changed(row, b[0], b[1], merge=None), 0x7629: _flowed, 0xD62B: _vertical, 0xD62C: _aligned,
    0xF636: _flag("fit_text"), 0xD639: _flag("no_wrap"), 0xD642: _flag("hide_mark"), 0xD609: _segment(0, 2, MAX_CELLS), 0x7627: _shaded(1), 0x7628: _shaded(2), 0xD62D: _shaded(1), 0xD62E: _shaded(2), 0xD620: _bordered, 0xD62F: _bordered,
    0xD612: _segment(0, 10, 22), 0xD616: _segment(22, 10, 22), 0xD60C: _segment(44, 10, 19), 0xD670: _segment(0, 10, 22), 0xD671: _segment(22, 10, 22), 0xD672: _segment(44, 10, 19), 0xD660: _one_shade("shading"), 0xD605: _around, 0xD613: _around,
    0xD61A: _colours("top"), 0xD61B: _colours("left"), 0xD61C: _colours("bottom"), 0xD61D: _colours("right"), 0xD632: lambda row, b: _margin(row, b, False), 0xD634: lambda row, b: _margin(row, b, True), 0xD63E: lambda row, b: _margin(row, b, True), 0xD633: _spacing,
    0xD635: _cell_width, 0xF614: _width("width", 30000), 0xF617: _width("before", 5000), 0xF618: _width("after", 5000), 0xF661: _indent, 0x740A: _look, 0x9407: _height, 0x360D: lambda row, b: row | anchors(b), 0x940E: _placed("x"), 0x940F: _placed("y"),
    0x9410: _distance("left"), 0x9411: _distance("top"), 0x941E: _distance("right"), 0x941F: _distance("bottom"), 0xD687: _one_shade("style_shading"),
} | {0xD680 + k: _style_border(side) for k, side in enumerate(("bottom", "left", "right", "inside_horizontal", "inside_vertical", "diagonal_down", "diagonal_up"))} | {0xD47F: _style_border("top")}


def edited(row: dict, opcode: int, b: bytes) -> tuple[dict, bool]:
    """The row after a modifier of ``EDITS``, and whether something of it was lost."""
    try:
        made = EDITS[opcode](row, b)
    except (struct.error, IndexError) as e:
        raise CorruptDocument(f"modifier {opcode:#06x} has {len(b)} bytes") from e
    return (row, True) if made is None else made if isinstance(made, tuple) else (made, False)


def built(row: dict, count: int) -> tuple[list[dict], str | None]:
    """The cells of a row that has ``count`` of them in its text, merged ones added to the cell before, and a warning.

    A cell is as wide as its override says, else as it prefers, else as the grid has it. Its own borders come before the
    row's; a list of colours recolours them, and a colour that is none takes the border away."""
    cells, edges, warning, out = row.get("cells", []), row.get("edges", []), None, []
    if cells and len(cells) != count:
        warning = "TABLE_CELL_DEFINITION_MISMATCH"
    elif edges and len(edges) != count + 1:
        warning = "TABLE_GRID_MISMATCH"
    for k in range(count):
        own = cells[k] if k < len(cells) else {}
        width = next((w for a, z, w in reversed(row.get("widths", [])) if a <= k < z), own.get("width"))
        if width is None and k + 1 < len(edges):
            width = edges[k + 1] - edges[k]
        made = {"ix": k, "width": width, "span": 1} | {key: own.get(key) for key in ("vertical_merge", "flow", "align", "fit_text", "no_wrap", "hide_mark", "border_diagonal_down", "border_diagonal_up")}
        for side in CELL_SIDES:
            line, colors = own.get(f"border_{side}") or row.get(f"border_{side}"), row.get(f"colors_{side}", [])
            if line and k < len(colors):
                parts = line.split(":")
                line = ":".join([*parts[:2], colors[k], *parts[3:]]) if colors[k] else None
            made[f"border_{side}"] = line
        margins = dict(row.get("default_margins", {}))
        for a, z, sides, value in row.get("margins", []):
            if a <= k < z:
                margins |= {side: row.get("default_margins", {}).get(side) if value is None else value for side in sides}
        made |= {f"margin_{side}": margins.get(side) for side in CELL_SIDES}
        made["shading"] = row["shadings"][k] if k < len(row.get("shadings", [])) else None
        if own.get("merge") == "continue" and out:
            last = out[-1]
            if last["width"] is not None or width is not None:
                last["width"] = (last["width"] or 0) + (width or 0)
            last["span"] += 1
        else:
            out.append(made)
    return out, warning


def grid(rows: list[dict]) -> list[int]:
    """The columns of a table: the edges of all its rows, with what they leave free before and after."""
    out: set[int] = set()
    for row in rows:
        if edges := row.get("edges"):
            out |= {*edges, *([edges[0] - row["before"]] if row.get("before") else []), *([edges[-1] + row["after"]] if row.get("after") else [])}
    return sorted(out)


def spans(edges: list[int], cells: list[dict], columns: list[int]) -> tuple[int, int]:
    """Sets the span in ``columns`` of each of the cells; gives how many columns are free before and after them."""
    if not edges or len(columns) < 2:
        return 0, 0
    place = {x: k for k, x in enumerate(columns)}
    at = 0
    for c in cells:
        if at + c["span"] < len(edges):
            wide = place[edges[at + c["span"]]] - place[edges[at]]
            at += c["span"]
            if wide > 0:
                c["span"] = wide
    return place[edges[0]], len(columns) - 1 - place[edges[-1]]


def floating(row: dict) -> dict:
    """A table that floats and asks for a share of the page while its grid is absolute: the grid decides."""
    edges = row.get("edges", [])
    if not (row.get("x_anchor") or row.get("y_anchor")) or row.get("width_type") != "pct" or len(edges) < 2 or edges[-1] <= edges[0]:
        return row
    placed = {} if row.get("x_twips") is not None or row.get("x_align") else {"x_twips": 0}
    return row | {"width": edges[-1] - edges[0], "width_type": "dxa", "autofit": False, "left_twips": max(-edges[0], 0)} | placed
