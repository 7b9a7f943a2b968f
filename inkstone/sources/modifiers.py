"""Property modifiers: lists of (opcode, operand), split and folded into sparse properties; what is absent is not set."""

from __future__ import annotations

import struct
from collections.abc import Callable

from inkstone.functions.dims import LANGUAGES, NUMBER_FORMATS, PALETTE

from . import tables as R
from .errors import CorruptDocument, part, take

_FIXED = (1, 1, 2, 4, 2, 2, 0, 3)
_HIGHLIGHTS = ("none", "black", "blue", "cyan", "green", "magenta", "red", "yellow", "white", "darkBlue", "darkCyan", "darkGreen", "darkMagenta", "darkRed", "darkYellow", "darkGray", "lightGray")
_UNDERLINES = dict(zip((0, 1, 2, 3, 4, 6, 7, 9, 10, 11, 20, 23, 25, 26, 27, 39, 43, 55), "none single words double dotted thick dash dotDash dotDotDash wave dottedHeavy dashedHeavy dashDotHeavy dashDotDotHeavy wavyHeavy dashLong wavyDouble dashLongHeavy".split()))
_ALIGN = ("left", "center", "right", "both", "distribute", "mediumKashida", "numTab", "highKashida", "lowKashida", "thaiDistribute")
_BREAKS = ("continuous", "nextColumn", "nextPage", "evenPage", "oddPage")
CHARACTER, PARAGRAPH, SECTION, TABLE = 2, 1, 4, 5


def split(data: bytes) -> list[tuple[int, bytes]]:
    """The modifiers of a list, in order; the operand's size is in the opcode, or leads it."""
    out, at = [], 0
    while at + 2 <= len(data):
        opcode = take(data, "H", at)[0]
        at += 2
        size, head = _FIXED[opcode >> 13], 0
        if opcode >> 13 == 6:
            if opcode == 0xD608 or opcode == 0xD606:  # a table's definition counts in two bytes, itself among them
                size, head = take(data, "H", at)[0] - 1, 2
            else:
                size, head = take(data, "B", at)[0], 1
                if opcode == 0xC615 and size == 255:  # more tab stops than a byte can count
                    deleted = take(data, "B", at + 1)[0]
                    size = 2 + 4 * deleted + 3 * take(data, "B", at + 2 + 4 * deleted)[0]
        out.append((opcode, part(data, at + head, size)))
        at += head + size
    return out


def _number(fmt: str) -> Callable[[bytes], int]:
    return lambda b: struct.unpack(f"<{fmt}", b)[0]


def _named(names) -> Callable[[bytes], str | None]:  # noqa: ANN001
    get = names.get if isinstance(names, dict) else lambda k: names[k] if k < len(names) else None
    return lambda b: get(b[0])


def _colour(b: bytes) -> str:
    return "auto" if b[3] == 255 else b[:3].hex().upper()


def _line(b: bytes) -> dict:
    value, multiple = struct.unpack("<hh", b)
    return {"line": abs(value), "line_rule": "auto" if multiple == 1 or not value else "exact" if value < 0 else "atLeast"}


def _list_of(b: bytes) -> int | None:
    value = struct.unpack("<h", b)[0]
    return None if value in (0, -2047) else abs(value)


_i8, _u16, _i16, _i32, _u32 = _number("b"), _number("H"), _number("h"), _number("i"), _number("I")
_lid = lambda b: LANGUAGES.get(_u16(b))
_flag = _named({0: False, 1: True})


def _within(fmt: str, low: int, high: int) -> Callable[[bytes], int | None]:
    """A number, or nothing where it is out of range."""
    return lambda b: v if low <= (v := struct.unpack(f"<{fmt}", b)[0]) <= high else None


_bool = lambda b: b[0] != 0

_EIGHT = "bold italic strike outline shadow small_caps caps hidden".split()
TOGGLES = {0x0835 + k: name for k, name in enumerate(_EIGHT)} | {0x0811: "web_hidden", 0x0818: "special_hidden", 0x0854: "imprint", 0x0855: "special", 0x0858: "emboss", 0x085A: "rtl", 0x085C: "bold_cs", 0x085D: "italic_cs", 0x0868: "snap_to_grid", 0x0875: "no_proof", 0x0882: "complex_script", 0x2A53: "double_strike"}
PLAIN: dict[int, tuple[str, Callable]] = {
    0x0800: ("deleted", _bool), 0x0801: ("inserted", _bool), 0x0806: ("data", _flag), 0x080A: ("ole", _flag), 0x0856: ("placeholder", _flag),
    0x2A3E: ("underline", _named(_UNDERLINES)), 0x4A43: ("size_half_points", _within("H", 2, 3276)), 0x4A61: ("size_cs_half_points", _within("H", 0, 3276)), 0x4845: ("raised_half_points", _i16), 0x2A42: ("color", _named(PALETTE)), 0x6870: ("color", _colour), 0x6877: ("underline_color", _colour),
    0x4A4F: ("font_ascii", _u16), 0x4A50: ("font_east_asia", _u16), 0x4A51: ("font_other", _u16), 0x4A5E: ("font_cs", _u16), 0x4A30: ("style_id", _u16), 0x2A48: ("vertical", _named({0: "baseline", 1: "superscript", 2: "subscript"})), 0x2A0C: ("highlight", _named(_HIGHLIGHTS)),
    0x486D: ("language", _lid), 0x4873: ("language", _lid), 0x4874: ("language_east_asia", _lid), 0x486E: ("language_east_asia", _lid), 0x485F: ("language_cs", _lid), 0x8840: ("spacing_twips", _i16), 0x484B: ("kerning_half_points", _within("h", 0, 3276)), 0x4852: ("scale_percent", _within("H", 1, 600)), 0x6A03: ("picture_location", _u32), 0x6A09: ("symbol", lambda b: f"{_u16(b[:2])}:{_u16(b[2:]):04X}"),
    0x6815: ("rsid_props", _u32), 0x6816: ("rsid_text", _u32), 0x2A34: ("emphasis", _named("none dot comma circle underDot".split())), 0x2879: ("break_clear", _named("none left right all".split())),
}
LANGUAGE = {0x485F, 0x486D, 0x486E, 0x4873, 0x4874}
PARA: dict[int, tuple[str, Callable]] = {
    0x4600: ("style_id", _u16), 0x2403: ("align", _named(_ALIGN)), 0x2461: ("align", _named(_ALIGN)), 0x2405: ("keep_lines", _bool), 0x2406: ("keep_next", _bool), 0x2407: ("page_break_before", _bool), 0x260A: ("list_level", _i8), 0x460B: ("list_id", _list_of), 0x240C: ("no_line_numbers", _bool),
    0x840E: ("right_twips", _i16), 0x845D: ("right_twips", _i16), 0x840F: ("left_twips", _i16), 0x845E: ("left_twips", _i16), 0x8411: ("first_line_twips", _i16), 0x8460: ("first_line_twips", _i16), 0xA413: ("before_twips", _u16), 0xA414: ("after_twips", _u16), 0x245B: ("before_auto", _bool), 0x245C: ("after_auto", _bool),
    0x2416: ("in_table", _bool), 0x2417: ("row_end", _bool), 0x244B: ("inner_cell_end", _bool), 0x244C: ("inner_row_end", _bool), 0x6649: ("table_depth", _i32), 0x2431: ("widow_control", _bool), 0x242A: ("no_hyphenation", _bool), 0x2640: ("outline_level", _i8), 0x2441: ("rtl", _bool), 0x246D: ("contextual_spacing", _bool),
    0x2470: ("mirror_indents", _bool), 0x6467: ("rsid", _u32), 0x2433: ("kinsoku", _bool), 0x2434: ("word_wrap", _bool), 0x2435: ("overflow_punctuation", _bool), 0x2436: ("top_line_punctuation", _bool), 0x2437: ("auto_space_latin", _bool), 0x2438: ("auto_space_numbers", _bool),
    0x2447: ("snap_to_grid", _bool), 0x2448: ("adjust_right", _bool), 0x4455: ("right_chars", _i16), 0x4456: ("left_chars", _i16), 0x4457: ("first_line_chars", _i16), 0x4458: ("before_lines", _within("h", -20, 31680)), 0x4459: ("after_lines", _within("h", -20, 31680)),
    0x4439: ("text_align", _named("top center baseline bottom auto".split())), 0x2471: ("tight_wrap", _named("none allLines firstAndLastLine firstLineOnly lastLineOnly".split())),
    0x2423: ("frame_wrap", _named("auto notBeside around none tight through".split())), 0x2430: ("frame_locked", _flag),
}
SECT: dict[int, tuple[str, Callable]] = {
    0x3009: ("break_kind", _named(_BREAKS)), 0x300A: ("title_page", _flag), 0x500B: ("columns", lambda b: _u16(b) + 1), 0x900C: ("column_space_twips", _u16), 0x3005: ("even_columns", _flag), 0x3019: ("column_line", _flag), 0x301D: ("orientation", _named({1: "portrait", 2: "landscape"})), 0xB01F: ("page_width_twips", _u16), 0xB020: ("page_height_twips", _u16),
    0xB021: ("left_twips", _u16), 0xB022: ("right_twips", _u16), 0x9023: ("top_twips", _i16), 0x9024: ("bottom_twips", _i16), 0xB025: ("gutter_twips", _u16), 0xB017: ("header_twips", _u16), 0xB018: ("footer_twips", _u16), 0x300E: ("page_number_format", lambda b: v if (v := NUMBER_FORMATS.get(b[0])) not in ("bullet", "none") else None), 0x3011: ("page_number_restart", _flag), 0x501C: ("page_number_start", _u16), 0x7044: ("page_number_start", _u32), 0x301A: ("vertical_align", _named("top center both bottom".split())), 0x3228: ("rtl", _flag), 0x3006: ("form_protected", _named({0: True, 1: False})),
    0x3000: ("chapter_separator", _named("hyphen period colon emDash enDash".split())), 0x3001: ("chapter_style", lambda b: b[0]), 0x3012: ("suppress_endnotes", _named({0: True, 1: False})), 0x5007: ("paper_first", _u16), 0x5008: ("paper_other", _u16), 0x3013: ("line_number_restart", _named("newPage newSection continuous".split())),
    0x5015: ("line_number_count_by", _u16), 0x9016: ("line_number_distance_twips", _u16), 0x501B: ("line_number_start", _u16), 0x303C: ("footnote_restart", _named("continuous eachSect eachPage".split())), 0x303B: ("footnote_position", _named({1: "pageBottom", 2: "beneathText"})),
    0x303E: ("endnote_restart", _named("continuous eachSect".split())), 0x503F: ("footnote_start", _within("H", 0, 16383)), 0x5041: ("endnote_start", _within("H", 0, 16383)), 0x322A: ("rtl_gutter", _flag), 0x7030: ("grid_char_space", _i32), 0x9031: ("grid_line_pitch_twips", _u16),
    0x5032: ("grid_type", lambda b: dict(enumerate("none linesAndChars lines snapToChars".split())).get(_u16(b))), 0x5033: ("flow", lambda b: ("lrTb" if not _u16(b) else "tbRl" if _u16(b) in (1, 3, 5) else None)), 0x5040: ("footnote_format", lambda b: NUMBER_FORMATS.get(b[0])), 0x5042: ("endnote_format", lambda b: NUMBER_FORMATS.get(b[0])), 0x703A: ("rsid", _u32), 0x5026: ("paper_request", _u16),
}
_SIDES = ("top", "left", "bottom", "right")
#: Sides of a paragraph's borders, of four and of eight bytes.
PARA_BORDERS = {0x6424 + k: side for k, side in enumerate((*_SIDES, "between"))} | {0xC64E + k: side for k, side in enumerate((*_SIDES, "between"))}
PAGE_BORDERS = {0x702B + k: side for k, side in enumerate(_SIDES)} | {0xD234 + k: side for k, side in enumerate(_SIDES)}
#: Modifiers of paragraphs and tables that other programs write and that say nothing.
_SILENT = {0x6629, 0xC653, 0xC669, 0xC66C}
ROW: dict[int, tuple[str, Callable]] = {
    0x548A: ("align", _named({0: "left", 1: "center", 2: "right"})), 0x5400: ("align", _named({0: "left", 1: "center", 2: "right"})), 0x9601: ("left_twips", _i16), 0x9602: ("gap_twips", _within("h", 0, 31680)), 0x3466: ("cant_split", _bool), 0x3403: ("cant_split", _bool), 0x3404: ("header", _bool), 0x563A: ("style_id", _u16), 0x3615: ("autofit", _flag),
    0x560B: ("rtl", lambda b: _u16(b) != 0), 0x5664: ("rtl", lambda b: _u16(b) != 0), 0x3465: ("no_overlap", _flag), 0x7479: ("rsid", _u32), 0x347C: ("style_align", _named("top center bottom".split())), 0x347D: ("style_no_wrap", _flag),
    0x3488: ("row_band", _within("B", 1, 3)), 0x3489: ("column_band", _within("B", 1, 3)),
}


def _put(out: dict, name: str, value: str | int | None) -> None:
    """Sets a property, or takes it away."""
    if value is None:
        out.pop(name, None)
    else:
        out[name] = value


def fold_character(mods: list[tuple[int, bytes]], base: dict, below: dict, unknown: set[int]) -> dict:
    """``base`` changed by the modifiers in order. ``below`` is the style's: relative toggles are taken against it."""
    out = dict(base)
    for opcode, b in mods:
        if opcode >> 10 & 7 != CHARACTER:
            continue
        if opcode in TOGGLES:
            name, was = TOGGLES[opcode], bool(below.get(TOGGLES[opcode], False))
            value = {0: False, 1: True, 0x80: was, 0x81: not was}.get(b[0])
            if value is None:
                unknown.add(opcode)
            else:
                out[name] = value
        elif opcode == 0x2A33:  # plain text again, but for what the text is
            out = {k: v for k, v in out.items() if k in ("special", "picture_location", "symbol", "style_id")}
        elif opcode == 0x4A30:
            out = {"style_id": _u16(b)} | {k: v for k, v in out.items() if k in ("special", "picture_location", "symbol")}
        elif opcode in (0x4866, 0xCA71):
            value, rough = R.shading(b)
            _put(out, "shading", value)
            if rough:
                unknown.add(opcode)
        elif opcode in (0x6865, 0xCA72):
            _put(out, "border", R.border(b))
        elif opcode == 0x2859:
            effects = ("lights", "blinkBackground", "sparkle", "antsBlack", "antsRed", "shimmer")
            if b[0] > len(effects):
                unknown.add(opcode)
            else:
                _put(out, "effect", effects[b[0] - 1] if b[0] else None)
        elif opcode == 0x286F:
            if b[0] not in (0, 1, 2, 255):
                unknown.add(opcode)
            else:
                _put(out, "font_hint", {0: "default", 1: "eastAsia", 2: "cs"}.get(b[0]))
        elif opcode == 0xCA76:
            width, number = take(b, "iI", 0)
            if 0 <= width <= R.MAX_TWIPS:
                _put(out, "fit_text_twips", width or None)
                _put(out, "fit_text_id", number if width else None)
            else:
                unknown.add(opcode)
        elif opcode == 0xCA78:
            flags, number = take(b, "HI", 0)
            bracket = flags >> 8 & 7
            if flags & 0x683C or (flags & 2 and bracket > 4):
                raise CorruptDocument("a layout of East Asian text has flags that are none")
            out |= {"east_asian_vertical": bool(flags & 1), "east_asian_combine": bool(flags & 2), "east_asian_compress": bool(flags & 0x1000), "east_asian_id": number}
            _put(out, "east_asian_brackets", ("none", "round", "square", "angle", "curly")[bracket] if flags & 2 else None)
        elif opcode in LANGUAGE and _u16(b) == 0x0400:  # text that is not proofed names no language
            out["no_proof"] = True
        elif opcode in PLAIN:
            name, decode = PLAIN[opcode]
            value = decode(b)
            if value is None:
                unknown.add(opcode)
            else:
                out[name] = value
        elif opcode != 0x0802:  # a field's own mark says nothing
            unknown.add(opcode)
    return out


def _frame(opcode: int, b: bytes) -> dict | None:
    """What a modifier says of the frame that a paragraph stands in, None values to be taken away; nothing if it is none."""
    if opcode == 0x261B:
        return {f"frame_{k}": v for k, v in R.anchors(b).items()}
    if opcode in (0x8418, 0x8419):
        return {f"frame_{k}": v for k, v in R.position(b, "x" if opcode == 0x8418 else "y").items()}
    if opcode in (0x841A, 0x842E, 0x842F):
        value = _i16(b)
        if not 0 <= value <= R.MAX_TWIPS:
            raise CorruptDocument("a frame is too large")
        return {"frame_width_twips": value or None} if opcode == 0x841A else {"frame_space_y_twips" if opcode == 0x842E else "frame_space_x_twips": value}
    if opcode == 0x442B:
        value = _u16(b)
        height, least = value & 0x7FFF, value >> 15
        if height > R.MAX_TWIPS or (least and not height):
            raise CorruptDocument("a frame has a height of no kind")
        return {"frame_height_twips": height or None, "frame_height_rule": "atLeast" if least else "exact" if height else "auto"}
    if opcode == 0x443A:
        if _u16(b) not in R.FLOWS:
            raise CorruptDocument("a frame has a text flow of no kind")
        return {"frame_flow": R.FLOWS[_u16(b)]}
    if opcode == 0x442C:
        kind, lines = _u16(b) & 7, _u16(b) >> 3 & 31
        if kind == lines == 0:
            return {"drop_cap": "none", "drop_cap_lines": None}
        return {"drop_cap": ("drop", "margin")[kind - 1], "drop_cap_lines": lines} if kind in (1, 2) and 1 <= lines <= 10 else None
    return None


_FRAMES = {0x261B, 0x8418, 0x8419, 0x841A, 0x842E, 0x842F, 0x442B, 0x443A, 0x442C}
_LEADERS = (None, "dot", "hyphen", "underscore", "heavy", "middleDot", "-", None)


def tabs(b: bytes, ranges: bool) -> list[tuple]:
    """(position, what, leader) of the stops that a change deletes (``clear``) and adds."""
    gone = take(b, "B", 0)[0]
    at = 1 + (4 if ranges else 2) * gone
    added = take(b, "B", at)[0]
    if gone > 64 or added > 64 or len(b) != at + 1 + 3 * added:
        raise CorruptDocument("tab stops do not fill their list")
    drop, places = take(b, f"{gone}h", 1), take(b, f"{added}h", at + 1)
    if list(drop) != sorted(drop) or list(places) != sorted(places) or (ranges and 0 in take(b, f"{gone}H", 1 + 2 * gone)):
        raise CorruptDocument("tab stops are out of order")
    out = [(place, "clear", None) for place in drop]
    for place, bits in zip(places, b[at + 1 + 2 * added :]):
        kind = ("left", "center", "right", "decimal", "bar", None, "num", None)[bits & 7]
        if kind is None or _LEADERS[bits >> 3 & 7] == "-":
            raise CorruptDocument("a tab stop of no kind")
        out.append((place, kind, _LEADERS[bits >> 3 & 7]))
    return out


def fold_paragraph(mods: list[tuple[int, bytes]], base: dict, unknown: set[int]) -> dict:
    """Paragraph and row properties: sets, sums (nesting) and lists (tab stops), in order."""
    out = dict(base)
    for opcode, b in mods:
        group = opcode >> 10 & 7
        if group == TABLE:
            row = out.get("row", {})
            if opcode in R.EDITS:
                row, rough = R.edited(row, opcode, b)
                if rough:
                    unknown.add(opcode)
            elif opcode in ROW and (value := ROW[opcode][1](b)) is not None:
                row = row | {ROW[opcode][0]: value}
            elif not (opcode == 0xD5FF and b == b"\x01\x00\x05\x00"):
                unknown.add(opcode)
            out["row"] = row
        elif group != PARAGRAPH:
            continue
        elif opcode == 0x664A:  # deeper or less deep than before
            out["table_depth"] = max(0, out.get("table_depth", 0) + _i32(b))
        elif opcode in (0x4610, 0x465F):  # a nesting takes the place of the one before, and the modern kind of the other
            if opcode == 0x465F or not out.get("nest_modern"):
                out |= {"left_twips": out.get("left_twips", 0) - out.get("nest_twips", 0) + _i16(b), "nest_twips": _i16(b), "nest_modern": opcode == 0x465F}
        elif opcode == 0x260A:  # a level that is none leaves the paragraph without its number
            if 0 <= _i8(b) <= 8:
                out["list_level"] = _i8(b)
                out.pop("list_skipped", None)
            elif b[0] == 12:
                out["list_skipped"] = True
            else:
                unknown.add(opcode)
        elif opcode == 0x2602:  # headings deeper or less deep, as far as they go
            level = out.get("style_id", 0) + _i8(b)
            if 1 <= out.get("style_id", 0) <= 9:
                out |= {"style_id": min(9, max(1, level)), "outline_level": min(9, max(1, level)) - 1}
        elif opcode in PARA_BORDERS:
            _put(out, f"border_{PARA_BORDERS[opcode]}", R.border(b))
        elif opcode == 0x442D:
            value, rough = R.shading(b)
            out["shading"] = value or ("nil:auto:auto" if b == b"\xff\xff" else "clear:auto:auto")
            if rough:
                unknown.add(opcode)
        elif opcode == 0xC64D:
            value, rough = R.shading(b)
            _put(out, "shading", value)
            if rough:
                unknown.add(opcode)
        elif opcode in _FRAMES:
            made = _frame(opcode, b)
            if made is None:
                unknown.add(opcode)
            for k, v in (made or {}).items():
                _put(out, k, v)
        elif opcode == 0x6412:
            out |= _line(b)
        elif opcode in (0xC60D, 0xC615):
            stops = {t[0]: t for t in out.get("tabs", [])}
            for t in tabs(b, opcode == 0xC615):
                stops[t[0]] = t
            out["tabs"] = [stops[k] for k in sorted(stops)]
        elif opcode in PARA:
            name, decode = PARA[opcode]
            if (value := decode(b)) is not None or name == "list_id":
                out[name] = value
            else:
                unknown.add(opcode)
        elif opcode not in _SILENT:
            unknown.add(opcode)
    return out


_CUTS = ("allPages", "firstPage", "notFirstPage")


def fold_section(mods: list[tuple[int, bytes]], unknown: set[int]) -> dict:
    """Properties of a section; numbers that count only together with others are settled at the end."""
    out: dict = {}
    widths: dict[int, int] = {}
    gaps: dict[int, int] = {}
    frame: dict = {}
    for opcode, b in mods:
        if opcode >> 10 & 7 != SECTION:
            continue
        if opcode in (0xF203, 0xF204):
            k, value = take(b, "BH", 0)
            if k > 43 or value > R.MAX_TWIPS or (opcode == 0xF203 and value < 718):
                raise CorruptDocument("a column of a section is out of range")
            (widths if opcode == 0xF203 else gaps)[k] = value
        elif opcode in PAGE_BORDERS:
            _put(out, f"border_{PAGE_BORDERS[opcode]}", R.border(b))
        elif opcode == 0x522F:
            show, order, from_ = b[0] & 7, b[0] >> 3 & 3, b[0] >> 5
            if b[1] or show > 2 or order > 1 or from_ > 1:
                raise CorruptDocument("page borders of no kind")
            frame = {"border_display": _CUTS[show], "border_order": ("front", "back")[order], "border_offset": ("text", "page")[from_]}
        elif opcode in SECT:
            value = SECT[opcode][1](b)
            if value is None:
                unknown.add(opcode)
            else:
                out[SECT[opcode][0]] = value
        elif not (opcode == 0xD1FF and b == b"\x03\x00"):
            unknown.add(opcode)
    for name, (low, high) in _LIMITS.items():
        if name in out and not low <= out[name] <= high:
            raise CorruptDocument(f"{name} of a section is {out[name]}")
    if out.get("grid_type") == "none":
        del out["grid_type"]
    n = out.get("columns", 1)
    if out.get("even_columns") is False:
        if set(widths) != set(range(n)):  # widths have to be given for every column and for no other
            unknown.add(0x3005)
            del out["even_columns"]
        elif any(k >= n - 1 for k in gaps):
            raise CorruptDocument("space after the last column of a section")
        else:
            out.pop("column_space_twips", None)
            out |= {"column_widths_twips": [widths[k] for k in range(n)], "column_spaces_twips": [gaps.get(k, 0) for k in range(n - 1)]}
    start = out.pop("page_number_start", 0)
    if out.get("page_number_restart"):
        out["page_number_start"] = start
    if not out.get("chapter_style"):
        out.pop("chapter_style", None), out.pop("chapter_separator", None)
    if any(k.startswith("border_") for k in out):
        out |= {"border_display": "allPages", "border_order": "front", "border_offset": "text"} | frame
    lines = {k: out.pop(f"line_number_{k}", d) for k, d in (("count_by", 0), ("start", 0), ("distance_twips", 0), ("restart", "newPage"))}
    if lines["count_by"]:
        out |= {f"line_number_{k}": v for k, v in lines.items()}
    for kind in ("footnote", "endnote"):
        if out.get(f"{kind}_restart", "continuous") != "continuous":
            out.pop(f"{kind}_start", None)
    return out


#: The margins that a page has where its section gives none, and how far headers are from its edge.
MARGINS = {"top_twips": 1440, "bottom_twips": 1440, "left_twips": 1440, "right_twips": 1440}
_LIMITS = {
    "columns": (1, 44), "page_width_twips": (144, 31680), "page_height_twips": (144, 31680), "top_twips": (-31665, 31665), "bottom_twips": (-31665, 31665), "line_number_count_by": (0, 100), "line_number_distance_twips": (0, 31680),
    "chapter_style": (0, 9), "page_number_start": (0, 2147483646), "grid_char_space": (-670925, 6488064), "grid_line_pitch_twips": (1, 31680),
}
