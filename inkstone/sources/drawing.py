"""Drawings: the tree of records beside the text, shapes with their options, and the images that they show."""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

from .errors import CorruptDocument, TooLarge, part, take

MAX_DEPTH, MAX_IMAGE = 32, 256 << 20
GROUP, SHAPE, STORE_ENTRY, SHAPE_ID, OPTIONS, CHILD_ANCHOR, GROUP_FRAME = 0xF003, 0xF004, 0xF007, 0xF00A, 0xF00B, 0xF00F, 0xF009
IMAGES = {0xF01A: "emf", 0xF01B: "wmf", 0xF01C: "pict", 0xF01D: "jpeg", 0xF01E: "png", 0xF01F: "bmp", 0xF029: "tiff", 0xF02A: "jpeg"}
_TWO_NAMES = {0x3D5, 0x217, 0x543, 0x46B, 0x6E3, 0x6E1, 0x7A9, 0x6E5}
_MAGIC = {"png": b"\x89PNG\r\n\x1a\n", "jpeg": b"\xff\xd8\xff", "bmp": b"BM", "tiff": (b"II*\0", b"MM\0*")}


def records(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(kind, instance, whether it holds records, first byte, end) of the records side by side in a range."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        head, kind, size = struct.unpack_from("<HHI", data, at)
        if at + 8 + size > end:
            raise CorruptDocument("a drawing record runs past its place")
        yield kind, head >> 4, head & 15 == 15, at + 8, at + 8 + size
        at += 8 + size


def options(data: bytes, at: int, end: int, count: int) -> dict[int, int | bytes]:
    """Options of a shape by number; long ones as bytes."""
    out: dict[int, int | bytes] = {}
    long_at = at + 6 * count
    for k in range(count):
        number, value = take(data, "Hi", at + 6 * k)
        if number & 0x8000:
            if long_at + value > end:
                raise CorruptDocument("a shape's option runs past its record")
            out[number & 0x3FFF], long_at = data[long_at : long_at + value], long_at + value
        else:
            out[number & 0x3FFF] = value
    return out


def colour(value: int | None) -> str | None:
    if value is None or not isinstance(value, int) or value >> 24 & 0xFF:
        return None
    return f"{value & 255:02X}{value >> 8 & 255:02X}{value >> 16 & 255:02X}"


def polygon(data: bytes) -> list[tuple[int, int]]:
    """Vertices of a wrap polygon, inside a square of 21600, halves to the even neighbour."""
    corners = points(data)
    if not corners:
        return []
    (x0, y0), (x1, y1) = (tuple(f(p[i] for p in corners) for i in (0, 1)) for f in (min, max))
    return [(round((x - x0) * 21600 / max(1, x1 - x0)), round((y - y0) * 21600 / max(1, y1 - y0))) for x, y in corners]


def points(data: bytes) -> list[tuple[int, int]]:
    """An array of points, of two or four bytes each way."""
    count, _, size = take(data, "HHH", 0)
    fmt, width = ("hh", 4) if size in (0xFFF0, 4) else ("ii", 8)
    return [take(data, fmt, 6 + width * k) for k in range(count)]


def _pairs(some: list[tuple[int, int]]) -> str:
    return ",".join(str(v) for p in some for v in p)


def path(o: dict[int, int | bytes]) -> tuple[str, str] | None:
    """(path, extent) of a shape's own geometry, in its own space: vertices taken by segments. Nothing where a segment is of
    a kind that has no equal, or where vertices are left over or lacking."""
    vertices, segments = o.get(0x145), o.get(0x146)
    if not isinstance(vertices, bytes) or not isinstance(segments, bytes) or len(segments) < 6:
        return None
    count, room, size = take(segments, "HHH", 0)
    left, top, right, bottom = (o.get(k, d) for k, d in ((0x140, 0), (0x141, 0), (0x142, 21600), (0x143, 21600)))
    if not 1 <= count <= min(room, 4096) or size != 2 or len(segments) != 6 + 2 * count or right <= left or bottom <= top:
        return None
    rest, out = iter([(x - left, y - top) for x, y in points(vertices)]), []

    def some(n: int) -> str | None:
        taken = [p for _, p in zip(range(n), rest)]
        return _pairs(taken) if len(taken) == n else None

    for segment in take(segments, f"{count}H", 6):
        kind, n = segment >> 13, segment & 0x1FFF
        if kind in (0, 1, 2):  # lines, curves, a move
            each = [some(n or 1)] if kind == 0 else [some(3) for _ in range(n or 1)] if kind == 1 else [some(1)]
            if None in each:
                return None
            out += ["lcm"[kind] + e for e in each]
        elif kind in (3, 4):
            out.append("xe"[kind - 3])
        elif kind == 7 or segment & 0xFF:
            return None
        else:
            out += {10: ["nf"], 11: ["ns"]}.get(segment >> 8 & 31, [])
    if next(rest, None) is not None or not out:
        return None
    return "".join(out) + ("" if out[-1] == "e" else "e"), f"{right - left},{bottom - top}"


_COMPOUND = ("single", "thinThin", "thickThin", "thinThick", "thickBetweenThin")
_DASHES = ("solid", "shortdash", "shortdot", "shortdashdot", "shortdashdotdot", "dot", "dash", "longdash", "dashdot", "longdashdot", "longdashdotdot")
_HEADS = ("none", "block", "classic", "diamond", "oval", "open")


def look(o: dict[int, int | bytes]) -> tuple[dict, bool]:
    """How a shape is filled, drawn and set, and whether that is only an approximation."""
    rough = False

    def number(key: int, default: int, most: int | None = None) -> int:
        nonlocal rough
        v = o.get(key, default)
        if not isinstance(v, int) or (most is not None and not 0 <= v <= most):
            rough = True
            return default
        return v

    def named(key: int, names: tuple[str, ...], default: int) -> str:
        nonlocal rough
        v = number(key, default)
        rough |= not 0 <= v < len(names)
        return names[v] if 0 <= v < len(names) else names[default]

    def switched(key: int, bit: int) -> bool:
        v = number(key, 0)
        return bool(v >> bit & 1) if v >> 16 + bit & 1 else True

    def shade(key: int, default: str) -> str:
        nonlocal rough
        v = o.get(key)
        if v is None:
            return default
        found = colour(v)
        rough |= found is None
        return found or default

    out: dict = {"filled": switched(0x1BF, 4), "lined": switched(0x1FF, 3)}
    if out["filled"]:
        rough |= number(0x180, 0) != 0
        out |= {"fill": shade(0x181, "FFFFFF"), "fill_opacity": number(0x182, 0x10000, 0x10000)}
    if out["lined"]:
        rough |= number(0x1C4, 0) != 0
        out |= {"line": shade(0x1C0, "000000"), "line_opacity": number(0x1C1, 0x10000, 0x10000), "line_width_emu": number(0x1CB, 9525, 20116800), "line_style": named(0x1CD, _COMPOUND, 0), "line_dash": named(0x1CE, _DASHES, 0)}
        out |= {"line_join": named(0x1D6, ("bevel", "miter", "round"), 2), "line_cap": named(0x1D7, ("round", "square", "flat"), 2)}
        for which, head, width, length in (("start", 0x1D0, 0x1D2, 0x1D3), ("end", 0x1D1, 0x1D4, 0x1D5)):
            out |= {f"{which}_arrow": named(head, _HEADS, 0), f"{which}_arrow_width": named(width, ("narrow", "medium", "wide"), 1), f"{which}_arrow_length": named(length, ("short", "medium", "long"), 1)}
    for side, key, default in (("left", 0x81, 91440), ("top", 0x82, 45720), ("right", 0x83, 91440), ("bottom", 0x84, 45720)):
        out[f"inset_{side}_emu"] = number(key, default, 20116800)
    if 0x390 in o or 0x391 in o or 0x392 in o or 0x393 in o:
        out |= {f"distance_{side}_emu": max(0, number(0x390 + k, 0)) for k, side in enumerate(("left", "top", "right", "bottom"))}
    return out, rough


def adjusts(o: dict[int, int | bytes]) -> str | None:
    """A shape's adjustments, with gaps where one is not given."""
    values = [str(v) if isinstance(v := o.get(0x147 + k), int) else "" for k in range(8)]
    while values and not values[-1]:
        values.pop()
    return ",".join(values) or None


#: Preset shapes that have an equal where documents are drawn today.
PRESETS = frozenset([*range(1, 17), *range(20, 24), *range(53, 56), 57, 59, 60, *range(64, 74), 75, 77, 78, 80, 81, 82, *range(84, 89), 92, 93, 94, 96, 97, *range(102, 106), 107, 108, *range(109, 121), 122, *range(125, 135), 176, 177, *range(183, 188), *range(189, 201)])


def line_like(s: dict) -> bool:
    """A straight line, or a shape of no kind that is drawn and not filled, as connectors in groups are."""
    return s.get("type") == 20 or (not s.get("type") and s["look"]["lined"] and not s["look"]["filled"])


def floating(anchors: list[dict], drawn: list[dict], boxes: dict[int, str], stored: int, tally: Counter) -> list[dict]:
    """What floats over each place of the text: text boxes, pictures and shapes, those in groups mapped through the frames
    of all groups around them. ``kind`` says what becomes of each; groups that show nothing are kept as ``group``."""
    known: dict[int, dict] = {}
    for d in drawn:
        known.setdefault(d["shape_id"], d)
    parents = {d["parent"] for d in known.values() if d["parent"] is not None}
    placed_at: dict[int, dict | None] = {a["shape_id"]: a for a in anchors}

    def at(number: int, seen: frozenset[int]) -> dict | None:
        if number in placed_at or number in seen:
            return placed_at.get(number)
        d = known.get(number)
        group = known.get(d["parent"]) if d and d["parent"] is not None else None
        outer = at(d["parent"], seen | {number}) if group and "anchor" in d and "frame" in group else None
        made = None
        if outer and group["frame"][2] != group["frame"][0] and group["frame"][3] != group["frame"][1]:
            left, top, right, bottom = placed(d["anchor"], group["frame"], (outer["l"], outer["t"], outer["r"], outer["b"]))
            made = outer | {"shape_id": number, "l": left, "t": top, "r": right, "b": bottom}
        placed_at[number] = made
        return made

    out, own = [], {a["shape_id"] for a in anchors}
    for number in [*own, *(n for n in known if n not in own)]:
        a, d = at(number, frozenset()), known.get(number, {})
        if a is None:
            if number in boxes:
                tally["TEXTBOX_WITHOUT_PLACE"] += 1
            continue
        style, rough = d.get("look", {}), d.get("rough", False)
        s = a | {k: d.get(k) for k in ("type", "parent", "rotation", "image", "fill", "line", "flip_h", "flip_v", "adjusts")} | {"path": None, "coordsize": None, "style": {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in style.items()}, "text": boxes.get(number)}
        if number in boxes:
            s["kind"] = "textbox"
        elif d.get("image") is not None:
            s["kind"] = "picture"
        elif d and line_like(d):
            s["kind"] = "line"
            if number not in own:
                tally["GROUPED_FLOATING_LINES_UNGROUPED"] += 1
        elif d.get("type") in PRESETS:
            s["kind"] = "shape"
        elif found := path(d.get("options", {})):
            s |= {"kind": "shape", "path": found[0], "coordsize": found[1]}
        elif len(d.get("polygon", [])) > 2:
            first, *rest = d["polygon"]
            s |= {"kind": "shape", "path": f"m{_pairs([first])}l{_pairs(rest)}xe", "coordsize": "21600,21600"}
            tally["FLOATING_SHAPE_GEOMETRY_APPROXIMATED"] += 1
        elif number in parents:
            s["kind"] = "frame" if style.get("filled") else "group"
            if s["kind"] == "frame":
                tally["GROUPED_FLOATING_FRAME_FLATTENED"] += 1
        else:
            s["kind"] = "deferred"
            tally["FLOATING_SHAPE_TYPES_DEFERRED"] += 1
        if rough and s["kind"] in ("shape", "line", "textbox"):
            tally["FLOATING_SHAPE_STYLE_APPROXIMATED"] += 1
        out.append(s)
    out.sort(key=lambda s: (s["story"], s["anchor_cp"], s["shape_id"]))
    shown = [(s["story"], s["anchor_cp"]) for s in out if s["kind"] == "picture" and s["shape_id"] in own]
    if len(set(shown)) != len(shown):
        raise CorruptDocument("two floating pictures have one place")
    return out


def shape(data: bytes, at: int, end: int) -> dict:
    out: dict = {"options": {}}
    for kind, instance, _, a, b in records(data, at, end):
        if kind == SHAPE_ID:
            out["type"], (out["shape_id"], flags) = instance, take(data, "II", a)
            out |= {"flip_h": bool(flags & 0x40), "flip_v": bool(flags & 0x80), "group": bool(flags & 1)}
        elif kind == OPTIONS:
            out["options"] |= options(data, a, b, instance)
        elif kind in (CHILD_ANCHOR, GROUP_FRAME):
            out["frame" if kind == GROUP_FRAME else "anchor"] = take(data, "iiii", a)
    o = out["options"]
    filled, lined = o.get(0x1BF, 0), o.get(0x1FF, 0)
    out |= {
        "rotation": o.get(0x4, 0) / 65536,
        "image": o.get(0x104),
        "fill": None if filled & 0x100000 and not filled & 0x10 else colour(o.get(0x181)),
        "line": None if lined & 0x80000 and not lined & 0x8 else colour(o.get(0x1C0)),
        "line_width_emu": o.get(0x1CB),
        "polygon": polygon(o[0x383]) if isinstance(o.get(0x383), bytes) else [],
        "adjusts": adjusts(o),
    }
    out["look"], out["rough"] = look(o)
    return out


def walk(data: bytes, at: int, end: int, parent: int | None = None, depth: int = 0) -> Iterator[dict]:
    """All shapes of a range of records, each with the group that it is in."""
    if depth > MAX_DEPTH:
        raise CorruptDocument("drawings are nested too deeply")
    head = None
    for kind, _, holds, a, b in records(data, at, end):
        if kind == SHAPE:
            s = shape(data, a, b)
            if "shape_id" not in s:
                continue
            if s["group"] and head is None and depth:
                head = s["shape_id"]
                yield s | {"parent": parent}
            else:
                yield s | {"parent": head if head is not None else parent}
        elif holds:
            yield from walk(data, a, b, head if kind == GROUP and head is not None else parent if head is None else head, depth + 1)


def placed(child: tuple[int, int, int, int], frame: tuple[int, int, int, int], rect: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """A rectangle in the coordinates of its group, mapped to those of the page; halves go to the even neighbour."""
    fx, fy = frame[2] - frame[0], frame[3] - frame[1]
    if not fx or not fy:
        raise CorruptDocument("a group without extent")
    x = [round(rect[0] + (child[i] - frame[0]) * (rect[2] - rect[0]) / fx) for i in (0, 2)]
    y = [round(rect[1] + (child[i] - frame[1]) * (rect[3] - rect[1]) / fy) for i in (1, 3)]
    return min(x), min(y), max(x), max(y)


def bitmap_file(dib: bytes) -> bytes:
    """A device-independent bitmap with the file header that it lacks."""
    size = take(dib, "I", 0)[0]
    if size == 12:
        depth, used, masks, width = take(dib, "H", 10)[0], 0, 0, 3
    else:
        depth, packing = take(dib, "HI", 14)
        used, masks, width = take(dib, "I", 32)[0], 12 if packing == 3 and size == 40 else 0, 4
    colours = used or (1 << depth if depth <= 8 else 0)
    at = 14 + size + masks + width * colours
    if at > 14 + len(dib):
        raise CorruptDocument("a bitmap ends before its pixels")
    return struct.pack("<2sIII", b"BM", 14 + len(dib), 0, at) + dib


def inflate(data: bytes, most: int = MAX_IMAGE) -> bytes:
    engine = zlib.decompressobj()
    try:
        out = engine.decompress(data, most)
    except zlib.error as e:
        raise CorruptDocument(f"an image does not unpack: {e}") from e
    if engine.unconsumed_tail:
        raise TooLarge("an image unpacks to too many bytes")
    return out


def image(data: bytes, kind: int, instance: int, at: int, end: int) -> tuple[str, bytes]:
    """(format, bytes of a file) of an image record."""
    name = IMAGES[kind]
    at += 32 if instance in _TWO_NAMES else 16
    if name in ("emf", "wmf", "pict"):
        saved, packing = take(data, "I", at + 28)[0], take(data, "B", at + 32)[0]
        body = part(data, at + 34, min(saved, end - at - 34))
        return name, inflate(body) if packing == 0 else body
    body = data[at + 1 : end]
    if name == "bmp" and body[:2] != b"BM":
        body = bitmap_file(body)
    if name == "jpeg" and (stop := body.rfind(b"\xff\xd9")) >= 0:
        body = body[: stop + 2]
    if not body.startswith(_MAGIC[name]):
        raise CorruptDocument(f"an image is no {name}")
    return name, body


def store(group: bytes, at: int, end: int, word: bytes) -> list[tuple[str, bytes] | None]:
    """The images that shapes name by number (from 1): in the store, or where it says in the main stream."""
    out: list[tuple[str, bytes] | None] = []
    for kind, _, holds, a, b in records(group, at, end):
        if kind == STORE_ENTRY:
            delayed, named = take(group, "I", a + 28)[0], take(group, "B", a + 33)[0]
            inner = next(records(group, a + 36 + named, b), None) if b > a + 36 + named else None
            source = group
            if inner is None and delayed != 0xFFFFFFFF and delayed:
                inner, source = next(records(word, delayed, len(word)), None), word
            out.append(image(source, inner[0], inner[1], inner[3], inner[4]) if inner and inner[0] in IMAGES else None)
        elif holds:
            out += store(group, a, b, word)
    return out


def drawings(data: bytes, word: bytes) -> tuple[list[dict], list[tuple[str, bytes] | None]]:
    """All shapes and all stored images of a document: a group record, then a byte and a record for each drawing."""
    if not data:
        return [], []
    size = take(data, "I", 4)[0]
    images, out, at = store(data, 8, 8 + size, word) if size else [], [], 8 + size
    while at + 9 <= len(data):
        size = take(data, "I", at + 5)[0]
        part(data, at + 9, size)
        out += walk(data, at + 9, at + 9 + size)
        at += 9 + size
    return out, images


def inline_picture(data: bytes, at: int) -> dict:
    """The picture in the data stream that a text's character names: its format, size on the page and bytes."""
    size, head = take(data, "IH", at)
    body = part(data, at, size)
    kind = take(body, "H", 6)[0]
    width, height, scale_x, scale_y = take(body, "HHHH", 28)
    if kind not in (0x64, 0x66):
        raise CorruptDocument(f"a picture of kind {kind}")
    at = head + (1 + take(body, "B", head)[0] if kind == 0x66 else 0)
    found = None
    for record, instance, _, a, b in records(body, at):
        if record == STORE_ENTRY:
            named = take(body, "B", a + 33)[0]
            record, instance, _, a, b = next(records(body, a + 36 + named, b), (0, 0, False, a, b))
        if record in IMAGES:
            found = found or image(body, record, instance, a, b)
    if found is None:
        raise CorruptDocument("a picture holds no image")
    across, down = ((goal * scale + 500) // 1000 for goal, scale in ((width, scale_x or 1000), (height, scale_y or 1000)))
    if not (15 <= across <= 31680 and 15 <= down <= 31680):
        raise CorruptDocument(f"a picture of {across} by {down}")
    return {"format": found[0], "width_twips": across, "height_twips": down, "data": found[1]}


def record(kind: int, instance: int, body: bytes, holds: bool = False) -> bytes:
    """One record, for tests and round trips."""
    return struct.pack("<HHI", instance << 4 | (15 if holds else 0), kind, len(body)) + body
