"""The parse stage: a row of bytes becomes one wide row of the document model, decoded once; relations are views of it.

A document that cannot be read never stops the job: its row has a status, the class of the error and its message, and
no model. Bytes are read only of files within the size limit, which the scan checks before it opens them.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from . import drawing as D
from . import modifiers as M
from . import word as W
from .ciphers import unlock
from .compound import MAX_FILE, Compound, build
from .errors import CorruptDocument, DocumentError
from . import tables as R
from .story import BINARY, Names, Paragraph, Place, Spans, assemble, binary_fields, field_ends, read

_I, _L, _S, _B = pa.int32(), pa.int64(), pa.string(), pa.bool_()
_PROPS = pa.map_(_S, _S)


def _list(**fields: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct(list(fields.items())))


MODEL = pa.schema([
    ("version", _I), ("language", _S), ("encrypted", _B),
    ("entries", _list(path=_S, kind=_S, size=_L)),
    ("stories", _list(story=_S, cp_start=_I, cp_end=_I)),
    ("pieces", _list(ix=_I, cp_start=_I, cp_end=_I, file_offset=_L, compressed=_B, prm=_I)),
    ("char_spans", _list(cp_start=_I, cp_end=_I, props=_PROPS)),
    ("para_spans", _list(cp_start=_I, cp_end=_I, props=_PROPS)),
    ("paragraphs", _list(story=_S, ix=_I, cp_start=_I, cp_end=_I, text=_S, depth=_I, style_id=_I, props=_PROPS)),
    ("inlines", _list(story=_S, paragraph=_I, ix=_I, kind=_S, text=_S, cp=_I, props=_PROPS)),
    ("nodes", _list(story=_S, path=pa.list_(_I), kind=_S, depth=_I, paragraph=_I)),
    ("table_rows", _list(story=_S, path=pa.list_(_I), grid_before=_I, grid_after=_I, edges=pa.list_(_I), props=_PROPS, cells=pa.list_(pa.struct([("ix", _I), ("width", _I), ("span", _I), ("props", _PROPS)])))),
    ("tables", _list(story=_S, path=pa.list_(_I), columns=pa.list_(_I), props=_PROPS)),
    ("fields", _list(story=_S, begin_cp=_I, sep_cp=_I, end_cp=_I, depth=_I, field_type=_S, instruction=_S, live=_B, fate=_S, locked=_B, dirty=_B)),
    ("bookmarks", _list(id=_I, name=_S, cp_start=_I, cp_end=_I, column_first=_I, column_last=_I, story=_S)),
    ("notes", _list(kind=_S, id=_I, ref_cp=_I, text=_S)),
    ("comments", _list(id=_I, ref_cp=_I, author=_S, initials=_S, text=_S, range_start=_I, range_end=_I)),
    ("sections", _list(ix=_I, cp_start=_I, cp_end=_I, props=_PROPS)),
    ("section_stories", _list(section=_I, slot=_S, story=_S, text=_S)),
    ("styles", _list(id=_I, kind=_S, name=_S, based_on=_I, next_style=_I, chp=_PROPS, pap=_PROPS)),
    ("table_conditions", _list(style=_I, condition=_S, chp=_PROPS, pap=_PROPS, row=_PROPS)),
    ("fonts", _list(ix=_I, name=_S)),
    ("lists", _list(list_id=_I, name=_S, kind=_S, level=_I, start=_I, format=_I, text=_S, align=_S, suffix=_S, legal=_B, restart_after=_I, chp=_PROPS, pap=_PROPS)),
    ("list_uses", _list(id=_I, list_id=_I, overrides=pa.list_(pa.struct([("level", _I), ("start", _I), ("format", _I), ("text", _S)])))),
    ("shapes", _list(story=_S, anchor_cp=_I, shape_id=_L, l=_I, t=_I, r=_I, b=_I, wrap=_I, behind=_B, x_from=_S, y_from=_S, side=_I, locked=_B, kind=_S, type=_I, parent=_L, rotation=pa.float64(), flip_h=_B, flip_v=_B, image=_I, fill=_S, line=_S, path=_S, coordsize=_S, adjusts=_S, style=_PROPS, text=_S)),
    ("pictures", _list(id=_I, cp=_I, format=_S, width_twips=_I, height_twips=_I, data=pa.binary())),
    ("images", _list(id=_I, format=_S, data=pa.binary())),
    ("ole_objects", _list(name=_S, size=_L, content=pa.binary(), object_id=_I, anchor_cp=_I)),
    ("core_properties", pa.map_(_S, _S)),
    ("settings", pa.map_(_S, _S)),
    ("diagnostics", _list(severity=_S, code=_S, n=_L)),
    ("stats", pa.map_(_S, _L)),
])
STATUS = [("status", _S), ("error_class", _S), ("error_message", _S)]
_SLOTS = ("even_header", "odd_header", "even_footer", "odd_footer", "first_header", "first_footer")


def _text(v: object) -> str:
    return str(v).lower() if isinstance(v, bool) else ",".join(map(str, v)) if isinstance(v, list) else str(v)


def _props(values: dict) -> dict[str, str]:
    return {k: _text(v) for k, v in values.items() if k not in ("row", "tabs")} | ({"tabs": ";".join(":".join(str(x) for x in t if x is not None) for t in values["tabs"])} if "tabs" in values else {})


class _Texts:
    """Property maps as text, each made once: runs share the maps of their format."""

    def __init__(self) -> None:
        self.made: dict[int, tuple[dict, dict]] = {}

    def __call__(self, values: dict) -> dict[str, str]:
        if id(values) not in self.made:
            self.made[id(values)] = values, _props(values)  # the map is held, so that its id is not used again
        return self.made[id(values)][1]


_FONTS = {"font_ascii": 0x4A4F, "font_east_asia": 0x4A50, "font_other": 0x4A51, "font_cs": 0x4A5E}


def _named(props: dict, typefaces: list[str], unknown: set[int]) -> dict:
    """Fonts by name in place of their number; a number that no font has is dropped and counted."""
    out = dict(props)
    for key, opcode in _FONTS.items():
        if isinstance(k := out.get(key), int):
            if k < len(typefaces):
                out[key] = typefaces[k]
            else:
                del out[key]
                unknown.add(opcode)
    if (symbol := out.get("symbol")) and symbol.partition(":")[0].isdigit():
        k, _, code = symbol.partition(":")
        if int(k) < len(typefaces):
            out["symbol"] = f"{typefaces[int(k)]}:{code}"
        else:
            del out["symbol"]
            unknown.add(0x6A09)
    return out


def _styled(runs: list, baseline, cuts: list[int], sheet: dict, prms: dict, typefaces: list[str], unknown: set[int]) -> list[tuple[int, int, dict]]:  # noqa: ANN001
    """Character properties by position. A run is cut where the paragraph style below it may change (``cuts``, in order)."""
    out: list[tuple[int, int, dict]] = []
    known: dict[tuple, dict] = {}
    for start, end, mods, piece in runs:
        inner = [start, *cuts[bisect_right(cuts, start) : bisect_left(cuts, end)], end]
        for a, b in zip(inner, inner[1:]):
            style, extra = baseline(a), prms.get(piece)
            key = style, id(mods), id(extra)
            props = known.get(key)
            if props is None:
                below = sheet.get(style, ({}, {}))[0]
                named = next((struct.unpack("<H", x[1])[0] for x in mods if x[0] == 0x4A30), None)
                own = below | sheet.get(named, ({}, {}))[0] if named is not None else below
                props = M.fold_character(mods, own, own, unknown)
                if extra:  # a piece's modifiers come after the run's
                    props = M.fold_character(extra, props, own, unknown)
                props = known[key] = _named(props, typefaces, unknown)
            if out and out[-1][1] == a and (out[-1][2] is props or out[-1][2] == props):
                out[-1] = (out[-1][0], b, out[-1][2])
            else:
                out.append((a, b, props))
    return out


_ROW_STRUCTURE = {"edges", "cells", "shadings", "margins", "widths", "default_margins", *(f"colors_{s}" for s in R.CELL_SIDES)}


def _flat(row: dict) -> dict[str, str]:
    own = {k: v for k, v in row.items() if k not in _ROW_STRUCTURE and v is not None}
    return _props(own | {f"margin_{k}": v for k, v in row.get("default_margins", {}).items() if v is not None})


def _check_notes(foot: list[dict], end: list[dict], said: list[dict], stories: dict, text: str, chars: Spans, tally: Counter) -> None:
    """Notes and comments have the marks that they should: of an automatic number in the text, and their own in what they
    say, which is no part of it (``mark``). A comment without its own mark is left out (``skipped``)."""
    for kind, which, some in (("footnote", "footnotes", foot), ("endnote", "endnotes", end), ("comment", "comments", said)):
        base, sign = stories[which][0], "\x05" if kind == "comment" else "\x02"
        for n in some:
            cp, a, b = n["ref_cp"], base + n["text_start"], base + n["text_end"]
            n |= {"mark": None, "skipped": False}
            own = kind != "comment" and not struct.unpack("<H", n["raw"])[0]  # a mark of its own in place of a number
            if text[cp : cp + 1] < " " if own else text[cp : cp + 1] != sign or not chars.at(cp).get("special"):
                raise CorruptDocument(f"the text has no mark for a {kind} at {cp}")
            body = text[a:b]
            if kind == "comment" and body.count(sign) != 1:
                n["skipped"] = True
                tally["COMMENT_MARKER_MISSING_SKIPPED"] += 1
                continue
            if not body.endswith("\r"):
                raise CorruptDocument(f"a {kind} does not end with a paragraph")
            if kind == "comment":
                n["mark"] = a + body.index(sign)
                if not chars.at(n["mark"]).get("special"):
                    raise CorruptDocument("a comment's own mark is an ordinary character")
                tally["COMMENT_MARKER_POSITION_REPAIRED"] += n["mark"] > a
            elif body.startswith(sign):
                n["mark"] = a
    for code in [c for c, n in tally.items() if not n]:
        del tally[code]


_FIELD_SLOTS = {"main": "fields_main", "footnotes": "fields_footnotes", "headers": "fields_headers", "comments": "fields_comments", "endnotes": "fields_endnotes", "textboxes": "fields_textboxes", "header_textboxes": "fields_header_textboxes"}
_SEPARATORS = ("footnote_separator", "footnote_continuation_separator", "footnote_continuation_notice", "endnote_separator", "endnote_continuation_separator", "endnote_continuation_notice")


def parse_document(data: bytes, password: str | None = None, wanted: frozenset[str] | None = None) -> dict:
    """The model of one document; raises DocumentError for damage that could change its meaning. Of the relations only
    ``wanted`` ones are made, where some are named; a document is checked whole all the same."""
    want = lambda *names: wanted is None or bool(wanted.intersection(names))
    file = Compound(data)
    word = file.read("WordDocument")
    base = W.header(word)
    tables = file.read(base.table)
    extra = file.read("Data") if "Data" in file.entries else b""
    word, tables, extra = unlock(base.flags, base.stored, password, word, tables, extra)
    h = W.full_header(word)
    tally: Counter = Counter()
    for r in file.repairs:
        tally["CFB_DIRECTORY_REPAIRED"] += 1
    unknown: set[int] = set()
    get = lambda name: W.slot(h, tables, name)
    table, shared = W.pieces(get("pieces"))
    text = W.units(word, table)
    if sum(h.counts.values()) > len(text):
        raise CorruptDocument("the stories are longer than the text")
    at, stories = 0, {}
    for s in W.STORIES:
        stories[s] = (at, at + h.counts[s])
        at += h.counts[s]

    typefaces = W.fonts(get("fonts"))
    sheet = W.styles(get("styles"))
    styled = {k: (_named(c, typefaces, unknown), p) for k, (c, p) in W.resolved(sheet, unknown).items()}
    prms = {}
    for p in table:
        if p.prm & 1:
            if p.prm >> 1 >= len(shared):
                raise CorruptDocument("a piece names a modifier list that is not there")
            prms[p.start] = shared[p.prm >> 1]
        elif p.prm:
            prms[p.start] = W.single(p.prm)
    paras: list[tuple[int, int, dict]] = []
    para_runs = W.formatting(word, get("para_pages"), extra, True)
    fkp_paragraphs = len(para_runs)
    folded: dict[tuple, dict] = {}
    for a, b, run, piece in W.to_positions(para_runs, table):
        key = run.style, tuple(run.mods), piece.start if piece.start in prms else -1
        props = folded.get(key)
        if props is None:
            own = styled.get(run.style, ({}, {}))[1]
            props = folded[key] = M.fold_paragraph(prms.get(piece.start, []), M.fold_paragraph(run.mods, own | {"style_id": run.style}, unknown), unknown)
        paras.append((a, b, props))
    para_spans = Spans(paras, styled.get(0, ({}, {}))[1])
    char_runs = [(a, b, run.mods, piece.start) for a, b, run, piece in W.to_positions(W.formatting(word, get("char_pages"), extra, False), table)]
    covered, gaps, none = 0, [], []
    firsts = [p.start for p in table]
    for a, b, _, _ in [*char_runs, (len(text), len(text), none, 0)]:  # text without a run still has a style and a piece
        while covered < a:
            piece = table[bisect_right(firsts, covered) - 1]
            stop = min(a, piece.end)
            gaps.append((covered, stop, none, piece.start))
            covered = stop
        covered = max(covered, b)
    cuts_at = sorted({c for a, b, _ in paras for c in (a, b)})
    chars = _styled(sorted([*char_runs, *gaps], key=lambda r: r[0]), lambda cp: para_spans.at(cp).get("style_id", 0), cuts_at, styled, prms, typefaces, unknown)
    char_spans = Spans(chars, {})

    marks = W.bookmarks(get("bookmark_names"), get("bookmark_starts"), get("bookmark_ends"))
    foot, end = W.notes(get("footnote_refs"), get("footnote_texts")), W.notes(get("endnote_refs"), get("endnote_texts"))
    ranges = W.comment_ranges(get("comment_tags"), get("comment_starts"), get("comment_ends"), tally)
    said = W.comments(get("comment_refs"), get("comment_texts"), get("comment_owners"), ranges, tally)
    _check_notes(foot, end, said, stories, text, char_spans, tally)
    options, repairs = W.settings(get("settings"), h.version)
    for code in repairs:
        tally[code] += 1
    list_at = h.slots.get("lists", (0, 0))
    abstract, used = W.lists(tables[list_at[0] :] if list_at[1] else b"", get("list_uses"), get("list_names"), tally)
    names = Names(frozenset(m["name"].casefold() for m in marks), frozenset(s.name.casefold() for s in sheet.values()), frozenset(x["name"].casefold() for x in abstract if x["name"]))
    ends: dict[int, int] = {}
    field_marks = binary_data = consumed = 0
    for which, slot_name in _FIELD_SLOTS.items():
        entries = W.fields(get(slot_name))
        field_marks += len(entries)
        if entries:
            ends |= field_ends(entries, text, stories[which][0], h.counts[which], lambda cp: char_spans.at(cp).get("special"), tally)

    # Pictures and objects by what their marks say; binary data of some fields is no text.
    pools = {int(p.rpartition("_")[2]): p for p, e in file.entries.items() if e.kind == "storage" and p.startswith("ObjectPool/_") and p.count("/") == 1 and p.rpartition("_")[2].isdigit()}
    pictures, objects, ignored = [], [], {n["mark"] for some in (foot, end, said) for n in some if n["mark"] is not None}
    if "\x01" in text or pools:
        around: dict[int, str] = {}
        for a, b in stories.values():
            if a < b:
                around |= binary_fields(text, a, b)
        for a, b, props in chars:
            location = props.get("picture_location")
            if location is None:
                continue
            for cp in range(a, b):
                if text[cp] == "\x14" and pools:
                    if location in pools:
                        objects.append({"object_id": len(objects) + 1, "anchor_cp": cp, "storage": location})
                    else:
                        tally["OLE_OBJECT_STORAGE_MISSING"] += 1
                elif text[cp] == "\x01" and props.get("special"):
                    if props.get("data"):
                        binary_data += 1
                        if around.get(cp) in BINARY:
                            ignored.add(cp)
                            consumed += 1
                        else:
                            tally["BINARY_FIELD_DATA_DEFERRED"] += 1
                    elif not props.get("ole"):
                        try:
                            pictures.append({"id": len(pictures) + 1, "cp": cp, **D.inline_picture(extra, location)})
                        except DocumentError:  # one bad picture costs itself
                            tally["INLINE_PICTURE_INVALID"] += 1
    placed_objects = {x["anchor_cp"]: x["object_id"] for x in objects}
    if loose := set(pools) - {x["storage"] for x in objects}:
        tally["OLE_OBJECTS_UNANCHORED"] += len(loose)
    drawn, images = D.drawings(get("drawing"), word)
    anchors = W.shapes(get("shapes_main"), "main") + W.shapes(get("shapes_headers"), "headers")
    refs = {n["ref_cp"]: (kind, k) for kind, some in (("footnote", foot), ("endnote", end), ("comment", said)) for k, n in enumerate(some, 1) if not n["skipped"]}
    refs |= {p["cp"]: ("picture", p["id"]) for p in pictures}
    refs |= {stories[s["story"]][0] + s["anchor_cp"]: ("shape", s["shape_id"]) for s in reversed(anchors)}
    cuts = W.sections(get("sections"), word, unknown, h.language, h.counts["main"], tally)
    for c in cuts:
        c["props"] = W.fallbacks(c["props"], options)
    where = Place(char_spans, para_spans, refs, names, frozenset(s["cp_end"] for s in cuts[:-1]), ends, placed_objects, frozenset(ignored))

    paragraphs, inlines, nodes, fields, grids, rows, row_maps = [], [], [], [], [], [], []
    texts = _Texts()
    tabled = want("tables", "table_rows")

    def story(name: str, start: int, stop: int) -> str:
        found, own = read(text, start, stop, where, tally)
        first = len(paragraphs)
        fields.extend({"story": name, **f} for f in own)
        number: dict[int, int] = {}
        for p in found:
            if p.mark == "row":
                continue
            number[id(p)] = len(paragraphs)
            paragraphs.append({"story": name, "ix": len(paragraphs) - first, "cp_start": p.cp_start, "cp_end": p.cp_end, "text": p.text, "depth": p.depth, "style_id": p.props.get("style_id", 0), "props": texts(p.props)})
            inlines.extend({"story": name, "paragraph": len(paragraphs) - 1, "ix": k, "kind": r["kind"], "text": r["text"], "cp": r["cp"], "props": texts(r["props"])} for k, r in enumerate(p.runs))
        made = assemble(found, tally)
        nodes.extend({"story": name, "path": n["path"], "kind": n["kind"], "depth": len(n["path"]), "paragraph": number.get(id(n["item"])) if n["kind"] == "paragraph" else None} for n in made)
        if any(n["kind"] == "table" for n in made):
            held = Counter(tuple(n["path"][:-1]) for n in made if n["kind"] == "cell")
            lines: dict[tuple, list] = {}
            for n in made:
                if n["kind"] == "row":
                    lines.setdefault(tuple(n["path"][:-1]), []).append((n["path"], n["item"].props.get("row", {})))
            for path, some in lines.items():
                columns = R.grid([r for _, r in some])
                grids.append({"story": name, "path": list(path), "columns": columns, "props": _flat(R.floating(some[0][1])) if tabled else None})
                row_maps.extend(some)
                for row_path, row in some:
                    cells, warning = R.built(row, held[tuple(row_path)])
                    if warning:
                        tally[warning] += 1
                    if tabled:
                        before, after = R.spans(row.get("edges", []), cells, columns)
                        rows.append({"story": name, "path": row_path, "grid_before": before, "grid_after": after, "edges": row.get("edges", []), "props": _flat(row), "cells": [{"ix": c["ix"], "width": c["width"], "span": c["span"], "props": _props({k: v for k, v in c.items() if v is not None and k not in ("ix", "width", "span")})} for c in cells]})
        return "\n".join(p.text for p in found if p.mark != "row")

    story("main", *stories["main"])
    mains = len(paragraphs)
    if h.counts["macros"]:
        tally["MACRO_TEXT_OMITTED"] += 1

    def beside(which: str, label: str, a: int, b: int) -> str:
        lo, hi = stories[which]
        if not lo <= lo + a <= lo + b <= hi:
            raise CorruptDocument(f"a text of {which} lies outside them")
        return story(label, lo + a, lo + b)

    noted = [{"kind": kind, "id": k, "ref_cp": n["ref_cp"], "text": beside(which, f"{kind}:{k}", n["text_start"], n["text_end"])} for kind, which, some in (("footnote", "footnotes", foot), ("endnote", "endnotes", end)) for k, n in enumerate(some, 1)]
    remarks = [{"id": k, "text": beside("comments", f"comment:{k}", c["text_start"], c["text_end"])} | {key: c[key] for key in ("ref_cp", "author", "initials", "range_start", "range_end")} for k, c in enumerate(said) if not c["skipped"]]
    said = [c for c in said if not c["skipped"]]
    heads, _ = W.plc(get("headers"), 0)
    placed = []
    if len(heads) > 2 and h.counts["headers"]:
        whole = len(cuts) or 1
        if len(heads) != 6 * (whole + 1) + 2:
            raise CorruptDocument(f"{len(heads) - 2} header stories for {whole} sections")
        for k, (a, b) in enumerate(zip(heads[:-1], heads[1:-1])):
            if a == b:
                continue
            lo = stories["headers"][0]
            if text[lo + b - 1 : lo + b] != "\r":
                raise CorruptDocument(f"header story {k} has no guard paragraph")
            slot_name = _SEPARATORS[k] if k < 6 else _SLOTS[(k - 6) % 6]
            label = f"separator:{slot_name}" if k < 6 else f"header:{(k - 6) // 6}:{slot_name}"
            said_there = beside("headers", label, a, b - 1)  # without the guard
            placed.append({"section": (k - 6) // 6, "slot": slot_name, "story": label, "text": said_there})
        for k, c in enumerate(cuts):  # a title page without headers of its own has empty ones
            for side in ("header", "footer"):
                own = {p["slot"] for p in placed if p["section"] == k}
                if c["props"].get("title_page") and f"odd_{side}" in own and f"first_{side}" not in own:
                    placed.append({"section": k, "slot": f"first_{side}", "story": None, "text": ""})
    for m in marks:
        m["story"] = next((s for s, (a, b) in stories.items() if a <= m["cp_start"] and m["cp_end"] <= b and a < b), None)
        if m["story"] is None:
            tally["BOOKMARK_DEFERRED"] += 1
    boxes: dict[int, str] = {}
    for slot_name, which in (("textbox_texts", "textboxes"), ("header_textbox_texts", "header_textboxes")):
        at_, entries = W.plc(get(slot_name), 22)
        for k, e in enumerate(entries):
            if (number := struct.unpack_from("<i", e, 14)[0]) > 0 and number not in boxes:
                boxes[number] = beside(which, f"textbox:{number}", at_[k], at_[k + 1])
    shapes = D.floating(anchors, drawn, boxes, len(images), tally)
    for s in shapes:
        if s["image"] is not None and not (0 < s["image"] <= len(images) and images[s["image"] - 1]):
            raise CorruptDocument(f"shape {s['shape_id']} shows an image that is not there")
    try:
        core = W.summary(file.read("\x05SummaryInformation")) if "\x05SummaryInformation" in file.entries else {}
    except DocumentError:
        core = {}
        tally["SUMMARY_INFORMATION_INVALID"] += 1
    missing = {p["style_id"] for p in paragraphs if p["style_id"] and p["style_id"] not in sheet}
    if missing and sheet:
        tally["STYLE_MISSING"] += len(missing)
    if unknown:
        tally["UNSUPPORTED_MODIFIER"] += len(unknown)
    by_storage: dict[int, dict] = {}
    for x in objects:
        by_storage.setdefault(x["storage"], x)
    held_objects = [{"name": p.rpartition("/")[2], "size": sum(e.size for q, e in file.entries.items() if q.startswith(f"{p}/")), "content": build(file.storage(p)), "object_id": by_storage.get(n, {}).get("object_id"), "anchor_cp": by_storage.get(n, {}).get("anchor_cp")} for n, p in pools.items()] if want("ole_objects") else []
    counted = {
        "cfb_sector_count": len(data) // 512, "table_stream": int(base.table == "1Table"), "fib_version": h.version, "piece_count": len(table), "piece_prm_count": sum(p.prm != 0 for p in table), "clx_prc_count": len(shared), "main_story_cp_count": h.counts["main"], "macro_story_cp_count": h.counts["macros"],
        "character_format_span_count": len(chars), "paragraph_format_span_count": len(paras), "character_fkp_run_count": len(char_runs), "paragraph_fkp_run_count": fkp_paragraphs, "font_count": len(typefaces), "core_property_count": len(core), "declared_field_count": len(ends), "declared_field_character_count": field_marks,
        "embedded_object_count": sum(i["kind"] == "object" for i in inlines), "header_footer_story_count": sum(p["section"] >= 0 for p in placed), "note_separator_story_count": sum(p["section"] < 0 for p in placed), "inline_binary_data_count": binary_data, "consumed_binary_field_data_count": consumed,
        "deferred_inline_picture_count": tally["INLINE_PICTURE_INVALID"], "warning_count": sum(tally.values()), "warning_code_count": sum(n > 0 for n in tally.values()), "unsupported_modifier_count": len(unknown), "ole_object_count": len(pools), "textbox_count": len(boxes), "image_count": len(images),
    }
    stats = counted if not want("stats") else counted | statistics(paragraphs[:mains], paragraphs, inlines, nodes, row_maps, fields, marks, sheet, abstract, used, cuts, options, foot, end, said, text, pictures, shapes, stories, boxes)
    for code in sorted(unknown):  # each by name, for the sorted list of what was not understood
        stats[f"unsupported_0x{code:04X}"] = 1
    few = {
        "version": lambda: h.version, "language": lambda: M.LANGUAGES.get(h.language), "encrypted": lambda: bool(base.flags & 0x100),
        "entries": lambda: [{"path": e.path, "kind": e.kind, "size": e.size} for e in sorted(file.entries.values(), key=lambda e: e.path) if e.path],
        "stories": lambda: [{"story": s, "cp_start": a, "cp_end": b} for s, (a, b) in stories.items() if a < b],
        "pieces": lambda: [{"ix": k, "cp_start": p.start, "cp_end": p.end, "file_offset": p.offset, "compressed": p.narrow, "prm": p.prm} for k, p in enumerate(table)],
        "char_spans": lambda: [{"cp_start": a, "cp_end": b, "props": texts(v)} for a, b, v in chars], "para_spans": lambda: [{"cp_start": a, "cp_end": b, "props": texts(v)} for a, b, v in paras],
        "paragraphs": lambda: paragraphs, "inlines": lambda: inlines, "nodes": lambda: nodes, "table_rows": lambda: rows, "tables": lambda: grids, "fields": lambda: fields, "bookmarks": lambda: [{"id": k, **m} for k, m in enumerate(marks)], "notes": lambda: noted, "comments": lambda: remarks,
        "sections": lambda: [{"ix": k, "cp_start": s["cp_start"], "cp_end": s["cp_end"], "props": _props(s["props"])} for k, s in enumerate(cuts)], "section_stories": lambda: placed,
        "styles": lambda: [{"id": s.number, "kind": s.kind, "name": s.name, "based_on": s.based_on, "next_style": s.next, "chp": _props(styled[s.number][0]), "pap": _props(styled[s.number][1])} for s in sheet.values()],
        "table_conditions": lambda: [{"style": s.number, "condition": when, "chp": _props(_named(M.fold_character(some.get("chp", []), {}, {}, set()), typefaces, set())), "pap": _props(M.fold_paragraph(some.get("pap", []), {}, set())), "row": _flat(M.fold_paragraph(some.get("tap", []), {}, set()).get("row", {}))} for s in sheet.values() for when, some in s.when.items()],
        "fonts": lambda: [{"ix": k, "name": f} for k, f in enumerate(typefaces)],
        "lists": lambda: [{"list_id": x["list_id"], "name": x["name"], "kind": x["kind"], "level": k, **lv, "chp": _props(_named(lv["chp"], typefaces, set())), "pap": _props(lv["pap"])} for x in abstract for k, lv in enumerate(x["levels"])],
        "list_uses": lambda: [{"id": u["id"], "list_id": u["list_id"], "overrides": [{"level": o["level"], "start": o["replaced"]["start"] if o["replaced"] else o["start"], "format": o["replaced"] and o["replaced"]["format"], "text": o["replaced"] and o["replaced"]["text"]} for o in u["overrides"]]} for u in used],
        "shapes": lambda: shapes, "pictures": lambda: pictures, "images": lambda: [{"id": k, "format": i[0], "data": i[1]} for k, i in enumerate(images, 1) if i], "ole_objects": lambda: held_objects,
        "core_properties": lambda: core, "settings": lambda: _props(options), "diagnostics": lambda: [{"severity": "warning", "code": k, "n": n} for k, n in sorted(tally.items())], "stats": lambda: stats,
    }
    return {k: make() for k, make in few.items() if want(k)}


def statistics(main: list, paragraphs: list, inlines: list, nodes: list, rows: list, fields: list, marks: list, sheet: dict, abstract: list, used: list, cuts: list, options: dict, foot: list, end: list, said: list, text: str, pictures: list, shapes: list, stories: dict, boxes: dict) -> dict[str, int]:
    """What a document has of everything that its report counts."""
    kinds, sorts, styles = Counter(n["kind"] for n in nodes), Counter(i["kind"] for i in inlines), Counter(s.kind for s in sheet.values())
    firsts = {tuple(path[:-1]): row for path, row in reversed(rows)}.values()  # the first row of each table speaks for it
    of = lambda test: sum(bool(test(c["props"])) for c in cuts)
    within = lambda cp, which: stories[which][0] <= cp < stories[which][1]
    float_of = lambda kind, story=None: sum(s["kind"] == kind and story in (None, s["story"]) for s in shapes)
    own_boxes = {which: [s for s in shapes if s["kind"] == "textbox" and s["story"] == story] for which, story in (("main", "main"), ("header", "headers"))}
    labels = {which: {f"textbox:{s['shape_id']}" for s in some} for which, some in own_boxes.items()}
    named = lambda p, *keys: any(k in p for k in keys)
    out = {
        "paragraph_count": len(main), "style_count": len(sheet), "table_style_count": styles["table"], "numbering_style_count": styles["numbering"], "bookmark_count": len(marks), "preserved_bookmark_count": sum(m["story"] is not None for m in marks), "column_bookmark_count": sum(m["column_first"] is not None for m in marks),
        "abstract_numbering_count": len(abstract), "named_list_count": sum(x["name"] is not None for x in abstract), "numbering_instance_count": len(used), "numbering_level_count": sum(len(x["levels"]) for x in abstract), "numbered_paragraph_count": sum(p["props"].get("list_id", "None") != "None" and "list_skipped" not in p["props"] for p in paragraphs),
        "table_count": kinds["table"], "table_row_count": kinds["row"], "table_cell_count": kinds["cell"], "styled_table_count": sum("style_id" in r for r in firsts), "preferred_width_table_count": sum(r.get("width_type", "nil") not in ("nil", "auto") for r in firsts), "cell_width_override_count": sum(len(r.get("widths", [])) for _, r in rows),
        "section_count": len(cuts), "document_grid_section_count": of(lambda p: "grid_type" in p), "section_page_number_format_count": of(lambda p: "page_number_format" in p), "section_page_number_start_count": of(lambda p: "page_number_start" in p), "chapter_numbered_section_count": of(lambda p: "chapter_style" in p),
        "page_bordered_section_count": of(lambda p: "border_display" in p), "paper_source_section_count": of(lambda p: named(p, "paper_first", "paper_other")), "form_protected_section_count": of(lambda p: p.get("form_protected")), "rtl_gutter_section_count": of(lambda p: p.get("rtl_gutter")), "line_numbered_section_count": of(lambda p: "line_number_count_by" in p),
        "column_separator_section_count": of(lambda p: p.get("column_line")), "unequal_column_section_count": of(lambda p: "column_widths_twips" in p), "vertically_aligned_section_count": of(lambda p: p.get("vertical_align", "top") != "top"), "section_note_numbering_override_count": of(lambda p: named(p, "footnote_format", "endnote_format", "footnote_restart", "endnote_restart")),
        "section_note_number_start_count": of(lambda p: named(p, "footnote_start", "endnote_start")), "section_note_placement_count": of(lambda p: named(p, "footnote_position", "endnote_position")), "bidirectional_section_count": of(lambda p: p.get("rtl")), "vertical_text_section_count": of(lambda p: p.get("flow", "lrTb") != "lrTb"),
        "mirror_margins": int(options.get("mirror_margins", False)), "gutter_at_top": int(options.get("gutter_at_top", False)), "default_tab_stop_twips": options.get("default_tab_twips", 0), "auto_hyphenation": int(options.get("auto_hyphenation", False)), "do_not_hyphenate_caps": int(options.get("no_caps_hyphenation", False)),
        "hyphenation_zone_twips": options.get("hyphenation_zone_twips", 0), "consecutive_hyphen_limit": options.get("consecutive_hyphens", 0), "track_revisions": int(options.get("track_changes", False)), "document_protection_edit": int("protection" in options), "adjust_line_height_in_table": int(options.get("adjust_line_height", False)),
        "header_footer_paragraph_count": sum(p["story"].startswith("header:") for p in paragraphs), "footnote_count": len(foot), "footnote_reference_count": sorts["footnote"], "custom_footnote_mark_count": sum(text[n["ref_cp"] : n["ref_cp"] + 1] != "\x02" for n in foot), "endnote_count": len(end), "endnote_reference_count": sorts["endnote"],
        "custom_endnote_mark_count": sum(text[n["ref_cp"] : n["ref_cp"] + 1] != "\x02" for n in end), "comment_count": len(said), "comment_reference_count": sorts["comment"], "comment_range_count": sum(c["range_start"] is not None for c in said), "inline_picture_count": len(pictures), "main_inline_picture_count": sum(within(p["cp"], "main") for p in pictures),
        "main_textbox_inline_picture_count": sum(within(p["cp"], "textboxes") for p in pictures), "header_inline_picture_count": sum(within(p["cp"], "headers") for p in pictures), "header_textbox_inline_picture_count": sum(within(p["cp"], "header_textboxes") for p in pictures), "deferred_header_inline_picture_count": 0,
        "floating_picture_count": float_of("picture"), "floating_shape_count": sum(float_of(k) for k in ("shape", "line", "frame")), "deferred_floating_shape_count": float_of("deferred"), "main_floating_picture_count": float_of("picture", "main"), "header_floating_picture_count": float_of("picture", "headers"),
        "deferred_floating_picture_count": 0, "deferred_header_floating_picture_count": 0, "non_picture_floating_shape_count": sum(s["kind"] != "picture" for s in shapes), "symbol_character_count": sorts["symbol"], "custom_tab_stop_count": sum(p["props"].get("tabs", "").count(":") and len(p["props"]["tabs"].split(";")) for p in paragraphs),
        "field_count": len(fields), "live_field_count": sum(f["live"] for f in fields),
    }
    floats = {s["shape_id"] for s in shapes}
    for which, some in own_boxes.items():
        grouped = [s for s in some if s["parent"] in floats]
        out |= {f"{which}_textbox_count": len(some), f"reconstructed_grouped_{which}_textbox_count": len(grouped), f"deferred_grouped_{which}_textbox_count": 0, f"styled_{which}_textbox_count": sum(bool(s["style"]) for s in some), f"{which}_textbox_field_count": sum(f["story"] in labels[which] for f in fields)}
    out["deferred_grouped_main_textbox_count"] = len(set(boxes) - {s["shape_id"] for s in shapes})
    return out


def tried(data: bytes | None, password: str | None, wanted: frozenset[str] | None = None) -> dict:
    """The model with its status; what no check foresaw is damage as well."""
    try:
        return {"status": "ok", **parse_document(data or b"", password, wanted)}
    except DocumentError as e:
        return {"status": "failed", "error_class": type(e).__name__, "error_message": str(e)}
    except (IndexError, KeyError, ValueError, struct.error, OverflowError, RecursionError) as e:
        return {"status": "failed", "error_class": "CorruptDocument", "error_message": f"{type(e).__name__}: {e}"}


def parse(docs: DataFrame, key: str = "path", content: str = "content", password: str | None = None, relations: tuple[str, ...] | None = None) -> DataFrame:
    """``docs(key, content)`` with the model of each document; other columns are left out. ``relations`` names the columns
    of the model to make, all by default: what a query does not read is not built."""
    kind = docs.select(key).schema[0]
    schema = pa.schema([*STATUS, *(f for f in MODEL if relations is None or f.name in relations)])
    wanted = None if relations is None else frozenset(relations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies = batch.column(0), batch.column(1)
            for i in range(0, batch.num_rows, 32):  # few models at a time: each is many times its bytes
                some = [tried(b.as_py(), password, wanted) for b in bodies[i : i + 32]]
                columns = [pa.array([d.get(f.name) for d in some], f.type) for f in schema]
                yield pa.RecordBatch.from_arrays([keys[i : i + 32], *columns], [key, *schema.names])

    return docs.select(key, content).mapInArrow(run, StructType([kind, *from_arrow_schema(schema).fields]))


def files(spark: SparkSession, root: str, recursive: bool = True, max_file: int = MAX_FILE) -> DataFrame:
    """``path, modificationTime, length, content`` of the documents under a folder: by suffix in any case, without the
    owner files that editors leave, within the size limit. The filter on length is pushed to the file listing."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][oO][cC]").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return found.filter(~F.element_at(F.split("path", "/"), -1).startswith("~$") & (F.col("length") <= max_file))


def relation(parsed: DataFrame, name: str, key: str = "path") -> DataFrame:
    """One relation of the model: only its own column is read from a stored model."""
    return parsed.filter("status = 'ok'").select(key, F.inline(name))


def looks_compound(content: Column) -> Column:
    """A test of the first eight bytes that never leaves the JVM."""
    return F.substring(content, 1, 8) == F.lit(bytearray(bytes.fromhex("D0CF11E0A1B11AE1")))


def batch_summary(parsed: DataFrame) -> DataFrame:
    """One row: how many documents, how many of them read, and their warnings."""
    warnings = F.coalesce(F.col("stats")["warning_count"], F.lit(0))
    return parsed.agg(F.count("*").alias("file_count"), F.count_if(F.col("status") == "ok").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum(warnings).alias("warning_count"))


def inspect(parsed: DataFrame, key: str = "path") -> DataFrame:
    """What a document is, without what it says, as JSON."""
    return parsed.select(key, F.to_json(F.struct("status", "error_class", "error_message", "version", "language", "encrypted", "entries", "stories", "stats")).alias("report"))


__all__ = ["Paragraph", "batch_summary", "files", "inspect", "looks_compound", "parse", "parse_document", "relation", "tried"]
