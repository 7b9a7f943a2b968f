"""The binary format: files built by us, facts of the published format, damage of every kind."""

import os
import random
import struct

import pytest

from inkstone.sources import builder, ciphers, compound, modifiers, parse, story, word
from inkstone.sources.errors import CorruptDocument, DocumentError, TooLarge

BOLD = struct.pack("<HB", 0x0835, 1)
IN_TABLE = struct.pack("<HB", 0x2416, 1)
ROW_END = IN_TABLE + struct.pack("<HB", 0x2417, 1)


def texts(d):
    return [p["text"] for p in d["paragraphs"]]


@pytest.mark.parametrize("sector", [512, 4096])
def test_compound_round_trip(sector):
    streams = {"WordDocument": os.urandom(5000), "1Table": b"x" * 4096, "a": b"hi", "ObjectPool/_1/Contents": b"q" * 70, "ObjectPool/_1/big": os.urandom(9000), "empty": b""}
    file = compound.Compound(compound.build(streams, sector))
    assert {p: file.read(p) for p in streams} == streams
    assert file.storage("ObjectPool/_1") == {"Contents": streams["ObjectPool/_1/Contents"], "big": streams["ObjectPool/_1/big"]}


def test_compound_needs_lists_of_allocation_sectors():
    streams = {"big": os.urandom(9 << 20)}
    assert compound.Compound(compound.build(streams)).read("big") == streams["big"]


def test_compound_limits_and_repairs():
    data = compound.build({"a": b"x" * 5000})
    with pytest.raises(TooLarge):
        compound.Compound(data, max_file=100)
    with pytest.raises(TooLarge):
        compound.Compound(data, max_stream=100).read("a")
    with pytest.raises(TooLarge):
        compound.Compound(data, max_entries=1)
    file = compound.Compound(data[:-100])
    assert file.repairs == ["last sector padded"]


def test_known_answers():
    assert ciphers._keystream(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    many = ciphers.rc4_blocks(os.urandom(512 * 200), [b"Key"] * 200)
    assert len(many) == 512 * 200
    data, keys = os.urandom(512 * 199 + 7), [os.urandom(16) for _ in range(200)]
    each = b"".join(ciphers._keystream(k, data[512 * i : 512 * (i + 1)]) for i, k in enumerate(keys))
    assert ciphers.rc4_blocks(data, keys) == each
    assert word.iso_time(132_000_000_000_000_000) == "2019-04-17T18:40:00Z" and word.iso_time(0) is None


@pytest.mark.parametrize("cipher", ["xor", "rc4", "capi"])
def test_passwords(cipher):
    data = builder.document("Secret text\rmore", password="pässword", cipher=cipher)
    assert parse.tried(data, None)["error_class"] == "NeedsPassword"
    assert parse.tried(data, "no")["error_class"] == "WrongPassword"
    assert texts(parse.parse_document(data, "pässword")) == ["Secret text", "more"]


@pytest.mark.parametrize(("text", "expected"), [("", [""]), ("a", ["a"]), ("a\r", ["a"]), ("a\r\rb", ["a", "", "b"]), (["Hello\r", "世界\r"], ["Hello", "世界"]), ("“x”\r", ["“x”"])])
def test_paragraphs(text, expected):
    d = parse.parse_document(builder.document(text))
    assert texts(d) == expected
    assert d["stats"]["paragraph_count"] == len(expected)


def test_surrogates():
    d = parse.parse_document(builder.document("a\ud800b😀\r"))
    assert texts(d) == ["a�b😀"] and d["diagnostics"] == [{"severity": "warning", "code": "INVALID_UTF16", "n": 1}]
    assert d["paragraphs"][0]["cp_end"] == 6


def test_fields():
    d = parse.parse_document(builder.document('x \x13 HYPERLINK "http://a" \x14link\x15 y\x13DDE x\x14old\x15\x13REF gone\x14r\x15\r'))
    assert texts(d) == ["x link yoldr"]
    assert [(f["field_type"], f["live"]) for f in d["fields"]] == [("HYPERLINK", True), ("DDE", False), ("REF", False)]
    nested = parse.parse_document(builder.document("\x13 REF \x13 PAGE \x14 7\x15\x14a\x15\r"))
    assert [(f["field_type"], f["depth"]) for f in nested["fields"]] == [("PAGE", 2), ("REF", 1)] and texts(nested) == ["a"]


def test_tables_nested_and_torn():
    t = "ab\rA\x07B\x07\x07end\r"
    runs = [(0, 3, 0, b""), (3, 7, 0, IN_TABLE), (7, 8, 0, ROW_END), (8, 12, 0, b"")]
    d = parse.parse_document(builder.document(t, para_runs=runs))
    assert [(n["kind"], n["path"]) for n in d["nodes"]] == [("paragraph", [0]), ("table", [1]), ("row", [1, 0]), ("cell", [1, 0, 0]), ("paragraph", [1, 0, 0, 0]), ("cell", [1, 0, 1]), ("paragraph", [1, 0, 1, 0]), ("paragraph", [2])]
    torn = parse.parse_document(builder.document("A\x07B\r", para_runs=[(0, 4, 0, IN_TABLE)]))
    assert torn["stats"]["table_count"] == 0 and [x["code"] for x in torn["diagnostics"]] == ["TABLE_FLATTENED"]
    deep = struct.pack("<HI", 0x6649, 2)
    inner, inner_row = IN_TABLE + deep + struct.pack("<HB", 0x244B, 1), IN_TABLE + deep + struct.pack("<HB", 0x244C, 1)
    nested = parse.parse_document(builder.document("i\r\ro\x07\x07", para_runs=[(0, 2, 0, inner), (2, 3, 0, inner_row), (3, 5, 0, IN_TABLE), (5, 6, 0, ROW_END)]))
    assert nested["stats"]["table_count"] == 2 and [n["kind"] for n in nested["nodes"]] == ["table", "row", "cell", "table", "row", "cell", "paragraph", "paragraph"]


def test_toggles_against_the_style_of_each_paragraph():
    sheet = builder.style_sheet([builder.style("Normal", chp=struct.pack("<HH", 0x4A43, 24)), builder.style("Head", based_on=0, chp=BOLD), builder.style("Deep", based_on=1)])
    runs = [(0, 2, 2, b""), (2, 4, 0, b""), (4, 6, 1, b"")]
    d = parse.parse_document(builder.document("h\rn\rk\r", para_runs=runs, char_runs=[(0, 6, struct.pack("<HB", 0x0835, 0x81))], tables={"styles": sheet}))
    assert [dict(i["props"])["bold"] for i in d["inlines"]] == ["false", "true", "false"]
    assert dict(d["styles"][2]["chp"]) == {"size_half_points": "24", "bold": "true"}


def test_style_cycle_fails():
    sheet = builder.style_sheet([builder.style("A", based_on=1), builder.style("B", based_on=0)])
    assert parse.tried(builder.document("x", tables={"styles": sheet}), None)["error_class"] == "CorruptDocument"


def test_piece_modifiers():
    d = parse.parse_document(builder.document(["a", "世"], prms=[1, 0x55 << 1 | 1 << 8], shared=[struct.pack("<HB", 0x0836, 1)]))
    assert [dict(i["props"]) for i in d["inlines"]] == [{"italic": "true"}, {"bold": "true"}]


def test_modifiers():
    assert modifiers.split(BOLD + struct.pack("<HBBB", 0xC60D, 2, 0, 0)) == [(0x0835, b"\1"), (0xC60D, b"\0\0")]
    fold = modifiers.fold_paragraph
    assert fold([(0x664A, struct.pack("<i", 2))], {"table_depth": 1}, set())["table_depth"] == 3
    tabs = struct.pack("<BBhB", 0, 1, 720, 1)
    assert fold([(0xC60D, tabs)], {}, set())["tabs"] == [(720, "center", None)]
    assert fold([(0x460B, struct.pack("<h", -2047))], {}, set())["list_id"] is None
    unknown = set()
    assert modifiers.fold_character([(0x0835, b"\2"), (0x2A33, b"\1"), (0x4A43, b"\x18\0")], {"italic": True}, {}, unknown) == {"size_half_points": 24}
    assert unknown == {0x0835}


def test_notes_comments_bookmarks_summary():
    note = "text of it\r"
    who = struct.pack("<H", 3) + "Ann".encode("utf-16-le")
    record = struct.pack("<H", 1) + "A".encode("utf-16-le") + bytes(16) + struct.pack("<HHHi", 0, 0, 0, -1)
    d = parse.parse_document(
        builder.document(
            "a\x02b\x05\r",
            stories={"footnotes": note + "\r", "comments": "\x05said\r\r"}, char_runs=[(cp, cp + 1, struct.pack("<HB", 0x0855, 1)) for cp in (1, 3, 5 + len(note) + 1)],
            tables={
                "footnote_refs": struct.pack("<iiH", 1, 5, 1), "footnote_texts": struct.pack("<iii", 0, len(note), len(note) + 1),
                "comment_refs": struct.pack("<ii", 3, 5) + record, "comment_texts": struct.pack("<iii", 0, 6, 7), "comment_owners": who,
                "bookmark_names": builder.wide_strings(["here"]), "bookmark_starts": struct.pack("<iiHH", 0, 5, 0, 0), "bookmark_ends": struct.pack("<ii", 1, 5),
            },
            summary={"title": "Ünï", "created": 132_000_000_000_000_000},
        )
    )
    assert d["notes"] == [{"kind": "footnote", "id": 1, "ref_cp": 1, "text": "text of it"}]
    assert d["comments"] == [{"id": 0, "ref_cp": 3, "author": "Ann", "initials": "A", "text": "said", "range_start": None, "range_end": None}]
    assert d["bookmarks"] == [{"id": 0, "name": "here", "cp_start": 0, "cp_end": 1, "column_first": None, "column_last": None, "story": "main"}]
    assert d["core_properties"] == {"title": "Ünï", "created": "2019-04-17T18:40:00Z"}


def test_sections():
    wide = struct.pack("<HB", 0x301D, 2)
    d = parse.parse_document(builder.document("a\fb\r", section_mods=[(0, 2, b""), (2, 4, wide)]))
    assert texts(d) == ["a", "b"] and dict(d["sections"][1]["props"]) == {"orientation": "landscape", "header_twips": "720", "footer_twips": "720"} | {f"{s}_twips": "1440" for s in ("top", "bottom", "left", "right")}
    assert [x["code"] for x in d["diagnostics"]] == ["SECTION_MARGIN_DEFAULTED"]
    with pytest.raises(CorruptDocument):
        modifiers.fold_section([(0x500B, struct.pack("<H", 60))], set())


def test_lists_shapes_fonts():
    level = struct.pack("<iBBB", 1, 0, 0, 1) + bytes(17) + struct.pack("<BBBB", 0, 0, 0, 0) + struct.pack("<H", 2) + "\0.".encode("utf-16-le")
    lists = struct.pack("<H", 1) + struct.pack("<i", 77) + bytes(22) + b"\1\0" + level
    uses = struct.pack("<I", 1) + struct.pack("<i", 77) + bytes(12) + struct.pack("<I", 0xFFFFFFFF)
    font = struct.pack("<BHBB", 0, 400, 0, 0) + bytes(34) + "Serif\0".encode("utf-16-le")
    shape = struct.pack("<ii", 0, 2) + struct.pack("<iiiiiHi", 9, 30, 2, 10, 4, 3 << 5, 0)
    d = parse.parse_document(builder.document("a\r", tables={"lists": lists, "list_uses": uses, "fonts": struct.pack("<HH", 1, 0) + bytes([len(font)]) + font, "shapes_main": shape}))
    first = d["lists"][0]
    assert [first[k] for k in ("list_id", "kind", "level", "start", "format", "text", "suffix")] == [77, "singleLevel", 0, 1, 0, "%1.", "tab"] and d["list_uses"] == [{"id": 1, "list_id": 77, "overrides": []}]
    assert d["fonts"] == [{"ix": 0, "name": "Serif"}] and (d["shapes"][0]["l"], d["shapes"][0]["r"], d["shapes"][0]["wrap"]) == (10, 30, 3)


def test_damage_is_an_error_of_the_document():
    rng = random.Random(3)
    whole = builder.document("some text\rand more 世界\r", char_runs=[(0, 4, BOLD)], para_runs=[(0, 10, 0, b"")], summary={"title": "t"})
    seen = set()
    for _ in range(400):
        data = bytearray(whole)
        for _ in range(rng.randrange(1, 6)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        if rng.random() < 0.3:
            del data[rng.randrange(len(data)) :]
        d = parse.tried(bytes(data), None)
        seen.add(d.get("error_class", d["status"]))
    assert {"ok", "CorruptCompound"} <= seen
    assert parse.tried(None, None)["error_class"] == "NotCompound"


def test_other_formats_are_refused():
    assert parse.tried(compound.build({"WordDocument": b"\0" * 5000}), None)["error_class"] == "NotWordDocument"
    old = bytearray(5000)
    struct.pack_into("<HH", old, 0, 0xA5EC, 0x0065)
    assert parse.tried(compound.build({"WordDocument": bytes(old)}), None)["error_class"] == "UnsupportedVersion"
    assert issubclass(CorruptDocument, DocumentError)
    assert story.classify("= 1 + 2", story.Names()) == ("=", "live")


PNG = b"\x89PNG\r\n\x1a\n" + bytes(20)


def test_drawings_pictures_objects():
    from inkstone.sources import drawing as D

    blip = D.record(0xF01E, 0x6E0, bytes(16) + b"\xff" + PNG)
    entry = D.record(0xF007, 6, bytes(28) + struct.pack("<IBBBB", 0, 0, 0, 0, 0) + blip)
    top = D.record(0xF000, 0, D.record(0xF001, 1, entry, True), True)
    opts = struct.pack("<HiHiHi", 0x4, 45 << 16, 0x4104, 1, 0x181, 0x0000FF)

    def sp(kind, number, flags, extra=b""):
        return D.record(0xF004, 0, D.record(0xF00A, kind, struct.pack("<II", number, flags)) + extra, True)

    group = D.record(0xF003, 0, sp(0, 2000, 1, D.record(0xF009, 0, struct.pack("<iiii", 0, 0, 100, 100))) + sp(1, 2001, 2, D.record(0xF00F, 0, struct.pack("<iiii", 50, 0, 100, 50))), True)
    page = b"\0" + D.record(0xF002, 0, D.record(0xF003, 0, sp(0, 1, 5) + sp(75, 1025, 0xA00, D.record(0xF00B, 3, opts)) + group, True), True)
    spa = lambda n, a: struct.pack("<iiiiiHi", n, *a, 2 << 5, 0)
    anchors = struct.pack("<iii", 0, 1, 4) + spa(1025, (0, 0, 10, 10)) + spa(2000, (0, 0, 200, 200))
    picf = bytearray(68)
    inline = D.record(0xF004, 0, b"", True) + blip
    struct.pack_into("<IHH", picf, 0, 68 + len(inline), 68, 0x64)
    struct.pack_into("<HHHH", picf, 28, 1000, 500, 1000, 1000)
    special = struct.pack("<HBHI", 0x0855, 1, 0x6A03, 0)
    data = builder.document("\x08\x08\x01\r", char_runs=[(2, 3, special)], tables={"drawing": top + page, "shapes_main": anchors}, streams={"Data": bytes(picf) + inline, "ObjectPool/_7/Contents": b"body"})
    d = parse.parse_document(data)
    assert [(s["shape_id"], s["type"], s["rotation"], s["image"], s["fill"]) for s in d["shapes"]][0] == (1025, 75, 45.0, 1, "FF0000")
    child = next(s for s in d["shapes"] if s["shape_id"] == 2001)
    assert (child["l"], child["t"], child["r"], child["b"], child["parent"]) == (100, 0, 200, 100, 2000)
    assert d["images"] == [{"id": 1, "format": "png", "data": PNG}]
    assert d["pictures"] == [{"id": 1, "cp": 2, "format": "png", "width_twips": 1000, "height_twips": 500, "data": PNG}]
    assert [i["kind"] for i in d["inlines"]] == ["shape", "shape", "picture"] and [x["code"] for x in d["diagnostics"]] == ["GROUPED_FLOATING_FRAME_FLATTENED", "OLE_OBJECTS_UNANCHORED"]
    assert compound.Compound(d["ole_objects"][0]["content"]).read("Contents") == b"body"
    bad = parse.parse_document(builder.document("\x01\r", char_runs=[(0, 1, special)], streams={"Data": bytes(80)}))
    assert [x["code"] for x in bad["diagnostics"]] == ["INLINE_PICTURE_INVALID", "OBJECT_ANCHOR_DEFERRED"]


def test_images():
    from inkstone.sources import drawing as D

    dib = struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)
    assert D.bitmap_file(dib)[:14] == struct.pack("<2sIII", b"BM", 58, 0, 54)
    import zlib

    assert D.inflate(zlib.compress(b"x" * 1000)) == b"x" * 1000
    with pytest.raises(TooLarge):
        D.inflate(zlib.compress(b"x" * 1000), 100)
    with pytest.raises(CorruptDocument):
        D.image(bytes(17) + b"no png", 0xF01E, 0x6E0, 0, 23)
    assert D.polygon(struct.pack("<HHHhhhh", 2, 2, 4, 0, 0, 10, 5)) == [(0, 0), (21600, 21600)]


@pytest.mark.parametrize("cipher", ["rc4", "capi"])
def test_blocks_of_one_key_are_made_once(cipher):
    ciphers._pad.cache_clear()
    whole = builder.document("abc\r" * 600, password="secret", cipher=cipher)  # two streams of several blocks
    made = ciphers._pad.cache_info().misses
    assert parse.parse_document(whole, "secret")["stats"]["paragraph_count"] == 600
    assert ciphers._pad.cache_info().misses == made <= 20 < ciphers._pad.cache_info().hits
    ciphers._pad.cache_clear()
    assert builder.document("abc\r" * 600, password="secret", cipher=cipher) == whole
