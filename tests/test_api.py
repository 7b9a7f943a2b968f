"""Entry points, reports, functions for SQL, and packages of every kind of content."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from inkstone import api
from inkstone.operators import intervals as I
from inkstone.plans import formats
from inkstone.sinks import docx, report
from inkstone.sources import builder, modifiers, parse, story, tables, word
from inkstone.sources.errors import CorruptDocument


def test_convert_in_memory():
    made = api.convert(builder.document("one\rtwo\r", summary={"title": "t"}))
    assert docx.text_of(made.package) == ["one", "two"] and made.report["fault"] is None and made.report["stats"]["paragraph_count"] == 2
    bad = api.convert(b"nothing")
    assert bad.package is None and bad.report["error_class"] == "NotCompound"
    assert "paragraphs" not in api.inspect(builder.document("x\r")) and api.inspect(builder.document("x\r"))["version"] == 0xC1
    assert "paragraph_count: 1" in report.as_text(api.inspect(builder.document("x\r"))) and report.as_text(api.inspect(b"")).startswith("NotCompound")


def test_folder_in_path_order_with_a_report(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    (source / "B").mkdir(parents=True)
    for name in ("b.doc", "C.DOC", "B/a.doc", "d.doc"):
        (source / name).write_bytes(builder.document(f"{name}\r") if name != "d.doc" else b"no")
    rows = api.convert_folder(spark, f"file://{source}", str(target), report_file=str(tmp_path / "r.json")).collect()
    assert [r.input.rpartition("/in/")[2] for r in rows] == ["b.doc", "B/a.doc", "C.DOC", "d.doc"]
    said = json.loads((tmp_path / "r.json").read_text())
    assert (said["file_count"], said["succeeded"], said["failed"], len(said["results"])) == (4, 3, 1, 4)
    assert [r["status"] for r in said["results"]] == ["succeeded"] * 3 + ["failed"] and said["results"][0]["output"].endswith("/b.docx")
    with pytest.raises(ValueError, match="place of a document"):
        api.convert_folder(spark, f"file://{source}", str(target), report_file=str(source / "b.doc"))
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".part")]


def test_a_report_that_fails_leaves_nothing(tmp_path):
    (tmp_path / "r.json").write_text("old")

    def pieces():
        yield "{"
        raise OSError("full")

    with pytest.raises(OSError):
        report.write_json(str(tmp_path / "r.json"), pieces())
    assert (tmp_path / "r.json").read_text() == "old" and len(list(tmp_path.iterdir())) == 1


def test_functions_for_sql(spark):
    api.register(spark)
    docs = spark.createDataFrame([(1, bytearray(builder.document("one\rtwo\r"))), (2, bytearray(b"no"))], "id int, content binary")
    docs.createOrReplaceTempView("files")
    rows = spark.sql("SELECT id, p.ix, p.text FROM files, LATERAL parse_doc(content) p ORDER BY id, ix").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "one"), (1, 1, "two")]
    said = spark.sql("SELECT doc_text(content) AS t, doc_status(content) AS s, length(doc_package(content)) AS n FROM files ORDER BY id").collect()
    assert (said[0].t, said[0].s, said[1].t, said[1].s, said[1].n) == ("one\ntwo", "ok", None, "NotCompound", None) and said[0].n > 500


SAMPLES = {"_bordered": (5, 7), "_celled": (3, 9), "_framed": (3, 9), "_fonted": (1, "Brand"), "_flagged": (6, 3), "_links": ("http://a/", 2), "_headed": ("a", "b"), "_pictured": (1, "n"), "_remarked": ("name", 4), "_sectioned": (5, 8), "_listed": (2, 3), "_set": (5, 3), "_drawn": (4, 9), "_data": (3, 2), "_conditional": (1, 9), "_noted": ("n", 5)}


@pytest.mark.parametrize("name", sorted(SAMPLES))
def test_packages_of_all_contents_are_sound_and_repeat(name):
    data = getattr(formats, name)(*SAMPLES[name])
    made = api.convert(data)
    assert made.report["status"] == "ok" and made.report["fault"] is None and made.package == api.convert(data).package
    for part in docx.names(made.package):
        if part.endswith(".rels") and part != "_rels/.rels":  # what a part links to is there
            for link in docx.tree(made.package, part):
                assert "word/" + link.get("Target") in docx.names(made.package)


def test_parts_in_order():
    made = api.convert(formats._pictured(1, "n")).package
    assert docx.names(made)[:4] == ["[Content_Types].xml", "_rels/.rels", "word/document.xml", "word/_rels/document.xml.rels"]
    body = docx.raw(made, "word/document.xml").decode()
    assert "<w:drawing>" in body and "<o:OLEObject" in body and 'ProgID="Word.Picture.8"' in body and "kept" in body and "old" not in body
    drawn = docx.raw(api.convert(formats._drawn(4, 9)).package, "word/document.xml").decode()
    assert 'path="m0,0l9,0,0,9xe"' in drawn and "<v:line" in drawn and 'dashstyle="shortdashdotdot"' in drawn


def test_field_marks_have_to_be_in_the_text():
    text = "\x13 PAGE \x141\x15\r"
    good = builder.field_table(text)
    assert parse.tried(builder.document(text, tables={"fields_main": good}), None)["status"] == "ok"
    for at, value in ((0, 1), (4, 0)):  # a mark elsewhere, marks out of order
        bad = bytearray(good)
        struct.pack_into("<i", bad, at, value)
        assert parse.tried(builder.document(text, tables={"fields_main": bytes(bad)}), None)["error_class"] == "CorruptDocument"
    none = parse.parse_document(builder.document(text, tables={"fields_main": struct.pack("<i", 1)}))
    assert [(f["live"], f["fate"]) for f in none["fields"]] == [(False, "undeclared")] and none["paragraphs"][0]["text"] == "1"


def test_long_fields_are_flattened_with_the_fields_in_them():
    text = '\x13 TOC \x14a\x13 PAGEREF x \x142\x15\rb\x15\r'
    marks = {"bookmark_names": builder.wide_strings(["x"]), "bookmark_starts": struct.pack("<iiHH", 0, len(text), 0, 0), "bookmark_ends": struct.pack("<ii", 1, len(text))}
    d = parse.parse_document(builder.document(text, tables=marks))
    assert [p["text"] for p in d["paragraphs"]] == ["a2", "b"] and not any(f["live"] for f in d["fields"]) and {i["kind"] for i in d["inlines"]} == {"text"}


def test_marks_at_one_place():
    assert word.boundaries([(0, 1, 5), (1, 5, 9), (2, 5, 5)]) == [(1, "start", 0), (5, "end", 0), (5, "start", 1), (5, "start", 2), (5, "end", 2), (9, "end", 1)]


def test_rows_and_cells():
    row, rough = tables.edited({}, 0xD608, bytes([2]) + struct.pack("<3h", 0, 10, 30))
    assert row == {"edges": [0, 10, 30], "cells": [{}, {}]} and not rough
    row, _ = tables.edited(row, 0x7621, struct.pack("<BBH", 1, 1, 5))
    assert row["edges"] == [0, 10, 15, 35]
    for opcode, operand in ((0x5622, b"\0\3"), (0x7623, struct.pack("<BBH", 2, 5, 1)), (0xD62C, b"\0\1\7"), (0x5624, b"\1"), (0xD608, bytes([2]) + struct.pack("<3h", 9, 1, 3))):
        with pytest.raises(CorruptDocument):
            tables.edited(row, opcode, operand)
    assert tables.grid([{"edges": [0, 10]}, {"edges": [5, 20], "before": 3, "after": 4}]) == [0, 2, 5, 10, 20, 24]
    assert tables.built(row, 2)[1] == "TABLE_CELL_DEFINITION_MISMATCH" and tables.built({"edges": [0, 1]}, 3)[1] == "TABLE_GRID_MISMATCH"
    wide = tables.floating({"edges": [-20, 80], "x_anchor": "page", "width_type": "pct", "width": 2500})
    assert (wide["width"], wide["width_type"], wide["autofit"], wide["left_twips"], wide["x_twips"]) == (100, "dxa", False, 20, 0)
    assert tables.border(b"\xff" * 4) is None and tables.border(bytes([4, 1, 6, 1 | 32])) == "single:4:FF0000:1:shadow" and tables.shading(b"\xff\xff") == (None, False)


def test_sections_settle_numbers_that_hang_together():
    fold = modifiers.fold_section
    assert "column_widths_twips" not in fold([(0x500B, b"\1\0"), (0x3005, b"\0"), (0xF203, struct.pack("<BH", 0, 900))], unknown := set()) and unknown == {0x3005}
    assert fold([(0x501C, b"\5\0")], set()) == {} and fold([(0x501C, b"\5\0"), (0x3011, b"\1")], set())["page_number_start"] == 5
    with pytest.raises(CorruptDocument):
        fold([(0xB01F, b"\1\0")], set())


def test_arguments_of_fields():
    assert story.argument('REF "a \\"b\\" c" \\h') == 'a "b" c' and story.argument("REF \\h x") is None and story.argument("PAGE") is None
    assert story.classify("STYLEREF Head", story.Names(styles=frozenset({"head"}))) == ("STYLEREF", "live") and story.classify("SEQ", story.Names())[1] == "broken"


def test_compose_carries_states_over_gaps(spark):
    a = spark.createDataFrame([(1, 0, 4, "a"), (1, 4, 6, "b"), (1, 9, 9, "no"), (2, 0, 1, "z")], "k int, cp_start int, cp_end int, v string")
    b = spark.createDataFrame([(1, 2, 5, 7), (1, 8, 10, 8)], "k int, cp_start int, cp_end int, w int")
    got = sorted((r.k, r.cp_start, r.cp_end, r.v, r.w) for r in I.compose(a, b, "k", "v", "w").collect())
    assert got == [(1, 0, 2, "a", None), (1, 2, 4, "a", 7), (1, 4, 5, "b", 7), (1, 5, 6, "b", None), (1, 8, 10, None, 8), (2, 0, 1, "z", None)]


def test_unknown_modifiers_by_name(spark):
    d = parse.parse_document(builder.document("x\r", char_runs=[(0, 1, struct.pack("<HB", 0x08FE, 1))]))
    assert d["stats"]["unsupported_0x08FE"] == 1 and len(d["stats"]) > 100
    assert F is not None
