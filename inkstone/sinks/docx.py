"""The package sink: a row of the document model becomes the bytes of a modern document, the same bytes every time."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from inkstone.functions.dims import NUMBER_FORMATS
from inkstone.sources import parse
from inkstone.sources.word import boundaries

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_MAIN = "application/vnd.openxmlformats-officedocument.wordprocessingml"
REQUIRED = ("[Content_Types].xml", "_rels/.rels", "word/document.xml")
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_DRAWING = "http://schemas.openxmlformats.org/drawingml/2006"
_SPACES = f'xmlns:w="{_W}" xmlns:r="{_R}" xmlns:wp="{_DRAWING}/wordprocessingDrawing" xmlns:a="{_DRAWING}/main" xmlns:pic="{_DRAWING}/picture" xmlns:v="urn:schemas-microsoft-com:vml" xmlns:o="urn:schemas-microsoft-com:office:office"'
_FLAGS = (("bold", "b"), ("bold_cs", "bCs"), ("italic", "i"), ("italic_cs", "iCs"), ("caps", "caps"), ("small_caps", "smallCaps"), ("strike", "strike"), ("double_strike", "dstrike"), ("outline", "outline"), ("shadow", "shadow"), ("emboss", "emboss"), ("imprint", "imprint"), ("no_proof", "noProof"), ("snap_to_grid", "snapToGrid"), ("hidden", "vanish"), ("web_hidden", "webHidden"))
_INLINE = {"tab": "<w:tab/>", "break": "<w:br/>", "page_break": '<w:br w:type="page"/>', "no_break_hyphen": "<w:noBreakHyphen/>", "soft_hyphen": "<w:softHyphen/>", "separator": "<w:separator/>", "continuation_separator": "<w:continuationSeparator/>"}
_MEDIA = {"png": "image/png", "jpeg": "image/jpeg", "bmp": "image/bmp", "tiff": "image/tiff", "emf": "image/x-emf", "wmf": "image/x-wmf", "pict": "image/pict"}
_TWIP, _SIDES = 635, ("top", "left", "bottom", "right")
_VML = {1: "rect", 2: "roundrect", 3: "oval", 20: "line"}


def _on_off(name: str, value: str | None) -> str:
    """Not set writes nothing, true the element, false the element with a value."""
    return "" if value is None else f"<w:{name}/>" if value == "true" else f'<w:{name} w:val="0"/>'


def _value(name: str, value: str | None, attribute: str = "val") -> str:
    return "" if value is None else f"<w:{name} w:{attribute}={quoteattr(value)}/>"


def _given(p: dict[str, str], *pairs: tuple[str, str]) -> str:
    """Attributes of the properties that are set."""
    return "".join(f" w:{name}={quoteattr(p[key])}" for key, name in pairs if key in p)


def _border(name: str, value: str | None) -> str:
    if value is None:
        return ""
    style, size, color, space, *more = value.split(":")
    return f'<w:{name} w:val="{style}" w:sz="{size}" w:space="{space}" w:color="{color}"' + "".join(f' w:{m}="1"' for m in more) + "/>"


def _borders(element: str, p: dict[str, str], sides: dict[str, str]) -> str:
    made = "".join(_border(tag, p.get(f"border_{side}")) for side, tag in sides.items())
    return f"<w:{element}>{made}</w:{element}>" if made else ""


def _shade(value: str | None) -> str:
    if value is None:
        return ""
    pattern, front, back = value.split(":")
    return f'<w:shd w:val="{pattern}" w:color="{front}" w:fill="{back}"/>'


def run_props(p: dict[str, str], style_ids: set[str]) -> str:
    style = p.get("style_id") if p.get("style_id") in style_ids else None
    fonts = _given(p, ("font_ascii", "ascii"), ("font_other", "hAnsi"), ("font_east_asia", "eastAsia"), ("font_cs", "cs"), ("font_hint", "hint"))
    out = _value("rStyle", f"S{style}" if style else None) + (f"<w:rFonts{fonts}/>" if fonts else "") + "".join(_on_off(tag, p.get(k)) for k, tag in _FLAGS)
    out += _value("color", p.get("color")) + _value("spacing", p.get("spacing_twips")) + _value("w", p.get("scale_percent")) + _value("kern", p.get("kerning_half_points")) + _value("position", p.get("raised_half_points"))
    out += _value("sz", p.get("size_half_points")) + _value("szCs", p.get("size_cs_half_points")) + _value("highlight", p.get("highlight"))
    if "underline" in p:
        out += f'<w:u w:val="{p["underline"]}"' + (f' w:color="{p["underline_color"]}"' if "underline_color" in p else "") + "/>"
    out += _value("effect", p.get("effect")) + _border("bdr", p.get("border")) + _shade(p.get("shading"))
    if "fit_text_twips" in p:
        out += f'<w:fitText w:val="{p["fit_text_twips"]}" w:id="{p["fit_text_id"]}"/>'
    out += _value("vertAlign", p.get("vertical")) + _on_off("rtl", p.get("rtl")) + _on_off("cs", p.get("complex_script")) + _value("em", p.get("emphasis"))
    languages = _given(p, ("language", "val"), ("language_east_asia", "eastAsia"), ("language_cs", "bidi"))
    out += f"<w:lang{languages}/>" if languages else ""
    if "east_asian_id" in p:
        flags = "".join(f' w:{a}="1"' for k, a in (("east_asian_vertical", "vert"), ("east_asian_combine", "combine"), ("east_asian_compress", "vertCompress")) if p.get(k) == "true")
        out += f'<w:eastAsianLayout w:id="{p["east_asian_id"]}"{flags}' + (f' w:combineBrackets="{p["east_asian_brackets"]}"' if "east_asian_brackets" in p else "") + "/>"
    return f"<w:rPr>{out}</w:rPr>" if out else ""


def _frame(p: dict[str, str]) -> str:
    keys = (("frame_width_twips", "w"), ("frame_height_twips", "h"), ("frame_height_rule", "hRule"), ("frame_x_anchor", "hAnchor"), ("frame_y_anchor", "vAnchor"), ("frame_x_twips", "x"), ("frame_x_align", "xAlign"), ("frame_y_twips", "y"), ("frame_y_align", "yAlign"))
    keys += (("frame_space_x_twips", "hSpace"), ("frame_space_y_twips", "vSpace"), ("frame_wrap", "wrap"), ("drop_cap", "dropCap"), ("drop_cap_lines", "lines"))
    made = _given(p, *keys) + (' w:anchorLock="1"' if p.get("frame_locked") == "true" else "")
    return f"<w:framePr{made}/>" if made else ""


_PARA_FLAGS = (("no_hyphenation", "suppressAutoHyphens"), ("kinsoku", "kinsoku"), ("word_wrap", "wordWrap"), ("overflow_punctuation", "overflowPunct"), ("top_line_punctuation", "topLinePunct"), ("auto_space_latin", "autoSpaceDE"), ("auto_space_numbers", "autoSpaceDN"), ("rtl", "bidi"), ("adjust_right", "adjustRightInd"), ("snap_to_grid", "snapToGrid"))


def paragraph_props(p: dict[str, str], style_ids: set[str], section: str = "") -> str:
    style = p.get("style_id") if p.get("style_id") in style_ids else None
    out = _value("pStyle", f"S{style}" if style else None) + "".join(_on_off(tag, p.get(k)) for k, tag in (("keep_next", "keepNext"), ("keep_lines", "keepLines"), ("page_break_before", "pageBreakBefore"))) + _frame(p) + _on_off("widowControl", p.get("widow_control"))
    if p.get("list_id", "None") != "None" and "list_skipped" not in p:
        out += f'<w:numPr><w:ilvl w:val="{p.get("list_level", "0")}"/><w:numId w:val="{p["list_id"]}"/></w:numPr>'
    out += _on_off("suppressLineNumbers", p.get("no_line_numbers")) + _borders("pBdr", p, {k: k for k in (*_SIDES, "between")}) + _shade(p.get("shading"))
    if "tabs" in p:
        stops = (t.split(":") for t in p["tabs"].split(";"))
        out += "<w:tabs>" + "".join(f'<w:tab w:val="{t[1]}"' + (f' w:leader="{t[2]}"' if len(t) > 2 else "") + f' w:pos="{t[0]}"/>' for t in stops) + "</w:tabs>"
    out += "".join(_on_off(tag, p.get(k)) for k, tag in _PARA_FLAGS)
    spacing = _given(p, ("before_lines", "beforeLines"), ("before_twips", "before"), ("after_lines", "afterLines"), ("after_twips", "after"), ("line", "line"), ("line_rule", "lineRule")) + "".join(f' w:{a}="{int(p[k] == "true")}"' for k, a in (("before_auto", "beforeAutospacing"), ("after_auto", "afterAutospacing")) if k in p)
    indent = _given(p, ("left_chars", "leftChars"), ("left_twips", "left"), ("right_chars", "rightChars"), ("right_twips", "right"))
    for key, ahead, back in (("first_line_chars", "firstLineChars", "hangingChars"), ("first_line_twips", "firstLine", "hanging")):
        if key in p:
            n = int(p[key])
            indent += f' w:{ahead}="{n}"' if n >= 0 else f' w:{back}="{-n}"'
    out += (f"<w:spacing{spacing}/>" if spacing else "") + (f"<w:ind{indent}/>" if indent else "") + _on_off("contextualSpacing", p.get("contextual_spacing")) + _on_off("mirrorIndents", p.get("mirror_indents")) + _value("jc", p.get("align"))
    out += _value("textDirection", p.get("frame_flow")) + _value("textAlignment", p.get("text_align")) + _value("textboxTightWrap", p.get("tight_wrap"))
    if p.get("outline_level") not in (None, "9"):
        out += _value("outlineLvl", p["outline_level"])
    return f"<w:pPr>{out}{section}</w:pPr>" if out or section else ""


def _notes(p: dict[str, str], kind: str) -> str:
    made = _value("pos", p.get(f"{kind}_position")) + _value("numFmt", p.get(f"{kind}_format")) + _value("numStart", p.get(f"{kind}_start")) + _value("numRestart", p.get(f"{kind}_restart"))
    return f"<w:{kind}Pr>{made}</w:{kind}Pr>" if made else ""


def section_props(p: dict[str, str], references: str = "") -> str:
    size = _given(p, ("page_width_twips", "w"), ("page_height_twips", "h"), ("orientation", "orient"))
    margins = "".join(f' w:{a}="{p.get(k, d)}"' for k, a, d in (("top_twips", "top", "1440"), ("right_twips", "right", "1440"), ("bottom_twips", "bottom", "1440"), ("left_twips", "left", "1440"), ("header_twips", "header", "720"), ("footer_twips", "footer", "720"), ("gutter_twips", "gutter", "0")))
    out = references + _notes(p, "footnote") + _notes(p, "endnote") + _value("type", p.get("break_kind")) + (f"<w:pgSz{size}/>" if size else "") + f"<w:pgMar{margins}/>"
    if source := _given(p, ("paper_first", "first"), ("paper_other", "other")):
        out += f"<w:paperSrc{source}/>"
    if edges := "".join(_border(side, p.get(f"border_{side}")) for side in _SIDES):
        out += f'<w:pgBorders w:zOrder="{p["border_order"]}" w:display="{p["border_display"]}" w:offsetFrom="{p["border_offset"]}">{edges}</w:pgBorders>'
    if lines := _given(p, ("line_number_count_by", "countBy"), ("line_number_start", "start"), ("line_number_distance_twips", "distance"), ("line_number_restart", "restart")):
        out += f"<w:lnNumType{lines}/>"
    if number := _given(p, ("page_number_format", "fmt"), ("page_number_start", "start"), ("chapter_style", "chapStyle"), ("chapter_separator", "chapSep")):
        out += f"<w:pgNumType{number}/>"
    columns = _given(p, ("columns", "num"), ("column_space_twips", "space")) + (' w:sep="1"' if p.get("column_line") == "true" else "")
    if "column_widths_twips" in p:
        gaps = [*(g for g in p.get("column_spaces_twips", "").split(",") if g), None]
        each = "".join(f'<w:col w:w="{w}"' + (f' w:space="{g}"' if g else "") + "/>" for w, g in zip(p["column_widths_twips"].split(","), gaps))
        out += f'<w:cols{columns} w:equalWidth="0">{each}</w:cols>'
    elif columns:
        out += f"<w:cols{columns}/>"
    out += _on_off("formProt", p.get("form_protected")) + _value("vAlign", p.get("vertical_align")) + _on_off("noEndnote", p.get("suppress_endnotes")) + _on_off("titlePg", p.get("title_page")) + _value("textDirection", p.get("flow")) + _on_off("bidi", p.get("rtl")) + _on_off("rtlGutter", p.get("rtl_gutter"))
    if grid := _given(p, ("grid_type", "type"), ("grid_line_pitch_twips", "linePitch"), ("grid_char_space", "charSpace")):
        out += f"<w:docGrid{grid}/>"
    return f"<w:sectPr>{out}</w:sectPr>"


def table_props(p: dict[str, str], style_ids: set[str]) -> str:
    style = p.get("style_id") if p.get("style_id") in style_ids else None
    place = _given(p, *((f"distance_{side}_twips", f"{side}FromText") for side in _SIDES), ("y_anchor", "vertAnchor"), ("x_anchor", "horzAnchor"), ("x_align", "tblpXSpec"), ("x_twips", "tblpX"), ("y_align", "tblpYSpec"), ("y_twips", "tblpY"))
    out = _value("tblStyle", f"S{style}" if style else None) + (f"<w:tblpPr{place}/>" if place else "") + ('<w:tblOverlap w:val="never"/>' if p.get("no_overlap") == "true" else "") + _on_off("bidiVisual", p.get("rtl"))
    out += _value("tblStyleRowBandSize", p.get("row_band")) + _value("tblStyleColBandSize", p.get("column_band"))
    if "width_type" in p:
        out += f'<w:tblW w:w="{p["width"]}" w:type="{p["width_type"]}"/>'
    out += _value("jc", p.get("align")) + (f'<w:tblInd w:w="{p["left_twips"]}" w:type="dxa"/>' if "left_twips" in p else "")
    out += _borders("tblBorders", p, {**{k: k for k in _SIDES}, "inside_horizontal": "insideH", "inside_vertical": "insideV"}) + _shade(p.get("shading")) + ('<w:tblLayout w:type="fixed"/>' if p.get("autofit") == "false" else "") + _margins("tblCellMar", p)
    if any(k.startswith("look_") for k in p):
        on = lambda k: int(p.get(f"look_{k}") == "true")
        out += f'<w:tblLook w:firstRow="{on("first_row")}" w:lastRow="{on("last_row")}" w:firstColumn="{on("first_column")}" w:lastColumn="{on("last_column")}" w:noHBand="{on("no_row_bands")}" w:noVBand="{on("no_column_bands")}"/>'
    return f"<w:tblPr>{out}</w:tblPr>"


def _margins(element: str, p: dict[str, str]) -> str:
    made = "".join(f'<w:{side} w:w="{p[f"margin_{side}"]}" w:type="dxa"/>' for side in _SIDES if f"margin_{side}" in p)
    return f"<w:{element}>{made}</w:{element}>" if made else ""


def row_props(row: dict) -> str:
    p = dict(row["props"])
    out = _value("gridBefore", str(row["grid_before"]) if row["grid_before"] else None)
    out += f'<w:wBefore w:w="{p["before"]}" w:type="{p["before_type"]}"/>' if "before_type" in p else ""
    out += _value("gridAfter", str(row["grid_after"]) if row["grid_after"] else None)
    out += f'<w:wAfter w:w="{p["after"]}" w:type="{p["after_type"]}"/>' if "after_type" in p else ""
    out += "<w:cantSplit/>" if p.get("cant_split") == "true" else ""
    if "height_twips" in p:
        out += f'<w:trHeight w:val="{p["height_twips"]}"' + (f' w:hRule="{p["height_rule"]}"' if "height_rule" in p else "") + "/>"
    out += "<w:tblHeader/>" if p.get("header") == "true" else ""
    out += f'<w:tblCellSpacing w:w="{p["spacing_twips"]}" w:type="dxa"/>' if "spacing_twips" in p else ""
    return f"<w:trPr>{out}</w:trPr>" if out else ""


def cell_props(cell: dict) -> str:
    p = dict(cell["props"])
    out = f'<w:tcW w:w="{cell["width"]}" w:type="dxa"/>' if cell["width"] is not None else ""
    out += f'<w:gridSpan w:val="{cell["span"]}"/>' if cell["span"] > 1 else ""
    if "vertical_merge" in p:
        out += "<w:vMerge/>" if p["vertical_merge"] == "continue" else '<w:vMerge w:val="restart"/>'
    out += _borders("tcBorders", p, {**{k: k for k in _SIDES}, "diagonal_down": "tl2br", "diagonal_up": "tr2bl"}) + _shade(p.get("shading"))
    out += _on_off("noWrap", p.get("no_wrap")) + _margins("tcMar", p) + _value("textDirection", p.get("flow")) + _on_off("tcFitText", p.get("fit_text")) + _value("vAlign", p.get("align")) + _on_off("hideMark", p.get("hide_mark"))
    return f"<w:tcPr>{out}</w:tcPr>" if out else ""


def _text(value: str) -> str:
    return f'<w:t xml:space="preserve">{escape(value)}</w:t>'



class _Story:
    """A part of the package with its own relations: images and objects that its runs show."""

    def __init__(self, doc: dict, package: _Package) -> None:
        self.doc, self.package, self.links = doc, package, []

    def link(self, kind: str, target: str) -> str:
        pair = kind, target
        if pair not in self.links:
            self.links.append(pair)
        return f"rId{self.links.index(pair) + 1}"

    def rels(self) -> str:
        return f'<Relationships xmlns="{_RELS}">{"".join(f'<Relationship Id="rId{k}" Type="{_R}/{kind}" Target="{target}"/>' for k, (kind, target) in enumerate(self.links, 1))}</Relationships>'

    def _blip(self, number: int, rid: str, width: int, height: int) -> str:
        graphic = f'<a:graphic><a:graphicData uri="{_DRAWING}/picture"><pic:pic><pic:nvPicPr><pic:cNvPr id="{number}" name="Picture {number}"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="{rid}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{width}" cy="{height}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic>'
        return f'<wp:docPr id="{number}" name="Picture {number}"/>{graphic}'

    def picture(self, number: int) -> str:
        p = self.package.pictures.get(number)
        if p is None:
            return ""
        width, height = p["width_twips"] * _TWIP, p["height_twips"] * _TWIP
        rid = self.link("image", self.package.media(("picture", number), p["format"], p["data"]))
        return f'<w:drawing><wp:inline distT="0" distB="0" distL="0" distR="0"><wp:extent cx="{width}" cy="{height}"/>{self._blip(number, rid, width, height)}</wp:inline></w:drawing>'

    def floating(self, s: dict) -> str:
        left, top, width, height = s["l"], s["t"], max(1, s["r"] - s["l"]), max(1, s["b"] - s["t"])
        if s["kind"] == "picture":
            stored = self.package.images.get(s["image"])
            if stored is None:
                return ""
            rid = self.link("image", self.package.media(("image", s["image"]), stored["format"], stored["data"]))
            number, style = 100_000 + s["shape_id"] % 1_000_000, dict(s["style"])
            wrap = {1: "<wp:wrapTopAndBottom/>", 3: "<wp:wrapNone/>"}.get(s["wrap"], '<wp:wrapSquare wrapText="bothSides"/>')
            far = {side: style.get(f"distance_{side}_emu", "0") for side in _SIDES}
            from_ = {"margin": "margin", "page": "page", "text": "column"}
            return (
                f'<w:drawing><wp:anchor distT="{far["top"]}" distB="{far["bottom"]}" distL="{far["left"]}" distR="{far["right"]}" simplePos="0" relativeHeight="{number}" behindDoc="{int(bool(s["behind"]))}" locked="{int(bool(s["locked"]))}" layoutInCell="1" allowOverlap="1"><wp:simplePos x="0" y="0"/>'
                f'<wp:positionH relativeFrom="{from_[s["x_from"] or "text"]}"><wp:posOffset>{left * _TWIP}</wp:posOffset></wp:positionH><wp:positionV relativeFrom="{ {**from_, "text": "paragraph"}[s["y_from"] or "text"] }"><wp:posOffset>{top * _TWIP}</wp:posOffset></wp:positionV>'
                f'<wp:extent cx="{width * _TWIP}" cy="{height * _TWIP}"/>{wrap}{self._blip(number, rid, width * _TWIP, height * _TWIP)}</wp:anchor></w:drawing>'
            )
        if s["kind"] not in ("shape", "line", "textbox", "frame"):
            return ""
        look = dict(s["style"])
        points = lambda twips: f"{twips / 20:g}pt"
        css = f"position:absolute;margin-left:{points(left)};margin-top:{points(top)};width:{points(width)};height:{points(height)};z-index:{0 if s['kind'] == 'frame' else -1 if s['behind'] else 1}"
        css += (f";rotation:{s['rotation']:g}" if s["rotation"] else "") + (";flip:" + "x" * bool(s["flip_h"]) + "y" * bool(s["flip_v"]) if s["flip_h"] or s["flip_v"] else "")
        paint = f' filled="{"t" if look.get("filled", "true") == "true" else "f"}"' + (f' fillcolor="#{look["fill"]}"' if "fill" in look else "")
        lined = look.get("lined", "true") == "true" and s["kind"] != "frame"
        paint += f' stroked="{"t" if lined else "f"}"' + (f' strokecolor="#{look["line"]}" strokeweight="{int(look["line_width_emu"]) / 12700:g}pt"' if lined and "line" in look else "")
        inner = f'<v:fill opacity="{int(look["fill_opacity"]) * 100 / 65536:g}%"/>' if look.get("fill_opacity", "65536") != "65536" else ""
        if lined and "line_dash" in look:
            inner += f'<v:stroke linestyle="{look["line_style"]}" dashstyle="{look["line_dash"]}" joinstyle="{look["line_join"]}" endcap="{look["line_cap"]}" startarrow="{look["start_arrow"]}" startarrowwidth="{look["start_arrow_width"]}" startarrowlength="{look["start_arrow_length"]}" endarrow="{look["end_arrow"]}" endarrowwidth="{look["end_arrow_width"]}" endarrowlength="{look["end_arrow_length"]}"/>'
        label = f"textbox:{s['shape_id']}"
        if s["kind"] == "textbox" and label in self.package.by_story:
            inset = ",".join(f"{int(look.get(f'inset_{side}_emu', d)) / 12700:g}pt" for side, d in (("left", 91440), ("top", 45720), ("right", 91440), ("bottom", 45720)))
            inner += f'<v:textbox inset="{inset}"><w:txbxContent>{self.blocks(label)}</w:txbxContent></v:textbox>'
        name = "shape" if s["path"] else _VML.get(s["type"] or 1, "shape")
        own = f' path="{s["path"]}" coordsize="{s["coordsize"]}"' if s["path"] else f' type="#_x0000_t{s["type"]}"' if name == "shape" else ""
        own += f' adj="{s["adjusts"]}"' if s["adjusts"] and name == "shape" else ""
        if name == "line":
            own += f' from="{points(left)},{points(top)}" to="{points(left + width)},{points(top + height)}"'
        return f'<w:pict><v:{name} id="_x0000_s{s["shape_id"]}" style="{css}"{own}{paint}>{inner}</v:{name}></w:pict>'

    def object(self, i: dict) -> str:
        number = int(i["text"])
        o, props = self.package.objects.get(number), dict(i["props"])
        if o is None:
            return ""
        rid = self.link("oleObject", self.package.embedding(number, o["content"]))
        preview, inner, size = self.package.pictures.get(int(props.get("preview", 0))), "", "width:72pt;height:72pt"
        if preview:
            size = f"width:{preview['width_twips'] / 20:g}pt;height:{preview['height_twips'] / 20:g}pt"
            inner = f'<v:imagedata r:id="{self.link("image", self.package.media(("picture", preview["id"]), preview["format"], preview["data"]))}"/>'
        name = f' ProgID="{props["prog_id"]}"' if "prog_id" in props else ""
        return f'<w:object><v:shape id="_x0000_o{number}" style="{size}">{inner}</v:shape><o:OLEObject Type="Embed"{name} ShapeID="_x0000_o{number}" DrawAspect="Content" ObjectID="_{number}" r:id="{rid}"/></w:object>'

    def paragraph(self, k: int) -> str:
        doc, pack = self.doc, self.package
        p = doc["paragraphs"][k]
        main = p["story"] == "main"
        out = "<w:p>" + pack.of_paragraph(p["props"], pack.section_ends.get(p["cp_end"], "") if main else "")
        kind = p["story"].partition(":")[0]
        if kind in ("footnote", "endnote", "comment") and p["ix"] == 0:  # the note's own number, which its reader shows
            out += f"<w:r><w:{'annotationRef' if kind == 'comment' else kind + 'Ref'}/></w:r>"
        for i in pack.inlines.get(k, []):
            out += pack.due(p["story"], i["cp"])
            props = pack.of_run(i["props"])
            kind, body = i["kind"], None
            if kind in ("footnote", "endnote"):
                own = dict(i["props"]).get("custom_mark")
                body = f'<w:{kind}Reference{' w:customMarkFollows="1"' if own else ""} w:id="{i["text"]}"/>' + (_text(own) if own else "")
            elif kind == "comment":
                body = f'<w:commentReference w:id="{int(i["text"]) - 1}"/>'
            elif kind == "picture":
                body = self.picture(int(i["text"]))
            elif kind == "shape":
                body = "".join(self.floating(s) for s in pack.shapes_at(p["story"], i["cp"]))
            elif kind == "object":
                body = self.object(i)
            elif kind == "symbol":
                font, _, code = i["text"].rpartition(":")
                body = f'<w:sym w:font={quoteattr(font)} w:char="{code}"/>'
            elif kind == "field_begin":
                state = "".join(f' w:{a}="1"' for key, a in (("locked", "fldLock"), ("dirty", "dirty")) if dict(i["props"]).get(key) == "true")
                out += f'<w:r>{props}<w:fldChar w:fldCharType="begin"{state}/></w:r><w:r>{props}<w:instrText xml:space="preserve"> {escape(i["text"])} </w:instrText></w:r>'
                continue
            elif kind in ("field_separator", "field_end"):
                body = f'<w:fldChar w:fldCharType="{"separate" if kind == "field_separator" else "end"}"/>'
            else:
                body = _INLINE.get(kind) or _text(i["text"])
                if kind == "break" and "break_clear" in dict(i["props"]):
                    body = f'<w:br w:type="textWrapping" w:clear="{dict(i["props"])["break_clear"]}"/>'
            if body:
                out += f"<w:r>{props}{body}</w:r>"
        return out + pack.due(p["story"], p["cp_end"] - 1) + "</w:p>"

    def blocks(self, label: str) -> str:
        """The paragraphs and tables of a story; cells that are merged into the one before are left out."""
        body, open_, skip, pack = [], [], None, self.package
        for n in self.package.by_story.get(label, []):
            path = tuple(n["path"])
            if skip is not None and path[: len(skip)] == skip:
                continue
            skip = None
            while open_ and open_[-1][0] >= len(path):
                body.append(open_.pop()[1])
            if n["kind"] == "paragraph":
                body.append(self.paragraph(n["paragraph"]))
                continue
            if n["kind"] == "table":
                t = pack.tables.get((label, path), {"columns": [], "props": {}})
                columns = "".join(f'<w:gridCol w:w="{b - a}"/>' for a, b in zip(t["columns"], t["columns"][1:]))
                body.append(f"<w:tbl>{table_props(dict(t['props'] or {}), pack.style_ids['table'])}<w:tblGrid>{columns}</w:tblGrid>")
                open_.append((len(path), "</w:tbl>"))
            elif n["kind"] == "row":
                row = pack.rows.get((label, path))
                body.append("<w:tr>" + (row_props(row) if row else ""))
                open_.append((len(path), "</w:tr>"))
            else:
                row = pack.rows.get((label, path[:-1]))
                cell = next((c for c in row["cells"] if c["ix"] == path[-1]), None) if row else {"width": None, "span": 1, "props": {}}
                if cell is None:
                    skip = path
                    continue
                body.append("<w:tc>" + cell_props(cell))
                open_.append((len(path), "</w:tc>"))
        return "".join([*body, *(e[1] for e in reversed(open_))])


def _ended(body: str) -> str:
    """A body that ends in a paragraph, as cells and stories must."""
    return body if body.endswith("</w:p>") else body + "<w:p/>"


class _Package:
    def __init__(self, doc: dict) -> None:
        self.doc = doc
        for name, key in (("pictures", "id"), ("images", "id"), ("bookmarks", "id"), ("comments", "id"), ("list_uses", "id")):
            ids = [x[key] for x in doc[name]]
            if len(set(ids)) != len(ids):
                raise ValueError(f"two {name} of one document share a number")
        self.style_ids = {kind: {str(s["id"]) for s in doc["styles"] if s["kind"] == kind} for kind in ("paragraph", "character", "table", "numbering")}
        self.run_texts: dict[tuple, str] = {}
        self.paragraph_texts: dict[tuple, str] = {}
        self.inlines: dict[int, list[dict]] = {}
        for i in doc["inlines"]:
            self.inlines.setdefault(i["paragraph"], []).append(i)
        self.by_story: dict[str, list[dict]] = {}
        for n in doc["nodes"]:
            self.by_story.setdefault(n["story"], []).append(n)
        self.rows = {(r["story"], tuple(r["path"])): r for r in doc["table_rows"]}
        self.tables = {(t["story"], tuple(t["path"])): t for t in doc["tables"]}
        self.pictures = {p["id"]: p for p in doc["pictures"]}
        self.images = {i["id"]: i for i in doc["images"]}
        self.objects = {o["object_id"]: o for o in doc["ole_objects"] if o["object_id"] is not None}
        starts = {s["story"]: s["cp_start"] for s in doc["stories"]}
        self.shapes: dict[int, list[dict]] = {}
        for s in doc["shapes"]:
            self.shapes.setdefault(starts.get(s["story"], 0) + s["anchor_cp"], []).append(s)
        self.files: dict[tuple, tuple[str, bytes]] = {}
        self.embedded: dict[int, tuple[str, bytes]] = {}
        self.section_ends: dict[int, str] = {}
        self.marks: dict[str, list[tuple[int, str]]] = {}
        named = {b["id"]: b for b in doc["bookmarks"]}
        for cp, what, n in boundaries([(b["id"], b["cp_start"], b["cp_end"]) for b in doc["bookmarks"] if b["story"] == "main"]):
            b = named[n]
            columns = f' w:colFirst="{b["column_first"]}" w:colLast="{b["column_last"]}"' if b["column_first"] is not None else ""
            self.marks.setdefault("main", []).append((cp, f'<w:bookmarkStart w:id="{n}" w:name={quoteattr(b["name"])}{columns}/>' if what == "start" else f'<w:bookmarkEnd w:id="{n}"/>'))
        said = boundaries([(c["id"], c["range_start"], c["range_end"]) for c in doc["comments"] if c["range_start"] is not None])
        self.marks["main"] = sorted([*self.marks.get("main", []), *((cp, f'<w:commentRange{what.title()} w:id="{n}"/>') for cp, what, n in said)], key=lambda m: m[0])[::-1]

    def of_run(self, props: dict | list) -> str:
        """The properties of runs, each kind written once."""
        key = tuple(props.items() if isinstance(props, dict) else props)
        if key not in self.run_texts:
            self.run_texts[key] = run_props(dict(key), self.style_ids["character"])
        return self.run_texts[key]

    def of_paragraph(self, props: dict | list, section: str) -> str:
        key = section, *(props.items() if isinstance(props, dict) else props)
        if key not in self.paragraph_texts:
            self.paragraph_texts[key] = paragraph_props(dict(key[1:]), self.style_ids["paragraph"], section)
        return self.paragraph_texts[key]

    def due(self, story: str, cp: int) -> str:
        todo, out = self.marks.get(story, []), ""
        while todo and todo[-1][0] <= cp:
            out += todo.pop()[1]
        return out

    def shapes_at(self, story: str, cp: int) -> list[dict]:
        return self.shapes.get(cp, [])

    def media(self, key: tuple, kind: str, data: bytes) -> str:
        if key not in self.files:
            self.files[key] = f"media/image{len(self.files) + 1}.{kind}", data
        return self.files[key][0]

    def embedding(self, number: int, data: bytes) -> str:
        return self.embedded.setdefault(number, (f"embeddings/oleObject{len(self.embedded) + 1}.bin", data))[0]


_SETTINGS = (("mirror_margins", "mirrorMargins"), ("gutter_at_top", "gutterAtTop"), ("track_changes", "trackRevisions"))


def settings_xml(p: dict[str, str]) -> str:
    """The settings of a document that differ from what a reader takes for granted."""
    on = lambda key, tag: f"<w:{tag}/>" if p.get(key) == "true" else ""
    out = "".join(on(*x) for x in _SETTINGS)
    if "protection" in p:
        out += f'<w:documentProtection w:edit="{p["protection"]}" w:enforcement="1"/>'
    out += _value("defaultTabStop", p.get("default_tab_twips")) + on("auto_hyphenation", "autoHyphenation") + _value("consecutiveHyphenLimit", p["consecutive_hyphens"] if p.get("consecutive_hyphens", "0") != "0" else None)
    out += _value("hyphenationZone", p["hyphenation_zone_twips"] if p.get("hyphenation_zone_twips", "0") != "0" else None) + on("no_caps_hyphenation", "doNotHyphenateCaps") + on("facing_pages", "evenAndOddHeaders")
    out += "<w:compat><w:adjustLineHeightInTable/></w:compat>" if p.get("adjust_line_height") == "true" else ""
    return f'<w:settings xmlns:w="{_W}">{out}</w:settings>' if out else ""


def package(doc: dict) -> bytes:
    """The file of one parsed document."""
    pack = _Package(doc)
    parts: dict[str, str | bytes] = {}
    kinds: dict[str, str] = {}
    main = _Story(doc, pack)
    tail: dict[str, str | bytes] = {}

    def add(name: str, kind: str, content: str, own: _Story | None = None, late: bool = False) -> str:
        where = tail if late else parts
        where[f"word/{name}.xml"] = content
        if own is not None and own.links:
            where[f"word/_rels/{name}.xml.rels"] = own.rels()
        kinds[f"word/{name}.xml"] = kind
        return main.link(kind, f"{name}.xml")

    # Headers and footers by section; a section without one of a kind goes on with the one before.
    count = {"header": 0, "footer": 0}
    references: dict[int, str] = {}
    for p in doc["section_stories"]:
        if p["section"] < 0:
            continue
        place, _, side = p["slot"].partition("_")
        count[side] += 1
        own = _Story(doc, pack)
        tag = {"header": "hdr", "footer": "ftr"}[side]
        rid = add(f"{side}{count[side]}", side, f"<w:{tag} {_SPACES}>{_ended(own.blocks(p['story'])) if p['story'] else '<w:p/>'}</w:{tag}>", own, late=True)
        references[p["section"]] = references.get(p["section"], "") + f'<w:{side}Reference w:type="{ {"odd": "default", "even": "even", "first": "first"}[place] }" r:id="{rid}"/>'
    ends = {s["cp_end"]: section_props(dict(s["props"]), references.get(s["ix"], "")) for s in doc["sections"]}
    last = ends.pop(doc["sections"][-1]["cp_end"], "") if doc["sections"] else ""
    pack.section_ends = ends
    body = main.blocks("main")
    parts["word/document.xml"] = f"<w:document {_SPACES}><w:body>{body}{pack.due('main', 1 << 31)}{last}</w:body></w:document>"
    kinds["word/document.xml"] = "document.main"

    every = set().union(*pack.style_ids.values())
    if any(s["kind"] != "numbering" for s in doc["styles"]):
        conditions: dict[int, str] = {}
        for c in doc["table_conditions"]:
            made = paragraph_props(dict(c["pap"]), set()) + run_props(dict(c["chp"]), set())
            conditions[c["style"]] = conditions.get(c["style"], "") + f'<w:tblStylePr w:type="{c["condition"]}">{made}</w:tblStylePr>'
        made = "".join(
            f'<w:style w:type="{s["kind"]}" w:styleId="S{s["id"]}"><w:name w:val={quoteattr(s["name"])}/>{_value("basedOn", f"S{s['based_on']}" if str(s["based_on"]) in every else None)}{_value("next", f"S{s['next_style']}" if s["kind"] == "paragraph" and str(s["next_style"]) in pack.style_ids["paragraph"] else None)}'
            f'{paragraph_props({k: v for k, v in dict(s["pap"]).items() if k != "style_id"}, set()) if s["kind"] in ("paragraph", "table") else ""}{run_props({k: v for k, v in dict(s["chp"]).items() if k != "style_id"}, set())}{conditions.get(s["id"], "")}</w:style>'
            for s in doc["styles"]
        )
        add("styles", "styles", f'<w:styles xmlns:w="{_W}">{made}</w:styles>')
    if doc["fonts"]:
        add("fontTable", "fontTable", f'<w:fonts xmlns:w="{_W}">{"".join(f"<w:font w:name={quoteattr(f['name'])}/>" for f in doc["fonts"])}</w:fonts>')
    if made := settings_xml(dict(doc["settings"])):
        add("settings", "settings", made)
    for kind in ("footnote", "endnote"):
        if own := [n for n in doc["notes"] if n["kind"] == kind]:
            story = _Story(doc, pack)
            marks = "".join(f'<w:{kind} w:type="{p["slot"].removeprefix(kind + "_").replace("continuation_separator", "continuationSeparator").replace("continuation_notice", "continuationNotice")}" w:id="{k - 3}">{_ended(story.blocks(p["story"]))}</w:{kind}>' for k, p in enumerate(p for p in doc["section_stories"] if p["section"] < 0 and p["slot"].startswith(kind)))
            made = marks + "".join(f'<w:{kind} w:id="{n["id"]}">{_ended(story.blocks(f"{kind}:{n['id']}"))}</w:{kind}>' for n in own)
            add(f"{kind}s", f"{kind}s", f"<w:{kind}s {_SPACES}>{made}</w:{kind}s>", story)
    if doc["comments"]:
        story = _Story(doc, pack)
        made = "".join(f'<w:comment w:id="{c["id"]}" w:author={quoteattr(c["author"])} w:initials={quoteattr(c["initials"])}>{_ended(story.blocks(f"comment:{c['id']}"))}</w:comment>' for c in doc["comments"])
        add("comments", "comments", f"<w:comments {_SPACES}>{made}</w:comments>", story)
    if doc["lists"]:
        add("numbering", "numbering", _numbering(doc))
    for _, (name, data) in pack.files.items():
        parts[f"word/{name}"] = data
    for name, data in pack.embedded.values():
        parts[f"word/{name}"] = data
    parts |= tail
    if main.links:
        parts["word/_rels/document.xml.rels"] = main.rels()
    root = f'<Relationship Id="rId1" Type="{_R}/officeDocument" Target="word/document.xml"/>'
    core = dict(doc["core_properties"])
    types = "".join(f'<Override PartName="/{p}" ContentType="{_MAIN}.{k}+xml"/>' for p, k in kinds.items())
    if core:
        names = {"title": "dc:title", "subject": "dc:subject", "author": "dc:creator", "keywords": "cp:keywords", "comments": "dc:description", "last_author": "cp:lastModifiedBy", "revision": "cp:revision"}
        said = "".join(f"<{names[k]}>{escape(v)}</{names[k]}>" for k, v in core.items() if k in names)
        said += "".join(f'<dcterms:{k} xsi:type="dcterms:W3CDTF">{core[k]}</dcterms:{k}>' for k in ("created", "modified") if k in core)
        parts["docProps/core.xml"] = f'<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">{said}</cp:coreProperties>'
        root += f'<Relationship Id="rId2" Type="{_RELS}/metadata/core-properties" Target="docProps/core.xml"/>'
        types += '<Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/>'
    plain = "".join(f'<Default Extension="{e}" ContentType="{_MEDIA[e]}"/>' for e in sorted({n.rpartition(".")[2] for n, _ in pack.files.values()})) + ('<Default Extension="bin" ContentType="application/vnd.openxmlformats-officedocument.oleObject"/>' if pack.embedded else "")
    first = {
        "[Content_Types].xml": f'<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{plain}{types}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_RELS}">{root}</Relationships>',
    }
    order = [*first, *(p for p in ("docProps/core.xml", "word/document.xml", "word/_rels/document.xml.rels") if p in parts)]
    whole = first | parts
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in [*order, *(p for p in whole if p not in order)]:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.external_attr, info.compress_type = 0o644 << 16, zipfile.ZIP_DEFLATED
            content = whole[name]
            z.writestr(info, content if isinstance(content, bytes) else _HEAD + content)
    return out.getvalue()


def _numbering(doc: dict) -> str:
    levels: dict[int, str] = {}
    heads: dict[int, str] = {}
    for lv in doc["lists"]:
        made = f'<w:lvl w:ilvl="{lv["level"]}"><w:start w:val="{lv["start"]}"/><w:numFmt w:val="{NUMBER_FORMATS.get(lv["format"], "decimal")}"/>' + (f'<w:lvlRestart w:val="{lv["restart_after"]}"/>' if lv["restart_after"] is not None else "") + ("<w:isLgl/>" if lv["legal"] else "")
        made += f'<w:suff w:val="{lv["suffix"]}"/><w:lvlText w:val={quoteattr(lv["text"])}/><w:lvlJc w:val="{lv["align"]}"/>{paragraph_props(dict(lv["pap"]), set())}{run_props(dict(lv["chp"]), set())}</w:lvl>'
        levels[lv["list_id"]] = levels.get(lv["list_id"], "") + made
        heads[lv["list_id"]] = _value("multiLevelType", lv["kind"]) + _value("name", lv["name"])
    number = {x: k for k, x in enumerate(levels)}
    made = "".join(f'<w:abstractNum w:abstractNumId="{number[x]}">{heads[x]}{lv}</w:abstractNum>' for x, lv in levels.items())
    for u in doc["list_uses"]:
        changes = "".join(
            f'<w:lvlOverride w:ilvl="{o["level"]}">' + (f'<w:startOverride w:val="{o["start"]}"/>' if o["format"] is None and o["start"] is not None else "")
            + (f'<w:lvl w:ilvl="{o["level"]}"><w:start w:val="{o["start"]}"/><w:numFmt w:val="{NUMBER_FORMATS.get(o["format"], "decimal")}"/><w:lvlText w:val={quoteattr(o["text"])}/></w:lvl>' if o["format"] is not None else "") + "</w:lvlOverride>"
            for o in u["overrides"] or []
        )
        made += f'<w:num w:numId="{u["id"]}"><w:abstractNumId w:val="{number[u["list_id"]]}"/>{changes}</w:num>'
    return f'<w:numbering xmlns:w="{_W}">{made}</w:numbering>'


def fault(data: bytes) -> str | None:
    """Why a package is not one; none if it is."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            for need in REQUIRED:
                if need not in names:
                    return f"{need} is missing"
            if bad := z.testzip():
                return f"{bad} is damaged"
            for n in names:
                if n.endswith((".xml", ".rels")):
                    ElementTree.fromstring(z.read(n))
    except (zipfile.BadZipFile, ElementTree.ParseError) as e:
        return str(e)
    return None


def tag(name: str) -> str:
    """The name of an element or attribute of a text's parts."""
    return f"{{{_W}}}{name}"


def names(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return z.namelist()


def raw(data: bytes, name: str) -> bytes:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return z.read(name)


def tree(data: bytes, name: str) -> ElementTree.Element:
    """A part of a package as its root element."""
    return ElementTree.fromstring(raw(data, name))


def text_of(data: bytes) -> list[str]:
    """The paragraphs of a package's main part, in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return ["".join(t.text or "" for t in p.iter(f"{{{_W}}}t")) for p in root.iter(f"{{{_W}}}p")]


_NEEDED = tuple(
    "stories paragraphs inlines nodes tables table_rows bookmarks notes comments sections section_stories styles table_conditions fonts lists list_uses shapes pictures images ole_objects settings core_properties".split()
)


def packages(parsed: DataFrame, key: str = "path") -> DataFrame:
    """``key, docx, fault`` of every document that was read; ``fault`` is null for a sound package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                some = batch.slice(i, 32)
                made = [package(d) for d in some.to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(made, pa.binary()), pa.array([fault(m) for m in made], pa.string())], [key, "docx", "fault"])

    kind = dict(parsed.dtypes)[key]
    return parsed.filter("status = 'ok'").select(key, *_NEEDED).mapInArrow(run, f"`{key}` {kind}, docx binary, fault string")


def converted(docs: DataFrame, key: str = "path", content: str = "content", relations: tuple[str, ...] = (), checked: bool = False) -> DataFrame:
    """``key``, the named relations, ``docx`` and, if ``checked``, ``fault`` of every document that can be read: parsed and
    packaged in one step, so that models are neither written nor sent on, but for what is named."""
    kept = [f for f in parse.MODEL if f.name in relations]
    schema = pa.schema([*kept, pa.field("docx", pa.binary()), *[pa.field("fault", pa.string())] * checked])
    wanted = frozenset((*_NEEDED, *relations))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies = batch.column(0), batch.column(1)
            for i in range(0, batch.num_rows, 32):
                some = [parse.tried(b.as_py(), None, wanted) for b in bodies[i : i + 32]]
                read = pa.array([d["status"] == "ok" for d in some], pa.bool_())
                some = [d for d in some if d["status"] == "ok"]
                for d in some:
                    d["docx"] = package(d)
                    if checked:
                        d["fault"] = fault(d["docx"])
                yield pa.RecordBatch.from_arrays([keys[i : i + 32].filter(read), *(pa.array([d.get(f.name) for d in some], f.type) for f in schema)], [key, *schema.names])

    return docs.select(key, content).mapInArrow(run, StructType([docs.select(key).schema[0], *from_arrow_schema(schema).fields]))


def write_files(made: DataFrame, folder: str, key: str = "path") -> DataFrame:
    """Writes sound packages as files named after their key, by the tasks that hold them; ``key, target, error``. A file
    appears whole or not at all, and a second attempt replaces it by the same bytes. Keys that lead to one target are an
    error for all but the first, and no target may be a source."""
    from pyspark.sql import Window

    name = F.regexp_replace(F.element_at(F.split(F.col(key).cast("string"), "/"), -1), r"(?i)\.doc$", "")
    nth = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(F.col(key)))
    named = made.withColumn("target", F.concat(F.lit(folder.rstrip("/") + "/"), name, F.lit(".docx"))).withColumn("error", F.when(F.col("fault").isNotNull(), F.col("fault")).when(nth > 1, "another document has this target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        from pyarrow import fs

        for batch in batches:
            for target, data, error in zip(*(batch.column(c).to_pylist() for c in ("target", "docx", "error"))):
                if error is None:
                    store, path = fs.FileSystem.from_uri(target if "://" in target else f"file://{os.path.abspath(target)}")
                    store.create_dir(os.path.dirname(path), recursive=True)
                    part = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
                    with store.open_output_stream(part) as f:
                        f.write(data)
                    store.move(part, path)
            yield batch.select([key, "target", "error"])

    return named.select(key, "target", "error", "docx").mapInArrow(run, f"`{key}` {dict(made.dtypes)[key]}, target string, error string")
