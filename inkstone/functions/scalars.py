"""Scalar functions of the document model as column expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that XML 1.0 cannot hold.
NOT_XML = r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"


def utf16_width(text: Column) -> Column:
    """Length in UTF-16 code units, as character positions count."""
    return F.length(F.encode(text, "UTF-16LE")) / 2


def xml_clean(text: Column, mark: str = "�") -> Column:
    return F.regexp_replace(text, NOT_XML, mark)


def colorref(c: Column) -> Column:
    """0x00BBGGRR to RRGGBB; ``auto`` for 0xFF000000."""
    byte = lambda k: F.shiftright(c, k).bitwiseAND(255).cast("int")
    return F.when(c == 0xFF000000, "auto").otherwise(F.format_string("%02X%02X%02X", byte(0), byte(8), byte(16)))


def filetime(ticks: Column) -> Column:
    """100-nanosecond ticks since 1601 to ISO 8601 seconds; null for 0."""
    seconds = F.floor(ticks / F.lit(10_000_000)).cast("bigint") - 11_644_473_600
    return F.when(ticks != 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def xor_verifier(bytes_: Column) -> Column:
    """The 15-bit rotating checksum of a password given as an array of ints, first byte first."""
    turned = lambda h: F.shiftright(h, 14).bitwiseAND(1).bitwiseOR(F.shiftleft(h, 1).bitwiseAND(0x7FFF))
    folded = F.aggregate(F.reverse(bytes_), F.lit(0), lambda h, b: turned(h).bitwiseXOR(b))
    return turned(folded).bitwiseXOR(F.size(bytes_)).bitwiseXOR(0xCE4B)


def hyperlink_safe(url: Column) -> Column:
    """http, https with a host, or mailto, without space or control characters."""
    clean = ~url.rlike(r"[\s\x00-\x20\x7f]")
    return F.coalesce(clean & url.rlike(r"^(?i)(?:https?://[^/?#]+|mailto:.)"), F.lit(False))


def field_type(instruction: Column) -> Column:
    """The first token in capitals; ``=`` for a formula."""
    head = F.upper(F.regexp_extract(instruction, r"^\s*(\S+)", 1))
    return F.when(head.startswith("="), "=").otherwise(head)


def field_argument(instruction: Column) -> Column:
    """The first argument that is not a switch, quoted or not."""
    return F.coalesce(
        F.nullif(F.regexp_replace(F.regexp_extract(instruction, r'^\s*\S+\s+(?:\\\S+\s+)*"((?:[^"\\]|\\.)*)"', 1), r"\\(.)", "$1"), F.lit("")),
        F.nullif(F.regexp_extract(instruction, r'^\s*\S+\s+(?:\\\S+\s+)*([^\s"\\]+)', 1), F.lit("")),
    )


def toggle(operand: Column, style: Column) -> Column:
    """0 and 1 are absolute, 0x80 takes the style's value, 0x81 its opposite; else not known."""
    below = F.coalesce(style, F.lit(False))
    return F.when(operand == 0, False).when(operand == 1, True).when(operand == 0x80, below).when(operand == 0x81, ~below)


def line_spacing(value: Column, multiple: Column) -> Column:
    """The rule of a line spacing: multiples are automatic, negative ones exact."""
    return F.when(multiple, "auto").when(value < 0, "exact").when(value > 0, "atLeast").otherwise("auto")


def list_index(i: Column) -> Column:
    """A paragraph's list: 0 and -2047 suppress it, negative ones count from the other end."""
    return F.when((i == 0) | (i == -2047), None).otherwise(F.abs(i))


def scaled(goal: Column, per_mille: Column) -> Column:
    """A picture's size under a scale; null outside what a page can hold."""
    size = F.floor((goal * per_mille + 500) / 1000).cast("bigint")
    return F.when(size.between(15, 31680), size)


def affine(v: Column, frame: tuple[Column, Column], rect: tuple[Column, Column]) -> Column:
    """A coordinate inside a group's frame, mapped to the group's place on the page; halves go to the even neighbour. Null for
    a frame without extent."""
    extent = frame[1] - frame[0]
    return F.when(extent != 0, F.bround(rect[0] + (v - frame[0]) * (rect[1] - rect[0]) / extent)).cast("bigint")


def twips_to_points(t: Column) -> Column:
    return t / F.lit(20.0)


def emu_to_points(e: Column) -> Column:
    return e / F.lit(12700.0)


def twips_to_emu(t: Column) -> Column:
    return t.cast("bigint") * 635


def sprm_group(opcode: Column) -> Column:
    return F.shiftright(opcode, 10).bitwiseAND(7)


def sprm_size(opcode: Column) -> Column:
    """Bytes of a modifier's operand, -1 where it names its own."""
    kind = F.shiftright(opcode, 13)
    return F.element_at(F.array(*[F.lit(n) for n in (1, 1, 2, 4, 2, 2, -1, 3)]), kind.cast("int") + 1)


def ole_prog_id(s: Column) -> Column:
    return s.rlike(r"^[A-Za-z.][A-Za-z0-9.]{0,38}$")


def opacity(fixed: Column) -> Column:
    """16.16 fixed point to a percentage."""
    return F.concat(F.regexp_replace(F.format_string("%.2f", fixed * 100 / 65536.0), r"\.?0+$", ""), F.lit("%"))


def list_label(template: Column, numbers: list[Column]) -> Column:
    """The label of a list item: ``%1`` is the number of the first level, and so on."""
    for k, n in enumerate(numbers, 1):
        template = F.replace(template, F.lit(f"%{k}"), n.cast("string"))
    return template


def merged_list(own: Column, defaults: list[int]) -> Column:
    """A sparse list over its defaults: what is missing or null takes the default of its place."""
    whole = F.array(*[F.lit(d) for d in defaults])
    return F.transform(whole, lambda d, i: F.coalesce(F.get(own, i), d))


def in_square(points: Column, size: int = 21600) -> Column:
    """Points (x, y) of a polygon moved and scaled into a square; halves go to the even neighbour."""

    def axis(name: str) -> tuple[Column, Column]:
        values = F.transform(points, lambda p: p[name])
        low = F.array_min(values)
        return low, F.greatest(F.lit(1), F.array_max(values) - low)

    (x0, w), (y0, h) = axis("x"), axis("y")
    to = lambda v, low, extent: F.bround((v - low) * size / extent).cast("int")
    return F.transform(points, lambda p: F.struct(to(p["x"], x0, w).alias("x"), to(p["y"], y0, h).alias("y")))


def present(*columns: Column) -> Column:
    """How many of some properties are set."""
    total = F.lit(0)
    for c in columns:
        total = total + c.isNotNull().cast("int")
    return total


def font_name(name: Column, alternate: Column) -> Column:
    """The first name that a document can hold; else none."""
    fits = lambda c: F.when(~c.rlike(NOT_XML) & (F.length(c) > 0), c)
    return F.coalesce(fits(name), fits(alternate))


#: Languages of places whose pages have their headers 708 twips from the edge.
NARROW_HEADERS = tuple(map(int, "1026 1027 1029 1030 1035 1038 1039 1043 1044 1045 1048 1051 1055 1058 1059 1060 1061 1067 1068 1069 1078 1079 1087 1088 1089 1092 2074".split()))


def header_distance(lid: Column) -> Column:
    """The distance of headers and footers from the edge, in twips, where a section gives none."""
    return F.when(lid == 1063, 567).when(lid.isin(*NARROW_HEADERS), 708).otherwise(720)


def noteref(instruction: Column) -> Column:
    """FTNREF fields under the name that they have now."""
    return F.regexp_replace(instruction, r"^(\s*)(?i:FTNREF)(?=\s|$)", "$1NOTEREF")


def place(raw: Column, names: dict[int, str]) -> Column:
    """A frame's place: an alignment for some values, else twips, which are stored one up, after ``@``."""
    out = F.concat(F.lit("@"), (F.when(raw > 32767, raw - 65536).otherwise(raw) - 1).cast("string"))
    for value, name in names.items():
        out = F.when(raw == value, name).otherwise(out)
    return out
