"""Text predicates and joins."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..codec.fonts import WIDTHS, known_glyphs, standard_widths
from ..options import HEADER_BYTES

EDGES = r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$"


def trim(c: Column) -> Column:
    """Without any Unicode white space at either end."""
    return F.regexp_replace(c, EDGES, "")


def is_all_numeric(c: Column) -> Column:
    """Digits, points, commas, hyphens and spaces only; true of an empty text."""
    return ~c.rlike(r"[^0-9.,\- ]")


def is_header_text(c: Column) -> Column:
    """1 to 30 bytes, and not numeric."""
    return F.octet_length(c).between(1, HEADER_BYTES) & ~is_all_numeric(c)


def is_number(c: Column) -> Column:
    """Digits and points, at least one."""
    return trim(c).rlike(r"^[0-9.]+\z")


def is_note(c: Column) -> Column:
    return F.upper(trim(c)).startswith("NOTE")


def smart_append(a: Column, b: Column) -> Column:
    """a and b with a space between, unless a is empty or ends in a hyphen or a slash."""
    return F.when(a == "", b).when(a.endswith("-") | a.endswith("/"), F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))


def append(a: Column, b: Column) -> Column:
    return F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, F.lit(" "), b))


def after_label(c: Column, label: str) -> Column:
    """The trimmed text after a label; empty where the label is not there."""
    at = F.instr(c, label)
    return F.when(at > 0, trim(F.substr(c, at + len(label)))).otherwise("")


def between_labels(c: Column, label: str, *stops: str) -> Column:
    """The text after a label up to each stop that stands after its first character, trimmed."""
    at = F.instr(c, label)
    out = F.substr(c, at + len(label))
    for stop in stops:
        end = F.instr(out, stop)
        out = F.when(end > 1, F.substr(out, F.lit(1), end - 1)).otherwise(out)
    return F.when(at > 0, trim(out)).otherwise("")


def escape_pdf(c: Column) -> Column:
    """A text for a PDF literal string."""
    return F.regexp_replace(c, r"([()\\])", r"\\$1")


def glyph_to_text(c: Column) -> Column:
    """A glyph name's text: one of the names that follow a rule, uniXXXX, or the name itself. For a whole glyph list
    join with sources.glyphs.read_glyph_list."""
    names = F.from_json(F.lit(json.dumps(known_glyphs())), "map<string,string>")
    uni = F.decode(F.unhex(F.substr(c, F.lit(4), F.lit(4))), "UTF-16BE")
    return F.when(F.length(c) == 1, c).otherwise(F.coalesce(F.try_element_at(names, c), F.when(c.rlike("^uni[0-9A-Fa-f]{4}$"), uni), c))


def text_width(c: Column, size: Column | float, font: str = "Helvetica", missing: float = 556.0) -> Column:
    """Width of a text in points by a standard font's table; of another font, half the size a byte."""
    size = size if isinstance(size, Column) else F.lit(float(size))
    table = standard_widths(font)
    if table is None:
        return F.octet_length(c) * size * 0.5
    if table is WIDTHS["Courier"]:
        return F.length(c) * 600.0 / 1000 * size
    widths = F.split(F.lit(",".join(str(table.get(i, missing)) for i in range(256))), ",").cast("array<double>")
    code = lambda ch: F.conv(F.hex(F.encode(ch, "UTF-16BE")), 16, 10).cast("long")
    each = F.transform(F.filter(F.split(c, ""), lambda ch: ch != ""), lambda ch: F.when(F.octet_length(ch) == 1, F.get(widths, F.ascii(ch))).otherwise(F.coalesce(F.get(widths, F.least(code(ch), F.lit(100000)).cast("int")), F.lit(missing))))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / 1000 * size
