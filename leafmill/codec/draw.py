"""Pages from drawing operations."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from functools import lru_cache

from .fonts import text_width
from .scan import Name, Ref
from .writer import HEAD, STAMP, about, literal, name_bytes, value_bytes

DECIMALS = 4  # of a number in a content stream; places read back are compared to three


def operand(x) -> bytes:
    """A number in its shortest form, a name, or a text."""
    if isinstance(x, Name):
        return name_bytes(x)
    if isinstance(x, str):
        return b"(" + literal(x) + b")"
    return shortest(x)


@lru_cache(maxsize=1 << 14)
def shortest(x: float) -> bytes:
    out = f"{x:.{DECIMALS}f}".rstrip("0").rstrip(".")
    return b"0" if out in ("", "-0") else out.encode()


class Pen:
    """A content stream in the making.

    Texts in a row share one text object, each at a place of its own by an absolute matrix; a font is set where a text
    needs another one than the stream has. ``fonts`` has the resource of every font that was used.
    """

    def __init__(self, resource: Callable[[str], str] | None = None):
        self.lines: list[bytes] = []
        self.fonts: dict[str, str] = {}
        self.resource = resource or (lambda _: f"F{len(self.fonts) + 1}")
        self.in_text, self.chosen = False, None

    def put(self, operator: str, *operands) -> None:
        self.lines.append(b" ".join([*map(operand, operands), operator.encode()]))

    def do(self, operator: str, *operands) -> None:
        """An operator that may not stand in a text object."""
        self.leave_text()
        self.put(operator, *operands)

    def leave_text(self) -> None:
        if self.in_text:
            self.put("ET")
            self.in_text = False

    def text(self, x: float, y: float, text: str, font: str, size: float) -> None:
        if font not in self.fonts:
            self.fonts[font] = self.resource(font)
        if not self.in_text:
            self.put("BT")
            self.in_text = True
        if self.chosen != (font, size):
            self.put("Tf", Name(self.fonts[font]), size)
            self.chosen = (font, size)
        self.lines.append(b"1 0 0 1 %b %b Tm\n(%b) Tj" % (shortest(x), shortest(y), literal(text)))

    def box(self, x: float, y: float, width: float, height: float, rgb=None) -> None:
        """An outline, or a filled box whose colour ends with it."""
        if rgb is None:
            self.do("re", x, y, width, height)
            self.do("S")
            return
        with Kept(self):
            self.do("rg", *rgb)
            self.do("re", x, y, width, height)
            self.do("f")

    def line(self, x1: float, y1: float, x2: float, y2: float, width: float) -> None:
        self.do("w", width)
        self.do("m", x1, y1)
        self.do("l", x2, y2)
        self.do("S")

    def content(self) -> bytes:
        self.leave_text()
        return b"\n".join(self.lines) + b"\n" if self.lines else b""


class Kept:
    """What is set inside ends with the block."""

    def __init__(self, pen: Pen):
        self.pen = pen

    def __enter__(self) -> None:
        self.pen.do("q")
        self.chosen = self.pen.chosen

    def __exit__(self, *_) -> None:
        self.pen.do("Q")
        self.pen.chosen = self.chosen


def page_content(ops: list[tuple[str, list[float], str | None]]) -> tuple[bytes, dict[str, str]]:
    """The content stream of operations (op, numbers, text), and the base font of each font resource. Operations:
    font(size; name), text(x, y; text), color, stroke, line(x1, y1, x2, y2, width), rect, fill(x, y, w, h, r, g, b)."""
    pen, font, size = Pen(), "Helvetica", 12.0
    for op, v, text in ops:
        match op:
            case "font":
                font, size = text or "Helvetica", v[0]
            case "text":
                pen.text(v[0], v[1], text or "", font, size)
            case "color":
                pen.do("rg", *v[:3])
            case "stroke":
                pen.do("RG", *v[:3])
            case "line":
                pen.line(*v[:5])
            case "rect":
                pen.box(*v[:4])
            case "fill":
                pen.box(*v[:4], rgb=v[4:7])
            case _:
                raise ValueError(f"no drawing operation: {op}")
    return pen.content(), {resource: base for base, resource in pen.fonts.items()}


def font_entry(base: str) -> dict:
    return {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(base), "Encoding": Name("WinAnsiEncoding")}


@lru_cache(maxsize=1 << 12)
def _page_object(num: int, width: float, height: float, body: int, fonts: tuple[tuple[str, int], ...]) -> bytes:
    resources = {"Font": {k: Ref(n, 0) for k, n in fonts}} if fonts else {}
    page = {"Type": Name("Page"), "Parent": Ref(1, 0), "MediaBox": [0, 0, width, height], "Contents": Ref(body, 0), "Resources": resources}
    return b"%d 0 obj\n%b\nendobj\n" % (num, value_bytes(page))


@lru_cache(maxsize=1 << 12)
def _font_object(num: int, base: str) -> bytes:
    return b"%d 0 obj\n%b\nendobj\n" % (num, value_bytes(font_entry(base)))


@lru_cache(maxsize=1 << 12)
def _end_objects(pages: tuple[int, ...], root: int, stamp: str) -> tuple[bytes, bytes, bytes]:
    """The tree of pages, the catalog and the description."""
    tree = {"Type": Name("Pages"), "Kids": [Ref(n, 0) for n in pages], "Count": len(pages)}
    values = (1, tree), (root, {"Type": Name("Catalog"), "Pages": Ref(1, 0)}), (root + 1, about(stamp))
    return tuple(b"%d 0 obj\n%b\nendobj\n" % (num, value_bytes(x)) for num, x in values)


def document(pages: list[tuple[float, float, bytes, dict[str, str]]], stamp: str = STAMP) -> bytes:
    """A document of pages (width, height, content, base font of each font resource), as Writer writes it: objects that
    many documents have alike are made once."""
    if not pages:
        raise ValueError("no pages")
    out, at, places, refs, known = [HEAD], len(HEAD), [0, 0], [], {}

    def put(*parts: bytes) -> None:
        nonlocal at
        out.extend(parts)
        places.append(at)
        at += sum(map(len, parts))

    for width, height, content, fonts in pages:
        body, raw = len(places), zlib.compress(content, 9)
        put(b"%d 0 obj\n<</Filter /FlateDecode /Length %d >>\nstream\n" % (body, len(raw)), raw, b"\nendstream\nendobj\n")
        for base in fonts.values():
            if base not in known:
                known[base] = len(places)
                put(_font_object(len(places), base))
        refs.append(len(places))
        put(_page_object(len(places), float(width), float(height), body, tuple((k, known[base]) for k, base in fonts.items())))
    root = len(places)
    tree, *rest = _end_objects(tuple(refs), root, stamp)
    places[1] = at
    out.append(tree)
    at += len(tree)
    for x in rest:
        put(x)
    out.append(b"xref\n0 %d\n0000000000 65535 f\r\n" % len(places))
    out.append(b"%010d 00000 n\r\n" * (len(places) - 1) % tuple(places[1:]))
    data = b"".join(out)
    own = hashlib.md5(data).hexdigest().encode()
    return b"%btrailer\n<</ID [<%b> <%b>] /Info %d 0 R /Root %d 0 R /Size %d >>\nstartxref\n%d\n%%%%EOF\n" % (data, own, own, root + 1, root, len(places), at)


def create(pages: list[tuple[float, float, list]], stamp: str = STAMP) -> bytes:
    """A document of pages (width, height, operations)."""
    return document([(width, height, *page_content(ops)) for width, height, ops in pages], stamp)


def width_of(text: str, font: str, size: float) -> float:
    """The width of text as drawn; characters without a width of their own count 500."""
    return text_width(text, size, font, 500.0)
