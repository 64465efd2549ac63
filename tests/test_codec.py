"""PDF bytes: damaged files, filters, fonts, drawing, merging and editing."""

import zlib

import numpy as np
import pytest

from leafmill.codec import compose, draw, filters, fonts, images, interpret, jpeg
from leafmill.codec.reader import Reader
from leafmill.codec.scan import END, Scanner
from leafmill.codec.writer import Writer, value_bytes


def document(*pages, size=(612, 792)):
    return draw.create([(*size, [("text", [72, 750 - 16 * k], t) for k, t in enumerate([p] if isinstance(p, str) else p)]) for p in pages])


def texts(data):
    r = Reader(data)
    return [[s.text for s in interpret.page_spans(r, p)] for p in r.pages()]


def run(content, resources=None):
    r = Reader(document("x"))
    return interpret.Interpreter(r, resources or {"Font": {"F1": draw.font_entry("Helvetica")}}).run(content)


def test_round_trip():
    assert texts(document(["Hello (World)", "back\\slash é €"], "Second")) == [["Hello (World)", "back\\slash é €"], ["Second"]]


def test_trailing_garbage_and_rebuild():
    good = document("text")
    assert texts(good + bytes(60 << 10)) == [["text"]]
    at = good.rindex(b"startxref")
    assert texts(good[:at] + b"startxref\n7\n%%EOF") == [["text"]]


@pytest.mark.parametrize("data", [b"", b"not a pdf", b"%PDF-1.4\nstartxref\n0\n%%EOF"])
def test_no_pdf(data):
    with pytest.raises(ValueError):
        Reader(data)


def test_inflate():
    engine = zlib.compressobj()
    part = engine.compress(b"xref-entry" * 64) + engine.flush(zlib.Z_SYNC_FLUSH)
    assert filters.inflate(part) == b"xref-entry" * 64
    with pytest.raises(ValueError):
        filters.inflate(part[:2])


def test_small_filters():
    assert filters.apply("ASCIIHexDecode", b"48 65 6C6C6F>", {}) == b"Hello" and filters.apply("AHx", b"4>", {}) == b"\x40"
    assert filters.apply("ASCII85Decode", b"<~87cURD]i,\"Ebo80~>", {}) == b"Hello World!"
    assert filters.apply("Unknown", b"as it is", {}) == b"as it is"


@pytest.mark.parametrize("case", [((1, 2, 3), 1), ((0, 5, 0), 5), ((5, 0, 5), 0), ((10, 10, 10), 10)])
def test_paeth(case):
    assert filters.paeth(*case[0]) == case[1]


@pytest.mark.parametrize("kind", range(5))
def test_png_rows(kind):
    rng = np.random.default_rng(kind)
    x = rng.integers(0, 256, (6, 12)).astype(int)
    out = bytearray()
    for y in range(6):
        up = x[y - 1] if y else np.zeros(12, int)
        left, corner = np.append([0, 0, 0], x[y, :-3]), np.append([0, 0, 0], up[:-3])
        guess = [np.zeros(12, int), left, up, (left + up) // 2, np.array([filters.paeth(*v) for v in zip(left, up, corner, strict=True)])][kind]
        out += bytes([kind]) + ((x[y] - guess) % 256).astype(np.uint8).tobytes()
    assert filters.unpredict(bytes(out), {"Predictor": 15, "Columns": 4, "Colors": 3}) == x.astype(np.uint8).tobytes()


def test_unicode_ranges():
    found = fonts.to_unicode(b"2 beginbfrange <FFFD> <FFFF> [<0041> <0042> <0043>] <0010> <0012> <0058> endbfrange 1 beginbfchar <01> <D83DDE00> endbfchar")
    assert [found[k] for k in (0xFFFD, 0xFFFE, 0xFFFF, 0x10, 0x12, 1)] == ["A", "B", "C", "X", "Z", "😀"]


def test_fonts():
    assert fonts.standard_widths("ABCDEF+Arial-BoldMT") is fonts.WIDTHS["Helvetica-Bold"] and fonts.standard_widths("TimesNewRomanPSMT") is fonts.WIDTHS["Times"]
    assert fonts.standard_widths("CourierNewPS-BoldItalicMT") is fonts.WIDTHS["Courier"] and fonts.standard_widths("Nobody") is None
    assert [fonts.glyph_text(n) for n in ("space", "uni0041", "X", "eacute", "alpha", "Omega", "five", "unknownglyph")] == [" ", "A", "X", "é", "α", "Ω", "5", "unknownglyph"]
    assert fonts.text_width("AB", 10) == pytest.approx(13.34) and draw.width_of("é", "Helvetica-Bold", 10) == 5.0 and draw.width_of("ab", "Nobody", 10) == 10.0


@pytest.mark.parametrize("bad", [b")", b"{", b"}", b">>", b"]", b"<<", b"[", b"(", b"BI ID", b"/#", b"q " * 5000, b"[" * 5000])
def test_stray_bytes_end(bad):
    assert [s.text for s in run(b"BT /F1 12 Tf (a) Tj ET " + bad)] == ["a"]


def test_operators():
    got = run(b"BT /F1 10 Tf 12 TL 100 700 Td (A) Tj T* (B) Tj (C) ' 1 2 (D) \" [(E) -1000 (F)] TJ 50 Tz 0 -20 TD (G) Tj ET q 2 0 0 2 5 5 cm BT 1 0 0 1 10 10 Tm (H) Tj ET Q BI /W 1 ID xx EI BT /F1 10 Tf (I) Tj ET")
    at = {s.text: (round(s.x, 2), round(s.y, 2)) for s in got}
    assert at["A"] == (100, 700) and at["B"] == (100, 688) and at["C"] == (100, 676) and at["D"] == (100, 664) and at["G"] == (100, 644)
    assert at["F"][0] - at["E"][0] == pytest.approx(6.67 + 2 + 10, abs=0.01) and at["H"] == (25, 25) and at["I"] == (0, 0)


def test_actual_text():
    got = run(b"BT /F1 10 Tf 10 10 Td /Span <</ActualText <FEFF00660069>>> BDC (x) Tj EMC (y) Tj ET")
    assert [s.text for s in got] == ["fi", "y"]


def test_form_depth_and_cycles():
    w = Writer()
    tree, form = w.allocate(), w.allocate()
    w.add_stream(form, {"Subtype": fonts.Name("Form"), "Resources": {"XObject": {"X": form}, "Font": {"F1": draw.font_entry("Helvetica")}}}, b"BT /F1 9 Tf (a) Tj ET /X Do")
    page = w.add(w.allocate(), {"Type": fonts.Name("Page"), "Parent": tree, "Resources": {"XObject": {"X": form}}, "Contents": w.add_stream(w.allocate(), {}, b"/X Do")})
    r = Reader(w.finish_pages(tree, [page, tree]))
    assert len(r.pages()) == 1 and len(interpret.page_spans(r, r.pages()[0])) == 10 and r.media_box(r.pages()[0]) == [0, 0, 612, 792]


@pytest.mark.parametrize("turn", [0, 90, 180, 270, -90, 450])
def test_turned_pages(turn):
    w = Writer()
    tree = w.allocate()
    page = w.add(w.allocate(), {"Type": fonts.Name("Page"), "Parent": tree, "MediaBox": [50, 30, 645, 872], "Rotate": turn, "Resources": {"Font": {"F1": draw.font_entry("Helvetica")}}, "Contents": w.add_stream(w.allocate(), {}, b"BT /F1 12 Tf 120 70 Td (Anchor) Tj ET")})
    data = w.finish_pages(tree, [page])
    r = Reader(data)
    s = interpret.page_spans(r, r.pages()[0])[0]
    edited = compose.edit(data, overlays=[compose.Overlay(0, s.x, s.y, "Over")])
    r = Reader(edited)
    a, b = interpret.page_spans(r, r.pages()[0])
    assert (a.x, a.y) == (pytest.approx(b.x, abs=0.02), pytest.approx(b.y, abs=0.02))


@pytest.mark.parametrize("content", [b"q 1 0 0 1 0 0 cm Q Q EMC Q", b"/A BMC BT ET", b"q q (q Q EMC) <71> % Q\n <</q /Q>> BDC"])
def test_isolation_balances(content):
    assert compose.brackets(compose.isolated(content)) == ([], [])


def test_merge():
    a, b = document("A", "B", "C"), document("D")
    assert texts(compose.merge([(a, [0, 2]), (b, None)]).data) == [["A"], ["C"], ["D"]]
    assert texts(compose.merge([(a, [-1, 0, -2])]).data) == [["C"], ["A"], ["B"]]
    with pytest.raises(ValueError):
        compose.merge([(a, [3])])
    first = Reader(a).trailer["ID"][0]
    assert Reader(compose.merge([(a, None), (b, None)]).data).trailer["ID"][0] == first
    for policy in ("fail", "truncate", "shrink"):
        with pytest.raises(compose.Oversize):
            compose.merge([(a, None)], 1, policy)
    whole = compose.merge([(a, None)] * 10)
    cut = compose.merge([(a, None)] * 10, int(len(whole.data) * 0.5), "truncate")
    assert 5 < cut.included_pages < 30 and len(cut.data) <= len(whole.data) * 0.5


def test_merge_writes_jpeg_anew():
    y, x = np.mgrid[0:400, 0:400]
    noise = np.random.default_rng(1).integers(0, 60, (400, 400, 3))
    data = jpeg.encode(np.clip(np.stack([x // 2, y // 2, (x + y) // 4], -1) + noise, 0, 255).astype(np.uint8), 95)
    from leafmill.codec.scan import Name, Stream

    w = Writer()
    tree = w.allocate()
    image = w.add(w.allocate(), Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 400, "Height": 400, "ColorSpace": Name("DeviceRGB"), "BitsPerComponent": 8, "Filter": Name("DCTDecode")}, data))
    page = w.add(w.allocate(), {"Type": Name("Page"), "Parent": tree, "Resources": {"XObject": {"I": image}}, "Contents": w.add_stream(w.allocate(), {}, b"/I Do")})
    whole = w.finish_pages(tree, [page])
    out = compose.merge([(whole, None)], len(whole) // 2, "shrink")
    assert out.included_pages == 1 and len(out.data) <= len(whole) // 2


@pytest.mark.parametrize("quality", [95, 50, 10])
def test_jpeg(quality):
    y, x = np.mgrid[0:37, 0:50]
    image = np.stack([x * 5, y * 6, x + y], -1).astype(np.uint8)
    assert abs(jpeg.decode(jpeg.encode(image, quality)).astype(int) - image).mean() < 6


def test_png():
    import struct

    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 256, (5, 7, 4)).astype(np.uint8)
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = b"".join(b"\0" + r.tobytes() for r in pixels)
    png = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
    got = images.read_png(png)
    assert (got.width, got.height, got.rgb, got.alpha) == (7, 5, pixels[..., :3].tobytes(), pixels[..., 3].tobytes())


@pytest.mark.parametrize("case", [(100, 100, 500, 500, 45, 0.85), (1772, 591, 595, 842, 45, 0.85), (100, 300, 500, 500, 30, 0.85), (400, 200, 842, 595, 0, 1.0)])
def test_fit_rotated(case):
    import math

    w, h = images.fit_rotated(*case)
    c, s = abs(math.cos(math.radians(case[4]))), abs(math.sin(math.radians(case[4])))
    across, down = w * c + h * s, w * s + h * c
    assert across <= case[2] * case[5] + 1e-6 and down <= case[3] * case[5] + 1e-6
    assert across == pytest.approx(case[2] * case[5]) or down == pytest.approx(case[3] * case[5])


def test_values():
    assert value_bytes({"B": [1, 2.5, None, True, b"\x01("], "A": fonts.Name("a b#")}) == b"<</A /a#20b#23 /B [1 2.5 null true <0128>] >>"
    s = Scanner(b"(a\\(b\\)\\101\\\nc) <4> 1 0 R -.5 /N#41 true null")
    assert [s.value() for _ in range(7)] == [b"a(b)Ac", b"\x40", (1, 0), -0.5, "NA", True, None] and s.value() is END
