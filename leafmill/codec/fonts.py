"""Fonts: widths, encodings, glyph names and ToUnicode maps."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from string import ascii_letters

from .reader import Reader
from .scan import Name, Scanner, Stream, hex_bytes, number

# Widths of the standard fonts in thousandths, from code 32 on, and from 160 on.
HELVETICA = """
    278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584
    584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667
    611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500
    722 500 500 500 334 260 334 584
"""
HELVETICA_160 = """
    278 333 556 556 556 556 260 556 333 737 370 556 584 333 737 333 400 584 333 333 333 556 537 278 333 333 365 556 834
    834 834 611 667 667 667 667 667 667 1000 722 667 667 667 667 278 278 278 278 722 722 778 778 778 778 778 584 778 722
    722 722 722 667 667 611 556 556 556 556 556 556 889 500 556 556 556 556 278 278 278 278 556 556 556 556 556 556 556
    584 611 556 556 556 556 500 556 500
"""
HELVETICA_BOLD = """
    278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584
    584 584 611 975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667
    611 333 278 333 584 556 333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556
    778 556 556 500 389 280 389 584
"""
TIMES = """
    250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564
    564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722
    611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500
    722 500 500 444 480 200 480 541
"""
TIMES_BOLD = """
    250 333 555 500 500 1000 833 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570
    570 570 500 930 722 667 722 722 667 611 778 778 389 500 778 667 944 722 778 611 778 722 556 667 722 722 1000 722 722
    667 333 278 333 581 500 333 500 556 444 556 444 333 500 556 278 333 556 278 833 556 500 556 556 444 389 333 556 500
    722 500 500 444 394 220 394 520
"""


def _from(first: int, text: str) -> dict[int, float]:
    return {first + i: float(w) for i, w in enumerate(text.split())}


WIDTHS = {
    "Courier": {i: 600.0 for i in range(256)},
    "Helvetica": _from(32, HELVETICA) | _from(160, HELVETICA_160),
    "Helvetica-Bold": _from(32, HELVETICA_BOLD),
    "Times": _from(32, TIMES),
    "Times-Bold": _from(32, TIMES_BOLD),
}


@lru_cache(maxsize=256)
def standard_widths(name: str) -> dict[int, float] | None:
    """Widths of a standard font or one of its usual stand-ins, by family and weight; None for others."""
    name = name.split("+", 1)[-1]
    m = re.fullmatch(r"(Courier(?:New)?|Helvetica|Arial|Times(?:NewRoman)?)(?:PS)?(?:MT)?-?(Roman|Bold|Italic|Oblique|BoldItalic|BoldOblique)?(?:MT)?", name)
    if not m or name in ("Times",):
        return None
    family = "Courier" if m[1].startswith("Courier") else "Times" if m[1].startswith("Times") else "Helvetica"
    bold = "Bold" in (m[2] or "") and family != "Courier"
    return WIDTHS[family + "-Bold" * bold]


def text_width(text: str, size: float, font: str = "Helvetica", missing: float = 556.0) -> float:
    """Width of a text in points; of a font that is not known, half the size a byte."""
    table = standard_widths(font)
    if table is None:
        return len(text.encode()) * size * 0.5
    return sum(table.get(ord(c), missing) for c in text) / 1000 * size


# Glyph names that follow no rule.
NAMED = dict(
    pair.split("=")
    for pair in """space=20 exclam=21 quotedbl=22 numbersign=23 dollar=24 percent=25 ampersand=26 quotesingle=27
    parenleft=28 parenright=29 asterisk=2A plus=2B comma=2C hyphen=2D period=2E slash=2F colon=3A semicolon=3B less=3C
    equal=3D greater=3E question=3F at=40 bracketleft=5B backslash=5C bracketright=5D asciicircum=5E underscore=5F
    grave=60 braceleft=7B bar=7C braceright=7D asciitilde=7E exclamdown=A1 cent=A2 sterling=A3 currency=A4 yen=A5
    brokenbar=A6 section=A7 dieresis=A8 copyright=A9 ordfeminine=AA guillemotleft=AB logicalnot=AC registered=AE
    macron=AF degree=B0 plusminus=B1 acute=B4 mu=B5 paragraph=B6 periodcentered=B7 cedilla=B8 ordmasculine=BA
    guillemotright=BB onequarter=BC onehalf=BD threequarters=BE questiondown=BF AE=C6 Eth=D0 multiply=D7 Oslash=D8
    Thorn=DE germandbls=DF ae=E6 eth=F0 divide=F7 oslash=F8 thorn=FE dotlessi=131 Lslash=141 lslash=142 OE=152 oe=153
    florin=192 circumflex=2C6 caron=2C7 breve=2D8 dotaccent=2D9 ring=2DA ogonek=2DB tilde=2DC hungarumlaut=2DD
    endash=2013 emdash=2014 quoteleft=2018 quoteright=2019 quotesinglbase=201A quotedblleft=201C quotedblright=201D
    quotedblbase=201E dagger=2020 daggerdbl=2021 bullet=2022 ellipsis=2026 perthousand=2030 guilsinglleft=2039
    guilsinglright=203A fraction=2044 Euro=20AC trademark=2122 minus=2212 infinity=221E notequal=2260 lessequal=2264
    greaterequal=2265 lozenge=25CA fi=FB01 fl=FB02 nbspace=A0 sfthyphen=AD onesuperior=B9 twosuperior=B2
    threesuperior=B3 Dcroat=110 dcroat=111 summation=2211 product=220F radical=221A integral=222B approxequal=2248
    partialdiff=2202 arrowleft=2190 arrowup=2191 arrowright=2192 arrowdown=2193 ff=FB00 ffi=FB03 ffl=FB04""".split()
)
ACCENTS = {"grave": "\u0300", "acute": "\u0301", "circumflex": "\u0302", "tilde": "\u0303", "macron": "\u0304", "breve": "\u0306", "dotaccent": "\u0307", "dieresis": "\u0308", "ring": "\u030a", "hungarumlaut": "\u030b", "caron": "\u030c", "cedilla": "\u0327", "ogonek": "\u0328", "commaaccent": "\u0327"}
DIGITS = {f"{unicodedata.name(chr(c)).split()[1].lower()}": chr(c) for c in range(0x30, 0x3A)}


@lru_cache(maxsize=1)
def known_glyphs() -> dict[str, str]:
    """Glyph names to texts, by rule: listed names, digits, letters with an accent, the letters of Greek and Hebrew by
    their names, and the numbered names of Cyrillic."""
    out = {name: chr(int(code, 16)) for name, code in NAMED.items()} | DIGITS
    for letter in ascii_letters:
        for accent, mark in ACCENTS.items():
            one = unicodedata.normalize("NFC", letter + mark)
            if len(one) == 1:
                out[letter + accent] = one
    for code in (*range(0x391, 0x3CA), *range(0x5D0, 0x5EB)):
        m = re.fullmatch(r"(?:GREEK|HEBREW) (CAPITAL |SMALL |)LETTER ([A-Z]+)", unicodedata.name(chr(code), ""))
        if m:
            out.setdefault(m[2].capitalize() if m[1] == "CAPITAL " else m[2].lower(), chr(code))
    for first, start, dotted in ((10017, 0x410, 0x401), (10065, 0x430, 0x451)):
        letters = [*range(start, start + 6), dotted, *range(start + 6, start + 32)]  # io stands after ie
        out |= {f"afii{first + i}": chr(c) for i, c in enumerate(letters)}
    return out


def glyph_text(name: str, more: dict[str, str] | None = None) -> str:
    """The text of a glyph name: that of a list given with it, of known_glyphs, uniXXXX with one or more code units, uXXXXX,
    or of its parts between underscores; what is none of these is its own text. What follows a dot does not count."""
    base = name.split(".")[0] or name
    for table in (more or {}, known_glyphs()):
        if base in table:
            return table[base]
    if m := re.fullmatch(r"uni((?:[0-9A-Fa-f]{4})+)", base):
        return utf16(bytes.fromhex(m[1]))
    if m := re.fullmatch(r"u([0-9A-Fa-f]{4,6})", base):
        return _scalar(int(m[1], 16)) or name
    if "_" in base.strip("_"):
        return "".join(glyph_text(part, more) for part in base.split("_"))
    return name


def read_glyph_list(text: str) -> dict[str, str]:
    """A glyph list in its published form: a name, a semicolon and code points a line; # begins a comment."""
    rows = (line.split("#")[0].strip().partition(";") for line in text.splitlines())
    return {name.strip(): "".join(chr(int(c, 16)) for c in codes.replace(",", " ").split()) for name, _, codes in rows if name and codes}


def _scalar(c: int) -> str:
    return chr(c) if c < 0x110000 and not 0xD800 <= c < 0xE000 else ""


def single_bytes(codec: str) -> dict[int, str]:
    """A code page; where it has none, Latin-1's."""
    return {i: bytes([i]).decode(codec, "ignore") or chr(i) for i in range(256)}


WIN_ANSI, MAC_ROMAN = single_bytes("cp1252"), single_bytes("mac_roman")


def utf16(data: bytes) -> str:
    return data.decode("utf-16-be", "replace")


HEXED = re.compile(rb"<([0-9A-Fa-f\s]*)>|(\[)|(\])")


def to_unicode(data: bytes) -> dict[int, str]:
    """Code to text of a ToUnicode map."""
    out: dict[int, str] = {}
    for body in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        found = [hex_bytes(m[1]) for m in re.finditer(rb"<([0-9A-Fa-f\s]*)>", body)]
        for code, text in zip(found[::2], found[1::2], strict=False):
            out[int.from_bytes(code[:2] if len(code) > 2 else code, "big")] = utf16(text if len(text) > 1 else b"\0" + text)
    for body in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        s, row = Scanner(body), []
        while len(body) > s.at:
            x = s.value(refs=False)
            if isinstance(x, (bytes, list)):
                row.append(x)
            if len(row) == 3:
                lo, hi = (int.from_bytes(b[:2], "big") for b in row[:2] if isinstance(b, bytes))
                if isinstance(row[2], list):
                    texts = [utf16(t) for t in row[2] if isinstance(t, bytes)]
                else:
                    first = int.from_bytes(row[2][-2:], "big")
                    texts = [_scalar(first + i & 0xFFFF) for i in range(max(0, hi - lo + 1))]
                for i, t in enumerate(texts[: max(0, hi - lo + 1)]):
                    out[lo + i] = t
                row = []
    return out


class Font:
    """How a font's strings read and how wide they are."""

    def __init__(self, reader: Reader, entries: dict):
        self.composite = entries.get("Subtype") == "Type0"
        stream = reader.resolve(entries.get("ToUnicode"))
        self.unicode = to_unicode(reader.decoded(stream)) if isinstance(stream, Stream) else None
        self.encoding = None if self.composite else self._encoding(reader, reader.resolve(entries.get("Encoding")))
        self.widths: dict[int, float] | None = None
        self.missing = 600.0
        if self.composite:
            below = reader.array(entries.get("DescendantFonts"))
            own = reader.dict(below[0]) if below else {}
            if below:
                self.missing = number(reader.resolve(own.get("DW", 1000.0)))
                self.widths = self._cid_widths(reader, reader.array(own.get("W")))
        else:
            own = entries
            if isinstance(reader.resolve(entries.get("Widths")), list):
                first = int(number(reader.resolve(entries.get("FirstChar"))))
                self.widths = {first + i: number(reader.resolve(w)) for i, w in enumerate(reader.array(entries["Widths"]))}
            else:
                self.widths = standard_widths(str(entries.get("BaseFont", "")))
        about = reader.resolve(reader.dict(own.get("FontDescriptor")).get("MissingWidth"))
        if isinstance(about, (int, float)):
            self.missing = float(about)

    @staticmethod
    def _encoding(reader: Reader, x) -> dict[int, str] | None:
        base = {"WinAnsiEncoding": WIN_ANSI, "MacRomanEncoding": MAC_ROMAN}
        if isinstance(x, Name):
            return base.get(x)
        if not isinstance(x, dict):
            return None
        out, code = dict(base.get(str(reader.resolve(x.get("BaseEncoding"))), WIN_ANSI)), 0
        for d in reader.array(x.get("Differences")):
            d = reader.resolve(d)
            if isinstance(d, Name):
                out[code] = glyph_text(str(d), reader.glyphs)
                code += 1
            elif isinstance(d, (int, float)):
                code = int(d)
        return out

    @staticmethod
    def _cid_widths(reader: Reader, array: list) -> dict[int, float]:
        out: dict[int, float] = {}
        at, items = 0, [reader.resolve(x) for x in array]
        while at + 1 < len(items):
            first, second = items[at], items[at + 1]
            if isinstance(second, list):
                out |= {int(number(first)) + i: number(reader.resolve(w)) for i, w in enumerate(second)}
                at += 2
            elif at + 2 < len(items):
                lo, hi = int(number(first)), int(number(second))
                out |= dict.fromkeys(range(lo, min(hi, lo + 65536) + 1), number(items[at + 2]))
                at += 3
            else:
                break
        return out

    def codes(self, data: bytes) -> list[int]:
        if self.composite and len(data) % 2 == 0:
            return [data[i] << 8 | data[i + 1] for i in range(0, len(data), 2)]
        return list(data)

    def text(self, data: bytes) -> str:
        if self.unicode is not None:
            double = self.composite or len(data) > 1 and (data[0] << 8 | data[1]) in self.unicode
            if double and len(data) % 2 == 0:
                return "".join(self.unicode.get(c) or _scalar(c) for c in (data[i] << 8 | data[i + 1] for i in range(0, len(data), 2)))
            return "".join(self.unicode.get(c) or WIN_ANSI[c] for c in data)
        table = self.encoding or WIN_ANSI
        if table is WIN_ANSI and data.isascii():
            return data.decode("ascii")
        return "".join(table[c] for c in data)

    def width(self, code: int) -> float:
        """In thousandths."""
        return (self.widths or {}).get(code, self.missing)
