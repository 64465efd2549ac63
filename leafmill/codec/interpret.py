"""Content streams to positioned text."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import NamedTuple

import numpy as np

from .fonts import Font, utf16
from .jpeg import decode as decode_jpeg
from .reader import Reader
from .scan import END, IDENTITY, TOKEN, Name, Op, Scanner, Stream, apply, matmul, name_of, number, word_of

DEEPEST_FORM = 10


class Span(NamedTuple):
    x: float
    y: float
    end_x: float
    font_size: float
    font: str
    text: str


class Picture(NamedTuple):
    """An image where it is drawn: the unit square goes to the page by the matrix. rgb is None if its colours cannot be read."""

    width: int
    height: int
    matrix: list[float]
    opacity: float
    rgb: bytes | None
    alpha: bytes | None


@dataclass
class State:
    ctm: list[float] = field(default_factory=lambda: list(IDENTITY))
    font: str = ""
    size: float = 0.0
    chars: float = 0.0
    words: float = 0.0
    scale: float = 100.0
    lead: float = 0.0
    opacity: float = 1.0


def actual_text(data: bytes) -> str:
    return utf16(data[2:]) if data[:2] == b"\xfe\xff" else data.decode("latin-1")


class Interpreter:
    """Runs the text operators of one content stream; forms are run by another one below it."""

    def __init__(self, reader: Reader, resources, depth: int = 0, ctm: list[float] | None = None, fonts: dict | None = None):
        self.reader, self.resources, self.depth = reader, reader.dict(resources), depth
        self.entries = reader.fonts(resources) or fonts or {}
        self.loaded: dict[str, Font] = {}
        self.state, self.saved = State(ctm=list(ctm or IDENTITY)), []
        self.matrix, self.line = list(IDENTITY), list(IDENTITY)
        self.marks: list[tuple | None] = []
        self.spans: list[Span] = []
        self.images: list[tuple[Stream, list[float], float]] = []

    def font(self) -> Font:
        name = self.state.font
        if name not in self.loaded:
            self.loaded[name] = Font(self.reader, self.entries.get(name, {}))
        return self.loaded[name]

    def run(self, content: bytes) -> list[Span]:
        s, stack, match = Scanner(content), [], TOKEN.match
        while True:
            if m := match(content, s.at):  # as Scanner.value would, without a call for each token
                kind, s.at = m.lastindex, m.end()
                raw = m[kind]
                x = (float(raw) if b"." in raw else int(raw)) if kind == 1 else raw if kind == 2 else word_of(raw) if kind == 3 else name_of(raw)
            elif (x := s.value(refs=False)) is END:
                break
            if not isinstance(x, Op):
                stack.append(x)
                continue
            if x == "BI":
                self.skip_image(s)
            else:
                act = ACTIONS.get(x)
                if act and len(stack) >= act[0]:
                    act[1](self, stack[len(stack) - act[0] :] if act[0] else stack)
            stack = []
        return self.spans

    def skip_image(self, s: Scanner) -> None:
        """Past the end mark of an inline image: EI between white space."""
        at = s.data.find(b"ID", s.at)
        while at >= 0:
            at = s.data.find(b"EI", at + 2)
            if at >= 0 and s.data[at - 1 : at] in (b"\n", b" ", b"\r", b"\t") and s.data[at + 2 : at + 3] in (b"\n", b" ", b"\r", b"\t", b""):
                s.at = at + 2
                return
        s.at = len(s.data)

    def shift(self, x: float, y: float) -> None:
        self.line = matmul([1, 0, 0, 1, x, y], self.line)
        self.matrix = list(self.line)

    def move(self, by: float) -> None:
        """Along the base line, in text space."""
        m = self.matrix
        m[4] += by * m[0]
        m[5] += by * m[1]

    def show(self, data) -> None:
        if not isinstance(data, bytes):
            return
        font, st = self.font(), self.state
        text = font.text(data)
        start = apply(st.ctm, *self.matrix[4:])
        stretch, single = st.scale / 100, not (font.composite and len(data) % 2 == 0)
        total, width, size, chars = 0.0, font.width, st.size, st.chars
        for code in font.codes(data):
            total += (width(code) / 1000 * size + chars) * stretch
            if single and code == 0x20:
                total += st.words * stretch
        self.move(total)
        if text and not any(m for m in self.marks):
            self.spans.append(Span(start[0], start[1], apply(st.ctm, *self.matrix[4:])[0], st.size, st.font, text))

    def show_all(self, items) -> None:
        for x in items if isinstance(items, list) else []:
            if isinstance(x, bytes):
                self.show(x)
            elif isinstance(x, (int, float)):
                self.move(-x / 1000 * self.state.size * self.state.scale / 100)

    def form(self, name) -> None:
        stream = self.reader.resolve(self.reader.dict(self.resources.get("XObject")).get(name)) if isinstance(name, Name) else None
        if isinstance(stream, Stream) and stream.entries.get("Subtype") == "Image":
            self.images.append((stream, list(self.state.ctm), self.state.opacity))
        if not isinstance(stream, Stream) or stream.entries.get("Subtype") != "Form" or self.depth >= DEEPEST_FORM:
            return
        own = [number(self.reader.resolve(x)) for x in self.reader.array(stream.entries.get("Matrix"))]
        ctm = matmul(own, self.state.ctm) if len(own) == 6 else self.state.ctm
        below = Interpreter(self.reader, stream.entries.get("Resources") or self.resources, self.depth + 1, ctm, self.entries)
        self.spans += below.run(self.reader.decoded(stream))
        self.images += below.images

    def fade(self, name) -> None:
        """The opacity of a graphics state by its name."""
        state = self.reader.dict(self.reader.dict(self.resources.get("ExtGState")).get(name)) if isinstance(name, Name) else {}
        share = self.reader.resolve(state.get("ca"))
        if isinstance(share, (int, float)):
            self.set(opacity=float(share))

    def mark(self, properties=None) -> None:
        if isinstance(properties, Name):
            properties = self.reader.dict(self.reader.dict(self.resources.get("Properties")).get(properties))
        text = self.reader.resolve(properties.get("ActualText")) if isinstance(properties, dict) else None
        self.marks.append((actual_text(text), *apply(self.state.ctm, *self.matrix[4:])) if isinstance(text, bytes) else None)

    def unmark(self) -> None:
        top = self.marks.pop() if self.marks else None
        if top and top[0] and not any(self.marks):
            self.spans.append(Span(top[1], top[2], max(top[1], apply(self.state.ctm, *self.matrix[4:])[0]), self.state.size, self.state.font, top[0]))

    def restore(self) -> None:
        if self.saved:
            self.state = self.saved.pop()

    def begin(self) -> None:
        self.matrix, self.line = list(IDENTITY), list(IDENTITY)

    def place(self, v) -> None:
        self.line = [number(x) for x in v]
        self.matrix = list(self.line)

    def set(self, **what) -> None:
        self.state = replace(self.state, **what)

    def next_line(self) -> None:
        self.shift(0, -self.state.lead)


ACTIONS = {
    "BT": (0, lambda i, v: i.begin()),
    "Tf": (2, lambda i, v: i.set(font=str(v[0]) if isinstance(v[0], Name) else i.state.font, size=number(v[1]))),
    "Tc": (1, lambda i, v: i.set(chars=number(v[0]))),
    "Tw": (1, lambda i, v: i.set(words=number(v[0]))),
    "TL": (1, lambda i, v: i.set(lead=number(v[0]))),
    "Tz": (1, lambda i, v: i.set(scale=number(v[0]))),
    "Th": (1, lambda i, v: i.set(scale=number(v[0]))),
    "Td": (2, lambda i, v: i.shift(number(v[0]), number(v[1]))),
    "TD": (2, lambda i, v: (i.set(lead=-number(v[1])), i.shift(number(v[0]), number(v[1])))),
    "Tm": (6, lambda i, v: i.place(v)),
    "T*": (0, lambda i, v: i.next_line()),
    "Tj": (1, lambda i, v: i.show(v[0])),
    "'": (1, lambda i, v: (i.next_line(), i.show(v[0]))),
    '"': (3, lambda i, v: (i.set(words=number(v[0]), chars=number(v[1])), i.next_line(), i.show(v[2]))),
    "TJ": (1, lambda i, v: i.show_all(v[0])),
    "q": (0, lambda i, v: i.saved.append(replace(i.state))),
    "Q": (0, lambda i, v: i.restore()),
    "cm": (6, lambda i, v: i.set(ctm=matmul([number(x) for x in v], i.state.ctm))),
    "Do": (1, lambda i, v: i.form(v[0])),
    "gs": (1, lambda i, v: i.fade(v[0])),
    "BMC": (0, lambda i, v: i.mark()),
    "BDC": (2, lambda i, v: i.mark(v[1])),
    "EMC": (0, lambda i, v: i.unmark()),
}


def turned(turn: int, box: list[float]) -> list[float]:
    """The map from a page's own space to the space it is displayed in; the box keeps its origin."""
    x, y, wide, high = box[0], box[1], box[2] - box[0], box[3] - box[1]
    return {90: [0, -1, 1, 0, x - y, x + y + wide], 180: [-1, 0, 0, -1, 2 * x + wide, 2 * y + high], 270: [0, 1, -1, 0, x + y + high, y - x]}.get(turn, IDENTITY)


def page_spans(reader: Reader, page: dict) -> list[Span]:
    """The text of a page in displayed space."""
    spans = Interpreter(reader, page.get("Resources")).run(reader.content(page))
    m = turned(reader.rotation(page), reader.media_box(page))
    if m is IDENTITY:
        return spans
    out = []
    for s in spans:
        x, y = apply(m, s.x, s.y)
        end = apply(m, s.end_x, s.y)[0]
        out.append(s._replace(x=x, y=y, end_x=end))
    return out


def samples(reader: Reader, stream: Stream) -> bytes | None:
    """Rows of samples of an image: those of a JPEG file, or 8-bit ones as they are."""
    if [n for n, _ in reader.filters(stream.entries)] == ["DCTDecode"]:
        return decode_jpeg(stream.raw).astype(np.uint8).tobytes()
    return reader.decoded(stream) if reader.resolve(stream.entries.get("BitsPerComponent")) == 8 else None


def picture(reader: Reader, stream: Stream, matrix: list[float], opacity: float) -> Picture:
    width, height = (int(number(reader.resolve(stream.entries.get(k)))) for k in ("Width", "Height"))
    data, mask = samples(reader, stream), reader.resolve(stream.entries.get("SMask"))
    if data is not None and len(data) == width * height:
        data = np.repeat(np.frombuffer(data, np.uint8), 3).tobytes()
    rgb = data if data is not None and len(data) == 3 * width * height else None
    return Picture(width, height, matrix, opacity, rgb, samples(reader, mask) if isinstance(mask, Stream) else None)


def page_images(reader: Reader, page: dict) -> list[Picture]:
    """The images of a page in the order in which they are drawn, in displayed space."""
    i = Interpreter(reader, page.get("Resources"))
    i.run(reader.content(page))
    m = turned(reader.rotation(page), reader.media_box(page))
    return [picture(reader, stream, matmul(own, m), opacity) for stream, own, opacity in i.images]
