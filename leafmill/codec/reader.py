"""Objects and pages of a PDF file."""

from __future__ import annotations

import re

from . import filters
from .scan import END, GAP, Name, Op, Ref, Scanner, Stream

INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")
ENTRY = re.compile(rb"\s*(\d{10}) \d{5} ([nf])(?=[\r\n ])")
PLAIN = re.compile(rb"\s*((?:\d{10} \d{5} [nf](?:\r\n| \n| \r))+)(?=\s*[t\d])")
STARTXREF = re.compile(rb"startxref\s*(\d+)")
ENDSTREAM = re.compile(rb"\s*endstream")
# a flat trailer of names, numbers and references
PLAIN_ENTRIES = rb"(?:/[A-Z][A-Za-z]* ?\d+(?: \d+ R)? ?)*"
TRAILER = re.compile(rb"(\s*trailer\s*<<" + PLAIN_ENTRIES + rb")/ID \[<((?:[0-9A-Fa-f]{2})*)> <((?:[0-9A-Fa-f]{2})*)>\]( ?" + PLAIN_ENTRIES + rb">>)(?=\s)")
# objects that many documents have alike, by their bytes and the one after; never changed once they are read
KNOWN: dict[bytes, tuple[object, bool]] = {}
MOST_KNOWN, LONGEST_KNOWN = 4096, 1024
LETTER_PAGE = [0.0, 0.0, 612.0, 792.0]


class Reader:
    """Resolves references on demand; the newest cross-reference entry of an object counts. glyphs: texts of glyph names
    beyond those that follow a rule."""

    def __init__(self, data: bytes, glyphs: dict[str, str] | None = None):
        self.data, self.trailer, self.glyphs = data, {}, glyphs
        self.places: dict[int, tuple] = {}  # ("at", offset) or ("in", stream number, index)
        self.known: dict[int, object] = {}
        self.busy: set[int] = set()
        self._read_tables()
        if "Root" not in self.trailer or not isinstance(self.resolve(self.trailer.get("Root")), dict):
            self._rebuild()
        if not isinstance(self.resolve(self.trailer.get("Root")), dict):
            raise ValueError("not a PDF file")

    # cross-reference tables

    def _read_tables(self) -> None:
        at = self.data.rfind(b"startxref")
        m = STARTXREF.match(self.data, at) if at >= 0 else None
        todo, seen = [int(m[1])] if m else [], set()
        while todo:
            at = todo.pop(0)
            if at in seen or not 0 <= at < len(self.data):
                continue
            seen.add(at)
            try:
                trailer = self._table(at) if self.data.startswith(b"xref", GAP.match(self.data, at).end()) else self._stream_table(at)
            except (ValueError, IndexError, TypeError, AttributeError):
                continue
            self.trailer = trailer | self.trailer
            todo += [int(trailer[k]) for k in ("XRefStm", "Prev") if isinstance(trailer.get(k), (int, float))]

    def _table(self, at: int) -> dict:
        s = Scanner(self.data, at)
        s.value()
        while True:
            if m := TRAILER.match(self.data, s.at):
                return self._trailer(m)
            first = s.value(refs=False)
            if first == "trailer":
                out = s.value()
                return out if isinstance(out, dict) else {}
            n = s.value(refs=False)
            if not isinstance(first, int) or not isinstance(n, int):
                raise ValueError("a broken cross-reference table")
            if rows := PLAIN.match(self.data, s.at):
                found = self.data[rows.end() - len(rows[1]) : rows.end()]
                if len(found) == 20 * n:
                    for i in range(n):
                        if found[20 * i + 17] == 0x6E:
                            self.places.setdefault(first + i, ("at", int(found[20 * i : 20 * i + 10])))
                    s.at = rows.end()
                    continue
            for num in range(first, first + n):
                if m := ENTRY.match(self.data, s.at):
                    s.at = m.end()
                    if m[2] == b"n":
                        self.places.setdefault(num, ("at", int(m[1])))
                    continue
                offset, _, kind = s.value(refs=False), s.value(refs=False), s.value(refs=False)
                if kind == "n":
                    self.places.setdefault(num, ("at", offset))
                elif kind != "f":
                    raise ValueError("a broken cross-reference table")

    @staticmethod
    def _trailer(m: re.Match) -> dict:
        """A trailer that many documents have alike but for its ID."""
        key = m[1] + b"/ID [<00> <01>]" + m[4]
        if key not in KNOWN:
            if len(KNOWN) >= MOST_KNOWN:
                KNOWN.clear()
            KNOWN[key] = Scanner(key, m[1].index(b"<<")).value(), False
        return KNOWN[key][0] | {"ID": [bytes.fromhex(m[2].decode()), bytes.fromhex(m[3].decode())]}

    def _stream_table(self, at: int) -> dict:
        stream = self._object_at(at)
        head = stream.entries
        widths = [int(x) for x in head["W"]]
        index = head.get("Index") or [0, int(head["Size"])]
        data, step, at = self.decoded(stream), sum(widths), 0
        for first, n in zip(index[::2], index[1::2], strict=False):
            for num in range(first, first + n):
                row, fields = data[at : at + step], []
                at += step
                if len(row) < step:
                    break
                for w in widths:
                    fields.append(int.from_bytes(row[:w], "big"))
                    row = row[w:]
                kind = fields[0] if widths[0] else 1
                if kind == 1:
                    self.places.setdefault(num, ("at", fields[1]))
                elif kind == 2:
                    self.places.setdefault(num, ("in", fields[1], fields[2]))
        return head

    def _rebuild(self) -> None:
        """Find objects by their heads where the tables are of no use; the last of a number counts."""
        for m in re.finditer(rb"(?<!\d)(\d{1,9})\s+\d{1,5}\s+obj\b", self.data):
            self.places[int(m[1])] = ("at", m.start())
        self.known.clear()
        for m in re.finditer(rb"\btrailer\b", self.data):
            x = Scanner(self.data, m.end()).value()
            if isinstance(x, dict):
                self.trailer |= x
        if not isinstance(self.resolve(self.trailer.get("Root")), dict):
            for num in list(self.places):
                x = self.resolve(Ref(num, 0))
                if isinstance(x, dict) and x.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(num, 0)

    # objects

    def _object_at(self, at: int):
        data = self.data
        end = data.find(b"endobj", at) + 6
        body = data.find(b"stream", at, end) + 6
        end = body if body > 5 else end
        key = data[at : end + 1] if 5 < end <= at + LONGEST_KNOWN else b""
        if key in KNOWN:
            x, is_stream = KNOWN[key]
            return Stream(x, self._stream_bytes(x, end)) if is_stream else x
        s = Scanner(data, at)
        num, _, word = s.value(refs=False), s.value(refs=False), s.value(refs=False)
        if not isinstance(num, int) or word != "obj":
            raise ValueError("no object there")
        x = s.value()
        after = s.at
        following = s.value()
        is_stream = isinstance(x, dict) and following == "stream"
        out = x if is_stream or x is not END and not isinstance(x, Op) else None
        if key and s.at == end and (is_stream or following == "endobj"):  # nothing was read beyond the key
            if len(KNOWN) >= MOST_KNOWN:
                KNOWN.clear()
            KNOWN[key] = out, is_stream
        if is_stream:
            return Stream(x, self._stream_bytes(x, s.at))
        s.at = after
        return out

    def _stream_bytes(self, entries: dict, at: int) -> bytes:
        if self.data[at : at + 2] == b"\r\n":
            at += 2
        elif self.data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        n = self.resolve(entries.get("Length"))
        if isinstance(n, int) and 0 <= n <= len(self.data) - at and ENDSTREAM.match(self.data, at + n):
            return self.data[at : at + n]
        end = self.data.find(b"endstream", at)
        return re.sub(rb"\r?\n\Z", b"", self.data[at : end if end >= 0 else len(self.data)])

    def resolve(self, x):
        """What a reference leads to, in the end; None if to nothing."""
        hops = 0
        while isinstance(x, Ref) and hops < 32:
            x, hops = self._load(x.num), hops + 1
        return None if isinstance(x, Ref) else x

    def _load(self, num: int):
        if num in self.known:
            return self.known[num]
        place = self.places.get(num)
        if not place or num in self.busy:
            return None
        self.busy.add(num)
        try:
            x = self._object_at(place[1]) if place[0] == "at" else self._packed(place[1]).get(num)
        except (ValueError, TypeError, IndexError):
            x = None
        finally:
            self.busy.discard(num)
        return self.known.setdefault(num, x)

    def _packed(self, num: int) -> dict[int, object]:
        """All objects of an object stream; those that are newest there are kept."""
        stream = self._load(num)
        if not isinstance(stream, Stream):
            return {}
        data = self.decoded(stream)
        n, first = int(self.resolve(stream.entries.get("N")) or 0), int(self.resolve(stream.entries.get("First")) or 0)
        s = Scanner(data)
        heads = [(s.value(refs=False), s.value(refs=False)) for _ in range(min(n, len(data)))]
        out = {}
        for own, at in heads:
            if isinstance(own, int) and isinstance(at, int) and 0 <= first + at < len(data):
                x = Scanner(data, first + at).value()
                out[own] = x
                if self.places.get(own, ("",))[:2] == ("in", num):
                    self.known.setdefault(own, x)
        return out

    def dict(self, x) -> dict:
        x = self.resolve(x)
        return x if isinstance(x, dict) else x.entries if isinstance(x, Stream) else {}

    def array(self, x) -> list:
        x = self.resolve(x)
        return x if isinstance(x, list) else []

    def filters(self, entries: dict) -> list[tuple[str, dict]]:
        names, parms = self.resolve(entries.get("Filter", entries.get("F"))), self.resolve(entries.get("DecodeParms", entries.get("DP")))
        names = names if isinstance(names, list) else [names] if isinstance(names, Name) else []
        parms = parms if isinstance(parms, list) else [parms]
        return [(str(self.resolve(n)), self.dict(parms[i]) if i < len(parms) else {}) for i, n in enumerate(names)]

    def decoded(self, stream: Stream) -> bytes:
        data = stream.raw
        for name, parms in self.filters(stream.entries):
            data = filters.apply(name, data, {k: self.resolve(v) for k, v in parms.items()})
        return data

    # pages

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with what they inherit."""
        out: list[dict] = []
        seen: set[int] = set()
        todo = [(self.dict(self.trailer.get("Root")).get("Pages"), {})]
        while todo:
            ref, above = todo.pop()
            if isinstance(ref, Ref):
                if ref.num in seen:
                    continue
                seen.add(ref.num)
            node = self.dict(ref)
            if not node:
                continue
            own = above | {k: node[k] for k in INHERITED if k in node}
            if "Kids" in node and node.get("Type") != "Page":
                todo += [(kid, own) for kid in reversed(self.array(node["Kids"]))]
            else:
                out.append(own | node)
        return out

    def media_box(self, page: dict) -> list[float]:
        box = [self.resolve(x) for x in self.array(page.get("MediaBox"))]
        return [float(x) for x in box] if len(box) == 4 and all(isinstance(x, (int, float)) for x in box) else list(LETTER_PAGE)

    def rotation(self, page: dict) -> int:
        turn = self.resolve(page.get("Rotate"))
        return int(turn) % 360 if isinstance(turn, (int, float)) else 0

    def content(self, page: dict) -> bytes:
        x = self.resolve(page.get("Contents"))
        parts = [self.resolve(p) for p in x] if isinstance(x, list) else [x]
        return b"\n".join(self.decoded(p) for p in parts if isinstance(p, Stream))

    def fonts(self, resources) -> dict[str, dict]:
        return {k: self.dict(v) for k, v in self.dict(self.dict(resources).get("Font")).items()}
