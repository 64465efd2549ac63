"""PDF bytes from objects."""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

from .scan import Name, Ref, Stream

STAMP = "D:19700101000000Z"
HEAD = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"


@lru_cache(maxsize=4096)
def name_bytes(name: str) -> bytes:
    raw = name.encode("latin-1", "replace")
    return b"/" + b"".join(bytes([c]) if 0x21 <= c <= 0x7E and c not in b"#()<>[]{}/%" else b"#%02X" % c for c in raw)


def value_bytes(x) -> bytes:
    """Keys sorted, strings as hexadecimal digits."""
    if x is None:
        return b"null"
    if isinstance(x, bool):
        return b"true" if x else b"false"
    if isinstance(x, Name):
        return name_bytes(x)
    if isinstance(x, int):
        return b"%d" % x
    if isinstance(x, float):
        return (f"{x:.6f}".rstrip("0").rstrip(".") or "0").replace("-0", "-0").encode()
    if isinstance(x, Ref):
        return b"%d %d R" % x
    if isinstance(x, str):
        x = text_bytes(x)
    if isinstance(x, (bytes, bytearray)):
        return b"<" + x.hex().encode() + b">"
    if isinstance(x, (list,)):
        return b"[" + b" ".join(map(value_bytes, x)) + b"]"
    if isinstance(x, dict):
        return b"<<" + b"".join(name_bytes(k) + b" " + value_bytes(v) + b" " for k, v in sorted(x.items())) + b">>"
    raise TypeError(f"no PDF value: {type(x).__name__}")


def text_bytes(text: str) -> bytes:
    """A text in WinAnsi; a question mark for what that lacks."""
    try:
        return text.encode("cp1252")
    except UnicodeEncodeError:
        pass
    out = bytearray()
    for c in text:
        try:
            out += c.encode("cp1252")
        except UnicodeEncodeError:
            out += b"?"
    return bytes(out)


def literal(text: str) -> bytes:
    """The inside of a literal string."""
    return re.sub(rb"([()\\])", rb"\\\1", text_bytes(text))


def about(stamp: str) -> dict:
    """The description of a document."""
    return {"Producer": b"leafmill", "CreationDate": stamp.encode(), "ModDate": stamp.encode()}


class Writer:
    """Objects one after another; ``mark`` and ``back`` undo what a page too many has added."""

    def __init__(self):
        self.out, self.places, self.next = bytearray(HEAD), {}, 1

    def allocate(self) -> Ref:
        self.next += 1
        return Ref(self.next - 1, 0)

    def add(self, ref: Ref, x) -> Ref:
        self.places[ref.num] = len(self.out)
        self.out += b"%d %d obj\n" % ref
        if isinstance(x, Stream):
            self.out += value_bytes(x.entries | {"Length": len(x.raw)}) + b"\nstream\n" + x.raw + b"\nendstream"
        else:
            self.out += value_bytes(x)
        self.out += b"\nendobj\n"
        return ref

    def add_stream(self, ref: Ref, entries: dict, data: bytes) -> Ref:
        return self.add(ref, Stream(entries | {"Filter": Name("FlateDecode")}, zlib.compress(data, 9)))

    def mark(self) -> tuple[int, int]:
        return len(self.out), self.next

    def back(self, mark: tuple[int, int]) -> None:
        """To a mark that all objects allocated since have been added after."""
        del self.out[mark[0] :]
        for num in range(mark[1], self.next):
            self.places.pop(num, None)
        self.next = mark[1]

    def final_size(self, pages: int) -> int:
        """What the file will take, about: the objects, the tree of pages and the tables."""
        return len(self.out) + 20 * (self.next + 2) + 12 * pages + 600

    def finish(self, root: Ref, first_id: bytes | None = None, stamp: str = STAMP) -> bytes:
        info = self.add(self.allocate(), about(stamp))
        at = len(self.out)
        self.out += b"xref\n0 %d\n0000000000 65535 f\r\n" % self.next
        for i in range(1, self.next):
            self.out += b"%010d 00000 n\r\n" % self.places[i] if i in self.places else b"0000000000 00000 f\r\n"
        own = hashlib.md5(self.out).digest()
        self.out += b"trailer\n" + value_bytes({"Size": self.next, "Root": root, "Info": info, "ID": [first_id or own, own]})
        self.out += b"\nstartxref\n%d\n%%%%EOF\n" % at
        return bytes(self.out)

    def finish_pages(self, tree: Ref, pages: list[Ref], first_id: bytes | None = None, stamp: str = STAMP) -> bytes:
        self.add(tree, {"Type": Name("Pages"), "Kids": pages, "Count": len(pages)})
        root = self.add(self.allocate(), {"Type": Name("Catalog"), "Pages": tree})
        return self.finish(root, first_id, stamp)
