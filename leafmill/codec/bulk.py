"""Many documents at once: contents that are texts in one font, written and read side by side.

What is written is what ``draw`` writes, byte for byte, and what is read is what ``interpret`` reads; pages of any other
content go there.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .draw import page_content, shortest
from .fonts import Font
from .interpret import page_spans
from .reader import Reader
from .scan import Name
from .writer import literal, name_bytes

SPECIAL = r"[()\\]|[^\x00-\x7f]"  # in a text that is not its own literal
SIMPLE = re.compile(rb"BT\n/([A-Za-z0-9]+) (\d+(?:\.\d+)?) Tf\n")
SHOWN = re.compile(rb"1 0 0 1 (-?\d+(?:\.\d+)?) (-?\d+(?:\.\d+)?) Tm\n\(([^()\\]*)\) Tj\n")
SIMPLE_FONT = {"Type", "Subtype", "BaseFont", "Encoding"}
BYTES_AT_ONCE = 16 << 20


def changed(*keys: np.ndarray) -> np.ndarray:
    """True where a run of equal keys begins."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


# Writing


def numbers(v: np.ndarray) -> pa.Array:
    each = pa.array(v).dictionary_encode()
    return pa.array([shortest(x) for x in each.dictionary.to_pylist()], pa.binary()).take(each.indices)


def literals(text: pa.Array) -> pa.Array:
    text = pc.fill_null(text, "")
    special = pc.match_substring_regex(text, SPECIAL)
    out = text.cast(pa.binary())
    if pc.any(special).as_py():
        out = pc.replace_with_mask(out, special, pa.array([literal(t) for t in text.filter(special).to_pylist()], pa.binary()))
    return out


def text_contents(start: np.ndarray, x: np.ndarray, y: np.ndarray, text: pa.Array, font_size: float | np.ndarray = 12.0) -> list[bytes]:
    """The content of each page, given where its texts start; all texts of a page are in its one font and size."""
    b = lambda s: pa.scalar(s, pa.binary())
    shown = pc.binary_join_element_wise(b(b"1 0 0 1 "), numbers(x), b(b" "), numbers(y), b(b" Tm\n("), literals(text), b(b") Tj\n"), b(b""))
    each = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(start, len(x)), pa.int32()), shown), b(b"")).to_pylist()
    size = np.broadcast_to(font_size, len(each)).tolist()
    return [b"BT\n/F1 %b Tf\n%bET\n" % (shortest(s), c) for s, c in zip(size, each, strict=True)]


def contents(page: np.ndarray, ops: pa.StructArray) -> list[tuple[bytes, dict[str, str]]]:
    """draw.page_content of each page; page: where the operations of each start, a font first or none."""
    kind, args, text = ops.field("op"), ops.field("args"), ops.field("text")
    n = len(kind)
    is_text, is_font = (pc.fill_null(pc.equal(kind, k), False).to_numpy(zero_copy_only=False) for k in ("text", "font"))
    many = pc.fill_null(pc.list_value_length(args), 0).to_numpy(zero_copy_only=False)
    first = np.zeros(n, bool)
    first[page] = True
    good = (is_text & (many >= 2)) | (is_font & first & (many >= 1))
    of_page = np.cumsum(first) - 1
    count = np.bincount(of_page, minlength=len(page))
    simple = np.ones(len(page), bool)
    np.logical_and.at(simple, of_page[~good], False)
    simple &= count > is_font[page]  # a page with a font alone has no content
    values, at = args.values.to_numpy(zero_copy_only=False), args.offsets.to_numpy()[:-1]
    if args.null_count or args.values.null_count:
        simple[:] = False
    bases, sizes = ["Helvetica"] * len(page), np.full(len(page), 12.0)
    for p in np.flatnonzero(simple & is_font[page]):
        bases[p], sizes[p] = text[int(page[p])].as_py() or "Helvetica", values[at[page[p]]]
    use = np.flatnonzero(is_text & simple[of_page])
    own = np.flatnonzero(changed(of_page[use])) if len(use) else use
    made = iter(text_contents(own, values[at[use]], values[at[use] + 1], text.take(pa.array(use)), sizes[simple]) if len(use) else [])
    out = []
    for p in range(len(page)):
        if simple[p]:
            out.append((next(made), {"F1": bases[p]}))
        else:
            rows = ops.slice(page[p], count[p]).to_pylist()
            out.append(page_content([(o["op"], o["args"] or [], o["text"]) for o in rows]))
    return out


# Reading


class Look(NamedTuple):
    """What a simple font makes of ASCII bytes: nothing but themselves; how wide each is in thousandths."""

    width: np.ndarray


LOOKS: dict[tuple, Look | None] = {}


def look_of(reader: Reader, entries: dict) -> Look | None:
    """Of a font that its name and encoding tell all of; None for others."""
    base, encoding = entries.get("BaseFont"), entries.get("Encoding")
    if not set(entries) <= SIMPLE_FONT or entries.get("Subtype") == "Type0" or not isinstance(base, Name) or not (encoding is None or isinstance(encoding, Name)):
        return None
    key = base, encoding
    if key not in LOOKS:
        if len(LOOKS) > 256:
            LOOKS.clear()
        font = Font(reader, entries)
        plain = all(font.text(bytes([i])) == chr(i) for i in range(128))
        LOOKS[key] = Look(np.array([font.width(i) / 1000 for i in range(128)])) if plain else None
    return LOOKS[key]


class Page(NamedTuple):
    """A page, or with number None a document that cannot be opened. Its texts are in spans, or else in shown, of each
    text after a first element its x, its y, itself, and an element more."""

    doc: int
    number: int | None
    box: list[float] | None
    turn: int | None
    error: str | None
    spans: list | None
    shown: list | None
    font: str
    size: float
    look: Look | None


def simple_page(reader: Reader, page: dict, doc: int, number: int, box: list[float], content: bytes) -> Page | None:
    m = SIMPLE.match(content)
    if not m or not content.isascii():
        return None
    name = m[1].decode()
    look = look_of(reader, reader.dict(reader.dict(reader.dict(page.get("Resources")).get("Font")).get(name)))
    if look is None:
        return None
    shown = SHOWN.split(content[m.end() :])
    if b"".join(shown[::4]) != b"ET\n":  # something else stands between the texts
        return None
    return Page(doc, number, box, 0, None, None, shown, name, float(m[2]), look)


def pages_of(doc: int, data: bytes | None, glyphs: dict[str, str] | None = None, wanted: set[int] | None = None) -> Iterator[Page]:
    try:
        reader = Reader(data or b"", glyphs)
        pages = reader.pages()
    except Exception as e:  # any damage is a row, not a failed task
        yield Page(doc, None, None, None, str(e) or type(e).__name__, [], None, "", 0.0, None)
        return
    for i, page in enumerate(pages):
        if wanted is not None and i not in wanted:
            continue
        box, turn = reader.media_box(page), reader.rotation(page)
        try:
            content = reader.content(page)
            simple = simple_page(reader, page, doc, i, box, content) if turn == 0 else None
            if simple:
                yield simple
                continue
            spans, error = page_spans(reader, page), None
        except Exception as e:
            spans, error = [], str(e) or type(e).__name__
        yield Page(doc, i, box, turn, error, spans, None, "", 0.0, None)


def lengths(data: np.ndarray, offs: np.ndarray, advance: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How far each text moves on: the sum over its bytes from the first to the last; advance: of each group's bytes."""
    out, todo, k = np.zeros(len(group)), np.flatnonzero(offs[1:] > offs[:-1]), 0
    while len(todo):
        out[todo] += advance[group[todo], data[offs[todo] + k]]
        k += 1
        todo = todo[offs[todo + 1] - offs[todo] > k]
    return out


SPAN = [*((n, pa.float64()) for n in ("x", "y", "end_x", "font_size")), ("font", pa.string()), ("text", pa.string())]


def columns(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
    """(page, seq, columns) of the spans of pages in order; page: its place in the list."""
    simple = [i for i, p in enumerate(pages) if p.shown is not None]
    at = np.repeat(np.array(simple, np.int64), [len(pages[i].shown) // 4 for i in simple])
    xs, ys, texts = (list(chain.from_iterable(pages[i].shown[k::4] for i in simple)) for k in (1, 2, 3))
    as_number = lambda v: np.array([], float) if not v else pa.array(v, pa.binary()).cast(pa.string()).dictionary_encode()
    value = lambda v: v if isinstance(v, np.ndarray) else np.array([float(t) for t in v.dictionary.to_pylist()])[v.indices.to_numpy()]
    x, y = value(as_number(xs)), value(as_number(ys))
    text = pa.array(texts, pa.binary())
    full = np.flatnonzero(pc.binary_length(text).to_numpy(zero_copy_only=False) > 0) if len(text) else np.zeros(0, np.int64)
    if len(full) < len(text):
        at, x, y, text = at[full], x[full], y[full], text.take(pa.array(full))
    kinds: dict[tuple, int] = {}
    kind = np.zeros(len(pages), np.int64)
    for i in simple:
        p = pages[i]
        kind[i] = kinds.setdefault((id(p.look), p.size, p.font), len(kinds))
    of = {kinds[id(p.look), p.size, p.font]: p for p in (pages[i] for i in simple)}
    advance = np.array([of[k].look.width * of[k].size for k in range(len(kinds))]).reshape(-1, 128)
    if len(text):
        offs, data = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1], np.frombuffer(text.buffers()[2], np.uint8)
        end = x + lengths(data, offs, advance, kind[at])
    else:
        end = x
    sizes, fonts = np.array([of[k].size for k in range(len(kinds))]), pa.array([of[k].font for k in range(len(kinds))], pa.string())
    out = {"x": pa.array(x), "y": pa.array(y), "end_x": pa.array(end), "font_size": pa.array(sizes[kind[at]] if len(at) else x), "font": fonts.take(pa.array(kind[at])) if len(at) else pa.array([], pa.string()), "text": text.cast(pa.string())}
    other = [(i, s) for i, p in enumerate(pages) if p.spans for s in p.spans]
    if other:
        rows = list(zip(*(s for _, s in other), strict=True))
        more = np.array([i for i, _ in other])
        order = np.argsort(np.append(at, more), kind="stable")
        out = {n: pa.concat_arrays([out[n], pa.array(v, t)]).take(pa.array(order)) for (n, t), v in zip(SPAN, rows, strict=True)}
        at = np.append(at, more)[order]
    new = np.flatnonzero(changed(at)) if len(at) else at
    seq = np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at))))
    return at, seq, out


def parts(batch: pa.RecordBatch, glyphs: dict[str, str] | None = None, wanted: set[int] | None = None) -> Iterator[tuple[pa.Array, list[Page]]]:
    """(doc_id, pages) of documents (doc_id, content), some of the batch at once; Page.doc is a place in doc_id."""
    pages: list[Page] = []
    size = 0
    for i, data in enumerate(content.as_py() for content in batch["content"]):
        pages += pages_of(i, data, glyphs, wanted)
        size += len(data or b"")
        if size >= BYTES_AT_ONCE:
            yield batch["doc_id"], pages
            pages, size = [], 0
    yield batch["doc_id"], pages


def span_batches(batches: Iterable[pa.RecordBatch], glyphs: dict[str, str] | None = None, wanted: set[int] | None = None) -> Iterator[pa.RecordBatch]:
    """Spans of documents (doc_id, content), whole documents at once."""
    for b in batches:
        for ids, pages in parts(b, glyphs, wanted):
            at, seq, found = columns(pages)
            doc = np.array([p.doc for p in pages], np.int64)[at] if len(at) else at
            number = np.array([-1 if p.number is None else p.number for p in pages], np.int64)[at] if len(at) else at
            yield pa.RecordBatch.from_pydict({"doc_id": ids.take(pa.array(doc)), "page": pa.array(number, pa.int32()), "span_seq": pa.array(seq, pa.int32())} | found)
