"""Quotations of documents in Arrow batches: a document is read and its fields and items found in one pass. The steps and
their results are those of ``quotes``."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..codec import bulk
from .batches import BLANK
from .lines import LINE_TOLERANCE

# The texts that quotations are known by.
COMPLETE = ("quantity", "product code", "suppliers code", "product description", "unit price", "total price", "list price", "cost price", "selling price")
ENDINGS = ("code", "price", "name", "description")
FOOTERS, FOOTERS_LEFT = ("Quote Expiry", "Pricing:", "Total:", "Quote Total:"), ("Logistics Charge:", "Delivery Charge:")
SUPPLIERS = ("Suppliers Code", "Suppliers")
Y_TOLERANCE, WRAP, FAR = 2.0, 15.0, 50.0
FIELDS = ("company", "quote_name", "quotation_ref", "issue_date", "quote_expiry", "estimator", "contact_name")
NUMBER = re.compile(r"[0-9.]+")


class Span(NamedTuple):
    """Spans of a line are in order by x and seq. trimmed: the text without white space at its ends."""

    x: float
    seq: int
    y: float
    end_x: float
    size: float
    text: str
    trimmed: str


Pages = list[tuple[int, list[Span]]]


# Fields


def page_lines(spans: list[Span]) -> Iterator[str]:
    """The texts of lines.build_lines of a page."""
    line: list[Span] = []
    top = 0.0
    for s in sorted(spans, key=itemgetter(2), reverse=True):  # those of one height stay in content order
        if not line or abs(top - s[2]) > LINE_TOLERANCE:
            if line:
                yield line_text(line)
            line, top = [], s[2]
        line.append(s)
    if line:
        yield line_text(line)


def line_text(spans: list[Span]) -> str:
    if len(spans) == 1:
        return spans[0].text
    out, end = [], -1.0
    for x, _, _, end_x, size, text, _ in sorted(spans):
        if end >= 0:
            gap, unit = x - end, max(2.0, size * 0.25)
            out.append(" " * max(1, int(min(10.0, gap / unit))) if gap > unit else " " if gap > 0.5 else "")
        end = end_x if end_x > x else x + len(text) * size * 0.5
        out.append(text)
    return "".join(out)


def after(text: str, label: str) -> str | None:
    at = text.find(label)
    return None if at < 0 else text[at + len(label) :].strip(BLANK)


def between(text: str, label: str, *stops: str) -> str | None:
    at = text.find(label)
    if at < 0:
        return None
    out = text[at + len(label) :]
    for stop in stops:
        end = out.find(stop)
        out = out[:end] if end > 0 else out
    return out.strip(BLANK)


def header_fields(pages: Pages) -> list[str]:
    """quotes.header_fields of a document."""
    found: dict[str, str] = {}
    for _, spans in pages:
        texts = list(page_lines(spans))
        for i, text in enumerate(texts):
            if ":" not in text:  # every label has one
                continue
            below = texts[i + 1].strip(BLANK) if i + 1 < len(texts) else ""
            here_or_below = lambda label: below if (own := after(text, label)) == "" else own  # noqa: B023, E731
            values = (
                between(text, "Company:", "Estimator:"),
                after(text, "Quote Name:"),
                here_or_below("Quotation Ref:"),
                here_or_below("Issue Date:"),
                (after(text, "Quote Expiry:") or "").removeprefix("Quote is valid until "),
                between(text, "Estimator:", "Estimator Tel:", "Contact"),
                between(text, "Contact Name:", "Estimator"),
            )
            for k, v in zip(FIELDS, values, strict=True):
                if v and k not in found:
                    found[k] = v
    return [found.get(k, "") for k in FIELDS]


# Items


class Columns(NamedTuple):
    names: tuple[str, ...]
    known: list[tuple[str, float]]
    prices: list[tuple[str, float]]
    found: dict[float, str]  # what column_of has given


@lru_cache(maxsize=1024)
def columns_of(names: tuple[str, ...], x: tuple[float, ...]) -> Columns:
    kinds = [kind_of(t) for t in names]
    last = dict(zip(kinds, x, strict=True))
    prices = [(t, at) for t, at, k in zip(names, x, kinds, strict=True) if k == "price"]
    return Columns(names, [(k, last.get(k, 0.0)) for k in ("qty", "prod", "supp", "desc")], prices, {})


def kind_of(name: str) -> str:
    low = name.lower()
    if low == "quantity":
        return "qty"
    for start, kind in (("product c", "prod"), ("supplier", "supp"), ("product d", "desc")):
        if low.startswith(start):
            return kind
    return "price" if "price" in low or "cost" in low else ""


def header_of(spans: list[Span]) -> tuple[float, Columns] | None:
    """quotes.whole_pages: where the header of a page ends, and its columns."""
    suppliers = [s.y for s in spans if s.trimmed in SUPPLIERS]
    quantities = [s.y for s in spans if s.trimmed == "Quantity"] if suppliers else []
    top = next((y for y in suppliers if any(abs(q - y) <= Y_TOLERANCE for q in quantities)), None)
    if top is None:
        return None
    heads = sorted((s.x, s.seq, s.trimmed) for s in spans if abs(s.y - top) <= Y_TOLERANCE and s.trimmed != "")
    named, x = [t for _, _, t in heads], tuple(x for x, _, _ in heads)
    y = top
    if any(t.lower() not in COMPLETE for t in named):
        under = [s for s in spans if Y_TOLERANCE < top - s.y < WRAP]
        for at, _, word in sorted((s.x, s.seq, s.trimmed) for s in under if s.trimmed.lower() in ENDINGS):
            best = min(((at - x[i], i) for i, t in enumerate(named) if t.lower() not in COMPLETE and at - x[i] >= 0), default=None)
            if best:
                named[best[1]] += " " + word
        y = min([top, *(s.y for s in under)])
    return y, columns_of(tuple(named), x)


def column_of(x: float, h: Columns) -> str:
    if x not in h.found:
        if len(h.found) >= 4096:
            h.found.clear()
        h.found[x] = nearest_column(x, h)
    return h.found[x]


def nearest_column(x: float, h: Columns) -> str:
    every = [c for c in h.known + h.prices if c[1] != 0]
    best = min(((abs(x - at), i) for i, (_, at) in enumerate(every)), default=None)
    if best and best[0] <= FAR:
        return every[best[1]][0]
    (_, _), (_, prod), (_, supp), (_, desc) = h.known
    return "qty" if x < prod else "prod" if x < supp else "supp" if x < desc else "desc"


def table_rows(pages: Pages) -> tuple[list[str] | None, list[tuple[dict[str, str], dict[str, str], str]]]:
    """(names of the first header, rows): quotes.table_rows of a document; a row has the texts of the four columns, those
    of prices, and its label."""
    out, names, header, closed = [], None, None, False
    for _, spans in pages:
        own = header_of(spans)
        header = own[1] if own else header
        if own and names is None:
            names = list(own[1].names)
        if header is None:
            continue
        leaders: dict[float, list[Span]] = {}
        below = own[0] - Y_TOLERANCE if own else np.inf
        for s in spans:
            y = s[2]
            if own and not y < below:
                continue
            row = leaders.get(y)
            if row is None:
                row = next((r for at, r in leaders.items() if abs(y - at) < Y_TOLERANCE), None)
                if row is None:
                    row = leaders[y] = []
            row.append(s)
        if not leaders:
            continue
        left = header.known[0][1] + 10
        if own:
            closed = False
        ended = False
        for y in sorted(leaders, reverse=True):
            row = leaders[y]
            if any(s.trimmed.startswith(FOOTERS) or s.x < left and s.trimmed.startswith(FOOTERS_LEFT) for s in row):
                ended = True
                break
            if not closed and (cells := row_cells(row, header)):
                out.append(cells)
        closed = closed or ended
    return names, out


def row_cells(row: list[Span], header: Columns) -> tuple[dict[str, str], dict[str, str], str] | None:
    four, prices, every = {"qty": "", "prod": "", "supp": "", "desc": ""}, {}, []
    for s in sorted(row):
        text = s.trimmed
        if text != "":
            column = column_of(s.x, header)
            cells = four if column in four else prices
            before = cells.get(column, "")
            cells[column] = f"{before} {text}" if before else text
            every.append(text)
    return (four, prices, " ".join(every)) if any(four.values()) else None


def appended(a: str, b: str) -> str:
    return a if b == "" else b if a == "" else a + b if a.endswith(("-", "/")) else f"{a} {b}"


def line_items(rows: list[tuple[dict[str, str], dict[str, str], str]]) -> list[list]:
    """[item_no, quantity, product_code, supplier_code, description, category, prices] of quotes.line_items."""
    out: list[list] = []
    category = ""
    for four, prices, label in rows:
        coded = four["prod"] != "" or four["supp"] != ""
        if coded and NUMBER.fullmatch(four["qty"].strip(BLANK)):
            out.append([len(out), four["qty"], four["prod"], four["supp"], four["desc"], category, prices])
        elif coded and four["qty"] == "" and out:
            i = out[-1]
            i[2], i[3] = appended(i[2], four["prod"]), appended(i[3], four["supp"])
            i[4] = " ".join(t for t in (i[4], four["desc"]) if t != "")
        else:
            category = label
    return out


def codes_of(items: list[list]) -> list[str]:
    """The codes of items in order, each once; hyphens and notes are none."""
    return list(dict.fromkeys(i[3] for i in items if i[3] not in ("", "-") and not i[3].strip(BLANK).upper().startswith("NOTE")))


# Batches

ITEM = "item_no bigint, quantity string, product_code string, supplier_code string, description string, category string"
SCHEMAS = {
    "fields": ", ".join(f"{k} string" for k in FIELDS),
    "items": f"{ITEM}, prices map<string,string>",
    "codes": "code_no bigint, code string",
    "quotes": ", ".join(f"{k} string" for k in FIELDS) + f", headers array<string>, line_items array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>, supplier_codes array<string>",
}
TEXT = pa.string()
ITEM_TYPES = [("item_no", pa.int64()), *((k, TEXT) for k in ("quantity", "product_code", "supplier_code", "description", "category"))]
ARROW = {
    "fields": [(k, TEXT) for k in FIELDS],
    "items": [*ITEM_TYPES, ("prices", pa.map_(TEXT, TEXT))],
    "codes": [("code_no", pa.int64()), ("code", TEXT)],
    "quotes": [*((k, TEXT) for k in FIELDS), ("headers", pa.list_(TEXT)), ("line_items", pa.list_(pa.struct(ITEM_TYPES))), ("supplier_codes", pa.list_(TEXT))],
}
ITEM_NAMES = [k for k, _ in ITEM_TYPES]


def rows_of(what: str, pages: Pages) -> list[tuple | list]:
    """The rows that a document gives to the table of that name."""
    if what == "fields":
        return [header_fields(pages)]
    names, rows = table_rows(pages)
    items = line_items(rows)
    if what == "items":
        return [(*i[:6], list(i[6].items())) for i in items]
    codes = codes_of(items)
    if what == "codes":
        return list(enumerate(codes))
    return [(*header_fields(pages), names or [], [dict(zip(ITEM_NAMES, i, strict=False)) for i in items] or None, codes)]


def documents(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[tuple[int, Pages]]]]:
    """(doc_id, documents): of each document with spans its place in doc_id and its pages, spans in content order."""
    for b in batches:
        for ids, pages in bulk.parts(b):
            at, seq, found = bulk.columns(pages)
            cut = np.searchsorted(at, np.arange(len(pages) + 1)).tolist()
            x, y, end_x, size = (found[k].to_numpy().tolist() for k in ("x", "y", "end_x", "font_size"))
            text, other = found["text"].to_pylist(), pc.utf8_trim(found["text"], BLANK)
            trimmed = text if other.equals(found["text"]) else other.to_pylist()
            spans = list(map(Span, x, seq.tolist(), y, end_x, size, text, trimmed))
            some = (i for i in range(len(pages)) if cut[i + 1] > cut[i])
            yield ids, [(doc, [(pages[i].number, spans[cut[i] : cut[i + 1]]) for i in own]) for doc, own in groupby(some, key=lambda i: pages[i].doc)]


def kernel(what: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # what is made here has no cycles, and is much
        try:
            for ids, docs in documents(batches):
                doc, rows = [], []
                for place, pages in docs:
                    own = rows_of(what, pages)
                    rows += own
                    doc += [place] * len(own)
                columns = zip(*rows, strict=True) if rows else [()] * len(ARROW[what])
                made = {k: pa.array(list(v), t) for (k, t), v in zip(ARROW[what], columns, strict=True)}
                yield pa.RecordBatch.from_pydict({"doc_id": ids.take(pa.array(doc, pa.int64()))} | made)
        finally:
            gc.enable()

    return run
