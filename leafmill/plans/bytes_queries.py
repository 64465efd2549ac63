"""Queries that go through PDF bytes."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codec.scan import Name, Stream
from ..codec.writer import Writer
from ..operators import lines, sinks
from ..operators.tables import find_table
from ..options import TableOpts
from ..sources.pdf import extract_metadata, extract_pages, extract_spans
from .layouts import INVOICE_SQL, LINES_SQL, as_invoice, invoice_spans, invoices, lines_together, packed_paged_texts, table

HEADERS = TableOpts(headers=("Part", "Supplier"))


def invoice_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_invoice(find_table(invoice_spans(spark, sf_dir), HEADERS))


def invoice_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = invoice_roundtrip(spark, sf_dir)
    return rows.groupBy("l_orderkey").agg(F.round(F.sum(F.col("price").cast("decimal(18,2)")), 2).cast("double").alias("revenue"), F.count("*").alias("n_lines"))


def paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.create_text_pdf(packed_paged_texts(lines_together(spark, sf_dir)))


def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_pages(paged_documents(spark, sf_dir)).where("error is null")
    return pages.groupBy(F.col("doc_id").cast("long").alias("l_orderkey")).agg(F.count("*").alias("n_pages"))


def page_media_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_pages(invoices(spark, sf_dir))
    return pages.groupBy(F.element_at("media_box", 3).alias("width"), F.element_at("media_box", 4).alias("height"), "rotate").agg(F.count("*").alias("n"))


def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_metadata(invoices(spark, sf_dir))
    return found.select(F.col("doc_id").cast("long").alias("l_orderkey"), "n_pages", F.array_join("trailer_keys", ",").alias("keys"))


def _broken(batches):
    for b in batches:
        yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"].cast(pa.string()), "content": pa.array([(t or "").encode() for t in b["text"].to_pylist()], pa.binary())})


def broken_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are no PDF files give a row with an error each."""
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    pages = extract_pages(texts.mapInArrow(_broken, "doc_id string, content binary"))
    return pages.select(F.col("doc_id").cast("long").alias("item_id"), F.col("page").isNull().alias("no_page"), F.col("error").isNotNull().alias("failed"))


def spans_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of parts in Courier 10: each character 6 points."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("op_seq"), F.lit(72.0).alias("x"), F.lit(700.0).alias("y"), F.col("p_name").alias("text"))
    spans = extract_spans(sinks.create_pdf(sinks.text_ops(part, "Courier", 10.0)))
    return spans.select(F.col("doc_id").cast("long").alias("p_partkey"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("end_x", 3).alias("end_x"), "font_size", "text")


# Encodings of the same text that the drawing operations never write


def _filtered(kind: str, data: bytes) -> tuple[bytes, list]:
    import base64

    if kind == "hex":
        return data.hex().encode() + b">", [Name("ASCIIHexDecode")]
    if kind == "ascii85":
        return base64.a85encode(data) + b"~>", [Name("ASCII85Decode")]
    if kind == "both":
        return base64.a85encode(zlib.compress(data)) + b"~>", [Name("ASCII85Decode"), Name("FlateDecode")]
    return _lzw(data), [Name("LZWDecode")]


def _lzw(data: bytes) -> bytes:
    """LZW codes as the filter reads them, widening one code early."""
    table, out, have, count, width = {bytes([i]): i for i in range(256)}, bytearray(), 0, 0, 9
    nxt = 258

    def put(code: int) -> None:
        nonlocal have, count
        have, count = have << width | code, count + width
        while count >= 8:
            out.append(have >> count - 8 & 255)
            count -= 8

    put(256)
    word = b""
    for i in range(len(data)):
        c = data[i : i + 1]
        if word + c in table:
            word += c
            continue
        put(table[word])
        table[word + c] = nxt
        nxt += 1
        if nxt + 1 > 4095:
            put(256)
            table, nxt, width = {bytes([i]): i for i in range(256)}, 258, 9
        else:
            width = max(9, nxt.bit_length())
        word = c
    if word:
        put(table[word])
        nxt += 1
        width = max(9, min(12, nxt.bit_length()))
    put(257)
    if count:
        out.append(have << 8 - count & 255)
    return bytes(out)


def _encoded(kind: str, text: str) -> bytes:
    """A document of one text: behind stream filters; by a ToUnicode map; in a form; or with packed objects and a
    cross-reference stream."""
    w = Writer()
    tree = w.allocate()
    font: dict = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}
    raw = text.encode("ascii", "replace")
    show = b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"
    resources: dict = {}
    if kind == "cmap":
        codes = sorted(set(raw))
        body = b"%d beginbfchar\n" % len(codes) + b"".join(b"<%04x> <%04x>\n" % (0x100 + i, c) for i, c in enumerate(codes)) + b"endbfchar\n"
        font = {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Own"), "ToUnicode": w.add_stream(w.allocate(), {}, body), "DescendantFonts": [{"DW": 500, "W": [0, [500]]}]}
        show = b"<" + b"".join(b"%04x" % (0x100 + codes.index(c)) for c in raw) + b">"
    content = b"BT /F1 12 Tf 72 700 Td " + show + b" Tj ET"
    resources["Font"] = {"F1": font}
    if kind == "form":
        form = w.add_stream(w.allocate(), {"Type": Name("XObject"), "Subtype": Name("Form"), "Resources": dict(resources), "Matrix": [1, 0, 0, 1, 10, 20]}, content)
        content, resources = b"q 1 0 0 1 5 5 cm /X Do Q", {"XObject": {"X": form}}
    entries: dict = {}
    if kind in ("hex", "ascii85", "both", "lzw"):
        data, names = _filtered(kind, content)
        body = w.add(w.allocate(), Stream({"Filter": names}, data))
    else:
        body = w.add_stream(w.allocate(), entries, content)
    page = {"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 0, 612, 792], "Contents": body, "Resources": resources}
    if kind != "xref_stream":
        return w.finish_pages(tree, [w.add(w.allocate(), page)])
    page_ref, root = w.allocate(), w.allocate()
    packed = [(page_ref, page), (tree, {"Type": Name("Pages"), "Kids": [page_ref], "Count": 1}), (root, {"Type": Name("Catalog"), "Pages": tree})]
    from ..codec.writer import value_bytes

    bodies = [value_bytes(x) for _, x in packed]
    starts = [sum(len(b) + 1 for b in bodies[:i]) for i in range(len(bodies))]
    head = b" ".join(b"%d %d" % (r.num, s) for (r, _), s in zip(packed, starts, strict=True)) + b" "
    holder = w.allocate()
    w.add_stream(holder, {"Type": Name("ObjStm"), "N": len(packed), "First": len(head)}, head + b" ".join(bodies))
    own = w.allocate()
    at = len(w.out)
    w.places[own.num] = at
    inside = {r.num: i for i, (r, _) in enumerate(packed)}
    rows = b"".join((b"\2" + holder.num.to_bytes(4, "big") + bytes([inside[i]])) if i in inside else (b"\1" + w.places[i].to_bytes(4, "big") + b"\0") if i in w.places else b"\0" * 6 for i in range(w.next))
    step = b"".join(b"\2" + bytes((a - b) & 255 for a, b in zip(rows[i : i + 6], rows[i - 6 : i] if i else bytes(6), strict=True)) for i in range(0, len(rows), 6))
    w.add(own, Stream({"Type": Name("XRef"), "Size": w.next, "W": [1, 4, 1], "Root": root, "Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": 6}}, zlib.compress(step)))
    return bytes(w.out) + b"startxref\n%d\n%%%%EOF\n" % at


def _encoding(kind: str):
    def make(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"].cast(pa.string()), "content": pa.array([_encoded(kind, t or "") for t in b["text"].to_pylist()], pa.binary())})

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.regexp_replace("text", "[^ -~]", "?").alias("text"))
        spans = extract_spans(items.mapInArrow(make, "doc_id string, content binary"))
        return spans.select(F.col("doc_id").cast("long").alias("item_id"), F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), "text")

    return query


def _encoding_sql(x: float = 72.0, y: float = 700.0) -> str:
    return f"SELECT item_id, {x}::DOUBLE AS x, {y}::DOUBLE AS y, regexp_replace(text, '[^ -~]', '?', 'g') AS text FROM benchmark"


def document_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, a turn a line and 30 a page, read back as the text of the document."""
    turns = table(spark, sf_dir, "conversations")
    line = F.regexp_replace("text", "[ \\n\\t\\r]+", " ")
    texts = turns.select(F.col("conv_id").cast("string").alias("doc_id"), F.floor(F.col("turn") / 30).cast("int").alias("page"), F.col("turn").cast("int").alias("op_seq"), F.lit(40.0).alias("x"), (700 - 20 * (F.col("turn") % 30)).cast("double").alias("y"), F.concat("role", F.lit(": "), line).alias("text"))
    spans = extract_spans(sinks.create_pdf(sinks.text_ops(texts)))
    return lines.document_text(lines.build_lines(spans)).select(F.col("doc_id").cast("long").alias("conv_id"), "text")


TURNS_SQL = "SELECT conv_id, string_agg(role || ': ' || regexp_replace(text, '[ \\n\\t\\r]+', ' ', 'g'), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"

QUERIES = {
    "invoice_roundtrip": (invoice_roundtrip, INVOICE_SQL),
    "invoice_revenue": (invoice_revenue, "SELECT l_orderkey, round(sum(cast(printf('%.2f', l_extendedprice) AS DECIMAL(18,2))), 2)::DOUBLE AS revenue, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey"),
    "page_count": (page_count, "SELECT l_orderkey, cast(ceil(count(*) / 3.0) AS BIGINT) AS n_pages FROM lineitem GROUP BY l_orderkey"),
    "page_media_box": (page_media_box, "SELECT 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, 0 AS rotate, count(DISTINCT l_orderkey) AS n FROM lineitem"),
    "document_metadata": (document_metadata, "SELECT DISTINCT l_orderkey, 1 AS n_pages, 'ID,Info,Root,Size' AS keys FROM lineitem"),
    "broken_documents": (broken_documents, "SELECT item_id, true AS no_page, true AS failed FROM benchmark"),
    "text_spans": (spans_sizes, "SELECT p_partkey, 72.0::DOUBLE AS x, 700.0::DOUBLE AS y, (72.0 + 6 * length(p_name))::DOUBLE AS end_x, 10.0::DOUBLE AS font_size, p_name AS text FROM part"),
    "filters_hex": (_encoding("hex"), _encoding_sql()),
    "filters_ascii85": (_encoding("ascii85"), _encoding_sql()),
    "filters_chain": (_encoding("both"), _encoding_sql()),
    "filters_lzw": (_encoding("lzw"), _encoding_sql()),
    "cmap_decode": (_encoding("cmap"), _encoding_sql()),
    "form_xobject_text": (_encoding("form"), _encoding_sql(87.0, 725.0)),
    "xref_stream_read": (_encoding("xref_stream"), _encoding_sql()),
    "document_text": (document_text_roundtrip, TURNS_SQL),
}
