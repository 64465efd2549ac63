"""Files, the data source, SQL functions, streams, sinks and quotations on small documents."""

import numpy as np
import pytest

from leafmill import schemas
from leafmill.codec import draw
from leafmill.codec.scan import Name
from leafmill.operators import quotes, sinks
from leafmill.plans import codec_queries
from leafmill.sources import glyphs, pdf
from leafmill.streaming import files


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("pdfs")
    for name, texts in {"a.pdf": ["alpha widget", "second page"], "b.pdf": ["beta"]}.items():
        (at / name).write_bytes(draw.create([(612, 792, [("text", [72, 700], t)]) for t in texts]))
    (at / "broken.pdf").write_bytes(b"not a pdf")
    return str(at)


def test_files(spark, folder):
    docs = pdf.read_files(spark, folder)
    assert {(r["doc_id"], r["name"]) for r in docs.select("doc_id", "name").collect()} == {(f"file:{folder}/{n}", n) for n in ("a.pdf", "b.pdf", "broken.pdf")}
    docs = docs.withColumn("doc_id", docs["name"])
    spans = {(r["doc_id"], r["page"], r["text"]) for r in pdf.extract_spans(docs).collect()}
    assert spans == {("a.pdf", 0, "alpha widget"), ("a.pdf", 1, "second page"), ("b.pdf", 0, "beta")}
    assert {r["text"] for r in pdf.extract_spans(docs, pages=[1]).collect()} == {"second page"}
    pages = {(r["doc_id"], r["page"]): r for r in pdf.extract_pages(docs).collect()}
    assert pages["broken.pdf", None]["error"] and pages["a.pdf", 1]["n_spans"] == 1 and pages["a.pdf", 0]["media_box"] == [0, 0, 612, 792]
    assert {r["doc_id"]: r["n_pages"] for r in pdf.extract_metadata(docs).collect()} == {"a.pdf": 2, "b.pdf": 1, "broken.pdf": None}


def test_equal_names(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.pdf").write_bytes(draw.create([(612, 792, [("text", [72, 700], f"from {folder}")])]))
    spans = pdf.extract_spans(pdf.read_files(spark, str(tmp_path)))
    assert {(r["doc_id"], r["text"]) for r in spans.collect()} == {(f"file:{tmp_path}/{f}/x.pdf", f"from {f}") for f in ("a", "b")}
    pdf.register(spark)
    both = spark.read.format("pdf_spans").load(f"{tmp_path}/*/x.pdf")
    assert {r["doc_id"] for r in both.collect()} == {f"file:{tmp_path}/{f}/x.pdf" for f in ("a", "b")}
    assert both.where("page = 0 AND page = 2").count() == 0


def test_glyph_list(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# a list\nsnowman;2603\npair;0041 0301\nsnowman;2603 # again\n\n")
    found = glyphs.read_glyph_list(spark, str(tmp_path / "list.txt"))
    assert glyphs.glyph_texts(found) == {"snowman": "\u2603", "pair": "A\u0301"}
    names = spark.createDataFrame([("snowman",), ("eacute",), ("other",)], "g string")
    assert {r["g"]: r["text"] for r in glyphs.with_glyph_text(names, "g", found).collect()} == {"snowman": "\u2603", "eacute": "é", "other": "other"}
    font = {"Type": Name("Font"), "Subtype": Name("Type1"), "Encoding": {"Differences": [1, Name("snowman")]}}
    docs = spark.createDataFrame([("d", bytearray(codec_queries.one_page(b"BT /F1 9 Tf <01> Tj ET", {"F1": font})))], "doc_id string, content binary")
    assert pdf.extract_spans(docs).first()["text"] == "snowman" and pdf.extract_spans(docs, glyphs=glyphs.glyph_texts(found)).first()["text"] == "\u2603"


def test_data_source_and_functions(spark, folder):
    pdf.register(spark)
    df = spark.read.format("pdf_spans").load(f"{folder}/*.pdf")
    assert {r["text"] for r in df.where("page = 1").collect()} == {"second page"}
    pdf.read_files(spark, folder).createOrReplaceTempView("docs")
    assert spark.sql("SELECT doc_id, s.text FROM docs, LATERAL pdf_spans(content) s").count() == 3
    assert spark.sql("SELECT p.n_spans FROM docs, LATERAL pdf_pages(content) p WHERE p.page IS NOT NULL").count() == 3


def test_stream(spark, folder, tmp_path):
    files.write_hits(files.read_stream(spark, folder), "widget", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    hits = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(h["doc_id"], h["page"], h["text"]) for h in hits] == [(f"file:{folder}/a.pdf", 0, "widget")]


def test_image_files(spark, tmp_path):
    import struct
    import zlib

    pixels = np.random.default_rng(0).integers(0, 256, (3, 4, 4)).astype(np.uint8)
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = b"".join(b"\0" + r.tobytes() for r in pixels)
    (tmp_path / "i.png").write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))
    r = pdf.read_image_files(spark, str(tmp_path)).first()
    assert (r["width"], r["height"], bytes(r["rgb"]), bytes(r["alpha"])) == (4, 3, pixels[..., :3].tobytes(), pixels[..., 3].tobytes())


def test_empty_sinks(spark):
    none = spark.createDataFrame([], schemas.DRAW_OPS)
    assert sinks.create_pdf(none).count() == 0
    docs = spark.createDataFrame([("a", bytearray(draw.create([(612, 792, [("text", [72, 700], "x")])])))], "doc_id string, content binary")
    assert sinks.overlay(docs, spark.createDataFrame([], sinks.EDITS)).count() == 1


def test_quote_states(spark):
    """A page without a header goes on with the last one's columns until a footer; a footer ends a page's rows."""
    x = {"qty": 50, "prod": 120, "supp": 220, "desc": 320}
    head = [(0, x["qty"], 700, "Quantity"), (0, x["prod"], 700, "Product Code"), (0, x["supp"], 700, "Suppliers Code"), (0, x["desc"], 700, "Product Description")]
    row = lambda p, y, q, c, s, d: [(p, x[k], y, t) for k, t in zip(x, (q, c, s, d), strict=True) if t]
    cells = [*head, *row(0, 680, "", "", "", "BASIN"), *row(0, 660, "2", "P1", "S/", "tap"), *row(0, 640, "", "", "9", "long"), *row(1, 700, "1", "P2", "NOTE 1", "pipe"), (1, 50, 650, "Total: 5"), *row(1, 640, "3", "P3", "S3", "never"), *row(2, 700, "4", "P4", "S4", "never")]
    df = spark.createDataFrame([("q", p, i, float(a), float(y), float(a + 6 * len(t)), 12.0, "F", t) for i, (p, a, y, t) in enumerate(cells)], schemas.SPANS)
    got = [tuple(r) for r in quotes.line_items(df).drop("prices").orderBy("item_no").collect()]
    assert got == [("q", 0, "2", "P1", "S/9", "tap long", "BASIN"), ("q", 1, "1", "P2", "NOTE 1", "pipe", "BASIN")]
    one = quotes.extract_quotes(df).first()
    assert one["supplier_codes"] == ["S/9"] and one["headers"][0] == "Quantity" and "S/9" in quotes.report(quotes.extract_quotes(df)).first()["report"]


def test_stamp_places(spark):
    pages = spark.createDataFrame([("d", i, [0.0, 0.0, 500.0, 700.0], 90 * (i % 2), 0, None) for i in range(4)], schemas.PAGES)
    got = {r["page"]: r for r in sinks.stamp_places(pages, 100, 100, 0.0, 1.0, skip_first=1, skip_last=1).collect()}
    assert set(got) == {1, 2} and got[1]["cx"] == 350 and got[2]["cx"] == 250 and got[2]["width"] == 500


