"""Jobs over folders."""

import os
import struct
import zlib

import pytest

from leafmill import jobs
from leafmill.codec import draw
from leafmill.codec.interpret import page_images, page_spans
from leafmill.codec.reader import Reader


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("in")
    for sub, n in (("a", 2), ("b", 3)):
        (at / sub).mkdir()
        rows = [("Item", "Quantity", "Price")] + [(f"thing{sub}{k}", str(k), f"{k}.50") for k in range(1, n + 1)]
        ops = [("text", [50 + 120 * c, 700 - 20 * r], t) for r, row in enumerate(rows) for c, t in enumerate(row)]
        (at / sub / "x.pdf").write_bytes(draw.create([(595, 842, ops)]))
    return at


def texts(path):
    r = Reader(open(path, "rb").read())
    return [[s.text for s in page_spans(r, p)] for p in r.pages()]


def test_tables_and_search(spark, folder, tmp_path):
    jobs.main(["tables", str(folder), f"{tmp_path}/t", "--headers", "Item,Quantity"], spark)
    rows = spark.read.parquet(f"{tmp_path}/t").collect()
    assert sorted(r["cells"][0] for r in rows) == ["thinga1", "thinga2", "thingb1", "thingb2", "thingb3"] and len({r["doc_id"] for r in rows}) == 2
    jobs.main(["tables", str(folder), f"{tmp_path}/l", "--headers", "Item,Quantity", "--lines"], spark)
    assert "thinga1         1   1.50" in {r["line"] for r in spark.read.parquet(f"{tmp_path}/l").collect()}
    jobs.main(["search", str(folder), f"{tmp_path}/s", "thingb3"], spark)
    assert spark.read.parquet(f"{tmp_path}/s").count() == 1


def test_merge_and_watermark(spark, folder, tmp_path):
    jobs.main(["merge", str(folder), f"{tmp_path}/m", "--files"], spark)
    assert [p[3] for p in texts(f"{tmp_path}/m/merged.pdf")] == ["thinga1", "thingb1"]
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    (tmp_path / "i.png").write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0\xff\0\0\x80\0\xff\0\xff")) + part(b"IEND", b""))
    jobs.main(["watermark", str(folder), f"{tmp_path}/w", f"{tmp_path}/i.png", "--files", "--opacity", "0.5"], spark)
    assert sorted(os.listdir(tmp_path / "w")) == ["2-x.pdf", "x.pdf"]
    r = Reader(open(f"{tmp_path}/w/x.pdf", "rb").read())
    image = page_images(r, r.pages()[0])[0]
    assert (image.rgb, image.alpha, image.opacity) == (b"\xff\0\0\0\xff\0", b"\x80\xff", 0.5)


def test_samples(spark, tmp_path):
    jobs.main(["sample", f"{tmp_path}/out", "--files"], spark)
    invoice, report = texts(f"{tmp_path}/out/invoice.pdf"), texts(f"{tmp_path}/out/report.pdf")
    assert invoice[0][0] == "Invoice" and invoice[0][-1] == "173.90" and [p[-1] for p in report] == ["1 / 3", "2 / 3", "3 / 3"]


def test_no_such_job():
    with pytest.raises(SystemExit):
        jobs.arguments(["nothing"])
