"""Pages and spans of PDF documents, parsed in Arrow batches. A file's document key is its whole path, as files in two
folders may have one name."""

from __future__ import annotations

from collections.abc import Iterator
from glob import glob
from os.path import isfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from .. import schemas
from ..codec import bulk, images
from ..codec.interpret import page_images, page_spans
from ..codec.reader import Reader

SPANS_IN_BATCH = 20_000
ARROW_SPANS = pa.schema([("doc_id", pa.string()), ("page", pa.int32()), ("span_seq", pa.int32()), *((n, pa.float64()) for n in ("x", "y", "end_x", "font_size")), ("font", pa.string()), ("text", pa.string())])
ARROW_PAGES = pa.schema([("doc_id", pa.string()), ("page", pa.int32()), ("media_box", pa.list_(pa.float64())), ("rotate", pa.int32()), ("n_spans", pa.int32()), ("error", pa.string())])


def keyed_files(files: DataFrame) -> DataFrame:
    """(doc_id, name, content) of binary files: the whole path, and its last part."""
    return files.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(doc_id, name, content) of all files below a path."""
    return keyed_files(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path))


IMAGE = "width int, height int, rgb binary, alpha binary"
ARROW_IMAGE = [("width", pa.int32()), ("height", pa.int32()), ("rgb", pa.binary()), ("alpha", pa.binary())]


def _image_columns(found: list[images.Image | None]) -> list[pa.Array]:
    return [pa.array([x and getattr(x, name) for x in found], kind) for name, kind in ARROW_IMAGE]


def _from_rows(data: bytes, height: int, width: int, channels: int) -> images.Image:
    """Of rows of blue, green, red and opacity, or of grey alone."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    rgba = np.full((height, width, 4), 255, np.uint8)
    rgba[..., :3] = x[..., [2, 1, 0]] if channels >= 3 else x[..., :1]
    if channels == 4:
        rgba[..., 3] = x[..., 3]
    return images.from_rgba(rgba)


def read_image_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, rgb, alpha) of PNG and JPEG files, decoded by Spark's image source."""
    image = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*").select(F.col("origin").alias("path"), "height", "width", "nChannels", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b["data"].to_pylist(), *(b[c].to_pylist() for c in ("height", "width", "nChannels")), strict=True)
            yield pa.RecordBatch.from_arrays([b["path"], *_image_columns([_from_rows(*r) for r in rows])], ["path", *(n for n, _ in ARROW_IMAGE)])

    return image.mapInArrow(run, f"path string, {IMAGE}")


def decode_png(files: DataFrame) -> DataFrame:
    """(doc_id, width, height, rgb, alpha, error) of PNG bytes (doc_id, content), interlaced ones too."""

    def one(data: bytes | None) -> tuple[images.Image | None, str | None]:
        try:
            return images.read_png(data or b""), None
        except Exception as e:  # any damage is a row, not a failed task
            return None, str(e) or type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(x) for x in b["content"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *_image_columns([i for i, _ in found]), pa.array([e for _, e in found], pa.string())], ["doc_id", *(n for n, _ in ARROW_IMAGE), "error"])

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, f"doc_id string, {IMAGE}, error string")


def pages_of(data: bytes | None, glyphs: dict[str, str] | None = None) -> Iterator[tuple[int, list[float], int, list, str | None]]:
    """(page, box, rotation, spans, error) of a document; one row with page null if it cannot be opened."""
    try:
        reader = Reader(data or b"", glyphs)
        pages = reader.pages()
    except Exception as e:  # any damage is a row, not a failed task
        yield None, None, None, [], str(e) or type(e).__name__
        return
    for i, page in enumerate(pages):
        try:
            spans, error = page_spans(reader, page), None
        except Exception as e:
            spans, error = [], str(e) or type(e).__name__
        yield i, reader.media_box(page), reader.rotation(page), spans, error


def _span_rows(doc: str, data: bytes | None, wanted: set[int] | None = None, glyphs: dict[str, str] | None = None) -> Iterator[tuple]:
    for page, _, _, spans, _ in pages_of(data, glyphs):
        if page is not None and (wanted is None or page in wanted):
            for k, s in enumerate(spans):
                yield doc, page, k, s.x, s.y, s.end_x, s.font_size, s.font, s.text


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    have: list[tuple] = []
    for r in rows:
        have.append(r)
        if len(have) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*have, strict=True), schema, strict=True)], schema=schema)
            have = []
    if have:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*have, strict=True), schema, strict=True)], schema=schema)


def extract_spans(docs: DataFrame, pages: list[int] | None = None, glyphs: dict[str, str] | None = None) -> DataFrame:
    """Spans of documents (doc_id, content); pages: only these; glyphs: texts of more glyph names (sources.glyphs)."""
    wanted = set(pages) if pages is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bulk.span_batches(batches, glyphs, wanted):
            for at in range(0, b.num_rows, SPANS_IN_BATCH):
                yield b.slice(at, SPANS_IN_BATCH)

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, schemas.SPANS)


def extract_pages(docs: DataFrame) -> DataFrame:
    """Pages of documents (doc_id, content), with what went wrong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, pages in bulk.parts(b):
                at, _, _ = bulk.columns(pages)
                many = np.bincount(at, minlength=len(pages))
                rows = zip(ids.take(pa.array([p.doc for p in pages], pa.int64())).to_pylist(), pages, many.tolist(), strict=True)
                yield from _batches(((doc, p.number, p.box, p.turn, n, p.error) for doc, p, n in rows), ARROW_PAGES)

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, schemas.PAGES)


ARROW_IMAGES = pa.schema([("doc_id", pa.string()), ("page", pa.int32()), ("image_no", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("matrix", pa.list_(pa.float64())), ("opacity", pa.float64()), ("rgb", pa.binary()), ("alpha", pa.binary())])


def _image_rows(doc: str, data: bytes | None) -> Iterator[tuple]:
    try:
        reader = Reader(data or b"")
        for i, page in enumerate(reader.pages()):
            for k, x in enumerate(page_images(reader, page)):
                yield doc, i, k, *x
    except Exception:  # extract_pages tells what is wrong with a document
        return


def extract_images(docs: DataFrame) -> DataFrame:
    """Images drawn on the pages of documents (doc_id, content): where, how opaque, and their samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = (r for doc, data in zip(b["doc_id"].to_pylist(), b["content"].to_pylist(), strict=True) for r in _image_rows(doc, data))
            yield from _batches(rows, ARROW_IMAGES, 64)

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, schemas.IMAGES)


def extract_metadata(docs: DataFrame) -> DataFrame:
    """(doc_id, n_pages, n_objects, trailer_keys, original_id, error)."""
    schema = pa.schema([("doc_id", pa.string()), ("n_pages", pa.int32()), ("n_objects", pa.int32()), ("trailer_keys", pa.list_(pa.string())), ("original_id", pa.string()), ("error", pa.string())])

    def one(doc: str, data: bytes | None) -> tuple:
        try:
            r = Reader(data or b"")
            ids = r.array(r.trailer.get("ID"))
            return doc, len(r.pages()), len(r.places), sorted(r.trailer), ids[0].hex() if ids and isinstance(ids[0], bytes) else None, None
        except Exception as e:
            return doc, None, None, None, None, str(e) or type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _batches((one(d, x) for d, x in zip(b["doc_id"].to_pylist(), b["content"].to_pylist(), strict=True)), schema)

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, "doc_id string, n_pages int, n_objects int, trailer_keys array<string>, original_id string, error string")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    """One partition a file; equalities on page are applied while reading, all of them."""

    def __init__(self, options: dict):
        self.options, self.pages = options, None

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  the interface's name
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("page",):
                self.pages = {f.value} if self.pages is None else self.pages & {f.value}
            else:
                yield f

    def partitions(self):
        return [_File(p) for p in sorted(glob(self.options["path"].removeprefix("file:").replace("//", "/"))) if isfile(p)]

    def read(self, partition: _File):
        with open(partition.path, "rb") as f:
            yield from _span_rows(f"file:{partition.path}", f.read(), self.pages)


class PdfSource(DataSource):
    """``spark.read.format("pdf_spans").load(glob)`` over files that every node reaches by their path; for object
    stores use ``read_files`` and ``extract_spans``."""

    @classmethod
    def name(cls) -> str:
        return "pdf_spans"

    def schema(self) -> str:
        return schemas.SPANS

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """The data source, and SQL table functions pdf_spans(content) and pdf_pages(content)."""
    from pyspark.sql.functions import udtf

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PdfSource)

    @udtf(returnType="page int, span_seq int, x double, y double, end_x double, font_size double, font string, text string")
    class PdfSpans:
        def eval(self, content: bytes):
            for r in _span_rows("", content):
                yield r[1:]

    @udtf(returnType="page int, media_box array<double>, rotate int, n_spans int, error string")
    class PdfPages:
        def eval(self, content: bytes):
            for i, box, turn, spans, error in pages_of(content):
                yield i, box, turn, len(spans), error

    spark.udtf.register("pdf_spans", PdfSpans)
    spark.udtf.register("pdf_pages", PdfPages)
