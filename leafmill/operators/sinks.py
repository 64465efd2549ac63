"""PDF documents out of tables: drawing, merging, editing. One document is one task's work; documents run side by side."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..codec import bulk, compose, draw
from ..codec.images import Image
from ..codec.writer import STAMP
from ..options import MergeOptions
from .batches import codes, ordered, whole
from .spread import spread

DOCUMENTS_AT_ONCE, ROWS_AT_ONCE, MERGES_AT_ONCE = 4096, 20_000, 256
DOCUMENT = pa.schema([("doc_id", pa.string()), ("content", pa.binary())])


def _documents(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], schema=DOCUMENT)


def sent(docs: DataFrame) -> DataFrame:
    """(doc_id, content) for a join by doc_id that deals documents out: what their size is estimated at comes from the rows
    they are made of, so that Spark would take large contents for a small table and broadcast them."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "content").hint("merge")


def create_pdf(ops: DataFrame, stamp: str = STAMP) -> DataFrame:
    """(doc_id, content) of drawing operations (doc_id, page, op_seq, op, args, text, width, height); pages are as wide
    and high as their first operation says, 612 by 792 where it does not."""
    op = F.struct("page", "op_seq", "op", "args", "text", F.coalesce("width", F.lit(612.0)).alias("width"), F.coalesce("height", F.lit(792.0)).alias("height"))
    docs = spread(ops.withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(op)).alias("ops"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, DOCUMENTS_AT_ONCE):
                some = b.slice(at, DOCUMENTS_AT_ONCE)
                n = pc.list_value_length(some["ops"]).to_numpy()
                ops = some["ops"].flatten()
                doc = np.repeat(np.arange(len(n)), n)
                page = pc.fill_null(ops.field("page"), np.iinfo(np.int32).min).to_numpy()
                new = np.flatnonzero(bulk.changed(doc, page)) if len(doc) else doc
                width, height = (ops.field(k).take(pa.array(new)).to_pylist() for k in ("width", "height"))
                yield _drawn(some["doc_id"], doc[new], list(zip(width, height, bulk.contents(new, ops), strict=True)), stamp)

    return docs.mapInArrow(run, "doc_id string, content binary")


def _drawn(ids: pa.Array, doc: np.ndarray, pages: list[tuple[float, float, tuple[bytes, dict[str, str]]]], stamp: str) -> pa.RecordBatch:
    """A document for each of ids; doc: that of each page."""
    cut = np.searchsorted(doc, np.arange(len(ids) + 1)).tolist()
    made = [draw.document([(w, h, *c) for w, h, c in pages[a:b]], stamp) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.RecordBatch.from_arrays([ids, pa.array(made, pa.binary())], schema=DOCUMENT)


def create_text_pdf(rows: DataFrame, width: float = 612.0, height: float = 792.0, stamp: str = STAMP) -> DataFrame:
    """create_pdf(text_ops(...)) of rows (doc_id, page, texts array<struct<op_seq, x, y, text>>), a row some texts of a page.
    The rows of a document stand together in one partition; they are neither dealt nor sorted by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole(batches, ("doc_id",), ROWS_AT_ONCE):
            t = t.combine_chunks()
            texts, key = t["texts"].combine_chunks(), t["doc_id"].combine_chunks()
            first = np.flatnonzero(bulk.changed(codes(key)))
            n = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.cumsum(bulk.changed(codes(key))) - 1, n)
            page = np.repeat(pc.fill_null(t["page"].combine_chunks(), np.iinfo(np.int32).min).to_numpy().astype(np.int64), n)
            op = texts.flatten()
            seq, x, y = (pc.cast(op.field(k), pa.float64()).to_numpy(zero_copy_only=False) for k in ("op_seq", "x", "y"))
            keys = [doc, page, seq]
            order = np.lexsort(keys[::-1])
            if not bulk.changed(*(k[order] for k in keys)).all():
                order = ordered(pc.fill_null(op.field("text"), ""), [*keys, x, y])
            doc, page = doc[order], page[order]
            new = np.flatnonzero(bulk.changed(doc, page)) if len(doc) else doc
            made = bulk.text_contents(new, x[order], y[order], op.field("text").take(pa.array(order))) if len(doc) else []
            pages = [(width, height, (c, {"F1": "Helvetica"})) for c in made]
            some = doc[new][bulk.changed(doc[new])] if len(doc) else doc
            yield _drawn(key.take(pa.array(first[some])), np.searchsorted(some, doc[new]), pages, stamp)

    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page"), "texts").mapInArrow(run, "doc_id string, content binary")


def text_ops(texts: DataFrame, font: str | None = None, size: float = 12.0) -> DataFrame:
    """Drawing operations of texts (doc_id, page, op_seq, x, y, text)."""
    args = F.array(F.col("x").cast("double"), F.col("y").cast("double"))
    own = texts.select(F.col("doc_id").cast("string").alias("doc_id"), "page", F.col("op_seq").cast("int").alias("op_seq"), F.lit("text").alias("op"), args.alias("args"), "text", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    if font is None:
        return own
    first = own.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(-1).alias("op_seq"), F.lit("font").alias("op"), F.array(F.lit(size)).alias("args"), F.lit(font).alias("text"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    return own.unionByName(first)


def merge_documents(docs: DataFrame, selections: DataFrame, opts: MergeOptions | None = None, stamp: str = STAMP) -> DataFrame:
    """(merge_id, data, total_pages, included_pages, oversize, size, max_size, error) of selections (merge_id, src_no,
    doc_id, pages): pages array<int> from 0, those below zero from the end, null: all. A merge with a source that is not
    among the documents, or without content, has an error and no data. A document is sent once to each merge that
    wants it, however often its pages are chosen there."""
    return merge_under(docs, selections, [opts or MergeOptions()], stamp).drop("policy")


def merge_under(docs: DataFrame, selections: DataFrame, options: list[MergeOptions], stamp: str = STAMP) -> DataFrame:
    """merge_documents under each of the options, with its policy, a row each: documents are made, sent and opened once."""
    own = selections.select(F.col("merge_id").cast("string").alias("merge_id"), "src_no", F.col("doc_id").cast("string").alias("doc_id"), "pages")
    own = own.groupBy("merge_id", "doc_id").agg(F.collect_list(F.struct("src_no", "pages")).alias("chosen"))
    own = own.join(sent(docs), "doc_id", "left")
    each = spread(own, "merge_id").groupBy("merge_id").agg(F.collect_list(F.struct("doc_id", "chosen", "content")).alias("sources"))
    schema = pa.schema([("merge_id", pa.string()), ("data", pa.binary()), ("total_pages", pa.int32()), ("included_pages", pa.int32()), ("oversize", pa.bool_()), ("size", pa.int64()), ("max_size", pa.int64()), ("error", pa.string()), ("policy", pa.string())])

    def opened(sources: list[dict]) -> compose.Merge:
        missing = sorted(str(s["doc_id"]) for s in sources if s["content"] is None)
        if missing:
            raise ValueError(f"no such source: {', '.join(missing)}")
        parts = sorted(((c["src_no"], c["pages"] is not None, c["pages"] or [], s["doc_id"], s["content"]) for s in sources for c in s["chosen"]), key=lambda p: p[:4])
        return compose.Merge([(content, pages if some else None) for _, some, pages, _, content in parts], stamp)

    def every(key: str, sources: list[dict]) -> Iterator[tuple]:
        try:
            whole, broken = opened(sources), None
        except Exception as e:  # a broken source is a row, not a failed task
            whole, broken = None, e
        for o in options:
            try:
                if broken:
                    raise broken
                m = whole.under(o.max_size, o.policy)
                yield key, m.data, m.total_pages, m.included_pages, False, len(m.data), o.max_size, None, o.policy
            except compose.Oversize as e:
                yield key, None, e.total, e.included, True, e.size, e.limit, str(e), o.policy
            except Exception as e:
                yield key, None, None, None, False, None, o.max_size, str(e) or type(e).__name__, o.policy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, MERGES_AT_ONCE):
                some = b.slice(at, MERGES_AT_ONCE)
                rows = [r for k, s in zip(some["merge_id"].to_pylist(), some["sources"].to_pylist(), strict=True) for r in every(k, s)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return each.mapInArrow(run, "merge_id string, data binary, total_pages int, included_pages int, oversize boolean, size long, max_size long, error string, policy string")


EDITS = "doc_id string, page int, edit_seq int, kind string, args array<double>, text string, image struct<width:int,height:int,rgb:binary,alpha:binary>"


def redactions(hits: DataFrame, rgb: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Edits that fill the places of search hits."""
    args = F.array(*[F.col(f"rect.{k}") for k in ("x", "y", "width", "height")], *map(F.lit, rgb))
    return hits.select("doc_id", "page", F.col("hit_no").alias("edit_seq"), F.lit("redact").alias("kind"), args.alias("args"), F.lit(None).cast("string").alias("text"), _no_image())


def text_overlays(texts: DataFrame, rgb: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Edits that draw texts (doc_id, page, edit_seq, x, y, text, font_size); a size of 0 means 12."""
    size = F.when(F.col("font_size") > 0, F.col("font_size")).otherwise(12.0)
    args = F.array(F.col("x").cast("double"), F.col("y").cast("double"), size, *map(F.lit, rgb))
    return texts.select("doc_id", "page", "edit_seq", F.lit("text").alias("kind"), args.alias("args"), "text", _no_image())


def image_stamps(places: DataFrame) -> DataFrame:
    """Edits that draw images (doc_id, page, edit_seq, cx, cy, width, height, rotation, opacity, image); without an image, nothing."""
    args = F.array(*[F.col(k).cast("double") for k in ("cx", "cy", "width", "height", "rotation", "opacity")])
    return places.where("image is not null").select("doc_id", "page", "edit_seq", F.lit("stamp").alias("kind"), args.alias("args"), F.lit(None).cast("string").alias("text"), "image")


def _no_image() -> Column:
    return F.lit(None).cast("struct<width:int,height:int,rgb:binary,alpha:binary>").alias("image")


def stamp_places(pages: DataFrame, width: int, height: int, rotation: float = 45.0, scale: float = 0.85, skip_first: int = 0, skip_last: int = 0) -> DataFrame:
    """(doc_id, page, cx, cy, width, height) of a stamp in the middle of each page, as large as fits; the first and last
    pages may be skipped. Pages turned by a right angle count as wide as they are high."""
    box = lambda i: F.get("media_box", F.lit(i))
    turned = F.pmod("rotate", F.lit(180)) == 90
    w, h = box(2) - box(0), box(3) - box(1)
    wide, high = F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)
    t = math.radians(rotation)
    c, s, aspect = abs(math.cos(t)), abs(math.sin(t)), height / width
    size = F.least(wide * scale / (c + aspect * s), high * scale / (s + aspect * c))
    n = F.count("*").over(Window.partitionBy("doc_id"))
    return pages.withColumn("n", n).where((F.col("page") >= skip_first) & (F.col("page") < F.col("n") - skip_last)).select("doc_id", "page", (box(0) + wide / 2).alias("cx"), (box(1) + high / 2).alias("cy"), size.alias("width"), (size * aspect).alias("height"))


def apply_edits(docs: DataFrame, edits: DataFrame, stamp: str = STAMP) -> DataFrame:
    """(doc_id, content) of documents with their edits drawn over the pages; documents without edits are left out."""
    each = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("kind", "page", "edit_seq", "args", "text"))).alias("edits"), F.array_sort(F.collect_list(F.when(F.col("image").isNotNull(), F.struct("page", "edit_seq", "image")))).alias("images"))
    own = sent(docs).join(each, "doc_id")

    def one(data: bytes, edits: list[dict], images: list[dict]) -> bytes:
        known: dict[Image, Image] = {}
        pictures = {(x["page"], x["edit_seq"]): known.setdefault(i := Image(*(x["image"][k] for k in ("width", "height", "rgb", "alpha"))), i) for x in images}
        reds, texts, stamps = [], [], []
        for e in edits:
            v = e["args"]
            if e["kind"] == "redact":
                reds.append(compose.Redaction(e["page"], *v[:4], tuple(v[4:7])))
            elif e["kind"] == "text":
                texts.append(compose.Overlay(e["page"], v[0], v[1], e["text"] or "", v[2], tuple(v[3:6])))
            else:
                stamps.append(compose.Stamp(e["page"], pictures[e["page"], e["edit_seq"]], *v[:6]))
        return compose.edit(data, reds, texts, stamps, stamp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _documents([(d, one(c, e, i)) for d, c, e, i in zip(b["doc_id"].to_pylist(), b["content"].to_pylist(), b["edits"].to_pylist(), b["images"].to_pylist(), strict=True)])

    return own.mapInArrow(run, "doc_id string, content binary")


def overlay(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """As apply_edits, with documents without edits as they are."""
    done = apply_edits(docs, edits)
    rest = sent(docs).join(edits.select("doc_id").distinct(), "doc_id", "left_anti")
    return done.unionByName(rest)
