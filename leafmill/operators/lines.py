"""Spans to lines and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import span_end, top_down_lines
from .spread import spread

LINE_TOLERANCE = 1.0
SPAN = ("x", "span_seq", "y", "end_x", "font_size", "font", "text")


def spaces(gap: Column, size: Column) -> Column:
    """What stands between two spans: spaces in proportion to a gap over a quarter of the size, one to ten; one for a
    gap over half a point; else nothing."""
    unit = F.greatest(F.lit(2.0), size * 0.25)
    return F.when(gap > unit, F.repeat(F.lit(" "), F.greatest(F.lit(1), F.least(F.lit(10), (gap / unit).cast("int"))))).when(gap > 0.5, " ").otherwise("")


def line_text(spans: Column) -> Column:
    """The text of a line's spans, in order of x."""
    start = F.struct(F.lit(-1.0).alias("end"), F.lit("").alias("text"))

    def step(acc: Column, s: Column) -> Column:
        between = F.when(acc["end"] >= 0, spaces(s["x"] - acc["end"], s["font_size"])).otherwise("")
        return F.struct(span_end(s["x"], s["end_x"], s["text"], s["font_size"]).alias("end"), F.concat(acc["text"], between, s["text"]).alias("text"))

    return F.aggregate(spans, start, step, lambda acc: acc["text"])


def build_lines(spans: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, y, text, spans): a line holds what is within a point of its highest span."""
    page = spread(spans, "doc_id", "page").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("down"), "span_seq", "x", "y", "end_x", "font_size", "font", "text"))).alias("s"))
    page = page.withColumn("n", top_down_lines(F.transform("s", lambda e: -e["down"]), LINE_TOLERANCE))
    flat = page.select("doc_id", "page", F.explode(F.arrays_zip("s", "n")).alias("z")).select("doc_id", "page", F.col("z.n").alias("line_no"), "z.s.*")
    lines = flat.groupBy("doc_id", "page", "line_no").agg(F.max("y").alias("y"), F.array_sort(F.collect_list(F.struct(*SPAN))).alias("spans"))
    return lines.select("doc_id", "page", "line_no", "y", line_text(F.col("spans")).alias("text"), "spans")


def joined(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Texts of the keys in order, a line each."""
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: s["text"]), "\n").alias("text"))


def page_text(lines: DataFrame) -> DataFrame:
    return joined(lines, ["doc_id", "page"], "line_no")


def document_text(lines: DataFrame) -> DataFrame:
    return joined(page_text(lines), ["doc_id"], "page")
