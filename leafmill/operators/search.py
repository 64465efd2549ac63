"""Where a text stands on the pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lines import build_lines


def positions(text: Column, query: str) -> Column:
    """Code points before each occurrence, from left to right and without overlap."""
    parts = F.transform(F.split(text, "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1), lambda p: F.length(p))
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.aggregate(F.slice(parts, 1, k), F.lit(0), lambda a, n: a + n) + (k - 1) * len(query))


def box(x: Column, y: Column, end: Column, size: Column) -> Column:
    return F.struct(x.alias("x"), (y - size * 0.2).alias("y"), (end - x).alias("width"), (size * 1.2).alias("height"))


def in_spans(spans: DataFrame, query: str) -> DataFrame:
    """Hits inside single spans; each character of a span is as wide as any other."""
    hit = spans.where(F.col("text").contains(query)).withColumn("at", F.explode(positions(F.col("text"), query)))
    each = (F.col("end_x") - F.col("x")) / F.greatest(F.length("text"), F.lit(1))
    x = F.col("x") + F.col("at") * each
    return hit.select("doc_id", "page", F.lit(0).alias("kind"), F.col("span_seq").alias("place"), "at", box(x, F.col("y"), x + len(query) * each, F.col("font_size")).alias("rect"), "font_size")


HIT = "struct<kind:int,place:int,at:int,rect:struct<x:double,y:double,width:double,height:double>,font_size:double>"


def span_hits(spans: Column, query: str) -> Column:
    """The hits inside single spans of a line, as in_spans finds them."""

    def own(s: Column) -> Column:
        each = (s["end_x"] - s["x"]) / F.greatest(F.length(s["text"]), F.lit(1))

        def hit(at: Column) -> Column:
            x = s["x"] + at * each
            return F.struct(F.lit(0).alias("kind"), s["span_seq"].alias("place"), at.alias("at"), box(x, s["y"], x + len(query) * each, s["font_size"]).alias("rect"), s["font_size"].alias("font_size"))

        return F.transform(positions(s["text"], query), hit)

    return F.flatten(F.transform(F.filter(spans, lambda s: s["text"].contains(query)), own))


def line_hits(line_no: Column, y: Column, text: Column, spans: Column, query: str) -> Column:
    """The hits in the text of a line, also across spans. Characters are counted over the spans alone."""
    each = lambda s: F.when((F.length(s["text"]) > 0) & (s["end_x"] > s["x"]), (s["end_x"] - s["x"]) / F.length(s["text"])).otherwise(s["font_size"] * 0.5)
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("x"), F.lit(0.0).alias("size"), F.lit(None).cast("double").alias("end"), F.lit(False).alias("done"))

    def place(at: Column) -> Column:
        stop = at + len(query)

        def step(acc: Column, s: Column) -> Column:
            n = acc["n"] + F.length(s["text"])
            begins = acc["x"].isNull() & (at < n)
            x = F.when(begins, s["x"] + (at - acc["n"]) * each(s)).otherwise(acc["x"])
            ends = ~acc["done"] & x.isNotNull() & (stop <= n)
            end = F.when(acc["done"], acc["end"]).when(ends, s["x"] + (stop - acc["n"]) * each(s)).when(x.isNotNull(), s["end_x"]).otherwise(acc["end"])
            return F.struct(n.alias("n"), x.alias("x"), F.when(begins, s["font_size"]).otherwise(acc["size"]).alias("size"), end.alias("end"), (acc["done"] | ends).alias("done"))

        return F.struct(at.alias("at"), F.aggregate(spans, start, step).alias("r"))

    found = F.filter(F.transform(positions(text, query), place), lambda h: h["r"]["end"] > h["r"]["x"])
    return F.transform(found, lambda h: F.struct(F.lit(1).alias("kind"), line_no.cast("int").alias("place"), h["at"].alias("at"), box(h["r"]["x"], y, h["r"]["end"], h["r"]["size"]).alias("rect"), spans[0]["font_size"].alias("font_size")))


def search(spans: DataFrame, query: str) -> DataFrame:
    """(doc_id, page, hit_no, text, rect, font_size): hits in spans, then those in lines that no earlier hit of the page
    is within a point of, both ways. A line has all its spans, so one pass over the lines finds both."""
    lines = build_lines(spans)
    if query:
        every = F.concat(span_hits(F.col("spans"), query), line_hits(F.col("line_no"), F.col("y"), F.col("text"), F.col("spans"), query))
        here = lines.where(F.col("text").contains(query) | F.exists("spans", lambda s: s["text"].contains(query)))
    else:
        every, here = F.array().cast(f"array<{HIT}>"), lines.where("false")
    page = here.select("doc_id", "page", every.alias("own")).groupBy("doc_id", "page").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("all"))

    def step(acc: Column, h: Column) -> Column:
        near = F.exists(acc, lambda k: (F.abs(k["rect"]["x"] - h["rect"]["x"]) < 1) & (F.abs(k["rect"]["y"] - h["rect"]["y"]) < 1))
        return F.when((h["kind"] == 1) & near, acc).otherwise(F.array_append(acc, h))

    kept = page.select("doc_id", "page", F.posexplode(F.aggregate("all", F.slice("all", 1, 0), step)).alias("hit_no", "h"))
    return kept.select("doc_id", "page", "hit_no", F.lit(query).alias("text"), "h.rect", "h.font_size")


def document_order(hits: DataFrame) -> DataFrame:
    """Hits numbered through each document."""
    return hits.withColumn("doc_hit_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "hit_no")) - 1)
