"""Spans to rows, and rows to cells.

A sheet is one page, or one document, with its rows in an array: (keys, rows array<struct<page, row_no, y, spans>>),
spans array<struct<x, end_x, font_size, text>> from left to right. Sheets come out of one exchange on their keys; what
follows works on the arrays, or with windows and sums on keys that start with the same columns, and needs no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import leader_clusters, nearest, spaced, span_end
from ..functions.text import is_all_numeric, trim
from ..options import ANCHOR_CLUSTER, COLUMN_SPACING, TableOpts
from .spread import spread

PAGE = ("doc_id", "page")


def sheets(spans: DataFrame, y_tol: float = 2.0) -> DataFrame:
    """Pages as sheets. In content order, a span with a text joins the first row whose first span is nearer than the
    tolerance; rows go from the top down."""
    real = spans.withColumn("text", trim(F.col("text"))).where(F.col("text") != "")
    page = spread(real, *PAGE).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("span_seq", "y", "x", "end_x", "font_size", "text"))).alias("s"))
    page = page.withColumn("c", F.explode(F.array(leader_clusters(F.transform("s", lambda e: e["y"]), y_tol))))
    members = lambda n: F.array_sort(F.transform(F.filter(F.arrays_zip("s", F.col("c.which").alias("which")), lambda z: z["which"] == n), lambda z: F.struct(z["s"]["x"].alias("x"), z["s"]["span_seq"].alias("span_seq"), z["s"]["end_x"].alias("end_x"), z["s"]["font_size"].alias("font_size"), z["s"]["text"].alias("text"))))
    rows = F.array_sort(F.transform("c.leaders", lambda y, i: F.struct((-y).alias("down"), members(i + 1).alias("spans"))))
    page = page.select(*PAGE, F.explode(F.array(rows)).alias("r"))
    return page.select(*PAGE, F.transform("r", lambda r, i: F.struct(F.col("page").alias("page"), i.alias("row_no"), (-r["down"]).alias("y"), r["spans"].alias("spans"))).alias("rows"))


def group_rows(spans: DataFrame, y_tol: float = 2.0) -> DataFrame:
    """(doc_id, page, row_no, y, pos, x, end_x, text), a span each."""
    row = sheets(spans, y_tol).select(*PAGE, F.explode("rows").alias("r"))
    return row.select(*PAGE, "r.row_no", "r.y", F.posexplode("r.spans").alias("pos", "s")).select(*PAGE, "row_no", "y", "pos", "s.x", "s.end_x", "s.text")


def starts(rows: Column) -> Column:
    """(v, page, row_no) of every span of rows: where it starts."""
    return F.flatten(F.transform(rows, lambda r: F.transform(r["spans"], lambda s: F.struct(s["x"].alias("v"), r["page"].alias("page"), r["row_no"].alias("row_no")))))


def gaps(rows: Column, over: float) -> Column:
    """(v, page, row_no) of every gap of more than ``over`` points between neighbours in a row: its middle."""

    def of(r: Column) -> Column:
        end = lambda s: span_end(s["x"], s["end_x"], s["text"], s["font_size"])
        pair = F.transform(r["spans"], lambda s, i: F.struct(end(s).alias("a"), F.get(r["spans"], i + 1)["x"].alias("b")))
        return F.transform(F.filter(pair, lambda p: p["b"] - p["a"] > over), lambda p: F.struct(((p["a"] + p["b"]) / 2).alias("v"), r["page"].alias("page"), r["row_no"].alias("row_no")))

    return F.flatten(F.transform(rows, of))


def with_clusters(df: DataFrame, values: Column, tolerance: float, name: str) -> DataFrame:
    """Adds array ``name`` of (x, support, rows): leaders of the values in order, and which rows each cluster has."""
    out = df.withColumn("_v", F.explode(F.array(values)))
    out = out.withColumn("_c", F.explode(F.array(leader_clusters(F.transform("_v", lambda e: e["v"]), tolerance))))
    own = lambda n: F.array_distinct(F.transform(F.filter(F.arrays_zip("_v", F.col("_c.which").alias("which")), lambda z: z["which"] == n), lambda z: F.struct(z["_v"]["page"].alias("page"), z["_v"]["row_no"].alias("row_no"))))
    found = F.transform("_c.leaders", lambda x, i: F.struct(x.alias("x"), own(i + 1).alias("rows")))
    out = out.withColumn("_f", F.explode(F.array(found)))
    return out.withColumn(name, F.array_sort(F.transform("_f", lambda c: F.struct(c["x"].alias("x"), F.size(c["rows"]).alias("support"), c["rows"].alias("rows"))))).drop("_v", "_c", "_f")


def well_kept(clusters: Column, threshold: Column) -> Column:
    """Clusters with that support, well apart."""
    return spaced(F.filter(clusters, lambda c: c["support"] >= threshold), COLUMN_SPACING)


def cluster_x(spans: DataFrame, tolerance: float = ANCHOR_CLUSTER, y_tol: float = 2.0) -> DataFrame:
    """(doc_id, page, x, support): where spans of a page start, and in how many rows."""
    found = with_clusters(sheets(spans, y_tol), starts(F.col("rows")), tolerance, "c")
    return found.select(*PAGE, F.explode("c").alias("c")).select(*PAGE, "c.x", "c.support")


def column_gaps(spans: DataFrame, over: float = 10.0, y_tol: float = 2.0) -> DataFrame:
    """(doc_id, page, row_no, mid) of each gap."""
    return sheets(spans, y_tol).select(*PAGE, F.explode(gaps(F.col("rows"), over)).alias("g")).select(*PAGE, "g.row_no", F.col("g.v").alias("mid"))


def zones(columns: Column, anchors: Column) -> Column:
    """Each anchor named by the first column in its zone, which ends half way to the next anchors; anchors without a
    name are left out."""

    def named(a: Column, i: Column) -> Column:
        lo, hi = ((F.get(anchors, k)["x"] + a["x"]) / 2 for k in (i - 1, i + 1))
        inside = F.filter(columns, lambda c: (lo.isNull() | (c["x"] >= lo)) & (hi.isNull() | (c["x"] < hi)))
        return F.struct(F.get(inside, F.lit(0))["name"].alias("name"), a["x"].alias("x"))

    return F.filter(F.transform(anchors, named), lambda c: c["name"].isNotNull())


def remapped(df: DataFrame, data: Column) -> DataFrame:
    """``columns`` moved to where the rows ``data`` stand, if three or more of them form as many well-kept starts as there
    are columns and no column is lost."""
    out = with_clusters(df.withColumn("_n", F.size(data)), starts(data), ANCHOR_CLUSTER, "_k")
    out = out.withColumn("_a", F.explode(F.array(well_kept(F.col("_k"), F.greatest(F.lit(3), (F.col("_n") / 10).cast("int"))))))
    out = out.withColumn("_z", F.explode(F.array(zones(F.col("columns"), F.col("_a")))))
    use = (F.col("_n") >= 3) & (F.size("_a") >= F.size("columns")) & (F.size("_z") >= F.size("columns"))
    return out.withColumn("columns", F.when(use, F.col("_z")).otherwise(F.col("columns"))).drop("_n", "_k", "_a", "_z")


# Rows to cells. Rows here are (keys, columns, row_no, y, spans), a row each.


def merge_close(rows: DataFrame, gap: Column, keys: tuple[str, ...]) -> DataFrame:
    """(keys, columns, row_no, y, bottom, spans): rows less than a gap below the one before join it; a gap of 0 is off."""
    w = Window.partitionBy(*keys).orderBy("row_no")
    apart = F.coalesce((gap <= 0) | (F.lag("y").over(w) - F.col("y") >= gap), F.lit(True))
    marked = rows.withColumn("apart", apart.cast("int")).withColumn("row", F.sum("apart").over(w) - 1)
    spans = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "spans"))), lambda r: F.transform(r["spans"], lambda s, i: F.struct(s["x"].alias("x"), r["row_no"].alias("r"), i.alias("i"), s["text"].alias("text")))))
    return marked.groupBy(*keys, "row").agg(F.first("columns").alias("columns"), F.max("y").alias("y"), F.min("y").alias("bottom"), F.array_sort(spans).alias("spans")).withColumnRenamed("row", "row_no")


def cut_after_gap(rows: DataFrame, gap: Column, keys: tuple[str, ...]) -> DataFrame:
    """Rows up to the first that starts more than a gap below the end of the one before; a gap of 0 is off."""
    w = Window.partitionBy(*keys).orderBy("row_no")
    far = F.coalesce((gap > 0) & (F.lag("bottom").over(w) - F.col("y") > gap), F.lit(False))
    return rows.withColumn("far", far.cast("int")).withColumn("cut", F.max("far").over(w)).where("cut = 0").drop("far", "cut")


def in_cells(columns: Column, spans: Column) -> Column:
    """The texts of a row by column: spans go to the nearest, in order of x."""
    return F.transform(columns, lambda c, i: F.array_join(F.transform(F.filter(spans, lambda s: nearest(s["x"], columns) == i), lambda s: s["text"]), " "))


def column_at(name: str, columns: Column) -> Column:
    """The number, from 0, of the first column of a name in either case; -1 if there is none."""
    return F.array_position(F.transform(columns, lambda c: F.lower(c["name"])), name.lower()).cast("int") - 1


def merge_by_anchor(cells: DataFrame, name: str, keys: tuple[str, ...]) -> DataFrame:
    """Rows without a text in the anchor column end the row before if the next column has a text that is no number;
    other such rows are dropped, but the first row stays. Without such a column nothing changes."""
    w = Window.partitionBy(*keys).orderBy("row_no")
    at = column_at(name, F.col("columns"))
    own, following = F.coalesce(F.get("cells", at), F.lit("")), F.coalesce(F.get("cells", at + 1), F.lit(""))
    marked = cells.withColumns({"lead": (at < 0) | (own != "") | (F.row_number().over(w) == 1), "more": (following != "") & ~is_all_numeric(following)})
    marked = marked.withColumn("group", F.sum(F.col("lead").cast("int")).over(w)).where("lead or more")
    joined = marked.groupBy(*keys, "group").agg(F.min("row_no").alias("row_no"), F.max("y").alias("y"), F.first("columns").alias("columns"), F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("all"))
    text = lambda i: F.array_join(F.filter(F.transform("all", lambda r: F.get(r["cells"], i)), lambda t: t != ""), " ")
    return joined.select(*keys, "row_no", "y", "columns", F.transform("columns", lambda c, i: text(i)).alias("cells"))


def data_rows(rows: DataFrame, opts: TableOpts, keys: tuple[str, ...]) -> DataFrame:
    """(keys, row_no, y, columns, cells): merge, cut, cells, filters and the anchor merge, in this order."""
    out = cut_after_gap(merge_close(rows, F.lit(float(opts.merge_gap)), keys), F.lit(float(opts.max_row_gap)), keys)
    return filtered(out.select(*keys, "row_no", "y", "columns", in_cells(F.col("columns"), F.col("spans")).alias("cells")), opts, keys)


def filtered(out: DataFrame, opts: TableOpts, keys: tuple[str, ...]) -> DataFrame:
    """Rows of cells after the filters and the anchor merge."""
    if opts.row_filter is not None:
        out = out.where(opts.row_filter)
    out = out.where(F.exists("cells", lambda c: c != ""))
    if opts.require_any_column:
        wanted = F.filter(F.array(*[column_at(n, F.col("columns")) for n in opts.require_any_column]), lambda i: i >= 0)
        out = out.where((F.size(wanted) == 0) | F.exists(wanted, lambda i: F.get("cells", i) != ""))
    return merge_by_anchor(out, opts.anchor_column, keys) if opts.anchor_column else out
