"""Tables on pages: by header texts, by recurring gaps, by recurring starts of texts, and across pages.

A found table is (doc_id, page, table_no, row_no, y, columns, cells), a row each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import trim
from ..options import SAME_HEADER, WRAP_REACH, TableOpts
from .batches import FIELDS, Limits, Sheets, across, found, unpacked, whole
from .rows import PAGE, column_at, data_rows, filtered, remapped, sheets
from .spread import spread

KEYS = list(PAGE)
COLUMNS = "array<struct<name:string,x:double>>"


def barrier(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that later lambdas read without computing it anew."""
    return df.withColumn(name, F.explode(F.array(value)))


def without_twins(spans: Column) -> Column:
    """Spans but those with the text of an earlier one within a point."""

    def step(acc: Column, s: Column) -> Column:
        twin = F.exists(acc, lambda k: (F.abs(k["x"] - s["x"]) < SAME_HEADER) & (k["text"] == s["text"]))
        return F.when(twin, acc).otherwise(F.array_append(acc, s))

    return F.aggregate(spans, F.slice(spans, 1, 0), step)


def wrapped(heads: Column, below: Column, top: Column, y_tol: float, wrap_tol: float) -> Column:
    """(heads, lowest): single words in rows close below end the nearest header that has no space yet; rows are taken
    until one is out of reach, has no single word, or has more of them than there were headers without a space."""
    unfinished = F.size(F.filter(heads, lambda h: ~h["text"].contains(" ")))
    start = F.struct(heads.alias("heads"), top.alias("lowest"), (unfinished > 0).alias("on"))

    def place(acc: Column, w: Column) -> Column:
        far = lambda h: F.abs(w["x"] - h["x"])
        best = F.array_min(F.transform(acc, lambda h, i: F.when(~h["text"].contains(" ") & (far(h) < WRAP_REACH), F.struct(far(h).alias("d"), i.alias("i")))))
        return F.transform(acc, lambda h, i: F.struct(h["x"].alias("x"), F.when(i == best["i"], F.concat(h["text"], F.lit(" "), w["text"])).otherwise(h["text"]).alias("text")))

    def step(acc: Column, row: Column) -> Column:
        down = top - row["y"]
        single = F.filter(row["spans"], lambda s: ~s["text"].contains(" "))
        on = acc["on"] & (down >= y_tol) & (down <= wrap_tol) & (F.size(single) > 0) & (F.size(single) <= unfinished)
        return F.struct(F.when(on, F.aggregate(single, acc["heads"], place)).otherwise(acc["heads"]).alias("heads"), F.when(on, F.least(acc["lowest"], row["y"])).otherwise(acc["lowest"]).alias("lowest"), on.alias("on"))

    return F.aggregate(below, start, step, lambda acc: F.struct(acc["heads"].alias("heads"), acc["lowest"].alias("lowest")))


def x_and_text(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["x"].alias("x"), s["text"].alias("text")))


def with_header(pages: DataFrame, wanted: Column) -> DataFrame:
    """Adds first, last and heads where a page has a header: the topmost row that holds all wanted texts (an array in
    lower case), else the topmost such pair of neighbours. Of one row all spans are heads, of two those that hold a
    wanted text, by x."""
    out = barrier(pages, "_w", wanted)
    held = lambda s: F.forall("_w", lambda w: F.exists(s, lambda x: F.lower(x["text"]).contains(w)))
    fits = F.transform("rows", lambda r, i: F.struct(held(r["spans"]).alias("one"), (F.get("rows", i + 1).isNotNull() & held(F.concat(r["spans"], F.coalesce(F.get("rows", i + 1)["spans"], F.slice(r["spans"], 1, 0))))).alias("two")))
    out = barrier(out, "_f", fits)
    at = lambda k: F.array_min(F.filter(F.transform("_f", lambda f, i: F.when(f[k], i)), lambda i: i.isNotNull()))
    out = out.withColumn("_one", at("one")).withColumn("first", F.coalesce("_one", at("two"))).where("first is not null")
    out = out.withColumn("last", F.col("first") + F.col("_one").isNull().cast("int"))
    spans = lambda k: F.get("rows", F.col(k))["spans"]
    both = F.filter(F.concat(spans("first"), spans("last")), lambda s: F.exists("_w", lambda w: F.lower(s["text"]).contains(F.trim(w))))
    by_x = lambda a, b: F.when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).otherwise(0)
    heads = F.when(F.col("_one").isNotNull(), without_twins(x_and_text(spans("first")))).otherwise(F.array_sort(without_twins(x_and_text(both)), by_x))
    return out.withColumn("heads", heads).where(F.size("heads") > 0).drop("_w", "_f", "_one")


def with_data(located: DataFrame, opts: TableOpts) -> DataFrame:
    """Adds columns, as the header has them, and data, the rows below the header and what is wrapped under it."""
    top = F.get("rows", F.col("last"))["y"]
    below = F.filter("rows", lambda r: r["row_no"] > F.col("last"))
    out = barrier(located, "_h", wrapped(F.col("heads"), below, top, opts.y_tol, opts.wrap_tol) if opts.wrap_tol > 0 else F.struct(F.col("heads").alias("heads"), top.alias("lowest")))
    data = F.filter("rows", lambda r: (r["row_no"] > F.col("last")) & (r["y"] < F.col("_h.lowest") - opts.y_tol))
    return out.withColumns({"columns": as_columns(F.col("_h.heads")), "data": data}).drop("_h")


def as_columns(heads: Column) -> Column:
    return F.transform(heads, lambda h: F.struct(h["text"].alias("name"), h["x"].alias("x")))


def exploded(df: DataFrame, *keep: str) -> DataFrame:
    """The rows of ``data``, a row each, with columns and what else is kept."""
    return df.select(*keep, "columns", F.explode("data").alias("r")).select(*keep, "columns", "r.row_no", "r.y", "r.spans")


def numbered(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy(*KEYS).orderBy("row_no")
    return rows.select(*KEYS, F.lit(0).alias("table_no"), (F.row_number().over(w) - 1).alias("row_no"), "y", "columns", "cells")


def by_headers(spans: DataFrame, opts: TableOpts) -> DataFrame:
    """Tables under the first header of each page."""
    place = with_data(with_header(sheets(spans, opts.y_tol), lowered(opts.headers)), opts)
    return numbered(data_rows(exploded(remapped(place, F.col("data")), *KEYS), opts, PAGE))


def lowered(texts: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(t.lower()) for t in texts]) if texts else F.array().cast("array<string>")


def in_batches(spans: DataFrame, keys: tuple[str, ...], opts: TableOpts, make: Callable[[Sheets], pa.Table], schema: str, in_order: bool = False) -> DataFrame:
    """What the kernels of ``batches`` make of whole pages or documents, dealt by keys: one exchange and one sort; none
    for spans that are in_order (see across_pages)."""
    packed = in_order and dict(spans.dtypes)["text"].startswith("array")
    if packed:
        real = spans.select(*PAGE, *FIELDS)
    else:
        at = lambda c: F.ascii(c).between(33, 126)
        trimmed = F.when(at(F.col("text")) & at(F.substring("text", -1, 1)), F.col("text")).otherwise(trim(F.col("text")))
        real = spans.withColumn("text", trimmed).where(F.col("text") != "").withColumn("low", F.lower("text"))
        real = real.select(*PAGE, *FIELDS, F.when(F.col("low") != F.col("text"), F.col("low")).alias("low"))
    kinds = dict(real.dtypes)
    y_tol = opts.y_tol

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for t in whole(map(unpacked, batches) if packed else batches, keys):
            s = Sheets(t, y_tol)
            if in_order:
                if not s.follows(last):
                    raise ValueError("spans are not in order of their documents and pages")
                last = s.doc_id[-1]
            yield from make(s).to_batches()

    dealt = real if in_order else spread(real, *keys).sortWithinPartitions(*PAGE, "span_seq")
    return dealt.mapInArrow(run, f"doc_id {kinds['doc_id']}, page {kinds['page']}, {schema}")


def by_ways(spans: DataFrame, opts: TableOpts, *ways: str) -> DataFrame:
    """Tables of pages by the ways named: the first of them that finds any on a page."""
    lim = Limits.of(opts)
    out = in_batches(spans, PAGE, opts, lambda s: found(s, lim, ways), f"way int, table_no int, row_no int, y double, columns {COLUMNS}, cells array<string>")
    if not lim.chosen:  # rows go first, then what is left is numbered
        keys = (*PAGE, "way", "table_no")
        page = Window.partitionBy(*KEYS)
        out = filtered(out, opts, keys).withColumn("first", F.min("way").over(page)).where("way = first")
        out = out.withColumn("row_no", F.row_number().over(Window.partitionBy(*keys).orderBy("row_no")) - 1)
        out = out.withColumn("table_no", F.dense_rank().over(page.orderBy("table_no")) - 1)
    return out.select(*KEYS, "table_no", "row_no", "y", "columns", "cells")


def by_gaps(spans: DataFrame, opts: TableOpts) -> DataFrame:
    """Tables where rows in a row share recurring gaps; the first row of such a region is its header."""
    return by_ways(spans, opts, "gaps")


def by_anchors(spans: DataFrame, opts: TableOpts) -> DataFrame:
    """Tables under the row that puts header-like texts on most of the page's recurring starts."""
    return by_ways(spans, opts, "anchors")


def find_tables(spans: DataFrame, opts: TableOpts | None = None) -> DataFrame:
    """By headers if there are any in the options; else all tables by gaps and, on pages without one, by anchors."""
    opts = opts or TableOpts()
    return by_headers(spans, opts) if opts.headers else by_ways(spans, opts, "gaps", "anchors")


def find_table(spans: DataFrame, opts: TableOpts | None = None) -> DataFrame:
    """The first table of each page."""
    return find_tables(spans, opts).where("table_no = 0")


# Across pages


def shared_columns(pages: DataFrame, opts: TableOpts) -> DataFrame:
    """(doc_id, columns): the headers of the first page that has them, moved to where data stands on all such pages."""
    place = with_header(pages, lowered(opts.headers))
    below = place.select("doc_id", "page", as_columns(F.col("heads")).alias("columns"), F.filter("rows", lambda r: r["row_no"] > F.col("last")).alias("rows"))
    both = below.groupBy("doc_id").agg(F.min_by("columns", "page").alias("columns"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "rows"))), lambda p: p["rows"])).alias("rows"))
    return remapped(both, F.col("rows")).select("doc_id", "columns")


def across_pages(spans: DataFrame, opts: TableOpts, in_order: bool = False) -> DataFrame:
    """One table of all pages of a document that have a header: (doc_id, row_no, page, y, columns, cells). From the
    second such page on, rows above the header come first: they continue the page before. Without headers in the
    options they are found; auto_tune then picks, over a grid of merge gaps and row gaps, the table of the best score.
    in_order: a document's spans are in one partition, sorted by doc_id and page;
    they are then neither dealt nor sorted, and what does not stand so is an error. Such spans may be packed: rows of
    (doc_id, page) with the other fields in arrays, of some spans of a page each."""
    if not opts.headers:
        return _across_found(spans, opts, in_order=in_order)
    pages = sheets(spans, opts.y_tol)
    given = shared_columns(pages, opts).where(F.size("columns") >= len(opts.headers))
    place = remapped(with_data(with_header(pages, lowered(opts.headers)), opts), F.col("data"))
    place = place.join(given.withColumnRenamed("columns", "given"), "doc_id", "left").withColumn("columns", F.coalesce("given", "columns"))
    place = place.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")))
    above = F.when(F.col("nth") > 1, F.filter("rows", lambda r: r["row_no"] < F.col("first"))).otherwise(F.slice("rows", 1, 0))
    parts = F.array(F.struct(F.lit(0).alias("part"), above.alias("data")), F.struct(F.lit(1).alias("part"), F.col("data").alias("data")))
    every = place.select("doc_id", "page", "columns", F.explode(parts).alias("p")).select("doc_id", "page", "columns", "p.part", "p.data")
    keys = ("doc_id", "page", "part")
    return in_one(data_rows(exploded(every, *keys), opts, keys))


def across_pages_wide(spans: DataFrame, opts: TableOpts, names: list[str], in_order: bool = False) -> DataFrame:
    """wide(across_pages(...), names); where headers are found and nothing is filtered, without cells by the way."""
    if opts.headers or not Limits.of(opts).chosen:
        return wide(across_pages(spans, opts, in_order), names)
    return _across_found(spans, opts, tuple(names), in_order)


def _across_found(spans: DataFrame, opts: TableOpts, names: tuple[str, ...] | None = None, in_order: bool = False) -> DataFrame:
    """The header is the row of a document that looks most like one, its names on the starts that recur over all pages;
    its own places where too few recur."""
    tune = opts.auto_tune and not opts.merge_gap and not opts.max_row_gap
    lim = Limits.of(opts, tune, None if names is None else tuple(n.lower() for n in names))
    rest = "" if lim.chosen else ", part int, grid int"
    what = f", columns {COLUMNS}, cells array<string>" if names is None else "".join(f", _{i} string" for i in range(len(names)))
    out = in_batches(spans, ("doc_id",), opts, lambda s: across(s, lim), f"row_no int, y double{what}{rest}", in_order)
    if names is not None:
        return out.select("doc_id", "row_no", "page", *[F.col(f"_{i}").alias(n) for i, n in enumerate(names)])
    if lim.chosen:
        return out.select("doc_id", "row_no", "page", "y", "columns", "cells")
    out = filtered(out, opts, ("doc_id", "page", "part", "grid"))
    if tune:
        total = Window.partitionBy("doc_id", "grid")
        filled = F.sum(F.size(F.filter("cells", lambda c: c != ""))).over(total) / F.sum(F.size("cells")).over(total)
        out = out.withColumn("score", F.log1p(F.count("*").over(total)) * F.pow(filled, 2))
        best = Window.partitionBy("doc_id")
        out = out.withColumn("best", F.max(F.struct("score", (-F.col("grid")).alias("early"))).over(best)).where(F.col("grid") == -F.col("best")["early"])
    return in_one(out)


def in_one(rows: DataFrame) -> DataFrame:
    """Rows of a document's pages and parts as one table."""
    w = Window.partitionBy("doc_id").orderBy("page", "part", "row_no")
    first = F.first("columns").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("doc_id", (F.row_number().over(w) - 1).alias("row_no"), "page", "y", first.alias("columns"), "cells")


def score(tables: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score): the logarithm of one more than the rows, times the square of the share of filled cells."""
    filled = F.size(F.filter("cells", lambda c: c != ""))
    return tables.groupBy(*keys).agg((F.log1p(F.count("*")) * F.pow(F.sum(filled) / F.sum(F.size("cells")), 2)).alias("score"))


# Shapes of results


def cells(tables: DataFrame) -> DataFrame:
    """A cell a row: the table's keys, row_no, col_no, col_name, text."""
    keys = [c for c in tables.columns if c not in ("y", "columns", "cells")]
    flat = tables.select(*keys, F.posexplode(F.arrays_zip("columns", "cells")).alias("col_no", "z"))
    return flat.select(*keys, "col_no", F.col("z.columns.name").alias("col_name"), F.coalesce("z.cells", F.lit("")).alias("text"))


def cell_by_name(name: str) -> Column:
    """The text under a header, in either case; empty where there is none."""
    at = column_at(name, F.col("columns"))
    return F.when(at >= 0, F.coalesce(F.get("cells", at), F.lit(""))).otherwise("")


def wide(tables: DataFrame, names: list[str]) -> DataFrame:
    """A column for each of the names; empty where a table lacks it."""
    keys = [c for c in tables.columns if c not in ("y", "columns", "cells")]
    return tables.select(*keys, *[cell_by_name(n).alias(n) for n in names])


def without_texts(*texts: str) -> Column:
    """A row filter: rows of which no cell holds one of the texts, in either case."""
    return ~F.exists("cells", lambda c: F.exists(lowered(texts), lambda t: F.lower(c).contains(t)))


def show(tables: DataFrame) -> DataFrame:
    """(keys, row_no, line): cells padded to the widest of their column, numbers to the right."""
    keys = [c for c in ("doc_id", "page", "table_no") if c in tables.columns]
    flat = cells(tables)
    size = F.max(F.greatest(F.length("text"), F.length("col_name"))).over(Window.partitionBy(*keys, "col_no"))
    flat = flat.withColumn("size", size)
    padded = F.when(F.col("text").rlike(r"^[0-9.,\- ]+\z"), F.lpad("text", F.col("size"), F.lit(" "))).otherwise(F.rpad("text", F.col("size"), F.lit(" ")))
    return flat.groupBy(*keys, "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", padded.alias("t")))), lambda s: s["t"]), "  ").alias("line"))
