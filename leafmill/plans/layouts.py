"""Documents drawn from the tables.

Header at y = 700, rows every 20 points, columns 60 points apart or more, Helvetica 12 unless said otherwise. Lines of
an order are numbered by their full list of values, as (l_orderkey, l_linenumber) repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import sinks
from ..operators.spread import spread
from ..sources.pdf import extract_spans

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
ORDER_SQL = ", ".join(LINE_ORDER)
# the lines of each order, numbered; the same on both sides
LINES_SQL = f"SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER_SQL}) AS n FROM lineitem"
COLUMNS = (("Part", 50, "cast(l_partkey AS string)"), ("Supplier", 130, "cast(l_suppkey AS string)"), ("Qty", 220, "format_string('%.2f', l_quantity)"), ("Price", 300, "format_string('%.2f', l_extendedprice)"), ("Flag", 400, "concat(l_returnflag, l_linestatus)"))
NAMES = [name for name, _, _ in COLUMNS]
CELLS_SQL = "cast(l_partkey AS VARCHAR) AS part, cast(l_suppkey AS VARCHAR) AS supplier, printf('%.2f', l_quantity) AS qty, printf('%.2f', l_extendedprice) AS price, l_returnflag || l_linestatus AS flag"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with n, the number of a line in its order from 1."""
    return numbered(table(spark, sf_dir, "lineitem"))


def lines_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_lines, dealt by order before they are numbered: the lines of an order stand together."""
    return numbered(spread(table(spark, sf_dir, "lineitem"), "l_orderkey"))


def numbered(lines: DataFrame) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return lines.withColumn("n", F.row_number().over(w))


def lines_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_lines with doc_id, dealt and sorted by it: there are fewer lines than spans to sort."""
    lines = order_lines(spark, sf_dir).withColumn("doc_id", F.col("l_orderkey").cast("string"))
    return spread(lines, "doc_id").sortWithinPartitions("doc_id", "n")


def cell_texts(lines: DataFrame, y: Column, page: Column | int = 0) -> DataFrame:
    """(doc_id, page, op_seq, x, y, text): a text for each cell of the lines."""
    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(float(x)).alias("x"), F.expr(e).alias("text")) for i, (_, x, e) in enumerate(COLUMNS)])
    page = F.lit(page) if isinstance(page, int) else page
    flat = lines.select(F.col("l_orderkey").cast("string").alias("doc_id"), page.cast("int").alias("page"), y.cast("double").alias("y"), "n", F.explode(cells).alias("k"))
    return flat.select("doc_id", "page", (F.col("n") * 10 + F.col("k.c")).cast("int").alias("op_seq"), "k.x", "y", "k.text")


def packed_texts(lines: DataFrame, page: Column | int, first: Column, head: list[tuple], body: list[tuple]) -> DataFrame:
    """(doc_id, page, texts): the texts ``body`` of each line, and ``head`` where it is its page's first, out of one pass
    over the lines; a text is (op_seq, x, y, text)."""
    page = F.lit(page) if isinstance(page, int) else page
    placed = lambda texts: F.array(*[F.struct(F.lit(seq).cast("int").alias("op_seq"), F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"), F.lit(text).alias("text")) for seq, x, y, text in texts])
    every = F.when(first, placed(head + body)).otherwise(placed(body))
    return lines.select(F.col("l_orderkey").cast("string").alias("doc_id"), page.cast("int").alias("page"), every.alias("texts"))


def flat(texts: DataFrame) -> DataFrame:
    """(doc_id, page, op_seq, x, y, text) of rows with texts in arrays."""
    return texts.select("doc_id", "page", F.inline("texts"))


def texts_of(lines: DataFrame, page: Column | int, first: Column, head: list[tuple], body: list[tuple]) -> DataFrame:
    return flat(packed_texts(lines, page, first, head, body))


def packed_headed_texts(lines: DataFrame, y: Column, page: Column | int, first: Column, *more: tuple) -> DataFrame:
    """cell_texts with header_texts on each page, and what more texts a line has; first: the line is its page's first."""
    body = [(F.col("n") * 10 + i, x, y, F.expr(e)) for i, (_, x, e) in enumerate(COLUMNS)]
    return packed_texts(lines, page, first, [(i, x, 700.0, n) for i, (n, x, _) in enumerate(COLUMNS)], [*body, *more])


def headed_texts(lines: DataFrame, y: Column, page: Column | int, first: Column, *more: tuple) -> DataFrame:
    return flat(packed_headed_texts(lines, y, page, first, *more))


def header_texts(pages: DataFrame, y: float = 700.0, names: tuple[tuple[str, float], ...] | None = None) -> DataFrame:
    """(doc_id, page, op_seq, x, y, text): the header on each of the pages (doc_id, page)."""
    names = names or tuple((n, float(x)) for n, x, _ in COLUMNS)
    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(float(x)).alias("x"), F.lit(n).alias("text")) for i, (n, x) in enumerate(names)])
    return pages.select("doc_id", "page", F.explode(cells).alias("k")).select("doc_id", "page", F.col("k.c").alias("op_seq"), "k.x", F.lit(y).alias("y"), "k.text")


def spans_of(texts: DataFrame) -> DataFrame:
    """Texts as spans without a document around them: six points a character, size 12."""
    return texts.select("doc_id", "page", F.col("op_seq").alias("span_seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.col("x") + 6 * F.length("text")).cast("double").alias("end_x"), F.lit(12.0).alias("font_size"), F.lit("F").alias("font"), "text")


def packed_invoice_texts(lines: DataFrame) -> DataFrame:
    """One page an order; orders have no more lines than fit."""
    return packed_headed_texts(lines, 700 - 20 * F.col("n"), 0, F.col("n") == 1)


def invoice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(packed_invoice_texts(order_lines(spark, sf_dir)))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content): every order as a PDF document."""
    return sinks.create_text_pdf(packed_invoice_texts(lines_together(spark, sf_dir)))


def invoice_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_spans(invoices(spark, sf_dir))


def packed_paged_texts(lines: DataFrame, per_page: int = 3) -> DataFrame:
    """Orders with three lines a page, and a header on each page."""
    page, row = F.floor((F.col("n") - 1) / per_page), (F.col("n") - 1) % per_page + 1
    return packed_headed_texts(lines, 700 - 20 * row, page, row == 1)


def paged_texts(spark: SparkSession, sf_dir: str, per_page: int = 3) -> DataFrame:
    return flat(packed_paged_texts(order_lines(spark, sf_dir), per_page))


def paged_spans(spark: SparkSession, sf_dir: str, per_page: int = 3) -> DataFrame:
    """The spans of paged_texts, in order of doc_id, page and span_seq; packed: a row a line, with its spans in arrays."""
    page, row = F.floor((F.col("n") - 1) / per_page), (F.col("n") - 1) % per_page + 1
    texts = [F.expr(e).alias(f"_{i}") for i, (_, _, e) in enumerate(COLUMNS)]
    lines = lines_by_document(spark, sf_dir).select("doc_id", page.cast("int").alias("page"), "n", row.alias("row"), *texts)
    head = [(F.lit(i), float(x), F.lit(700.0), F.lit(name)) for i, (name, x, _) in enumerate(COLUMNS)]
    body = [(F.col("n") * 10 + i, float(x), 700.0 - 20 * F.col("row"), F.col(f"_{i}")) for i, (_, x, _) in enumerate(COLUMNS)]

    def field(name: str, of: Callable[[Column, float, Column, Column], Column]) -> Column:
        first, own = (F.array(*[of(*t) for t in texts]) for texts in (head + body, body))
        return F.when(F.col("row") == 1, first).otherwise(own).alias(name)

    return lines.select(
        "doc_id", "page",
        field("span_seq", lambda seq, x, y, text: seq.cast("int")),
        field("x", lambda seq, x, y, text: F.lit(x)),
        field("y", lambda seq, x, y, text: y.cast("double")),
        field("end_x", lambda seq, x, y, text: (x + 6 * F.length(text)).cast("double")),
        field("font_size", lambda seq, x, y, text: F.lit(12.0)),
        field("text", lambda seq, x, y, text: text),
    )


def as_invoice(tables: DataFrame) -> DataFrame:
    """(l_orderkey, n, part, supplier, qty, price, flag) of found tables, wide ones too."""
    from ..operators.tables import cell_by_name

    cell = F.col if "cells" not in tables.columns else cell_by_name
    return tables.select(F.col("doc_id").cast("long").alias("l_orderkey"), (F.col("row_no") + 1).cast("long").alias("n"), *[cell(v).alias(v.lower()) for v in NAMES])


INVOICE_SQL = f"SELECT l_orderkey, n, {CELLS_SQL} FROM ({LINES_SQL})"
