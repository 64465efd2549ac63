"""Queries over rows, clusters, gaps and tables. Spans are laid out from the lines of orders, without PDF bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import rows, tables
from ..options import TableOpts
from .layouts import CELLS_SQL, INVOICE_SQL, LINES_SQL, NAMES, as_invoice, cell_texts, headed_texts, header_texts, invoice_texts, order_lines, paged_spans, paged_texts, spans_of, texts_of

HEADERS = TableOpts(headers=("Part", "Supplier"))


def key():
    return F.col("doc_id").cast("long").alias("l_orderkey")

CELL_LIST = "[(0, 50, cast(l_partkey AS VARCHAR)), (1, 130, cast(l_suppkey AS VARCHAR)), (2, 220, printf('%.2f', l_quantity)), (3, 300, printf('%.2f', l_extendedprice)), (4, 400, l_returnflag || l_linestatus)]"
FLAT_SQL = f"SELECT l_orderkey, n, c[1] AS k, c[2] AS x, c[3] AS t FROM (SELECT l_orderkey, n, unnest({CELL_LIST}) AS c FROM ({LINES_SQL}))".replace("c[1]", "struct_extract(c, 1)").replace("c[2]", "struct_extract(c, 2)").replace("c[3]", "struct_extract(c, 3)")


def body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_texts(order_lines(spark, sf_dir), 700 - 20 * F.col("n"))


def group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells stand up to 1.2 points lower than the first of their row."""
    jitter = spans_of(body(spark, sf_dir)).withColumn("y", F.col("y") - (F.col("span_seq") % 10) * 0.3)
    out = rows.group_rows(jitter)
    return out.select(key(), "row_no", F.round("y", 2).alias("y"), "pos", "text")


def cluster_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows start up to two points further right than the first."""
    jitter = spans_of(body(spark, sf_dir)).withColumn("x", F.col("x") + (F.floor(F.col("span_seq") / 10) % 3))
    return rows.cluster_x(jitter).select(key(), "x", "support")


def column_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.column_gaps(spans_of(body(spark, sf_dir))).select(key(), "row_no", F.round("mid", 3).alias("mid"))


def explicit_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_invoice(tables.find_table(spans_of(invoice_texts(spark, sf_dir)), HEADERS))


def wrapped_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header words on two lines, twelve points apart."""
    data = body(spark, sf_dir).withColumn("y", F.col("y") - 20)
    pages = data.select("doc_id", "page").distinct()
    top = header_texts(pages, 700.0, (("Product", 50.0), ("Suppliers", 130.0), ("Unit", 220.0), ("Total", 300.0), ("Flags", 400.0)))
    low = header_texts(pages, 688.0, (("Code", 55.0), ("Code", 135.0), ("Count", 225.0), ("Price", 305.0))).withColumn("op_seq", F.col("op_seq") + 5)
    found = tables.find_table(spans_of(data.unionByName(top).unionByName(low)), TableOpts(headers=("Product", "Suppliers")))
    return found.select(key(), (F.col("row_no") + 1).cast("long").alias("n"), F.array_join(F.transform("columns", lambda c: c["name"]), "|").alias("names"), F.array_join("cells", "|").alias("cells"))


def two_row_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wanted headers stand on two rows; the others of these rows are no columns."""
    data = body(spark, sf_dir).withColumn("y", F.col("y") - 20)
    pages = data.select("doc_id", "page").distinct()
    top = header_texts(pages, 700.0, (("Part No", 50.0), ("ignored here", 220.0)))
    low = header_texts(pages, 680.0, (("Supplier No", 130.0), ("Price due", 300.0))).withColumn("op_seq", F.col("op_seq") + 5)
    found = tables.find_table(spans_of(data.unionByName(top).unionByName(low)), TableOpts(headers=("part no", "SUPPLIER NO", "price")))
    return found.select(key(), (F.col("row_no") + 1).cast("long").alias("n"), F.array_join(F.transform("columns", lambda c: c["name"]), "|").alias("names"), F.array_join("cells", "|").alias("cells"))


EVEN_NAMES = ("PartNumber", "SupplierNo", "TotalPrice")


def even_table(width: int, gap: float, top: Column | float = 700.0, seq: int = 0) -> tuple[list[tuple], list[tuple]]:
    """(head, body) of a table whose texts are all of one width, so that gaps and starts recur exactly."""
    values = (F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.format_string("%.2f", "l_extendedprice"))
    xs = [50 + i * (6 * width + gap) for i in range(len(values))]
    head = [(seq + i, x, top, n) for i, (x, n) in enumerate(zip(xs, EVEN_NAMES, strict=True))]
    return head, [(F.col("n") * 10 + seq + i, x, top - 20 * F.col("n"), F.lpad(v, width, "0")) for i, (x, v) in enumerate(zip(xs, values, strict=True))]


def even_cells(spark: SparkSession, sf_dir: str, width: int, gap: float) -> DataFrame:
    return spans_of(texts_of(order_lines(spark, sf_dir), 0, F.col("n") == 1, *even_table(width, gap)))


def as_three(found: DataFrame) -> DataFrame:
    return found.select(key(), (F.col("row_no") + 1).cast("long").alias("n"), *[F.get("cells", F.lit(i)).alias(k) for i, k in enumerate(("part", "supplier", "price"))])


def three_sql(width: int) -> str:
    pad = lambda e: f"lpad({e}, {width}, '0')"
    return f"SELECT l_orderkey, n, {pad('cast(l_partkey AS VARCHAR)')} AS part, {pad('cast(l_suppkey AS VARCHAR)')} AS supplier, {pad("printf('%.2f', l_extendedprice)")} AS price FROM ({LINES_SQL}) JOIN (SELECT l_orderkey, count(*) AS many FROM lineitem GROUP BY l_orderkey) USING (l_orderkey) WHERE many >= 2"


def gap_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_three(tables.by_gaps(even_cells(spark, sf_dir, 10, 30.0), TableOpts()))


def anchor_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells six points apart leave no gap; starts recur."""
    return as_three(tables.by_anchors(even_cells(spark, sf_dir, 10, 6.0), TableOpts()))


def any_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents with wide gaps and with narrow ones, found either way."""
    wide = even_cells(spark, sf_dir, 10, 30.0).where("cast(doc_id AS long) % 2 = 0")
    narrow = even_cells(spark, sf_dir, 10, 6.0).where("cast(doc_id AS long) % 2 = 1")
    return as_three(tables.find_table(wide.unionByName(narrow)))


def two_on_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table, a line of text, and a second table with the same lines below it."""
    lines = order_lines(spark, sf_dir).withColumn("many", F.count("*").over(Window.partitionBy("l_orderkey")))
    head, body = even_table(10, 30.0)
    low_head, low_body = even_table(10, 30.0, 700.0 - 20 * (F.col("many") + 2), 200_000)
    between = (100_000, 50.0, 680.0 - 20 * F.col("many"), "notes")
    found = tables.find_tables(spans_of(texts_of(lines, 0, F.col("n") == 1, [*head, between, *low_head], body + low_body)))
    return found.select(key(), F.col("table_no").cast("int").alias("table_no"), (F.col("row_no") + 1).cast("long").alias("n"), *[F.get("cells", F.lit(i)).alias(k) for i, k in enumerate(("part", "supplier", "price"))])


def header_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data stands 25 points right of its headers; three rows or more move the columns there."""
    data = body(spark, sf_dir)
    head = header_texts(data.select("doc_id", "page").distinct())
    found = tables.find_table(spans_of(data.withColumn("x", F.col("x") + 25).unionByName(head)), HEADERS)
    first = found.where("row_no = 0").select(key(), F.explode("columns").alias("c"))
    return first.select("l_orderkey", F.col("c.name").alias("name"), F.col("c.x").alias("x"))


def continued(spark: SparkSession, sf_dir: str, below: int = 12) -> DataFrame:
    """Rows 40 points apart, each with a text under its supplier that many points below."""
    y = 700.0 - 40 * F.col("n")
    more = (F.col("n") * 10 + 7, 130.0, y - below, F.concat(F.lit("ref "), F.col("l_returnflag")))
    return spans_of(headed_texts(order_lines(spark, sf_dir), y, 0, F.col("n") == 1, more))


CONTINUED_SQL = f"SELECT l_orderkey, n, part, supplier || ' ref ' || l_returnflag AS supplier, qty, price, flag FROM (SELECT *, {CELLS_SQL} FROM ({LINES_SQL}))"


def merge_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_invoice(tables.find_table(continued(spark, sf_dir), TableOpts(headers=("Part", "Supplier"), merge_gap=16)))


def anchor_column_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_invoice(tables.find_table(continued(spark, sf_dir), TableOpts(headers=("Part", "Supplier"), anchor_column="PART")))


def far_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after the third stand 60 points lower."""
    data = cell_texts(order_lines(spark, sf_dir), 700 - 20 * F.col("n") - F.when(F.col("n") > 3, 60).otherwise(0))
    return spans_of(data.unionByName(header_texts(data.select("doc_id", "page").distinct())))


def max_row_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_invoice(tables.find_table(far_rows(spark, sf_dir), TableOpts(headers=("Part", "Supplier"), max_row_gap=50)))


def merge_and_max_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = continued(spark, sf_dir).withColumn("y", F.when((F.col("span_seq") >= 40), F.col("y") - 60).otherwise(F.col("y")))
    return as_invoice(tables.find_table(data, TableOpts(headers=("Part", "Supplier"), merge_gap=16, max_row_gap=50)))


def row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.find_table(spans_of(invoice_texts(spark, sf_dir)), TableOpts(headers=("Part", "Supplier"), row_filter=tables.without_texts("r")))
    return as_invoice(found).drop("n").withColumn("rows", F.lit(1))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities stand on even lines only."""
    data = body(spark, sf_dir).where("op_seq % 10 != 2 OR cast(floor(op_seq / 10) AS int) % 2 = 0")
    return spans_of(data.unionByName(header_texts(data.select("doc_id", "page").distinct())))


def require_any_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.find_table(sparse(spark, sf_dir), TableOpts(headers=("Part", "Supplier"), require_any_column=("qty", "none such")))
    return as_invoice(found).withColumn("n", F.col("n") * 2)


def spilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines a page; from the second page on the first line stands above the header."""
    lines = order_lines(spark, sf_dir)
    page, row = F.floor((F.col("n") - 1) / 3), (F.col("n") - 1) % 3 + 1
    y = F.when((page > 0) & (row == 1), 720.0).otherwise(700.0 - 20 * row)
    data = cell_texts(lines, y, page)
    return spans_of(data.unionByName(header_texts(data.select("doc_id", "page").distinct())))


def across_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_invoice(tables.across_pages(spilled(spark, sf_dir), HEADERS))


def across_pages_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_invoice(tables.across_pages_wide(paged_spans(spark, sf_dir), TableOpts(), NAMES, in_order=True))


def autotune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_invoice(tables.across_pages(spans_of(paged_texts(spark, sf_dir)), TableOpts(auto_tune=True)))


def autotune_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 40 points apart, each continued 14 points below: of the candidates only those that merge what is closer than
    16 points and do not end a table at 26 give full rows; the others give fewer or emptier ones."""
    return as_invoice(tables.across_pages(continued(spark, sf_dir, 14), TableOpts(auto_tune=True)))


def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as lines of text: numbers to the right, as wide as the widest of a column."""
    found = tables.show(tables.find_table(spans_of(invoice_texts(spark, sf_dir)), HEADERS))
    return found.select(key(), (F.col("row_no") + 1).cast("long").alias("n"), "line")


def _table_lines_sql() -> str:
    names = ("Part", "Supplier", "Qty", "Price", "Flag")
    fields = ("part", "supplier", "qty", "price", "flag")
    size = lambda f, h: f"greatest({len(h)}, max(length({f})) OVER (PARTITION BY l_orderkey))"
    cells = [f"{'rpad' if f == 'flag' else 'lpad'}({f}, {size(f, h)}::INTEGER, ' ')" for f, h in zip(fields, names, strict=True)]
    return f"SELECT l_orderkey, n, {" || '  ' || ".join(cells)} AS line FROM ({INVOICE_SQL})"


def table_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.find_table(sparse(spark, sf_dir), HEADERS)
    return tables.score(found, ["doc_id"]).select(key(), F.round("score", 6).alias("score"))


def cell_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.find_table(spans_of(invoice_texts(spark, sf_dir)), HEADERS).where("row_no = 0")
    return found.select(key(), tables.cell_by_name("QTY").alias("qty"), tables.cell_by_name("missing").alias("missing"), rows.column_at("price", F.col("columns")).alias("price_at"), rows.column_at("none", F.col("columns")).alias("none_at"))


def long_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.cells(tables.find_table(spans_of(invoice_texts(spark, sf_dir)), HEADERS))
    return found.select(key(), (F.col("row_no") + 1).cast("long").alias("n"), F.col("col_no").cast("int").alias("k"), "text")


def nearest_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.geometry import nearest
    from .layouts import table

    columns = F.array(*[F.struct(F.lit(float(x)).alias("x")) for x in (50, 130, 220, 300, 400)])
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", nearest((F.col("p_partkey") % 500).cast("double"), columns).alias("col"))


NEAREST_SQL = "SELECT p_partkey, min_by(i, d * 10 + i)::INTEGER AS col FROM (SELECT p_partkey, i, abs(p_partkey % 500 - x) AS d FROM part, (VALUES (0, 50), (1, 130), (2, 220), (3, 300), (4, 400)) AS c(i, x)) GROUP BY p_partkey"
JOINED_CELLS = "cast(l_partkey AS VARCHAR) || '|' || cast(l_suppkey AS VARCHAR) || '|' || printf('%.2f', l_quantity) || '|' || printf('%.2f', l_extendedprice) || '|' || l_returnflag || l_linestatus"

QUERIES = {
    "group_rows": (group_rows, f"SELECT l_orderkey, (n - 1)::INTEGER AS row_no, (700.0 - 20 * n)::DOUBLE AS y, k::INTEGER AS pos, t AS text FROM ({FLAT_SQL})"),
    "cluster_x": (cluster_x, f"SELECT l_orderkey, (x + 1)::DOUBLE AS x, count(*)::INTEGER AS support FROM ({FLAT_SQL}) GROUP BY l_orderkey, x"),
    "column_gaps": (column_gaps, f"SELECT l_orderkey, (n - 1)::INTEGER AS row_no, round((x + 6 * length(t) + nx) / 2.0, 3)::DOUBLE AS mid FROM (SELECT *, lead(x) OVER (PARTITION BY l_orderkey, n ORDER BY k) AS nx FROM ({FLAT_SQL})) WHERE nx - x - 6 * length(t) > 10"),
    "tables_explicit_headers": (explicit_headers, INVOICE_SQL),
    "tables_wrapped_headers": (wrapped_headers, f"SELECT l_orderkey, n, 'Product Code|Suppliers Code|Unit Count|Total Price|Flags' AS names, {JOINED_CELLS} AS cells FROM ({LINES_SQL})"),
    # columns stand at 50, 130 and 300: a quantity at 220 is nearer to 300, a flag at 400 too
    "tables_two_row_headers": (two_row_headers, f"SELECT l_orderkey, n, 'Part No|Supplier No|Price due' AS names, cast(l_partkey AS VARCHAR) || '|' || cast(l_suppkey AS VARCHAR) || '|' || printf('%.2f', l_quantity) || ' ' || printf('%.2f', l_extendedprice) || ' ' || l_returnflag || l_linestatus AS cells FROM ({LINES_SQL})"),
    "tables_gap_detect": (gap_detect, three_sql(10)),
    "tables_anchor_detect": (anchor_detect, three_sql(10)),
    "tables_any_detect": (any_detect, three_sql(10)),
    "header_remap": (header_remap, "SELECT l_orderkey, name, (x + CASE WHEN many >= 3 THEN 25 ELSE 0 END)::DOUBLE AS x FROM (SELECT l_orderkey, count(*) AS many FROM lineitem GROUP BY l_orderkey), (VALUES ('Part', 50), ('Supplier', 130), ('Qty', 220), ('Price', 300), ('Flag', 400)) AS h(name, x)"),
    "merge_gap": (merge_gap, CONTINUED_SQL),
    "anchor_column_merge": (anchor_column_merge, CONTINUED_SQL),
    "max_row_gap": (max_row_gap, INVOICE_SQL + " WHERE n <= 3"),
    "merge_and_max_gap": (merge_and_max_gap, CONTINUED_SQL + " WHERE n <= 3"),
    "row_filter": (row_filter, f"SELECT l_orderkey, part, supplier, qty, price, flag, 1 AS rows FROM ({INVOICE_SQL}) WHERE NOT contains(lower(flag), 'r')"),
    "require_any_column": (require_any_column, INVOICE_SQL + " WHERE n % 2 = 0"),
    "tables_across_pages": (across_pages, INVOICE_SQL),
    "tables_across_pages_auto": (across_pages_auto, INVOICE_SQL),
    "table_autotune": (autotune, INVOICE_SQL),
    "tables_two_on_page": (two_on_page, three_sql(10).replace("SELECT l_orderkey, n,", "SELECT l_orderkey, t::INTEGER AS table_no, n,").replace(" JOIN (SELECT l_orderkey, count(*) AS many FROM lineitem GROUP BY l_orderkey) USING (l_orderkey) WHERE many >= 2", ", (VALUES (0), (1)) AS twice(t)")),
    "table_autotune_choice": (autotune_choice, CONTINUED_SQL),
    "table_lines": (table_lines, _table_lines_sql()),
    "table_score": (table_score, "SELECT l_orderkey, round(ln(1 + count(*)) * pow((count(*) * 4 + count(*) // 2)::DOUBLE / (count(*) * 5), 2), 6)::DOUBLE AS score FROM lineitem GROUP BY l_orderkey"),
    "cell_lookup": (cell_lookup, f"SELECT l_orderkey, qty, '' AS missing, 3 AS price_at, -1 AS none_at FROM ({INVOICE_SQL}) WHERE n = 1"),
    "table_cells": (long_cells, f"SELECT l_orderkey, n, k::INTEGER AS k, t AS text FROM ({FLAT_SQL})"),
    "nearest_column": (nearest_column, NEAREST_SQL),
}
