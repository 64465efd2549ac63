"""Quotations drawn from customers and their orders, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import quotes, sinks
from ..operators.spread import spread
from .layouts import LINE_ORDER, LINES_SQL, flat, table

HEAD = (("Quantity", 50.0), ("Product Code", 120.0), ("Suppliers", 220.0), ("Product Description", 320.0), ("Unit Price", 480.0))
PER_PAGE = 8


def _text(n: Column | int, seq: int, x: float, y: Column | int, text: Column | str) -> Column:
    """(op_seq, x, y, text) of a text of line n, or of none at 0."""
    of = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct((of(n) * 100 + seq).cast("int").alias("op_seq"), F.lit(float(x)).alias("x"), of(y).cast("double").alias("y"), of(text).alias("text"))


def packed_quotation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order a quotation: labels on the first page; a table whose second header word is wrapped; a category before
    every third line; a code that goes on below its line; eight lines a page, headers on each; a footer. Orders are dealt
    along with their lines, and texts come out of one pass over both."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.where("o_orderkey is not null").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "c_name", "c_mktsegment", F.lit(0).alias("line"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER, F.lit(1).alias("line"))
    w = Window.partitionBy("l_orderkey").orderBy("line", *LINE_ORDER)
    start, end = Window.unboundedPreceding, Window.unboundedFollowing
    both = spread(lines.unionByName(orders, allowMissingColumns=True), "l_orderkey")
    both = both.withColumns({"n": F.sum("line").over(w.rowsBetween(start, Window.currentRow)), "many": F.sum("line").over(w.rowsBetween(start, end))}).where("many > 0")
    n, key = F.col("n"), F.col("l_orderkey").cast("string")
    top = F.array(
        _text(0, 1, 50, 780, F.concat(F.lit("Company: "), F.col("c_name"), F.lit(" Estimator: A "), F.col("c_mktsegment"))),
        _text(0, 2, 50, 765, F.concat(F.lit("Quote Name: Order "), key)),
        _text(0, 3, 50, 750, "Quotation Ref:"),
        _text(0, 4, 50, 735, F.concat(F.lit("REF-"), key)),
        _text(0, 5, 50, 720, F.concat(F.lit("Quote Expiry: Quote is valid until "), F.date_format("o_orderdate", "dd/MM/yyyy"))),
    )
    page, row = F.floor((n - 1) / PER_PAGE), (n - 1) % PER_PAGE
    y = 640 - 60 * row
    cells = {50: F.col("l_quantity").cast("int").cast("string"), 120: F.concat(F.lit("P-"), F.col("l_partkey").cast("string")), 220: F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.lit("-")), 320: F.concat(F.lit("item "), F.col("l_returnflag")), 480: F.format_string("%.2f", "l_extendedprice")}
    body = [_text(n, 10 + i, x, y, t) for i, (x, t) in enumerate(cells.items())]
    body.append(_text(n, 20, 220, y - 20, F.concat(F.lit("X"), F.col("l_linestatus"))))
    category = F.array(_text(n, 5, 320, y + 20, F.concat(F.lit("CATEGORY "), F.col("l_linestatus"), F.lit(" "), n.cast("string"))))
    head = F.array(*[_text(0, 50 + i, x, 690, t) for i, (t, x) in enumerate(HEAD)], _text(0, 56, 222, 678, "Code"))
    foot = F.array(_text(99, 90, 50, 60, "Total: see above"), _text(99, 91, 120, 40, "P-after the footer"))
    none = F.slice(foot, 1, 0)
    every = F.concat(F.array(*body), *[F.when(when, part).otherwise(none) for when, part in ((n % 3 == 1, category), (row == 0, head), (n == F.col("many"), foot))])
    is_line = F.col("line") == 1
    return both.select(key.alias("doc_id"), F.when(is_line, page).otherwise(0).cast("int").alias("page"), F.when(is_line, every).otherwise(top).alias("texts"))


def quotation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(packed_quotation_texts(spark, sf_dir))


def quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content): every order with its lines as a PDF document."""
    return sinks.create_text_pdf(packed_quotation_texts(spark, sf_dir))


def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quotes.of_documents(quotations(spark, sf_dir), "fields")
    return found.select(F.col("doc_id").cast("long").alias("o_orderkey"), *quotes.FIELDS)


FIELDS_SQL = """SELECT o_orderkey, c_name AS company, 'Order ' || o_orderkey AS quote_name, 'REF-' || o_orderkey AS quotation_ref, '' AS issue_date, strftime(o_orderdate, '%d/%m/%Y') AS quote_expiry, 'A ' || c_mktsegment AS estimator, '' AS contact_name
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"""


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quotes.of_documents(quotations(spark, sf_dir), "items")
    return found.select(F.col("doc_id").cast("long").alias("l_orderkey"), "item_no", "quantity", "product_code", "supplier_code", "description", F.try_element_at("prices", F.lit("Unit Price")).alias("unit_price"))


ITEMS_SQL = f"SELECT l_orderkey, (n - 1)::BIGINT AS item_no, cast(l_quantity AS INTEGER)::VARCHAR AS quantity, 'P-' || l_partkey AS product_code, 'S' || l_suppkey || '-X' || l_linestatus AS supplier_code, 'item ' || l_returnflag AS description, printf('%.2f', l_extendedprice) AS unit_price FROM ({LINES_SQL})"


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quotes.of_documents(quotations(spark, sf_dir), "items")
    return found.select(F.col("doc_id").cast("long").alias("l_orderkey"), "item_no", "category")


CATEGORY_SQL = f"SELECT l_orderkey, (n - 1)::BIGINT AS item_no, last_value(CASE WHEN n % 3 = 1 THEN 'CATEGORY ' || l_linestatus || ' ' || n END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY n) AS category FROM ({LINES_SQL})"


def supplier_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quotes.of_documents(quotations(spark, sf_dir), "codes")
    return found.select(F.col("doc_id").cast("long").alias("l_orderkey"), F.col("code_no").cast("long").alias("code_no"), "code")


CODES_SQL = f"SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY first) - 1 AS code_no, code FROM (SELECT l_orderkey, 'S' || l_suppkey || '-X' || l_linestatus AS code, min(n) AS first FROM ({LINES_SQL}) GROUP BY ALL)"


def whole_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quotes.of_documents(quotations(spark, sf_dir))
    return found.select(F.col("doc_id").cast("long").alias("l_orderkey"), F.array_join("headers", "|").alias("headers"), F.size("line_items").cast("long").alias("n_items"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quotes.report(quotes.of_documents(quotations(spark, sf_dir)))
    return found.select(F.col("doc_id").cast("long").alias("l_orderkey"), "report")


REPORT_SQL = f"""WITH f AS ({FIELDS_SQL}), i AS ({ITEMS_SQL}), g AS ({CATEGORY_SQL}), c AS ({CODES_SQL}),
lines AS (SELECT l_orderkey, string_agg(concat_ws(' | ', quantity, product_code, supplier_code, description, category), chr(10) ORDER BY item_no) AS items FROM i JOIN g USING (l_orderkey, item_no) GROUP BY l_orderkey),
codes AS (SELECT l_orderkey, string_agg(code, ', ' ORDER BY code_no) AS codes FROM c GROUP BY l_orderkey)
SELECT l_orderkey, concat_ws(chr(10), 'Company: ' || company, 'Quote Name: ' || quote_name, 'Quotation Ref: ' || quotation_ref, 'Issue Date: ' || issue_date, 'Quote Expiry: ' || quote_expiry, 'Estimator: ' || estimator, 'Contact Name: ' || contact_name, 'Supplier Codes: ' || codes, items) AS report
FROM f JOIN lines ON o_orderkey = l_orderkey JOIN codes USING (l_orderkey)"""

QUERIES = {
    "quote_report": (reports, REPORT_SQL),
    "quote_header_fields": (header_fields, FIELDS_SQL),
    "quote_line_items": (line_items, ITEMS_SQL),
    "quote_category_fill": (categories, CATEGORY_SQL),
    "quote_supplier_codes": (supplier_codes, CODES_SQL),
    "quotes": (whole_quotes, "SELECT l_orderkey, 'Quantity|Product Code|Suppliers Code|Product Description|Unit Price' AS headers, count(*) AS n_items FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey"),
}
