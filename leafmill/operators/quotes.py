"""Quotations: labelled fields, and line items from a table that may go on over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import after_label, between_labels, is_note, is_number, smart_append, trim
from .lines import build_lines
from .quote_batches import COMPLETE, ENDINGS, FAR, FIELDS, FOOTERS, FOOTERS_LEFT, SCHEMAS, WRAP, Y_TOLERANCE, kernel
from .spread import spread

def header_fields(lines: DataFrame) -> DataFrame:
    """(doc_id, company, quote_name, ...): of each field the first value of a document that is not empty. A reference or
    date may stand on the line after its label."""
    text, after = F.col("text"), F.lead("text").over(Window.partitionBy("doc_id", "page").orderBy("line_no"))

    def here_or_below(label: str) -> Column:
        own = after_label(text, label)
        return F.when(F.instr(text, label) > 0, F.when(own != "", own).otherwise(F.coalesce(trim(after), F.lit("")))).otherwise("")

    expiry = after_label(text, "Quote Expiry:")
    values = {
        "company": between_labels(text, "Company:", "Estimator:"),
        "quote_name": after_label(text, "Quote Name:"),
        "quotation_ref": here_or_below("Quotation Ref:"),
        "issue_date": here_or_below("Issue Date:"),
        "quote_expiry": F.regexp_replace(expiry, "^Quote is valid until ", ""),
        "estimator": between_labels(text, "Estimator:", "Estimator Tel:", "Contact"),
        "contact_name": between_labels(text, "Contact Name:", "Estimator"),
    }
    found = lines.select("doc_id", F.struct("page", "line_no").alias("at"), *[F.nullif(v, F.lit("")).alias(k) for k, v in values.items()])
    first = [F.coalesce(F.min_by(k, F.when(F.col(k).isNotNull(), F.col("at"))), F.lit("")).alias(k) for k in FIELDS]
    return found.groupBy("doc_id").agg(*first)


def table_headers(spans: DataFrame) -> DataFrame:
    """(doc_id, page, header_y, names, qty_x, prod_x, supp_x, desc_x, prices): pages with a row that holds Quantity and
    Suppliers (Code); single words close below end the header to their left that is not complete yet."""
    return whole_pages(spans).where("header_y is not null").drop("s")


def whole_pages(spans: DataFrame) -> DataFrame:
    """table_headers and s, the spans of a page in order; of pages without such a row too, with nulls. Dealt by document."""
    s = spread(spans.select("doc_id", "page", "span_seq", "x", "y", trim(F.col("text")).alias("text")), "doc_id")
    page = s.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("span_seq", "x", "y", "text"))).alias("s"))
    anchor = F.filter("s", lambda a: a["text"].isin("Suppliers Code", "Suppliers") & F.exists("s", lambda b: (F.abs(b["y"] - a["y"]) <= Y_TOLERANCE) & (b["text"] == "Quantity")))
    page = page.withColumn("top", F.get(anchor, F.lit(0))["y"])
    heads = F.array_sort(F.transform(F.filter("s", lambda a: (F.abs(a["y"] - F.col("top")) <= Y_TOLERANCE) & (a["text"] != "")), lambda a: F.struct(a["x"].alias("x"), a["span_seq"].alias("span_seq"), a["text"].alias("text"))))
    page = page.withColumn("heads", F.explode(F.array(heads)))
    open_head = lambda h: ~F.lower(h["text"]).isin(*COMPLETE)
    under = F.filter("s", lambda a: (F.col("top") - a["y"] > Y_TOLERANCE) & (F.col("top") - a["y"] < WRAP))
    words = F.array_sort(F.transform(F.filter(under, lambda a: F.lower(a["text"]).isin(*ENDINGS)), lambda a: F.struct(a["x"].alias("x"), a["span_seq"].alias("span_seq"), a["text"].alias("text"))))

    def place(acc: Column, w: Column) -> Column:
        best = F.array_min(F.transform(acc, lambda h, i: F.when(open_head(h) & (w["x"] - h["x"] >= 0), F.struct((w["x"] - h["x"]).alias("d"), i.alias("i")))))
        return F.transform(acc, lambda h, i: F.struct(h["x"].alias("x"), h["span_seq"].alias("span_seq"), F.when(i == best["i"], F.concat_ws(" ", h["text"], w["text"])).otherwise(h["text"]).alias("text")))

    unfinished = F.exists("heads", open_head)
    page = page.withColumn("named", F.explode(F.array(F.when(unfinished, F.aggregate(words, F.col("heads"), place)).otherwise(F.col("heads")))))
    lowest = F.least(F.col("top"), F.coalesce(F.array_min(F.transform(under, lambda a: a["y"])), F.col("top")))
    low = lambda h: F.lower(h["text"])
    kind = lambda h: F.when(low(h) == "quantity", "qty").when(low(h).startswith("product c"), "prod").when(low(h).startswith("supplier"), "supp").when(low(h).startswith("product d"), "desc").when(low(h).contains("price") | low(h).contains("cost"), "price").otherwise("")
    last = lambda k: F.coalesce(F.try_element_at(F.filter("named", lambda h: kind(h) == k), F.lit(-1))["x"], F.lit(0.0)).alias(f"{k}_x")
    prices = F.transform(F.filter("named", lambda h: kind(h) == "price"), lambda h: F.struct(h["text"].alias("name"), h["x"].alias("x")))
    found = {"header_y": F.when(unfinished, lowest).otherwise(F.col("top")), "names": F.transform("named", lambda h: h["text"]), **{f"{k}_x": last(k) for k in ("qty", "prod", "supp", "desc")}, "prices": prices}
    return page.select("doc_id", "page", *[F.when(F.col("top").isNotNull(), v).alias(k) for k, v in found.items()], "s")


def column_of(x: Column) -> Column:
    """The column a text at x belongs to: the nearest that the table has; beyond 50 points, by order of the known ones."""
    known = F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"{k}_x").alias("x")) for k in ("qty", "prod", "supp", "desc")])
    every = F.filter(F.concat(known, F.col("prices")), lambda c: c["x"] != 0)
    best = F.array_min(F.transform(every, lambda c, i: F.struct(F.abs(x - c["x"]).alias("d"), i.alias("i"), c["name"].alias("name"))))
    by_order = F.when(x < F.col("prod_x"), "qty").when(x < F.col("supp_x"), "prod").when(x < F.col("desc_x"), "supp").otherwise("desc")
    return F.when(best.isNull() | (best["d"] > FAR), by_order).otherwise(best["name"])


def table_rows(spans: DataFrame) -> DataFrame:
    """(doc_id, page, row_no, qty, prod, supp, desc, prices, label): rows below the header of each page, or of a page
    without one by the columns of the last page that has one, up to a footer; pages after a footer wait for a header."""
    w = Window.partitionBy("doc_id").orderBy("page")
    every = whole_pages(spans)
    carried = [F.last(c, ignorenulls=True).over(w).alias(c) for c in ("qty_x", "prod_x", "supp_x", "desc_x", "prices")]
    every = every.select("doc_id", "page", F.col("header_y"), F.col("header_y").isNotNull().alias("headed"), *carried, "s").where("qty_x is not null")
    below = F.filter("s", lambda e: F.col("header_y").isNull() | (e["y"] < F.col("header_y") - Y_TOLERANCE))
    own = every.select("doc_id", "page", "headed", "qty_x", "prod_x", "supp_x", "desc_x", "prices", F.inline(below))
    footer = F.lit(False)
    for t in FOOTERS:
        footer |= F.col("text").startswith(t)
    for t in FOOTERS_LEFT:
        footer |= F.col("text").startswith(t) & (F.col("x") < F.col("qty_x") + 10)
    own = own.withColumns({"footer": footer, "col": column_of(F.col("x"))})
    from ..functions.geometry import leader_clusters

    keys = ["doc_id", "page"]
    page = own.groupBy(*keys).agg(F.first("headed").alias("headed"), F.array_sort(F.collect_list(F.struct("span_seq", "y", "x", "col", "text", "footer"))).alias("s"))
    page = page.withColumn("c", F.explode(F.array(leader_clusters(F.transform("s", lambda e: e["y"]), Y_TOLERANCE))))
    flat = page.select(*keys, "headed", F.col("c.leaders").alias("leaders"), F.explode(F.arrays_zip("s", F.col("c.which").alias("which"))).alias("z"))
    flat = flat.select(*keys, "headed", F.get("leaders", F.col("z.which") - 1).alias("row_y"), "z.s.*")
    row = flat.groupBy(*keys, "row_y").agg(F.first("headed").alias("headed"), F.bool_or("footer").alias("footer"), F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("x", "span_seq", "col", "text")))).alias("cells"))
    down = Window.partitionBy(*keys).orderBy(F.desc("row_y"))
    row = row.withColumns({"ended": F.max(F.col("footer").cast("int")).over(down), "page_ended": F.max(F.col("footer").cast("int")).over(Window.partitionBy(*keys)), "row_no": F.row_number().over(down) - 1})
    # a page without a header counts only if no footer stands since the last header; row 0 speaks for its page
    row = row.withColumn("since", F.sum((F.col("headed") & (F.col("row_no") == 0)).cast("int")).over(w))
    earlier = Window.partitionBy("doc_id", "since").orderBy("page").rangeBetween(Window.unboundedPreceding, -1)
    row = row.withColumn("closed", F.coalesce(F.max("page_ended").over(earlier), F.lit(0))).where("(headed or closed = 0) and ended = 0")
    part = lambda k: F.array_join(F.transform(F.filter("cells", lambda c: c["col"] == k), lambda c: c["text"]), " ").alias(k)
    others = F.filter("cells", lambda c: ~c["col"].isin("qty", "prod", "supp", "desc"))
    names = F.array_distinct(F.transform(others, lambda c: c["col"]))
    prices = F.map_from_arrays(names, F.transform(names, lambda n: F.array_join(F.transform(F.filter(others, lambda c: c["col"] == n), lambda c: c["text"]), " ")))
    label = F.array_join(F.transform("cells", lambda c: c["text"]), " ")
    out = row.select(*keys, "row_no", part("qty"), part("prod"), part("supp"), part("desc"), prices.alias("prices"), label.alias("label"))
    return out.where("qty != '' or prod != '' or supp != '' or desc != ''")


def line_items(spans: DataFrame) -> DataFrame:
    """(doc_id, item_no, quantity, product_code, supplier_code, description, prices, category): rows with a number and a
    code are items; rows without a quantity but with a code go on the item before; any other row names the category of
    the items after it, over pages too."""
    w = Window.partitionBy("doc_id").orderBy("page", "row_no")
    rows = table_rows(spans)
    coded = (F.col("prod") != "") | (F.col("supp") != "")
    rows = rows.withColumn("item", is_number(F.col("qty")) & coded)
    rows = rows.withColumn("item_no", F.sum(F.col("item").cast("int")).over(w))
    rows = rows.withColumn("more", ~F.col("item") & (F.col("qty") == "") & coded & (F.col("item_no") > 0))
    category = F.last(F.when(~F.col("item") & ~F.col("more"), F.col("label")), ignorenulls=True).over(w)
    rows = rows.withColumn("category", F.coalesce(category, F.lit(""))).where("item or more")
    each = rows.groupBy("doc_id", "item_no").agg(F.array_sort(F.collect_list(F.struct("page", "row_no", "prod", "supp", "desc"))).alias("parts"), F.max(F.when(F.col("item"), F.col("qty"))).alias("quantity"), F.first(F.when(F.col("item"), F.col("prices")), ignorenulls=True).alias("prices"), F.max(F.when(F.col("item"), F.col("category"))).alias("category"))
    fold = lambda k: F.aggregate("parts", F.lit(""), lambda a, p: F.when(p[k] == "", a).otherwise(smart_append(a, p[k])))
    desc = F.array_join(F.filter(F.transform("parts", lambda p: p["desc"]), lambda t: t != ""), " ")
    return each.select("doc_id", (F.col("item_no") - 1).alias("item_no"), "quantity", fold("prod").alias("product_code"), fold("supp").alias("supplier_code"), desc.alias("description"), "prices", "category")


def is_code(text: Column) -> Column:
    """Hyphens and notes are no codes."""
    return (text != "") & (text != "-") & ~is_note(text)


def supplier_codes(items: DataFrame) -> DataFrame:
    """(doc_id, code_no, code): the codes of a document's items in order, each once; hyphens and notes are none."""
    real = items.where(is_code(F.col("supplier_code")))
    first = real.groupBy("doc_id", F.col("supplier_code").alias("code")).agg(F.min("item_no").alias("at"))
    return first.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).alias("code_no"), "code")


def extract_quotes(spans: DataFrame) -> DataFrame:
    """(doc_id, fields, headers, supplier_codes, line_items): a quotation a row."""
    fields = header_fields(build_lines(spans))
    items = line_items(spans)
    heads = table_headers(spans).groupBy("doc_id").agg(F.min_by("names", "page").alias("headers"))
    each = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("item_no", "quantity", "product_code", "supplier_code", "description", "category"))).alias("line_items"))
    each = each.withColumn("supplier_codes", F.array_distinct(F.filter(F.transform("line_items", lambda i: i["supplier_code"]), is_code)))
    empty = F.array().cast("array<string>")
    out = fields.join(heads, "doc_id", "left").join(each, "doc_id", "left")
    return out.withColumns({"headers": F.coalesce("headers", empty), "supplier_codes": F.coalesce("supplier_codes", empty)})


def of_documents(docs: DataFrame, what: str = "quotes") -> DataFrame:
    """Of documents (doc_id, content), read and searched in one pass that needs no exchange: fields as header_fields, items
    as line_items, codes as supplier_codes, or quotes as extract_quotes gives them."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(kernel(what), f"doc_id string, {SCHEMAS[what]}")


def report(quotes: DataFrame) -> DataFrame:
    """(doc_id, report): a quotation as text."""
    labels = {"company": "Company", "quote_name": "Quote Name", "quotation_ref": "Quotation Ref", "issue_date": "Issue Date", "quote_expiry": "Quote Expiry", "estimator": "Estimator", "contact_name": "Contact Name"}
    head = [F.concat(F.lit(f"{v}: "), F.col(k)) for k, v in labels.items()]
    codes = F.concat(F.lit("Supplier Codes: "), F.array_join("supplier_codes", ", "))
    items = F.array_join(F.transform(F.coalesce("line_items", F.array().cast("array<struct<item_no:bigint,quantity:string,product_code:string,supplier_code:string,description:string,category:string>>")), lambda i: F.concat_ws(" | ", i["quantity"], i["product_code"], i["supplier_code"], i["description"], i["category"])), "\n")
    return quotes.select("doc_id", F.concat_ws("\n", *head, codes, items).alias("report"))
