"""Many documents at once: equal to one by one, and dealt out once."""

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from leafmill.codec import bulk, compose, draw
from leafmill.codec.interpret import page_spans
from leafmill.codec.reader import Reader
from leafmill.codec.scan import Name
from leafmill.codec.writer import Writer
from leafmill.operators import quotes, sinks
from leafmill.operators.lines import build_lines
from leafmill.plans import bytes_queries, edit_queries, quote_queries
from leafmill.sources.pdf import extract_spans

DATA = "/root/testdata/sf0.001"
TEXTS = ["a", "(x)", "a\\b", "é ü", "日本", "", "12.50", "a\nb", "two words  ", "\x07bell", None, "x" * 300]


def some_pages(rng: random.Random, d: int) -> list[tuple[float, float, list]]:
    def op() -> tuple:
        kind = rng.choice(["text"] * 9 + ["font", "color"])
        return {"text": ("text", [rng.choice([0.0, -0.0, 1e-7, -12.34567, 1234567.891]), rng.random() * 800], rng.choice(TEXTS)), "font": ("font", [10.5], rng.choice(["Courier", None])), "color": ("color", [1.0, 0.0, 0.5], None)}[kind]

    plain = lambda: [("text", [50.5, 700.0], f"w{i} {d}") for i in range(rng.randint(1, 9))]
    ops = [[op() for _ in range(rng.randint(1, 12))] if rng.random() < 0.4 else plain() for _ in range(rng.randint(1, 3))]
    return [(612.0, 792.0, ([("font", [10.0], "Courier")] if rng.random() < 0.3 else []) + o) for o in ops]


def written_one_by_one(pages: list[tuple[float, float, list]]) -> bytes:
    w = Writer()
    tree, refs, known = w.allocate(), [], {}
    for width, height, ops in pages:
        content, fonts = draw.page_content(ops)
        body = w.add_stream(w.allocate(), {}, content)
        for base in fonts.values():
            known[base] = known.get(base) or w.add(w.allocate(), draw.font_entry(base))
        resources = {"Font": {k: known[base] for k, base in fonts.items()}} if fonts else {}
        refs.append(w.add(w.allocate(), {"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 0, width, height], "Contents": body, "Resources": resources}))
    return w.finish_pages(tree, refs)


def test_written_and_read_as_one_by_one():
    rng = random.Random(1)
    docs = [some_pages(rng, d) for d in range(200)]
    data = [draw.create(p) for p in docs]
    assert data == [written_one_by_one(p) for p in docs]
    flat = [(d, i, o) for d, pages in enumerate(docs) for i, (_, _, ops) in enumerate(pages) for o in ops]
    ops = pa.StructArray.from_arrays([pa.array([f[2][0] for f in flat]), pa.array([f[2][1] for f in flat], pa.list_(pa.float64())), pa.array([f[2][2] for f in flat], pa.string())], ["op", "args", "text"])
    starts = np.flatnonzero(bulk.changed(*(np.array([f[k] for f in flat]) for k in (0, 1))))
    assert bulk.contents(starts, ops) == [draw.page_content(ops) for pages in docs for _, _, ops in pages]
    data += [b"junk", None, data[3][:200], data[7].replace(b"/Type /Page ", b"/Rotate 90 /Type /Page "), data[9].replace(b"ID [<", b"ID [(<)")]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([str(i) for i in range(len(data))]), "content": pa.array(data, pa.binary())})
    want = []
    for i, x in enumerate(data):
        try:
            reader = Reader(x or b"")
        except ValueError:
            continue
        want += [(str(i), p, k, *s) for p, page in enumerate(reader.pages()) for k, s in enumerate(page_spans(reader, page))]
    assert [tuple(r.values()) for t in bulk.span_batches([batch]) for r in t.to_pylist()] == want and len(want) > 1000
    simple = [p.shown is not None for _, pages in bulk.parts(batch) for p in pages]
    assert 0.4 < np.mean(simple) < 1


def test_packed_texts_make_the_documents_of_single_ones(spark, monkeypatch):
    monkeypatch.setattr(sinks, "ROWS_AT_ONCE", 5)
    rows = [(d, p, k, float(k), 700.0 - p, f"t{k % 3}(") for d in ("a", "b", "c") for p in (1, 0) for k in range(9)] + [("c", 0, 3, 3.0, 700.0, "t0(")]
    one = spark.createDataFrame(rows, "doc_id string, page int, op_seq int, x double, y double, text string")
    packed = one.selectExpr("doc_id", "page", "array(struct(op_seq, x, y, text)) AS texts").repartition(3, "doc_id").sortWithinPartitions("doc_id")
    same = lambda df: sorted((r["doc_id"], bytes(r["content"])) for r in df.collect())
    assert same(sinks.create_text_pdf(packed)) == same(sinks.create_pdf(sinks.text_ops(one)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", ["page_count", "page_media_box"])
def test_lines_are_dealt_once_and_texts_never(spark, name):
    plan = bytes_queries.QUERIES[name][0](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert len(re.findall("Exchange", below)) == 1 and "collect_list" not in plan and "Generate" not in plan


WORDS = ["Quantity", "Suppliers", "Suppliers Code", " Quantity ", "Code", "code", "Price", "Product Code", "Product", "Product Description", "Unit Price", "Cost", "12", "1.5", "P-1", "S9-", "X/", "NOTE a", "-", " ", "Total: 5", "Delivery Charge: 3", "Company: A Estimator: B Contact", "Contact Name: C Estimator", "Quote Name:", "Issue Date:", "Quotation Ref: R", "Quote Expiry: Quote is valid until 1/2", "free text", "é "]


def odd_quotation(rng: random.Random) -> bytes:
    pages = []
    for _ in range(rng.randint(1, 4)):
        ops = [("text", [rng.choice([0.0, 50.0, 52.0, 120.0, 220.0, 320.0, 480.0, 590.0]), rng.choice([700.0, 699.0, 690.0, 688.5, 680.0, 640.0, 638.5, 620.0, 600.0, 40.0])], rng.choice(WORDS)) for _ in range(rng.randint(1, 30))]
        if rng.random() < 0.6:
            ops += [("text", [x, 690.0], t) for x, t in zip((50.0, 120.0, 220.0, 320.0, 480.0), ("Quantity", "Product Code", "Suppliers", "Product Description", "Unit Price"), strict=True)]
            ops += [("text", [x, y], t) for y in (660.0, 630.0) for x, t in ((50.0, "3"), (120.0, "P-7"), (220.0, "S1-"), (480.0, "9.50")) if rng.random() < 0.8]
        pages.append((612.0, 792.0, ops))
    return draw.create(pages)


def test_quotations_of_documents_as_of_spans(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(f"d{i}", bytearray(odd_quotation(rng))) for i in range(300)] + [("bad", bytearray(b"x")), ("none", None)], "doc_id string, content binary").repartition(4)
    spans = extract_spans(docs).cache()
    names = ["doc_id", *quotes.FIELDS, "headers", "line_items", "supplier_codes"]
    same = lambda df, cols: sorted(map(repr, df.select(*cols).collect()))
    want = same(quotes.extract_quotes(spans), names)
    assert same(quotes.of_documents(docs), names) == want and len(want) == 300
    items, cols = quotes.of_documents(docs, "items"), ["doc_id", "item_no", "quantity", "product_code", "supplier_code", "description", "category", "prices"]
    assert same(items, cols) == same(quotes.line_items(spans), cols) and items.count() > 300
    assert same(quotes.of_documents(docs, "codes"), ["doc_id", "code_no", "code"]) == same(quotes.supplier_codes(quotes.line_items(spans)), ["doc_id", "code_no", "code"])
    assert same(quotes.of_documents(docs, "fields"), names[:8]) == same(quotes.header_fields(build_lines(spans)), names[:8])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", ["quotes", "quote_report", "quote_header_fields", "quote_line_items", "quote_category_fill", "quote_supplier_codes"])
def test_quotations_are_read_in_one_pass(spark, name):
    plan = quote_queries.QUERIES[name][0](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("MapInArrow", plan)) == 2 and len(re.findall("REPARTITION", plan)) == 1 and "l_orderkey" not in "".join(re.findall("Join.*", plan))
    assert len(re.findall("Exchange", plan[: plan.index("Union")])) == 1  # what follows the lines: that they are dealt by


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_documents_are_made_once_for_all_policies(spark):
    plan = edit_queries.merge_limits(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("MapInArrow", plan)) == 2 and "Union" not in plan[: plan.index("MapInArrow")]


def test_a_merge_is_joined_once_under_all_limits(monkeypatch):
    data, joined = draw.create([(612.0, 792.0, [("text", [72.0, 700.0], "once")])] * 3), []
    own = compose._join
    monkeypatch.setattr(compose, "_join", lambda *a: (joined.append(a[1:4]), own(*a))[1])
    m = compose.Merge([(data, None)] * 4)
    for limit, policy in ((0, "fail"), (10**6, "fail"), (1, "fail"), (10**6, "shrink"), (1, "shrink"), (1, "truncate")):
        try:
            got = m.under(limit, policy)
        except compose.Oversize as e:
            assert limit == 1 and e.total == 12
        else:
            assert got == compose.merge([(data, None)] * 4, limit, policy) and got.included_pages == 12
    assert joined[:1] == [(False, 0, 0)] and (True, 0, 10) not in joined and len(joined) == 6  # three, and the three of compose.merge
