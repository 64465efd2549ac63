"""Layouts with known tables, lines and hits."""

import pytest
from pyspark.sql import functions as F

from leafmill import schemas
from leafmill.operators import lines, search, tables
from leafmill.options import TableOpts


def spans(spark, *pages):
    out = []
    for p, layout in enumerate(pages):
        k = 0
        for y, items in layout:
            for x, t in items:
                out.append(("d", p, k, float(x), float(y), float(x + 6 * len(t)), 12.0, "F", t))
                k += 1
    return spark.createDataFrame(out, schemas.SPANS)


def at(*xs):
    return lambda y, *texts: (y, list(zip(xs, texts, strict=False)))


def found(df):
    rows = df.orderBy(*[c for c in ("page", "table_no", "row_no") if c in df.columns]).collect()
    return ([c["name"] for c in rows[0]["columns"]], [r["cells"] for r in rows]) if rows else (None, [])


R = at(50, 150, 250)
NAMES = [R(700, "Name", "Age", "City"), R(680, "Alice", "30", "New York"), R(660, "Bob", "25", "London")]
W = at(50, 200, 350)
PEOPLE = [W(700, "Name", "Age", "City"), W(680, "Alice", "30", "New York"), W(660, "Bob", "25", "London"), W(640, "Carol", "35", "Paris"), W(620, "Dave", "28", "Berlin")]
BANK = [(700, [(50, "Date"), (150, "Desc"), (350, "Amount")]), (680, [(50, "Jan 05"), (150, "Payment to"), (350, "100.00")]), (668, [(150, "ACME Corp")]), (656, [(150, "Ref ABC123")]), (636, [(50, "Jan 06"), (150, "Transfer"), (350, "200.00")]), (624, [(150, "from Bob")])]


def test_headers(spark):
    o = TableOpts(headers=("Name", "Age"))
    assert found(tables.find_table(spans(spark, NAMES), o)) == (["Name", "Age", "City"], [["Alice", "30", "New York"], ["Bob", "25", "London"]])
    assert found(tables.find_table(spans(spark, [(700, [(50, "Hello")]), (680, [(50, "World")])]), o)) == (None, [])


def test_wrapped_headers(spark):
    page = [(700, [(50, "Product"), (150, "Suppliers"), (300, "Unit")]), (688, [(55, "Code"), (155, "Code"), (305, "Price")]), (660, [(50, "ABC-123"), (150, "SUP-001"), (300, "45.00")])]
    assert found(tables.find_table(spans(spark, page), TableOpts(headers=("Product", "Suppliers")))) == (["Product Code", "Suppliers Code", "Unit Price"], [["ABC-123", "SUP-001", "45.00"]])
    plain = found(tables.find_table(spans(spark, page), TableOpts(headers=("Product", "Suppliers"), wrap_tolerance=-1)))
    assert plain[0] == ["Product", "Suppliers", "Unit"] and plain[1][0] == ["Code", "Code", "Price"]


def test_row_filter(spark):
    page = [R(700, "A", "B", "C"), R(680, "1", "2", "3"), R(660, "skip", "this", "row"), R(640, "4", "5", "6")]
    assert found(tables.find_table(spans(spark, page), TableOpts(headers=("A", "B"), row_filter=F.col("cells")[0] != "skip")))[1] == [["1", "2", "3"], ["4", "5", "6"]]


@pytest.mark.parametrize(("gap", "rows"), [(0, 3), (50, 2)])
def test_max_row_gap(spark, gap, rows):
    page = [*NAMES, R(500, "Footer", "Info", "Here")]
    assert len(found(tables.find_table(spans(spark, page), TableOpts(headers=("Name", "Age"), max_row_gap=gap)))[1]) == rows


def test_merging(spark):
    want = [["Jan 05", "Payment to ACME Corp Ref ABC123", "100.00"], ["Jan 06", "Transfer from Bob", "200.00"]]
    df = spans(spark, BANK)
    assert len(found(tables.find_table(df, TableOpts(headers=("Date", "Desc"))))[1]) == 5
    assert found(tables.find_table(df, TableOpts(headers=("Date", "Desc"), merge_gap=16)))[1] == want
    assert found(tables.find_table(df, TableOpts(headers=("Date", "Desc"), anchor_column="date")))[1] == want
    both = [R(700, "A", "B", "C"), R(680, "a1", "b1", "c1"), (668, [(150, "b1-cont")]), R(648, "a2", "b2", "c2"), (636, [(150, "b2-cont")]), R(500, "f1", "f2", "f3")]
    assert found(tables.find_table(spans(spark, both), TableOpts(headers=("A", "B"), merge_gap=16, max_row_gap=50)))[1] == [["a1", "b1 b1-cont", "c1"], ["a2", "b2 b2-cont", "c2"]]


def test_anchor_merge_drops_summaries(spark):
    page = [R(700, "Date", "Desc", "Sum"), R(680, "d1", "x", "1"), (660, [(250, "99.00")]), (640, [(150, "123")]), (620, [(150, "more"), (250, "z")])]
    assert found(tables.find_table(spans(spark, page), TableOpts(headers=("Date", "Desc"), anchor_column="Date")))[1] == [["d1", "x more", "1 z"]]


def test_gaps(spark):
    names, rows = found(tables.find_tables(spans(spark, PEOPLE)))
    assert names == ["Name", "Age", "City"] and len(rows) == 4 and rows[2][2] == "Paris"
    assert found(tables.find_tables(spans(spark, [(y, [(50, "One whole sentence stands here.")]) for y in (700, 680, 660)]))) == (None, [])
    two = [(y, list(zip((50, 250), t, strict=True))) for y, t in ((700, ("Key", "Value")), (680, ("name", "alice")), (660, ("age", "30")), (640, ("city", "london")))]
    assert found(tables.find_tables(spans(spark, two))) == (None, [])
    assert len(found(tables.find_tables(spans(spark, two), TableOpts(min_columns=2)))[1]) == 3


def test_anchors(spark):
    page = [(700, [(50, "Date"), (150, "Desc"), (350, "Debit"), (450, "Credit")])]
    for i, y in enumerate((680, 636, 604, 572, 540)):
        page += [(y, [(50, f"Jan 0{i + 1}"), (150, "Payment"), ((350, 450)[i % 2], "100.00")]), (y - 12, [(150, "details")])]
    names, rows = found(tables.by_anchors(spans(spark, page), TableOpts()))
    assert names == ["Date", "Desc", "Debit", "Credit"] and len(rows) == 10 and rows[2] == ["Jan 02", "Payment", "", "100.00"]


def test_across_pages(spark):
    a, b = [R(700, "X", "Y", "Z"), R(680, "a", "b", "c")], [R(720, "s", "p", "q"), R(700, "X", "Y", "Z"), R(680, "d", "e", "f")]
    assert found(tables.across_pages(spans(spark, a, b), TableOpts(headers=("X", "Y"))))[1] == [["a", "b", "c"], ["s", "p", "q"], ["d", "e", "f"]]
    for tune in (False, True):
        names, rows = found(tables.across_pages(spans(spark, PEOPLE, PEOPLE), TableOpts(auto_tune=tune)))
        assert names == ["Name", "Age", "City"] and len(rows) == 8


def test_lines_and_search(spark):
    df = spark.createDataFrame([("d", 0, 0, 10.0, 100.0, 50.0, 12.0, "F", "Hello"), ("d", 0, 1, 100.0, 100.0, 140.0, 12.0, "F", "World"), ("d", 0, 2, 142.0, 100.0, 145.0, 12.0, "F", "!"), ("d", 0, 3, 10.0, 80.0, 60.0, 12.0, "F", "Line Two")], schemas.SPANS)
    assert [r["text"] for r in lines.build_lines(df).orderBy("line_no").collect()] == ["Hello" + " " * 10 + "World !", "Line Two"]
    hits = search.search(df, "o").collect()
    assert [round(h["rect"]["x"], 2) for h in hits] == [42.0, 108.0, 53.75] and hits[0]["rect"]["width"] > 0
    assert search.search(df, "absent").count() == 0 and search.search(df, "").count() == 0


def test_search_across_spans(spark):
    df = spark.createDataFrame([("d", 1, 0, 10.0, 100.0, 34.0, 12.0, "F", "tar"), ("d", 1, 1, 34.0, 100.0, 58.0, 12.0, "F", "get \\E(x)")], schemas.SPANS)
    hits = search.search(df, "target").collect()
    assert len(hits) == 1 and hits[0]["page"] == 1 and hits[0]["rect"]["width"] > 0
    assert search.search(df, "\\E(x").count() == 1


def test_show_and_cells(spark):
    df = tables.find_table(spans(spark, PEOPLE))
    assert [r["line"] for r in tables.show(df).orderBy("row_no").collect()][0] == "Alice   30  New York"
    assert tables.cells(df).where("col_name = 'City' and row_no = 2").first()["text"] == "Paris"
    assert tables.wide(df, ["city", "missing"]).orderBy("row_no").first()["missing"] == ""
