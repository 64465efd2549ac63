"""Tables found in batches: one pass over lines and spans, and steps side by side equal to steps one by one."""

import os
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill import schemas
from leafmill.operators import batches, tables
from leafmill.options import TableOpts
from leafmill.plans import layout_queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", ["table_autotune", "table_autotune_choice", "tables_across_pages_auto", "tables_two_on_page"])
def test_one_pass_and_two_exchanges(spark, name):
    plan = layout_queries.QUERIES[name][0](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", plan)) == 1 and len(re.findall("Exchange hashpartitioning", plan)) == 2
    assert "Join" not in plan and "MapInArrow" in plan


def test_leaders_and_spacing_as_one_by_one():
    rng = np.random.default_rng(0)
    groups = np.sort(rng.integers(0, 40, 600))
    v = rng.integers(0, 60, 600).astype(float)
    v[7] = np.nan
    which, at = batches.leaders(groups, v, 3.0)
    lead: dict[int, list[int]] = {}
    for i, (g, x) in enumerate(zip(groups, v, strict=True)):
        near = [k for k in lead.setdefault(g, []) if abs(v[k] - x) < 3]
        assert at[which[i]] == (near[0] if near else i)
        if not near:
            lead[g].append(i)
    order = np.lexsort((v, groups))
    keep, last = batches.spaced(groups[order], v[order]), {}
    for i, k in zip(order, keep, strict=True):
        far = groups[i] not in last or not v[i] - last[groups[i]] < batches.COLUMN_SPACING
        assert k == far
        if far:
            last[groups[i]] = v[i]


def test_documents_stay_whole(monkeypatch):
    monkeypatch.setattr(batches, "SPANS_AT_ONCE", 10)
    rng = np.random.default_rng(1)
    doc = np.repeat(np.arange(30), rng.integers(1, 40, 30))
    page = rng.integers(0, 2, len(doc))
    t = pa.table({"doc_id": doc.astype(str), "page": np.sort(page + 2 * doc) % 2, "n": np.arange(len(doc))})
    for keys in (("doc_id",), ("doc_id", "page")):
        parts = [p.to_pandas() for p in batches.whole(iter(t.to_batches(max_chunksize=7)), keys)]
        assert [n for p in parts for n in p["n"]] == list(range(len(doc))) and len(parts) > 3
        every = [k for p in parts for k in p[list(keys)].drop_duplicates().itertuples(index=False, name=None)]
        assert len(every) == len(set(every))


def test_filters_come_before_the_choice(spark):
    rows = []
    for p in (0, 1):
        for i, texts in enumerate((("Name", "Age", "City"), ("Ann", "30", "Rome"), ("note", "", ""), ("Bob", "25", "Oslo"), ("Cid", "41", "Bern"))):
            rows += [("d", p, i * 3 + c, 50.0 + 150 * c, 700.0 - 20 * i, 90.0 + 150 * c, 12.0, "F", t) for c, t in enumerate(texts)]
    df = spark.createDataFrame(rows, schemas.SPANS)
    for tune in (False, True):
        opts = TableOpts(auto_tune=tune, row_filter=F.col("cells")[0] != "note")
        got = tables.across_pages(df, opts).orderBy("row_no").collect()
        assert [r["row_no"] for r in got] == list(range(6)) and [r["cells"][0] for r in got] == ["Ann", "Bob", "Cid"] * 2
    got = tables.find_tables(df, TableOpts(row_filter=F.col("cells")[0] != "Ann")).orderBy("page").collect()  # of two tables a page the first is emptied
    assert [(r["table_no"], r["row_no"], r["cells"][0]) for r in got] == [(0, 0, "Cid")] * 2


def packed(df):
    """Spans in order, a row for each page or, of pages with many, for each ten spans."""
    t = df.withColumn("_k", F.floor(F.col("span_seq") / 10)).groupBy("doc_id", "page", "_k").agg(F.array_sort(F.collect_list(F.struct(*batches.FIELDS))).alias("s"))
    return t.repartition(3, "doc_id").sortWithinPartitions("doc_id", "page", "_k").select("doc_id", "page", *[F.col(f"s.{f}").alias(f) for f in batches.FIELDS])


def test_packed_spans_and_wide_tables_as_others(spark):
    rows = []
    for d in range(25):
        for p in range(1 + d % 3):
            for i in range(2 + d % 5):
                texts = (" Name", "Größe ", "ΟΔΟΣ", "") if i == 0 else (f"n{d}", f"{i}.5", " " if i == 1 else f"x {p}", " é")
                rows += [(f"d{d}", p, i * 4 + c, 50.0 + 150 * c, 700.0 - 20 * i, 90.0 + 150 * c, 12.0, "F", None if d == 3 and i == 2 and c == 1 else t) for c, t in enumerate(texts)]
    df = spark.createDataFrame(rows, schemas.SPANS)
    names = ["NAME", "größe", "οδος", "none"]
    for opts in (TableOpts(), TableOpts(auto_tune=True), TableOpts(row_filter=F.col("cells")[0] != "n7"), TableOpts(headers=("name",))):
        found = tables.across_pages(df, opts)
        want = sorted(map(tuple, tables.wide(found, names).select("doc_id", "row_no", "page", *names).collect()))
        assert len(want) > 30 and {r[6] for r in want} == {""}
        assert sorted(map(tuple, tables.across_pages_wide(df, opts, names).select("doc_id", "row_no", "page", *names).collect())) == want
        if not opts.headers:
            assert sorted(map(tuple, tables.across_pages_wide(packed(df), opts, names, in_order=True).select("doc_id", "row_no", "page", *names).collect())) == want
            assert sorted(map(str, tables.across_pages(packed(df), opts, in_order=True).collect())) == sorted(map(str, found.collect()))
    for bad in (packed(df).sortWithinPartitions(F.desc("doc_id"), "page"), packed(df).sortWithinPartitions("doc_id", F.desc("page")), packed(df).withColumn("x", F.array(F.lit(1.0)))):
        with pytest.raises(Exception, match="order of their documents|differ in length"):
            tables.across_pages(bad, TableOpts(), in_order=True).collect()


def test_texts_are_trimmed_and_lowered_as_by_spark(spark):
    every = [chr(c) for c in range(1, 0x3100) if chr(c).isprintable() or chr(c).isspace() or c < 256]
    texts = [c + "Ab" + c for c in every] + every + ["ΑΣ", "ΑΣ Β", "\x00a ", "a\n", " ", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = df.select(tables.trim(F.col("text")).alias("text")).where("text != ''").select("text", F.lower("text")).collect()
    one = {f: pa.array([[i] for i in range(len(texts))], pa.list_(pa.int32())) for f in batches.FIELDS} | {"text": pa.array([[t] for t in texts])}
    b = pa.RecordBatch.from_pydict({"doc_id": pa.array(["d"] * len(texts)), "page": pa.array([0] * len(texts), pa.int32())} | one)
    got = batches.unpacked(b)
    assert list(zip(got["text"].to_pylist(), got["low"].to_pylist(), strict=True)) == [tuple(r) for r in want]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_lines_not_spans_are_sorted(spark):
    plan = layout_queries.across_pages_auto(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "page" not in "".join(re.findall(r"Sort \[.*", plan)) and "transform(" not in plan
