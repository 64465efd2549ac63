"""The driver contract, with and without the corpus subpackage."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
QUICK = ["filters_chain", "filters_lzw", "xref_stream_read", "text_predicates", "label_values", "glyph_to_text", "fit_rotated", "rotate_overlay", "nearest_column", "line_spacing", "tables_explicit_headers", "merge_gap", "merge_size_policies"]


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "invoice_roundtrip" in entry.queries()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    same = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted(got.columns) == sorted(names)
    assert sorted((same(r) for r in got.select(*names).collect()), key=str) == sorted((same(r) for r in want.fetchall()), key=str)


def test_without_corpus_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": ""}, check=True)
