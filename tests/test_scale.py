"""Plans that hold at size: documents are dealt out, and made once."""

import os

import pytest

from leafmill.operators import sinks
from leafmill.plans import codec_queries

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", ["overlay_isolated", "merge_descriptive_keys", "merge_jpeg_shrink"])
def test_contents_are_not_broadcast(spark, name):
    found = plan(codec_queries.QUERIES[name][0](spark, DATA))
    assert "SortMergeJoin" in found and "BroadcastHashJoin" not in found


def test_documents_in_small_rows_are_not_broadcast(spark):
    docs = spark.createDataFrame([("a", b"x")], "doc_id string, content binary")
    texts = spark.createDataFrame([("a", 0, 0, 1.0, 1.0, "t", 0.0)], "doc_id string, page int, edit_seq int, x double, y double, text string, font_size double")
    edits = sinks.text_overlays(texts)
    assert "BroadcastHashJoin" not in plan(sinks.overlay(docs, edits))
