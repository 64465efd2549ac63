"""What scratch tables leave on disk."""

import time

from leafmill.llm import segments
from leafmill.llm.common import Scratch


def shuffle_files(spark) -> set[str]:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for i in range(found.size()) if (f := found.apply(i)).getName().startswith("shuffle_")}


def test_scratch_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    with Scratch(spark) as scratch:
        kept = scratch.keep(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "counts")
        until = time.time() + 5
        while shuffle_files(spark) - before and time.time() < until:
            time.sleep(0.1)
        assert not shuffle_files(spark) - before
        assert kept.count() == 7


def test_places_of_repeated_rows_are_listed_once(spark):
    rows = spark.createDataFrame([(1, 5, 0, 46), (1, 5, 0, 46), (1, 5, 50, 2)], "doc_id long, text_key long, start int, n int")
    found = segments.per_document(rows, "cut").first()["cut"]
    assert sorted((p["start"], p["n"]) for p in found) == [(0, 46), (50, 2)]
