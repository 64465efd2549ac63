"""Spans, pages and hits of PDF files as they arrive; no state is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import search
from ..sources.pdf import extract_pages, extract_spans, keyed_files

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def read_stream(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(doc_id, name, content) of files as they appear below a path."""
    return keyed_files(spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob).load(path))


def spans(files: DataFrame) -> DataFrame:
    return extract_spans(files)


def pages(files: DataFrame) -> DataFrame:
    return extract_pages(files)


def write_hits(files: DataFrame, query: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the hits of each batch; a batch is written to a folder of its own, so that a repeated one replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        search.search(extract_spans(batch), query).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
