"""The registered queries over the parquet tables and the SQL that gives the same rows.

No table holds a PDF, so documents are drawn from the tables, read back as bytes, and turned into rows again; what comes
out is compared with the rows that went in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bytes_queries, codec_queries, edit_queries, layout_queries, quote_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "invoice_roundtrip"
MODULES = (bytes_queries, codec_queries, text_queries, layout_queries, edit_queries, quote_queries)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
