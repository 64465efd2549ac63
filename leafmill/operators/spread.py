"""Dealing out rows whose work is heavier than their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by keys over all shuffle partitions: adaptive execution sizes partitions by bytes and would put the work of
    many small documents into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
