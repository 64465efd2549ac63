"""Glyph lists from files in their published form: ``name;0041 0301`` a line, ``#`` before comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LARGEST = 100_000


def read_glyph_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of a glyph list; of a name that stands there twice, one."""
    line = F.trim(F.regexp_replace("value", "#.*", ""))
    parts = F.split(line, ";")
    codes = F.filter(F.split(F.trim(F.get(parts, F.lit(1))), "[ ,]+"), lambda c: c.rlike("^[0-9A-Fa-f]{4,6}$"))
    text = F.array_join(F.transform(codes, lambda c: F.decode(F.unhex(F.lpad(c, 8, "0")), "UTF-32")), "")
    return spark.read.text(path).where(line.contains(";")).select(F.trim(F.get(parts, F.lit(0))).alias("name"), text.alias("text")).where("name != '' AND text != ''").groupBy("name").agg(F.min("text").alias("text"))


def with_glyph_text(df: DataFrame, column: str, glyphs: DataFrame, out: str = "text") -> DataFrame:
    """The frame with each glyph name's text by a list, or else by rule."""
    from ..functions.text import glyph_to_text

    known = glyphs.select(F.col("name").alias("_name"), F.col("text").alias("_text"))
    return df.join(known, df[column] == known["_name"], "left").withColumn(out, F.coalesce("_text", glyph_to_text(F.col(column)))).drop("_name", "_text")


def glyph_texts(glyphs: DataFrame) -> dict[str, str]:
    """A glyph list for extract_spans, which takes it to every task; it may not have over ``LARGEST`` names."""
    rows = glyphs.limit(LARGEST + 1).collect()
    if len(rows) > LARGEST:
        raise ValueError(f"a glyph list of over {LARGEST} names")
    return {r["name"]: r["text"] for r in rows}
