"""The corpus pipeline: toxicity, n-gram Jaccard join, substring dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import jaccard_join, packing, secret_scan, substring_runs, toxicity
from leafmill.llm.common import DOC_COLUMNS, Scratch, by_document, documents, table


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.kept(docs.select(*DOC_COLUMNS), model)


def stage_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least doc_id."""
    keyed = documents(docs)
    with Scratch(spark) as scratch:
        classes = jaccard_join.classes(keyed, scratch)
    heads = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("text_key").eqNullSafe(F.col("class_key"))).select("doc_id", "text_key").distinct()
    own = docs.select(*DOC_COLUMNS).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    return by_document(own, heads, "left_semi").dropDuplicates(["text_key", "doc_id"]).select(*DOC_COLUMNS)


def stage_substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows go; documents that have lost all their words go too."""
    return substring_runs.cleaned(docs.select(*DOC_COLUMNS))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    own = docs.select(*DOC_COLUMNS)
    out = secret_scan.redact(own, secret_scan.fitted(own))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*DOC_COLUMNS)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", stage_toxicity), ("ngram_jaccard_join", stage_jaccard), ("substring_dedup", stage_substring), ("secret_scans", stage_secrets), ("packing", stage_packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what lies between two stages is deleted once the next one stands."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for i, (name, stage) in enumerate(STAGES):
            docs = scratch.keep(stage(spark, docs, sf_dir), name, result=i == len(STAGES) - 1)
            if i:
                scratch.free(STAGES[i - 1][0])
    return docs
