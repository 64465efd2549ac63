"""Shared pieces: table access, scratch tables on shared storage, Arrow output."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file:///tmp/leafmill-{spark.sparkContext.applicationId}"  # one process: its own folder is shared
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Writes in the block drop their shuffle files as they end; else those stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors.

    ``keep`` writes one and reads it back; leaving the block deletes all but those kept with ``result=True``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.paths = spark, f"{shared_dir(spark)}/leafmill/{uuid.uuid4().hex}", []

    def __enter__(self) -> Scratch:
        return self

    def path(self, name: str, result: bool = False) -> str:
        at = f"{self.base}-{name}"
        if not result:
            self.paths.append(at)
        return at

    def keep(self, df: DataFrame, name: str, result: bool = False) -> DataFrame:
        at = self.path(name, result)
        with shuffles_dropped(self.spark):
            df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def free(self, *names: str) -> None:
        """Delete tables that no later step reads, and let Spark drop the shuffle files behind them."""
        for at in [p for p in self.paths if not names or p.rpartition("-")[2] in names]:
            delete(self.spark, at)
            self.paths.remove(at)
        self.spark._jvm.System.gc()

    def __exit__(self, *_) -> None:
        self.free()


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text (null: empty), with a key that tells apart rows whose doc_id repeats with another text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [F.col("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"), *(F.col(x) for x in extra)]
    return df.select(*own)


def by_document(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on the document key; a null doc_id is a value like any other."""
    r = right.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    on = left["text_key"].eqNullSafe(r["_key"]) & left["doc_id"].eqNullSafe(r["_id"])
    out = left.join(r, on, how)
    return out.drop("_id", "_key")


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)
