"""Jobs over folders: ``spark-submit leafmill/jobs.py JOB ...`` or ``python -m leafmill.jobs JOB ...``.

    tables IN OUT [--headers A,B] [--merge-gap N] [--max-row-gap N] [--anchor NAME] [--across] [--auto-tune] [--lines]
    quotes IN OUT [--report]
    search IN OUT TEXT
    merge IN OUT [--max-size N] [--policy fail|truncate|shrink]     all files of a folder, by path, as one document
    watermark IN OUT IMAGE [--rotation N] [--opacity N] [--scale N] [--skip-first N] [--skip-last N]
    sample OUT                                                      an invoice and a report

Documents are read from every PDF file below IN. Tables, quotes and hits are written as Parquet; documents as rows of
(doc_id, content), a file each with ``--files`` where OUT is a folder that every executor reaches by its path.
"""

from __future__ import annotations

import argparse
import os
import sys

if __package__ in (None, ""):  # run as a script
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from leafmill.codec import draw  # noqa: E402
from leafmill.operators import quotes, search, sinks, tables  # noqa: E402
from leafmill.options import MergeOptions, TableOpts  # noqa: E402
from leafmill.plans.samples import invoice_page, report_pages  # noqa: E402
from leafmill.ship import ship  # noqa: E402
from leafmill.sources.pdf import extract_pages, extract_spans, read_files, read_image_files  # noqa: E402


def table_rows(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    opts = TableOpts(headers=tuple(filter(None, a.headers.split(","))), merge_gap=a.merge_gap, max_row_gap=a.max_row_gap, anchor_column=a.anchor, auto_tune=a.auto_tune)
    spans = extract_spans(read_files(spark, a.source))
    found = tables.across_pages(spans, opts) if a.across or a.auto_tune else tables.find_tables(spans, opts)
    return tables.show(found) if a.lines else found


def quote_rows(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    found = quotes.extract_quotes(extract_spans(read_files(spark, a.source)))
    return quotes.report(found) if a.report else found


def hits(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return search.document_order(search.search(extract_spans(read_files(spark, a.source)), a.text))


def merged(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    docs = read_files(spark, a.source)
    chosen = docs.select(F.lit("merged").alias("merge_id"), F.col("doc_id").alias("src_no"), "doc_id", F.lit(None).cast("array<int>").alias("pages"))
    out = sinks.merge_documents(docs, chosen, MergeOptions(a.max_size, a.policy))
    return out.select(F.concat("merge_id", F.lit(".pdf")).alias("doc_id"), F.col("data").alias("content"), "total_pages", "included_pages", "oversize", "error")


def watermarked(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    docs = read_files(spark, a.source)
    image = read_image_files(spark, a.image).first()
    if image is None:
        raise ValueError(f"no image at {a.image}")
    places = sinks.stamp_places(extract_pages(docs), image["width"], image["height"], a.rotation, a.scale, a.skip_first, a.skip_last)
    one = F.struct(*[F.lit(image[k]).cast(kind).alias(k) for k, kind in (("width", "int"), ("height", "int"), ("rgb", "binary"), ("alpha", "binary"))])
    edits = sinks.image_stamps(places.withColumns({"edit_seq": F.lit(0), "rotation": F.lit(a.rotation), "opacity": F.lit(a.opacity), "image": one}))
    return sinks.overlay(docs, edits)


def samples(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    made = [("invoice.pdf", draw.create([invoice_page()])), ("report.pdf", draw.create(report_pages()))]
    return spark.createDataFrame([(n, bytearray(x)) for n, x in made], "doc_id string, content binary")


def write_files(docs: DataFrame, out: str) -> int:
    """Each document as a file of its key's last part below out; how many. Keys that share it get a number before."""
    folder = out.removeprefix("file:").replace("//", "/")
    os.makedirs(folder, exist_ok=True)
    from pyspark.sql.window import Window

    name = F.element_at(F.split("doc_id", "/"), -1)
    nth = F.row_number().over(Window.partitionBy("name").orderBy("doc_id"))
    named = docs.select("doc_id", name.alias("name"), "content").where("content is not null").withColumn("nth", nth)
    named = named.select(F.when(F.col("nth") > 1, F.concat_ws("-", "nth", "name")).otherwise(F.col("name")).alias("name"), "content")

    def write(rows) -> None:
        for r in rows:
            draft = f"{folder}/.{r['name']}.{os.getpid()}"
            with open(draft, "wb") as f:
                f.write(r["content"])
            os.replace(draft, f"{folder}/{r['name']}")  # a task that runs twice leaves one whole file

    named.foreachPartition(write)
    return named.count()


JOBS = {"tables": table_rows, "quotes": quote_rows, "search": hits, "merge": merged, "watermark": watermarked, "sample": samples}
DOCUMENTS = ("merge", "watermark", "sample")


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="leafmill.jobs", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = parser.add_subparsers(dest="job", required=True)
    made = {name: jobs.add_parser(name) for name in JOBS}
    for name, p in made.items():
        if name != "sample":
            p.add_argument("source")
        p.add_argument("out")
    made["search"].add_argument("text")
    made["watermark"].add_argument("image")
    for name in DOCUMENTS:
        made[name].add_argument("--files", action="store_true")
    for flag, kind, default in (("--headers", str, ""), ("--merge-gap", float, 0.0), ("--max-row-gap", float, 0.0), ("--anchor", str, "")):
        made["tables"].add_argument(flag, type=kind, default=default)
    for flag in ("--across", "--auto-tune", "--lines"):
        made["tables"].add_argument(flag, action="store_true")
    made["quotes"].add_argument("--report", action="store_true")
    made["merge"].add_argument("--max-size", type=int, default=0)
    made["merge"].add_argument("--policy", choices=("fail", "truncate", "shrink"), default="fail")
    for flag, kind, default in (("--rotation", float, 45.0), ("--opacity", float, 0.3), ("--scale", float, 0.85), ("--skip-first", int, 0), ("--skip-last", int, 0)):
        made["watermark"].add_argument(flag, type=kind, default=default)
    return parser.parse_args(argv)


def main(argv: list[str], spark: SparkSession | None = None) -> None:
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName(f"leafmill {a.job}").getOrCreate()
    ship(spark)
    rows = JOBS[a.job](spark, a)
    if getattr(a, "files", False):
        write_files(rows, a.out)
    else:
        rows.write.mode("errorifexists").parquet(a.out)


if __name__ == "__main__":
    main(sys.argv[1:])
