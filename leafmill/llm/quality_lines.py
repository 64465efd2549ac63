"""Quality rules: cross-document line frequency.

Normalised lines (words joined by one space, ASCII letters lower-cased, digits read as 0) are hashed; for each host the
documents that hold a line are counted; lines in more than ``max_docs`` documents of the host, and in more than
``max_share`` of its documents, are removed; a document that loses more than ``max_removed`` of its words, or keeps
fewer than ``min_words``, is depleted and rejected.

Defined results: null text has no words; a null host is a host of its own; each row counts as a document, also if its
doc_id repeats; a text without words fails the base rules. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textnum as tn
from .common import Scratch, batch, by_document, documents

NEWLINE = 10
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
FOLDED = tn.BYTE[tn.FOLD]

STATS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("host", pa.string()), *((x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("lines", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int64()))])
STATS_SQL = "doc_id long, text_key long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lines array<long>, line_words array<long>"


def repeated(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items keyed within rows: equal to an earlier item of the row; equal to any other of the row."""
    later, shared = np.zeros(len(key), bool), np.zeros(len(key), bool)
    if len(key) > 1:
        k = tn.mix(key + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(k, kind="stable")
        same = k[order][1:] == k[order][:-1]
        later[order[1:][same]] = True
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
    return later, shared


def text_stats(buf: np.ndarray, offs: np.ndarray) -> dict[str, object]:
    """Base counts of each row, and the distinct normalised lines of each row with the words they hold."""
    start, end, first = tn.words(buf, offs)
    n_words = np.diff(first)
    code_points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=code_points[1:])
    row = tn.row_of(first)
    p = tn.prefix(tn.BYTE[buf])
    w = tn.spans(p, start, end)

    # lines that hold a word: runs of words of one row with as many newlines before them
    cut = np.append(np.flatnonzero(buf == NEWLINE), len(buf))
    nth = np.searchsorted(cut, start)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (nth[1:] != nth[:-1])
    first_word = np.flatnonzero(fresh)
    words_in = np.diff(np.append(first_word, len(start)))
    line_row, nth = row[first_word], nth[first_word]
    line_start = np.maximum(offs[line_row], np.where(nth > 0, cut[nth - 1] + 1, 0))
    body = np.minimum(offs[line_row + 1], cut[nth])
    dup, _ = repeated(tn.spans(p, line_start, body), line_row)
    n_dup = np.bincount(line_row[dup], minlength=len(n_words))

    folded = tn.spans(tn.prefix(FOLDED[buf]), start, end)
    norm = tn.spans(tn.prefix(folded), first_word, first_word + words_in)
    again, _ = repeated(norm, line_row)

    tri = tn.windows(tn.prefix(w), 3)
    inside = row[: len(tri)] == row[2:] if len(row) > 2 else np.zeros(0, bool)
    _, shared = repeated(tri[inside], row[: len(tri)][inside])
    at = np.flatnonzero(inside)[shared]
    hit = np.zeros(len(w) + 2, bool)
    for k in range(3):
        hit[at + k] = True
    n_repeat = tn.sums(hit[: len(w)], first)

    lines_in = ~again
    order = np.bincount(line_row[lines_in], minlength=len(n_words))
    by_line = np.zeros(len(order) + 1, np.int32)
    np.cumsum(order, out=by_line[1:])
    # words of every line with the same normal form count for its first
    total = _totals(norm, line_row, words_in, lines_in)
    return {
        "n_words": n_words,
        "word_chars": tn.sums(code_points[end] - code_points[start], first),
        "n_symbols": tn.sums(SYMBOL[buf], offs),
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "base_failed": (n_words < 50) | (100 * n_repeat > 50 * n_words),
        "lines": pa.ListArray.from_arrays(pa.array(by_line), pa.array(norm[lines_in].view(np.int64))),
        "line_words": pa.ListArray.from_arrays(pa.array(by_line), pa.array(total)),
    }


def _totals(norm: np.ndarray, row: np.ndarray, n: np.ndarray, first: np.ndarray) -> np.ndarray:
    if not len(norm):
        return np.zeros(0, np.int64)
    k = tn.mix(norm + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, where = np.unique(k, return_inverse=True)
    return np.bincount(where, weights=n).astype(np.int64)[where][first]


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, buf, offs in tn.chunks(b["text"]):
            part = b.slice(lo, hi - lo)
            yield batch(STATS, {x: part[x] for x in ("doc_id", "text_key", "host")} | text_stats(buf, offs))


def line_frequency(df: DataFrame, host: str = "source", max_docs: int = 50, max_share: float = 0.01, max_removed: float = 0.5, min_words: int = 25) -> DataFrame:
    """One row for each input row: base counts, base_failed, n_removed_words, n_removed_lines and kept.

    Line counts are summed on the map side, so a line that a third of all documents hold is one row per task; the join
    back to the lines is an ordinary one that adaptive execution splits where a key is hot.
    """
    spark = df.sparkSession
    docs = documents(df.withColumn("host", F.col(host).cast("string")), "host").withColumn("doc_id", F.col("doc_id").cast("long"))
    with Scratch(spark) as scratch:
        stats = scratch.keep(docs.mapInArrow(_stats, STATS_SQL), "stats")
        sizes = stats.groupBy("host").agg(F.count("*").alias("host_docs"))
        lines = stats.select("doc_id", "text_key", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("doc_id", "text_key", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
        often = lines.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs).withColumnRenamed("host", "h").withColumnRenamed("line", "l")
        sizes = sizes.withColumnRenamed("host", "hh")
        often = often.join(sizes, often["h"].eqNullSafe(sizes["hh"])).where(F.col("docs") > max_share * F.col("host_docs")).select("h", "l")
        gone = lines.join(often, lines["host"].eqNullSafe(often["h"]) & (lines["line"] == often["l"])).groupBy("doc_id", "text_key").agg(F.sum("words").alias("gone_words"), F.count("*").alias("gone_lines"))
        base = stats.drop("lines", "line_words", "host").withColumn("same", F.count("*").over(Window.partitionBy("doc_id", "text_key")))
        out = by_document(base, gone)
        share = (F.coalesce("gone_words", F.lit(0)) / F.col("same")).cast("long")
        out = out.withColumn("n_removed_words", share).withColumn("n_removed_lines", (F.coalesce("gone_lines", F.lit(0)) / F.col("same")).cast("long"))
        left = F.col("n_words") - F.col("n_removed_words")
        depleted = (F.col("n_removed_words") > max_removed * F.col("n_words")) | (left < min_words)
        out = out.withColumn("kept", ~F.col("base_failed") & ~depleted)
        return scratch.keep(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words", "n_removed_lines"), "result", result=True)
