"""Repeated windows by content-defined segments.

Every window of ``n`` units (words or bytes) is named by the least hash of the runs of ``k`` units inside it. Windows
in a row with the same name form a segment. Equal windows have equal names wherever they stand, so a window can only
be repeated where its name is; and where all segments of a name are the same text, all their windows repeat. What is
left, segments that share a name but differ somewhere, is compared window by window.

A segment is a row of (fp, span, check, doc_id, text_key, start, n, twice): its name, two independent 64-bit hashes of
all it covers, where its windows start, how many there are, and whether its name occurs in it twice, so that it may
repeat itself. There are about 2 / (n - k + 2) rows a unit. Texts are taken as equal where both hashes are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import batch

LOW = np.uint64(4095)
SEGMENTS = pa.schema([("fp", pa.int64()), ("span", pa.int64()), ("check", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("twice", pa.bool_())])
SEGMENTS_SQL = "fp long, span long, check long, doc_id long, text_key long, start int, n int, twice boolean"

OTHER = tn.seeds(256, 3)

# A unit reader gives, for bytes and offsets, two independent values for each unit and the first unit of each row.
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def word_units(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, end, first = tn.words(buf, offs)
    return tn.word_hashes(buf, start, end), tn.word_hashes(buf, start, end, OTHER), first


def byte_units(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tn.BYTE[buf], OTHER[buf], offs


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every width values in a row."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def segments(values: np.ndarray, other: np.ndarray, first: np.ndarray, n: int, k: int) -> dict[str, np.ndarray]:
    """The segments of rows of units: row, start (in the row), n, fp, span, check, twice."""
    units, width = len(values), n - k + 1
    if units < n:
        none = np.zeros(0, np.int64)
        return {"row": none, "start": none, "n": none, "fp": none, "span": none, "check": none, "twice": none.astype(bool)}
    p = tn.prefix(values)
    g = (p[k:] - p[:-k]) * tn.powers(tn.R_INV, len(p))[: len(p) - k]
    g ^= g >> np.uint64(32)
    g *= np.uint64(0x9E3779B97F4A7C15)
    place = np.arange(len(g), dtype=np.uint64) & LOW
    g &= ~LOW
    left, right = least(g | place, width), least(g | (LOW - place), width)
    name = left & ~LOW
    twice = (left & LOW) != LOW - (right & LOW)
    size = np.diff(first)
    row = np.repeat(np.arange(len(size)), size)
    valid = row[: len(name)] == row[n - 1 :]
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (name[1:] != name[:-1])
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | (name[1:] != name[:-1])
    start, last = np.flatnonzero(fresh), np.flatnonzero(stop)
    long = last - start >= 4 * width
    if long.any():  # a run that goes on and on is cut at fixed distances from its start
        parts = np.where(long, (last - start) // (4 * width) + 1, 1)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, last, forced = np.repeat(start, parts) + nth * 4 * width, np.repeat(last, parts), np.repeat(long, parts)
        last = np.where(forced, np.minimum(last, start + 4 * width - 1), last)
    else:
        forced = long
    many = np.append(0, np.cumsum(twice))
    return {
        "row": row[start],
        "start": start - first[row[start]],
        "n": last - start + 1,
        "fp": name[start].view(np.int64),
        "span": tn.spans(p, start, last + n).view(np.int64),
        "check": tn.spans(tn.prefix(other), start, last + n).view(np.int64),
        "twice": (many[last + 1] > many[start]) | (last - start >= width) | forced,
    }


def find(docs: DataFrame, units: Units, n: int, k: int, chunk: int) -> DataFrame:
    """The segments of documents (doc_id, text, text_key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, keys = b["doc_id"].to_numpy(zero_copy_only=False), b["text_key"].to_numpy()
            known = pa.array(docs, from_pandas=True) if b["doc_id"].null_count else None
            for lo, hi, buf, offs in tn.chunks(b["text"], chunk):
                s = segments(*units(buf, offs), n, k)
                row = s.pop("row") + lo
                ids = b["doc_id"].take(pa.array(row)) if known is not None else docs[row]
                if len(row):
                    yield batch(SEGMENTS, s | {"doc_id": ids, "text_key": keys[row], "start": s["start"].astype(np.int32), "n": s["n"].astype(np.int32)})

    return docs.select("doc_id", "text", "text_key").mapInArrow(run, SEGMENTS_SQL)


def entries(found: DataFrame) -> DataFrame:
    """One row a name: how many segments have it, the least and the greatest of both hashes, and whether one has it twice."""
    ends = [f(x).alias(f"{x}_{end}") for x in ("span", "check") for f, end in ((F.min, "lo"), (F.max, "hi"))]
    return found.groupBy("fp").agg(F.count("*").alias("segments"), *ends, F.bool_or("twice").alias("any_twice"))


def merged(parts: DataFrame) -> DataFrame:
    """Entries of several runs as entries of one."""
    ends = [f(f"{x}_{end}").alias(f"{x}_{end}") for x in ("span", "check") for f, end in ((F.min, "lo"), (F.max, "hi"))]
    return parts.groupBy("fp").agg(F.sum("segments").alias("segments"), *ends, F.bool_or("any_twice").alias("any_twice"))


def repeating() -> Column:
    """Of entries: the name may repeat."""
    return (F.col("segments") > 1) | F.col("any_twice")


def judged(found: DataFrame, index: DataFrame) -> DataFrame:
    """Segments whose name may repeat, by the entries of those names, with whole: every window of it repeats for sure."""
    alike = (F.col("span_lo") == F.col("span_hi")) & (F.col("check_lo") == F.col("check_hi"))
    names = index.select("fp", (alike & (F.col("segments") > 1)).alias("whole"))
    return found.join(names, "fp")


TEXT = ("fp", "span", "check")


def kinds(mixed: DataFrame) -> DataFrame:
    """(fp, span, check, copies, one): the different texts under a name, how many segments have each, and one of them."""
    order = F.struct("text_key", "start", F.coalesce("doc_id", F.lit(0)))
    return mixed.groupBy(*TEXT).agg(F.count("*").alias("copies"), F.min_by(F.struct("doc_id", "text_key", "start", "n"), order).alias("one"))


def copied(mixed: DataFrame, known: DataFrame) -> DataFrame:
    """Places of the segments whose text another segment has too."""
    return mixed.join(known.where("copies > 1").select(*TEXT), list(TEXT)).select("doc_id", "text_key", "start", "n")


def per_document(rows: DataFrame, name: str) -> DataFrame:
    """Places (start, n) gathered by document, each once however many rows are that document; no more than it has units."""
    return rows.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "n")).alias(name))


def places(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and n of every place in a column of lists of them (null: none)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    row = np.repeat(np.arange(len(col)), [x or 0 for x in pa.compute.list_value_length(col).to_pylist()])
    flat = col.flatten()
    return row, flat.field("start").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
