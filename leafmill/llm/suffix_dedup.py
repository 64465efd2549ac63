"""Suffix-array dedup: distributed difference-cover algorithm.

Repeated byte strings of ``n`` bytes are found in two steps. Segments (see segments) settle all windows whose name is
unique or whose segments are all one text. The rest goes, one text of each kind, to tasks by name, where suffixes are
sorted by the difference cover modulo 3: triples at the sampled places are sorted and named, the names are sorted by
recursion, the remaining suffixes are merged in, and adjacent prefixes of n bytes are compared. A task sorts ``wide``
different texts of one name at most, which bounds its memory; the windows of names with more are dealt by two 64-bit
hashes, which finds the same.

Defined results: null text is empty; matches never cross rows; repeated rows repeat each other; a null doc_id is a
value like any other; a text shorter than n keeps all its bytes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segments as sg
from . import textnum as tn
from .bpe import ranges
from .common import Scratch, batch, by_document, documents
from .substring_runs import window_rows

CHUNK = 1 << 19


def joined(high: np.ndarray, low: np.ndarray, top: int, width: int) -> np.ndarray:
    """Keys in the order of pairs of numbers, low below width and high below top; the highs are renumbered where they
    would not fit a word."""
    if top * width >= 1 << 62:
        high = np.unique(high, return_inverse=True)[1]
    return high * width + low


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffixes of positive numbers in order, by the difference cover modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    x = np.zeros(n + 3, np.int64)
    x[:n] = s
    base = int(x.max()) + 1
    if base > 1 << 30:
        x[:n] = np.unique(x[:n], return_inverse=True)[1] + 1
        base = int(x.max()) + 1
    pairs = x[:-1] * base + x[1:]  # below 2 ** 62
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    key = joined(pairs[sample], x[np.minimum(sample + 2, n + 2)], base * base, base)
    order = np.argsort(key, kind="stable")
    fresh = np.append(True, key[order][1:] != key[order][:-1])
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(fresh)
    by = order if fresh.all() else suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[by]] = np.arange(1, len(sample) + 1)
    sampled = sample[by]
    sampled = sampled[sampled < n]
    span = len(sample) + 2
    zeros = np.arange(0, n, 3)
    pair = lambda i: x[i] * span + rank[i + 1]
    zeros = zeros[np.argsort(pair(zeros), kind="stable")]
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    both = np.concatenate([second, zeros])
    triple = joined(pairs[both], rank[both + 2], base * base, span)
    place = np.arange(len(zeros)) + np.searchsorted(pair(first), pair(zeros)) + np.searchsorted(triple[: len(second)], triple[len(second) :])
    out = np.empty(n, np.int64)
    rest = np.ones(n, bool)
    rest[place] = False
    out[place], out[rest] = zeros, sampled
    return out


def repeated_prefixes(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Which of the starts have the same n bytes after them as another; strings in data end with a zero."""
    order = suffix_array(data.astype(np.int64) + 1)
    nth = np.full(len(data), -1)
    nth[starts] = np.arange(len(starts))
    at = nth[order]
    at = at[at >= 0]
    h = tn.windows(tn.prefix(tn.BYTE[data]), n)[starts[at]]
    near = np.flatnonzero(h[1:] == h[:-1])
    sure = np.zeros(len(near), bool)
    for i in range(0, len(near), 2000):  # compared byte by byte
        a, b = starts[at[near[i : i + 2000]]], starts[at[near[i : i + 2000] + 1]]
        step = np.arange(n)
        sure[i : i + 2000] = (data[a[:, None] + step] == data[b[:, None] + step]).all(1)
    out = np.zeros(len(starts), bool)
    out[at[near[sure]]] = True
    out[at[near[sure] + 1]] = True
    return out


SPANS = pa.schema([("fp", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])
SPANS_SQL = "fp long, doc_id long, text_key long, start int, n int, data binary"
FOUND = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


def span_bytes(docs: DataFrame, places: DataFrame, n: int) -> DataFrame:
    """The bytes that each segment covers."""
    own = places.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "n", "fp")).alias("open"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b["text_key"].to_numpy()
            for lo, hi, buf, offs in tn.chunks(b["text"], CHUNK):
                part = b["open"][lo:hi]
                row, start, count = sg.places(part)
                size = count + n - 1
                data = buf[ranges(offs[row] + start, size)]
                at = np.append(0, np.cumsum(size)).astype(np.int32)
                col = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])
                yield batch(SPANS, {"fp": part.flatten().field("fp"), "doc_id": b["doc_id"].take(pa.array(row + lo)), "text_key": keys[row + lo], "start": start.astype(np.int32), "n": count.astype(np.int32), "data": col})

    return by_document(docs, own, "inner").select("doc_id", "text_key", "text", "open").mapInArrow(run, SPANS_SQL)


def by_suffixes(spans: DataFrame, n: int, limit: int = CHUNK) -> DataFrame:
    """Places of windows that another window under the same name equals; names are sorted into tasks."""

    def settle(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        buf, offs = tn.view(t["data"])
        size = np.diff(offs) + 1  # a zero ends each
        data = np.append(buf, np.uint8(0))[ranges(offs[:-1], size)]
        base = np.cumsum(size) - size
        data[base + size - 1] = 0
        count = t["n"].to_numpy().astype(np.int64)
        row, nth = np.repeat(np.arange(len(count)), count), ranges(np.zeros(len(count), np.int64), count)
        hit = repeated_prefixes(data, base[row] + nth, n)
        row, nth = row[hit], nth[hit]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (nth[1:] != nth[:-1] + 1)
        at = np.flatnonzero(fresh)
        return batch(FOUND, {"doc_id": t["doc_id"].take(pa.array(row[at])), "text_key": t["text_key"].take(pa.array(row[at])), "start": (t["start"].to_numpy()[row[at]] + nth[at]).astype(np.int32), "n": np.diff(np.append(at, len(row))).astype(np.int32)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, size, last = [], 0, None
        for b in batches:
            names = b["fp"].to_numpy()
            edge = np.flatnonzero(names[1:] != names[:-1]) + 1
            sizes = np.append(0, np.cumsum(tn.view(b["data"])[1][1:] - tn.view(b["data"])[1][:-1]))
            lo = 0
            if have and size >= limit and names[0] != last:
                yield settle(have)
                have, size = [], 0
            for cut in edge.tolist():
                if size + sizes[cut] - sizes[lo] >= limit:
                    yield settle([*have, b.slice(lo, cut - lo)])
                    have, size, lo = [], 0, cut
            have.append(b.slice(lo))
            size += int(sizes[-1] - sizes[lo])
            last = names[-1]
        if have:
            yield settle(have)

    return spans.repartition("fp").sortWithinPartitions("fp").mapInArrow(run, "doc_id long, text_key long, start int, n int")


def repeated_strings(docs: DataFrame, scratch: Scratch, n: int = 400, k: int = 64, wide: int = 2000) -> DataFrame:
    """(doc_id, text_key, cut): for each document with repeated strings of n bytes, the places where they start."""
    found = scratch.keep(sg.find(docs, sg.byte_units, n, k, CHUNK), "segments")
    names = scratch.keep(sg.entries(found).where(sg.repeating()), "names")
    known = scratch.keep(sg.judged(found, names), "judged")
    scratch.free("segments")
    mixed = known.where("not whole")
    kinds = scratch.keep(sg.kinds(mixed), "kinds")
    many = scratch.keep(kinds.groupBy("fp").agg(F.count("*").alias("texts")), "many")
    copied = sg.copied(mixed, kinds)
    ones = kinds.join(many, "fp").select("fp", "texts", "one.*")
    few = span_bytes(docs, ones.where(F.col("texts") <= wide), n)
    out = known.where("whole").select("doc_id", "text_key", "start", "n").unionByName(copied).unionByName(by_suffixes(few, n))
    rest = sg.per_document(ones.where(F.col("texts") > wide), "open")
    rows = scratch.keep(window_rows(docs, rest, sg.byte_units, n, CHUNK), "windows")
    twice = scratch.keep(rows.groupBy("a", "b").agg(F.count("*").alias("c")).where("c > 1").select("a", "b"), "twice")
    out = out.unionByName(rows.join(twice, ["a", "b"]).select("doc_id", "text_key", "start", F.lit(1).alias("n")))
    return scratch.keep(sg.per_document(out, "cut"), "cut", result=True)


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def dedup(df: DataFrame, n: int = 400, k: int = 64, wide: int = 2000) -> DataFrame:
    """Remove every byte that a repeated string of n bytes covers; one row for each input row."""
    docs = documents(df).withColumn("doc_id", F.col("doc_id").cast("long"))
    with Scratch(df.sparkSession) as scratch:
        cut = repeated_strings(docs, scratch, n, k, wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tn.chunks(b["text"], CHUNK):
                row, at, count = sg.places(b["cut"][lo:hi])
                gone = tn.covered(offs[row] + at, offs[row] + at + count + n - 1, len(buf))
                first = tn.runs(gone, offs)[0]
                edge = np.append(0, np.cumsum(~gone))[offs]
                flat = buf[~gone].tobytes()
                yield batch(OUT, {"doc_id": b["doc_id"][lo:hi], "n_bytes": np.diff(offs), "n_removed": tn.sums(gone, offs), "n_spans": np.diff(np.searchsorted(first, offs)), "kept_sha256": [hashlib.sha256(flat[i:j]).hexdigest() for i, j in zip(edge.tolist(), edge[1:].tolist())]})

    return by_document(docs, cut).select("doc_id", "text", "cut").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
