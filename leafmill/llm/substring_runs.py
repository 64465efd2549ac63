"""Substring dedup: log-structured fingerprint index.

``FingerprintIndex`` keeps the names of historical windows (see segments) in a folder, as immutable runs that are
bucketed and sorted by name, with one row a name, so that no name is too large for its task. A new batch is merge-joined
with the runs when it arrives, which moves no run; it becomes a run of its own, and once ``fan_out`` runs of about one
size stand they are compacted into one. The join gives the batch's names that repeat, in it or in history.
Segments that names cannot settle, one of each different text, are verified window by window; texts and windows are
taken as equal where two independent 64-bit hashes over their words are. A manifest names the runs that stand: a call
that fails leaves the index as it was, and a later session opens it again.

``FingerprintIndex.add`` is the incremental form: places in the new batch that repeat in it or in history. ``dedup`` and
``cleaned`` put a whole table through the index in batches, and then judge all batches by all that is known at the end.

Defined results: null text has no words; a text of fewer than ``n`` words has no window; repeated rows repeat each
other's windows; a null doc_id is a value like any other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import segments as sg
from . import textnum as tn
from .bpe import ranges
from .common import Scratch, batch, by_document, delete, documents, file_system, shuffles_dropped

CHUNK = 1 << 20
ENTRY_SQL = "fp long, segments long, span_lo long, span_hi long, check_lo long, check_hi long, any_twice boolean"
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def ordered_scans(spark: SparkSession):
    """Scans of runs count as sorted, so that merge joins and sums of them need no sort; for plans made in the block."""
    before = spark.conf.get(ORDERED)
    spark.conf.set(ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(ORDERED, before)


class FingerprintIndex:
    """Runs and segments below ``path``, a folder that driver and executors share. ``state`` is the newest manifest:
    buckets, the runs as (number, batches in it), and the batches."""

    def __init__(self, spark: SparkSession, path: str, n: int = 35, k: int = 8, fan_out: int = 4):
        self.spark, self.path, self.n, self.k, self.fan_out = spark, path.rstrip("/"), n, k, fan_out
        self.tables: dict[int, str] = {}
        self.version, self.state = self._newest()
        if (self.state["n"], self.state["k"]) != (n, k):
            raise ValueError(f"the index at {path} has windows of {self.state['n']} words and runs of {self.state['k']}")

    # the manifest

    def _newest(self) -> tuple[int, dict]:
        fs, where = file_system(self.spark, f"{self.path}/manifest")
        found = [int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit()] if fs.exists(where) else []
        if not found:
            return 0, {"n": self.n, "k": self.k, "buckets": int(self.spark.conf.get("spark.sql.shuffle.partitions")), "runs": [], "batches": 0}
        text = self.spark.read.option("wholetext", "true").text(f"{self.path}/manifest/{max(found)}").first()[0]
        return max(found), json.loads(text)

    def _commit(self, state: dict) -> None:
        """The next manifest, complete under its name or not at all; then what only older ones name is deleted."""
        fs, where = file_system(self.spark, f"{self.path}/manifest/{self.version + 1}")
        draft = f"{self.path}/manifest/.{uuid.uuid4().hex}"
        out = fs.create(file_system(self.spark, draft)[1], True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(file_system(self.spark, draft)[1], where):
            raise OSError(f"another writer has committed to {self.path}")
        gone = {r for r, _ in self.state["runs"]} - {r for r, _ in state["runs"]}
        self.version, self.state = self.version + 1, state
        for run in gone:
            self._drop(run)
            delete(self.spark, f"{self.path}/run-{run}")

    # runs

    def _run(self, number: int) -> DataFrame:
        if number not in self.tables:
            name = f"leafmill_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} ({ENTRY_SQL}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.state['buckets']} BUCKETS LOCATION '{self.path}/run-{number}'")
            self.tables[number] = name
        return self.spark.table(self.tables[number])

    def _drop(self, number: int) -> None:
        if number in self.tables:
            self.spark.sql(f"DROP TABLE {self.tables.pop(number)}")

    def close(self) -> None:
        """Forget the tables' names; the folder stays."""
        for number in list(self.tables):
            self._drop(number)

    def _write_run(self, rows: DataFrame, number: int) -> None:
        delete(self.spark, f"{self.path}/run-{number}")
        name = f"leafmill_run_{uuid.uuid4().hex}"
        own = rows.select("fp", "segments", "span_lo", "span_hi", "check_lo", "check_hi", "any_twice").repartition(self.state["buckets"], "fp")
        with shuffles_dropped(self.spark):
            own.write.bucketBy(self.state["buckets"], "fp").sortBy("fp").option("path", f"{self.path}/run-{number}").saveAsTable(name)
        self.tables[number] = name

    def _next(self) -> int:
        return max([r for r, _ in self.state["runs"]], default=-1) + 1

    def ingest(self, found: DataFrame) -> DataFrame:
        """Add the segments of a batch. The entries, history included, of those names of the batch that repeat."""
        nth, number = self.state["batches"], self._next()
        found.write.mode("overwrite").parquet(f"{self.path}/segments-{nth}")
        old = [r for r, _ in self.state["runs"]]
        self._write_run(sg.entries(self.segments(nth)), number)
        with ordered_scans(self.spark):
            every = own = self._run(number)
            for r in old:  # each run is bucketed and sorted alike: a merge join, without an exchange
                past = self._run(r).join(own.select("fp"), "fp", "left_semi")
                every = every.unionByName(past)
            hits = (sg.merged(every) if old else own).where(sg.repeating())
            hits.write.mode("overwrite").parquet(f"{self.path}/hits-{nth}")
        self._commit(self.state | {"runs": [*self.state["runs"], [number, 1]], "batches": nth + 1})
        self.compact()
        return self.hits(nth)

    def compact(self) -> None:
        """Merge the newest runs into one while ``fan_out`` of them hold as many batches as the newest of them or fewer;
        the old ones go once a manifest names the new one."""
        while True:
            runs = self.state["runs"]
            last = runs[-self.fan_out :]
            if len(last) < self.fan_out or last[0][1] > last[-1][1] * self.fan_out:
                return
            number = self._next()
            with ordered_scans(self.spark):
                every = self._run(last[0][0])
                for r, _ in last[1:]:
                    every = every.unionByName(self._run(r))
                self._write_run(sg.merged(every), number)
            self._commit(self.state | {"runs": [*runs[: -self.fan_out], [number, sum(b for _, b in last)]]})

    def segments(self, nth: int) -> DataFrame:
        return self.spark.read.schema(sg.SEGMENTS_SQL).parquet(f"{self.path}/segments-{nth}")

    def hits(self, nth: int) -> DataFrame:
        return self.spark.read.schema(ENTRY_SQL).parquet(f"{self.path}/hits-{nth}")

    def all_segments(self) -> DataFrame:
        every = [self.segments(i) for i in range(self.state["batches"])]
        return self.spark.read.schema(sg.SEGMENTS_SQL).parquet(*(f"{self.path}/segments-{i}" for i in range(self.state["batches"]))) if every else self.spark.createDataFrame([], sg.SEGMENTS_SQL)

    def all_hits(self) -> DataFrame:
        """The entries of all names that repeat: the last batch that has a name knows of all before it."""
        paths = [f"{self.path}/hits-{i}" for i in range(self.state["batches"])]
        if not paths:
            return self.spark.createDataFrame([], ENTRY_SQL)
        every = self.spark.read.schema(ENTRY_SQL).parquet(*paths)
        low, high = [F.min(c).alias(c) for c in ("span_lo", "check_lo")], [F.max(c).alias(c) for c in ("segments", "span_hi", "check_hi", "any_twice")]
        return every.groupBy("fp").agg(*low, *high)

    # documents

    def add(self, docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Take in a batch (doc_id, text). (doc_id, text_key, cut): for each of its documents with windows that start
        anywhere else, in the batch or before, the places where they start. history: the documents of earlier batches,
        of which only those that hold an open text are read; the index itself keeps no text."""
        own = documents(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
        every = own if history is None else own.unionByName(documents(history).withColumn("doc_id", F.col("doc_id").cast("long")))
        with Scratch(self.spark) as scratch:
            hits = self.ingest(sg.find(own, sg.word_units, self.n, self.k, CHUNK))
            cut = settled(every, self.all_segments(), hits, scratch, self.n)
            mine = own.select("doc_id", "text_key").distinct()
            return scratch.keep(by_document(cut, mine, "left_semi"), "cut", result=True)


WINDOWS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32())])


def window_rows(docs: DataFrame, open_places: DataFrame, units: sg.Units, n: int, chunk: int) -> DataFrame:
    """Two hashes of every window at the places left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b["text_key"].to_numpy()
            for lo, hi, buf, offs in tn.chunks(b["text"], chunk):
                row, start, count = sg.places(b["open"][lo:hi])
                at = np.repeat(row, count)
                one, two, first = units(buf, offs)
                where = ranges(start, count)
                s = where + first[at]
                a, c = (tn.spans(tn.prefix(x), s, s + n) for x in (one, two))
                for i in range(0, len(at), 500_000):
                    j = slice(i, i + 500_000)
                    yield batch(WINDOWS, {"a": a[j].view(np.int64), "b": c[j].view(np.int64), "doc_id": b["doc_id"].take(pa.array(at[j] + lo)), "text_key": keys[at[j] + lo], "start": where[j].astype(np.int32)})

    return by_document(docs, open_places, "inner").select("doc_id", "text_key", "text", "open").mapInArrow(run, "a long, b long, doc_id long, text_key long, start int")


def settled(docs: DataFrame, found: DataFrame, hits: DataFrame, scratch: Scratch, n: int, units: sg.Units = sg.word_units) -> DataFrame:
    """(doc_id, text_key, cut): the places of the windows that repeat, of segments under names that repeat."""
    known = scratch.keep(sg.judged(found, scratch.keep(hits, "names")).select(*sg.TEXT, "doc_id", "text_key", "start", "n", "whole"), "judged")
    whole = known.where("whole").select("doc_id", "text_key", "start", "n")
    mixed = known.where("not whole")
    kinds = scratch.keep(sg.kinds(mixed), "kinds")
    rest = sg.per_document(kinds.select("one.*"), "open")
    rows = scratch.keep(window_rows(docs, rest, units, n, CHUNK), "windows")
    twice = scratch.keep(rows.groupBy("a", "b").agg(F.count("*").alias("c")).where("c > 1").select("a", "b"), "twice")
    seen = rows.join(twice, ["a", "b"]).select("doc_id", "text_key", "start", F.lit(1).alias("n"))
    return sg.per_document(whole.unionByName(sg.copied(mixed, kinds)).unionByName(seen), "cut")


def repeated_windows(docs: DataFrame, scratch: Scratch, n: int = 35, k: int = 8, batches: int = 2) -> DataFrame:
    """(doc_id, text_key, cut): for each document with repeated windows, the places where they start. The documents go
    through an index in batches; names that repeat come from its joins at each arrival."""
    index = FingerprintIndex(docs.sparkSession, scratch.path("index"), n, k)
    try:
        for i in range(batches):
            mine = docs.where(F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(batches)) == i) if batches > 1 else docs
            index.ingest(sg.find(mine, sg.word_units, n, k, CHUNK))
        out = scratch.keep(settled(docs, index.all_segments(), index.all_hits(), scratch, n), "cut", result=True)
    finally:
        index.close()
    scratch.free()
    return out


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])


def remove(docs: DataFrame, cut: DataFrame, n: int = 35, text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256; with text, also the text without the removed words."""

    schema = pa.schema([f for f in OUT if text or f.name != "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tn.chunks(b["text"], CHUNK):
                start, end, first = tn.words(buf, offs)
                row, at, count = sg.places(b["cut"][lo:hi])
                gone = tn.covered(first[row] + at, first[row] + at + count + n - 1, len(start))
                kept = np.flatnonzero(~gone)
                size = end[kept] - start[kept] + 1
                joined = np.append(buf, np.uint8(0x20))[ranges(start[kept], size)]
                stop = np.cumsum(size)
                joined[stop - 1] = 0x20
                edge = np.append(0, stop)[np.searchsorted(kept, first)]
                flat = joined.tobytes()
                cols = {"doc_id": b["doc_id"][lo:hi], "n_words": np.diff(first), "n_removed": tn.sums(gone, first), "kept_sha256": [hashlib.sha256(flat[i : max(i, j - 1)]).hexdigest() for i, j in zip(edge.tolist(), edge[1:].tolist())]}
                if text:
                    cols["text"] = _cut_text(buf, offs, start, first, gone)
                yield batch(schema, cols)

    sql = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * text
    return by_document(docs, cut).select("doc_id", "text", "cut").mapInArrow(run, sql)


def _cut_text(buf: np.ndarray, offs: np.ndarray, start: np.ndarray, first: np.ndarray, gone: np.ndarray) -> pa.Array:
    """Each text without its removed words and the white space after them."""
    row = tn.row_of(first)
    nxt = np.append(start[1:], len(buf))
    nxt = np.minimum(nxt, offs[row + 1])
    drop = tn.covered(start[gone], nxt[gone], len(buf))
    at = np.append(0, np.cumsum(~drop))[offs]
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(buf[~drop].tobytes())]).cast(pa.string())


def dedup(df: DataFrame, n: int = 35, k: int = 8, batches: int = 2) -> DataFrame:
    """Remove every word that a repeated window of n words covers; one row for each input row."""
    docs = documents(df).withColumn("doc_id", F.col("doc_id").cast("long"))
    with Scratch(df.sparkSession) as scratch:
        cut = repeated_windows(docs, scratch, n, k, batches)
    return remove(docs, cut, n)


def cleaned(df: DataFrame, n: int = 35, k: int = 8, batches: int = 2) -> DataFrame:
    """Documents (doc_id, text, lang, source, n_chars) with their repeated words cut out of the text; those that lose
    every word are dropped, those that lose none are as before."""
    docs = documents(df, "lang", "source", "n_chars")
    with Scratch(df.sparkSession) as scratch:
        cut = repeated_windows(docs.select("doc_id", "text", "text_key"), scratch, n, k, batches)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for lo, hi, buf, offs in tn.chunks(b["text"], CHUNK):
                start, end, first = tn.words(buf, offs)
                row, at, count = sg.places(b["cut"][lo:hi])
                gone = tn.covered(first[row] + at, first[row] + at + count + n - 1, len(start))
                lost = tn.sums(gone, first)
                text = _cut_text(buf, offs, start, first, gone)
                own = b.slice(lo, hi - lo)
                size = np.where(lost > 0, pa.compute.utf8_length(text).to_numpy(), 0)
                changed = pa.array(lost > 0)
                cols = {"doc_id": own["doc_id"], "text": text, "lang": own["lang"], "source": own["source"], "n_chars": pa.compute.if_else(changed, pa.array(size, pa.int64()), own["n_chars"])}
                keep = (lost == 0) | (lost < np.diff(first))
                yield pa.RecordBatch.from_pydict(cols).filter(pa.array(keep))

    return by_document(docs, cut).select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"), "cut").mapInArrow(run, "doc_id long, text string, lang string, source string, n_chars long")
