"""Packing: best-fit decreasing.

A document's ids (and the end id) are cut into full windows and a rest. Full windows are sequences of their own. Rests
are dealt by hash into partitions that adaptive execution sizes, sorted there by falling length (a sort that can
spill), and each takes the tightest open window, found in a segment tree over remaining capacities.

Defined results: null or empty text is the end id alone; repeated rows are packed each by itself; equal lengths go in
order of doc_id, then start. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from . import textnum as tn
from .common import batch

CHUNK = 6 << 20  # bytes of text encoded at once; bounds a worker's memory
PIECES = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
PIECES_SQL = ", ".join(f"{f.name} long" for f in PIECES)
PLACED = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Windows:
    """Open windows in a segment tree whose leaves are remaining capacities; a node says whether any below is open."""

    def __init__(self, size: int):
        self.size, self.leaves = size, 1 << size.bit_length()
        self.open = [False] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]
        self.made = 0

    def _mark(self, capacity: int) -> None:
        node, here = self.leaves + capacity, bool(self.at[capacity])
        while node and self.open[node] != here:
            self.open[node] = here
            node >>= 1
            here = node > 0 and (self.open[2 * node] or self.open[2 * node + 1])

    def tightest(self, length: int) -> int | None:
        """The least capacity of an open window that takes length."""
        node, tree = self.leaves + length, self.open
        if tree[node]:
            return length
        while node > 1:
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None

    def place(self, length: int) -> tuple[int, int]:
        """The window that takes length, and the offset there."""
        capacity = self.tightest(length)
        if capacity is None:
            window, capacity = self.made, self.size
            self.made += 1
        else:
            window = self.at[capacity].pop()
            if not self.at[capacity]:
                self._mark(capacity)
        left = capacity - length
        if left:
            self.at[left].append(window)
            if len(self.at[left]) == 1:
                self._mark(left)
        return window, self.size - capacity


def cut(df: DataFrame, size: int, end_id: int, path: str) -> DataFrame:
    """The pieces of every document, without a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe.vocabulary(path)
        for part in bpe.gathered(batches, CHUNK):
            ids, at = vocab.encode(*tn.view(part["text"]), by_index=False)
            docs = part["doc_id"].to_pylist()
            rows: list[tuple] = []
            for doc, i, j in zip(docs, at.tolist(), at[1:].tolist(), strict=False):
                own = memoryview(np.append(ids[i:j], end_id).astype("<u4").tobytes())
                n = j - i + 1
                rows += [(doc, k, min(size, n - k), zlib.crc32(own[4 * k : 4 * (k + size)]), n) for k in range(0, n, size)]
            yield batch(PIECES, dict(zip(PIECES.names, zip(*rows, strict=True), strict=True)))

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECES_SQL)


def pack(df: DataFrame, size: int = 2048, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or bpe.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, first = Windows(size), TaskContext.get().partitionId() << 40
        for b in batches:
            places = [windows.place(n) for n in b["length"].to_pylist()]
            yield batch(PLACED, {x: b[x] for x in PIECES.names} | {"sequence_id": [first + w for w, _ in places], "offset": [o for _, o in places]})

    pieces = cut(df, size, end_id, path).repartition("doc_id", "start", "ids_crc32")
    return pieces.sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids_crc32").mapInArrow(run, PIECES_SQL + ", sequence_id long, offset long")
