"""N-gram Jaccard join: Bayesian candidate pruning.

Texts are sets of shingles of five words. Equal sets are one set with copies. Sets that share a MinHash band are in one
bucket of that band. A set's home is the largest of its buckets; the sets of a home are dealt into blocks of bounded
size. Two blocks are compared where they have sets of one bucket, and of each block only those sets are sent that share
a bucket with the other: so a pair is met once, in the task of its two blocks, and no pairs are ever rows. There pairs
are compared a few MinHash values at a time: with a flat prior, the posterior probability that the similarity reaches
the threshold after m equal values of n is P(Binomial(n + 1, t) <= m), and a pair below ``tolerance`` is dropped and not
looked at again. All others are verified on the whole shingle sets. A task gives link counts and a spanning label of each
set; classes are the connected components of these verified links.

A pair of similarity s is missed by all bands with probability (1 - s ** rows) ** bands, at 0.8 about 3e-6.

Defined results: a text of one to four words is one shingle; a text without words is like none, not even its equals;
repeated rows are copies of each other; null text is empty. class_id is the least doc_id of the class. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .bpe import ranges
from .common import Scratch, batch, by_document, documents
from .components import components

WORDS, BANDS, ROWS = 5, 32, 5
BLOCK_SETS, BLOCK_SHINGLES = 512, 400_000
MULTIPLY = (tn.seeds(BANDS * ROWS, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
FLIP = (tn.seeds(BANDS * ROWS, 12) >> np.uint64(32)).astype(np.uint32)
CHUNK = 1 << 20


def shingles(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each row, repeats included, and each row's first."""
    start, end, first = tn.words(buf, offs)
    n = np.diff(first)
    count = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(np.int64))
    p = tn.prefix(tn.word_hashes(buf, start, end))
    at = ranges(first[:-1], count)
    return tn.spans(p, at, at + np.repeat(np.minimum(n, WORDS), count)), np.append(0, np.cumsum(count))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values of each row that has a shingle."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((len(starts), BANDS * ROWS), np.uint32)
    for i in range(BANDS * ROWS if len(starts) else 0):
        out[:, i] = np.minimum.reduceat((x ^ FLIP[i]) * MULTIPLY[i], starts)
    return out


BANDED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("set_id", pa.int64()), ("shingles", pa.int64()), ("bands", pa.list_(pa.int64()))])
BANDED_SQL = "doc_id long, text_key long, set_id long, shingles long, bands array<long>"


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, buf, offs in tn.chunks(b["text"], CHUNK):
            h, first = shingles(buf, offs)
            size = np.diff(first)
            has = np.flatnonzero(size)
            total = np.append(np.uint64(0), np.cumsum(tn.mix(h)))
            set_id = tn.mix(tn.mix(total[first[1:]] - total[first[:-1]]) + size.astype(np.uint64))
            sig = signatures(h, first)
            keys = np.zeros((len(has), BANDS), np.uint64)
            for r in range(ROWS):
                keys = tn.mix(keys + sig[:, r::ROWS].astype(np.uint64) + np.uint64(1))
            keys = tn.mix(keys + np.arange(BANDS, dtype=np.uint64)[None, :])
            at = np.zeros(hi - lo + 1, np.int32)
            at[1:] = np.cumsum(size > 0) * BANDS
            yield batch(BANDED, {"doc_id": b["doc_id"][lo:hi], "text_key": b["text_key"][lo:hi], "set_id": pa.array(set_id.view(np.int64), mask=size == 0), "shingles": size, "bands": pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel().view(np.int64)))})


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float, n: int) -> int:
    """The fewest equal values of n at which a pair is not dropped."""
    p, total = (1 - threshold) ** (n + 1), 0.0
    for m in range(n + 1):
        total += p
        if total >= tolerance:
            return m
        p *= (n + 1 - m) / (m + 1) * threshold / (1 - threshold)
    return n


def alike(a_sig: np.ndarray, b_sig: np.ndarray, threshold: float, tolerance: float, same: bool, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that pruning leaves, as rows of a and of b; same: a and b are one block, pairs once. The first values
    are compared for all pairs, the others for those alone that are still alive."""
    n = a_sig.shape[1]
    equal = np.zeros((len(a_sig), len(b_sig)), np.uint16)
    for c in range(step):
        equal += a_sig[:, c][:, None] == b_sig[:, c][None, :]
    alive = equal >= least_matches(threshold, tolerance, step)
    i, j = np.nonzero(np.triu(alive, 1) if same else alive)
    m = equal[i, j].astype(np.int64)
    for lo in range(step, n, step):
        if not len(i):
            break
        for c in range(lo, lo + step):
            m += a_sig[i, c] == b_sig[j, c]
        left = m >= least_matches(threshold, tolerance, lo + step)
        i, j, m = i[left], j[left], m[left]
    return i, j


def similar(a_sig: np.ndarray, b_sig: np.ndarray, a_sets: list, b_sets: list, threshold: float, tolerance: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sets (sorted distinct hashes) that reach the threshold, as rows of a and of b."""
    i, j = alike(a_sig, b_sig, threshold, tolerance, same)
    if not len(i):
        return i, j
    rows, x = np.unique(i, return_inverse=True)
    cols, y = np.unique(j, return_inverse=True)
    sets = [a_sets[k] for k in rows] + [b_sets[k] for k in cols]
    size = np.array([len(k) for k in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, nth, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[nth] > 1
    nth, owner = nth[shared], owner[shared]
    _, nth = np.unique(nth, return_inverse=True)
    order = np.argsort(nth, kind="stable")
    nth, owner = nth[order], owner[order]
    both = np.zeros((len(rows), len(cols)), np.float32)
    width = 4096
    for lo in range(0, int(nth[-1]) + 1 if len(nth) else 0, width):
        first, last = np.searchsorted(nth, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[first:last], nth[first:last] - lo] = 1
        both += m[: len(rows)] @ m[len(rows) :].T
    both = both[x, y]
    enough = both >= threshold * (size[x] + size[len(rows) + y] - both) - 1e-6
    return i[enough], j[enough]


SETS = pa.schema([("set_id", pa.int64()), ("copies", pa.int64()), ("block", pa.int64()), ("others", pa.list_(pa.int64())), ("signature", pa.binary()), ("members", pa.binary())])
SETS_SQL = "set_id long, copies long, block long, others array<long>, signature binary, members binary"
LINKS = pa.schema([("set_id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, buf, offs in tn.chunks(b["text"], CHUNK):
            h, first = shingles(buf, offs)
            sig = signatures(h, first)
            sets = [np.unique(h[i:j]).tobytes() for i, j in zip(first.tolist(), first[1:].tolist())]
            yield batch(SETS, {x: b[x][lo:hi] for x in ("set_id", "copies", "block", "others")} | {"signature": [x.tobytes() for x in sig], "members": sets})


def _compare(threshold: float, tolerance: float):
    def settle(rows: pa.RecordBatch) -> pa.RecordBatch:
        block, ids = rows["block"].to_numpy(), rows["set_id"].to_numpy()
        copies = rows["copies"].to_numpy()
        sig = np.stack([np.frombuffer(x, np.uint32) for x in rows["signature"].to_pylist()])
        sets = [np.frombuffer(x, np.uint64) for x in rows["members"].to_pylist()]
        lo, hi = rows["i"][0].as_py(), rows["j"][0].as_py()
        a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        x, y = similar(sig[a], sig[b], [sets[i] for i in a], [sets[i] for i in b], threshold, tolerance, lo == hi)
        x, y = a[x], b[y]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, x, copies[y])
        np.add.at(links, y, copies[x])
        root = np.arange(len(ids))
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        label = rank[root]
        while len(x):  # labels fall to the least of the component
            was = label.copy()
            np.minimum.at(label, x, was[y])
            np.minimum.at(label, y, was[x])
            label = label[order[label]]
            if (label == was).all():
                break
        has = np.flatnonzero(links)
        return batch(LINKS, {"set_id": ids[has], "links": links[has], "root": ids[order[label[has]]]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            key = np.stack([b[x].to_numpy().astype(np.int64) for x in ("i", "j")], 1)
            edge = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for i, j in zip(edge, edge[1:]):
                if have and tuple(key[i]) != last:
                    yield settle(pa.Table.from_batches(have).combine_chunks().to_batches()[0])
                    have = []
                have.append(b.slice(i, j - i))
                last = tuple(key[i])
        if have:
            yield settle(pa.Table.from_batches(have).combine_chunks().to_batches()[0])

    return run


def dealt(member: DataFrame, sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(set_id, block) of sets in buckets (set_id, band, n), and (set_id, others): the other blocks with a set that
    shares a bucket. A bucket of b sets costs b rows with a list of its blocks; in a large one these are about
    b / BLOCK_SETS."""
    home = member.groupBy("set_id").agg(F.max(F.struct("n", "band")).alias("home")).select("set_id", F.col("home.band").alias("home"))
    home = scratch.keep(home.join(sets.select("set_id", "shingles"), "set_id"), "home")
    room = F.greatest(F.count("*") / BLOCK_SETS, F.sum("shingles") / BLOCK_SHINGLES)
    blocks = scratch.keep(home.groupBy("home").agg(F.ceil(room).alias("blocks")), "blocks")
    nth = F.pmod(F.xxhash64("set_id"), F.col("blocks"))
    placed = scratch.keep(home.join(blocks, "home").select("set_id", F.xxhash64("home", nth).alias("block")), "placed")
    seen = scratch.keep(member.select("set_id", "band").join(placed, "set_id"), "seen")
    reached = scratch.keep(seen.groupBy("band").agg(F.collect_set("block").alias("reached")), "reached")
    meets = seen.join(reached, "band").groupBy("set_id", "block").agg(F.array_distinct(F.flatten(F.collect_set("reached"))).alias("all"))
    others = scratch.keep(meets.select("set_id", F.array_remove("all", F.col("block")).alias("others")), "others")
    scratch.free("home", "blocks", "seen", "reached")
    return placed, others


def classes(docs: DataFrame, scratch: Scratch, threshold: float = 0.8, tolerance: float = 1e-9) -> DataFrame:
    """(doc_id, text_key, class_id, class_key, n_links, n_copies) of documents (doc_id, text, text_key)."""
    own = scratch.keep(docs.mapInArrow(_banded, BANDED_SQL), "banded")
    known = own.where("set_id is not null")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    sets = scratch.keep(known.groupBy("set_id").agg(F.count("*").alias("copies"), F.min(first).alias("first"), F.max("shingles").alias("shingles")), "sets")
    firsts = sets.select("set_id", "first.doc_id", "first.text_key")
    keys = by_document(known.select("doc_id", "text_key", "bands"), firsts, "inner").dropDuplicates(["set_id"]).select("set_id", F.explode("bands").alias("band"))
    keys = scratch.keep(keys, "keys")
    shared = scratch.keep(keys.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    member = scratch.keep(keys.join(shared, "band"), "member")
    scratch.free("keys", "shared")
    placed, others = dealt(member, sets, scratch)
    where = placed.join(others, "set_id", "left").join(sets.select("set_id", "copies", "first"), "set_id")
    where = where.select("first.doc_id", "first.text_key", "set_id", "copies", "block", F.concat(F.array("block"), F.coalesce("others", F.array())).alias("others"))
    texts = by_document(docs, where, "inner").dropDuplicates(["set_id"]).select("text", "set_id", "copies", "block", "others")
    sent = texts.mapInArrow(_sets, SETS_SQL).withColumn("other", F.explode("others"))
    sent = sent.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_id", "copies", "signature", "members")
    found = sent.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(_compare(threshold, tolerance), "set_id long, links long, root long")
    links = scratch.keep(found, "links")
    scratch.free("member", "placed", "others")
    near = scratch.keep(components(links.where("set_id != root").select(F.col("set_id").alias("u"), F.col("root").alias("v")), scratch, "linked"), "near").withColumnsRenamed({"node": "set_id", "component": "class"})
    total = links.groupBy("set_id").agg(F.sum("links").alias("links"))
    every = sets.join(near, "set_id", "left").join(total, "set_id", "left").withColumn("class", F.coalesce("class", "set_id"))
    every = scratch.keep(every.select("set_id", "class", "first", F.coalesce("links", F.lit(0)).alias("links"), "copies"), "every")
    heads = scratch.keep(every.groupBy("class").agg(F.min("first").alias("head")), "heads")
    every = every.join(heads, "class").select("set_id", "head", "links", "copies")
    out = own.select("doc_id", "text_key", "set_id").join(every, "set_id", "left")
    alone = F.col("head").isNull()
    out = out.select("doc_id", "text_key", F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"), F.when(alone, F.col("text_key")).otherwise(F.col("head.text_key")).alias("class_key"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"))
    out = scratch.keep(out, "classes", result=True)
    scratch.free()
    return out


def join(df: DataFrame, threshold: float = 0.8, tolerance: float = 1e-9) -> DataFrame:
    """One row for each input row: doc_id, class_id, n_links (documents similar to it) and n_copies (of its set)."""
    docs = documents(df).withColumn("doc_id", F.col("doc_id").cast("long"))
    with Scratch(df.sparkSession) as scratch:
        out = classes(docs, scratch, threshold, tolerance)
    return out.select("doc_id", "class_id", "n_links", "n_copies")
