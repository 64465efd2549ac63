"""Language ID: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased letters, anything else is a gap; runs of one to three characters are hashed into
``2 ** BITS`` buckets. Counts come from a sample of at most ``per_language`` training rows of every language, those of
the least hashes; where a language's doc_ids repeat more than twice on average the sample is smaller. The matrix of
log-probabilities is broadcast with only the buckets that a language has; texts are scored by ``BLOCK`` languages at once.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if nothing could be learned; rows with
a null lang teach nothing; ties go to the first language by name; repeated rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textnum as tn
from .bpe import LETTER, classes
from .common import batch
from .toxicity import held_out

BITS = 16
ORDERS = 3
BLOCK = 64


@lru_cache(maxsize=1)
def lowered() -> np.ndarray:
    """Each code point's lower-case letter as a number, 0 for what is no letter."""
    out = np.where(classes() == LETTER, np.arange(0x110000, dtype=np.uint32), 0).astype(np.uint32)
    for i in np.flatnonzero(out[:0x20000]).tolist():
        low = chr(i).lower()
        if len(low) == 1:
            out[i] = ord(low)
    return out


def grams(buf: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the bucket of the n-gram at every character (0: none), each row's first character, and which rows have a letter."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    at = np.searchsorted(lead, offs)
    c = lowered()[np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)]
    letters = tn.sums(c > 0, at) > 0
    n = len(c)
    left = np.ones(n, np.int8)  # characters from here to the end of the row
    stops = at[1:][(at[1:] > 0) & (at[1:] <= n)] - 1
    near = np.zeros(n, bool)
    near[stops] = True
    out, key = [], c.astype(np.uint64)
    valid = c > 0
    end = near
    for k in range(ORDERS):
        if k:
            nxt = np.zeros(n, np.uint64)
            nxt[: max(0, n - k)] = c[k:]
            valid = left.astype(bool) & ~end
            if k > 1:
                end = end | np.append(near[k - 1 :], np.ones(min(n, k - 1), bool))
                valid = ~end
            key = key * np.uint64(0x9E3779B97F4A7C15) + nxt
            valid &= (c > 0) | (nxt > 0)
        bucket = ((key + np.uint64(k + 1)) * np.uint64(0xD1B54A32D192ED03) >> np.uint64(64 - BITS)).astype(np.int32)
        out.append(np.where(valid, bucket | 1 << BITS, 0).astype(np.int32))
    return out, at, letters


class Logs:
    """A matrix of log-probabilities, languages by buckets, that holds counted buckets alone; the others of a row are alike."""

    def __init__(self, row: np.ndarray, bucket: np.ndarray, n: np.ndarray, languages: int):
        order = np.argsort(row, kind="stable")
        self.shape = (languages, 1 << BITS)
        self.first = np.searchsorted(row[order], np.arange(languages + 1))
        total = np.bincount(row, weights=n, minlength=languages) + 0.1 * (1 << BITS)
        self.bucket = bucket[order].astype(np.uint16)
        self.own = np.log((n[order] + 0.1) / total[row[order]]).astype(np.float32)
        self.other = np.log(0.1 / total).astype(np.float32)

    def block(self, lo: int, hi: int) -> np.ndarray:
        """Rows lo to hi, behind as many zeros for characters without a bucket."""
        out = np.zeros((hi - lo, 2 << BITS), np.float32)
        out[:, 1 << BITS :] = self.other[lo:hi, None]
        a, b = self.first[lo], self.first[hi]
        row = np.repeat(np.arange(hi - lo), np.diff(self.first[lo : hi + 1]))
        out[row, self.bucket[a:b].astype(np.int64) + (1 << BITS)] = self.own[a:b]
        return out


def train(docs: DataFrame, per_language: int = 800) -> tuple[list[str], Logs]:
    """All languages by name, and for each the log-probability of every bucket; from rows not held out."""
    known = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & ~held_out(parts=3, part=1))
    least = F.xxhash64("doc_id")
    common = known.groupBy("lang").agg(F.count("*").alias("n"), F.min(least).alias("first"))
    # the share of hashes that holds about twice the sample, so that no task sorts a whole language
    near = (least / 2.0**64 + 0.5 <= 2 * per_language / F.col("n")) | (least == F.col("first"))
    known = known.join(common, "lang").where(near).select("doc_id", "lang").distinct()
    first = known.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(least, "doc_id"))).where(F.col("nth") <= per_language)
    ids = first.select(F.col("doc_id").alias("id"), F.col("lang").alias("own"))
    # bounded: per_language rows of each language
    found = docs.join(ids, (docs["doc_id"] == ids["id"]) & (docs["lang"] == ids["own"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = b["own"].dictionary_encode()
            own = np.asarray(coded.indices).astype(np.int64)
            for lo, hi, buf, offs in tn.chunks(b["text"], 1 << 19):
                keys, at, _ = grams(buf, offs)
                row = np.repeat(own[lo:hi], np.diff(at))
                pair = np.concatenate([row[k > 0] << BITS | k[k > 0] & (1 << BITS) - 1 for k in keys])
                pair, n = np.unique(pair, return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": coded.dictionary.take(pa.array(pair >> BITS)), "bucket": (pair & (1 << BITS) - 1).astype(np.int32), "n": n.astype(np.int64)})

    parts = found.select("own", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "lang string, bucket int, n long")
    table = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    coded = table["lang"].combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    langs = sorted(names)
    place = {x: i for i, x in enumerate(langs)}
    row = np.array([place[x] for x in names], np.int64)[np.asarray(coded.indices)]
    return langs, Logs(row, table["bucket"].to_numpy(), table["n"].to_numpy(), len(langs))


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, model: tuple[list[str], Logs]) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (the language's posterior probability)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs = sent.value
        cuts = range(0, len(langs), BLOCK)
        block = lru_cache(maxsize=1)(lambda lo: logs.block(lo, min(lo + BLOCK, len(langs))))
        for b in batches:
            for lo, hi, buf, offs in tn.chunks(b["text"], 1 << 19):
                keys, at, letters = grams(buf, offs)
                best, most, below = np.zeros(hi - lo, np.int64), np.full(hi - lo, -np.inf), np.zeros(hi - lo)
                for cut in cuts:
                    table = block(cut)
                    total = np.zeros((hi - lo, len(table)))
                    for i, own in enumerate(table):
                        gained = np.zeros(len(keys[0]) + 1)
                        np.cumsum(own[keys[0]] + own[keys[1]] + own[keys[2]], dtype=np.float64, out=gained[1:])
                        total[:, i] = gained[at[1:]] - gained[at[:-1]]
                    top = total.max(1)
                    best = np.where(top > most, cut + total.argmax(1), best)
                    more = np.maximum(top, most)
                    below = below * np.exp(most - more) + np.exp(np.clip(total - more[:, None], -700, 0)).sum(1)
                    most = more
                score = 1 / np.maximum(below, 1)
                sure = letters & bool(langs)
                yield batch(OUT, {"doc_id": b["doc_id"][lo:hi], "held_out": b["held_out"][lo:hi], "lang_pred": [langs[j] if ok else "und" for j, ok in zip(best, sure)], "score": np.where(sure, score, 0.0)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(parts=3, part=1).alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
