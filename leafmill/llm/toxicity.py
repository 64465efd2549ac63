"""Toxicity: non-negative positive-unlabelled learning.

A linear classifier over the presence of hashed words and word beginnings, trained in numpy from confirmed toxic texts
and unlabelled ones with the class-prior-corrected risk  p R+(P) + max(0, R-(U) - p R-(P)).  The sample is bounded by
``max_positive`` and ``max_unlabelled`` rows, those of the least hashes; the prior is the toxic share of the labelled
training rows. Features are counted and chosen on the executors; the driver gets the chosen ones of the sample alone, and
sends out their weights.

Defined results: null and empty texts have no features and score the bias; without a toxic training row, or a feature
that tells the sets apart, every score is 0; repeated rows score alike; null labels count as unlabelled. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import Scratch, batch

BITS = 18
BEGINNINGS = (4, 5)
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed feature of every word and of its beginnings, repeats included."""
    low = LOWER[buf]
    if len(buf) > 1:  # capitals of Latin-1, two bytes in UTF-8
        second = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        low[1:][second] += 0x20
    start, end = tn.runs(IN_WORD[low], offs)
    row = np.searchsorted(offs, start, "right") - 1
    p = tn.prefix(tn.BYTE[low])
    keys, rows = [tn.spans(p, start, end)], [row]
    for n in BEGINNINGS:
        longer = end - start > n
        s = start[longer]
        keys.append(tn.spans(p, s, s + n) ^ np.uint64(n))
        rows.append(row[longer])
    return np.concatenate(rows), (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        row, feature = features(buf, offs)
        has = np.flatnonzero(self.weights[feature])
        pairs = np.unique(row[has].astype(np.int64) << BITS | feature[has])
        z = np.bincount(pairs >> BITS, self.weights[pairs & ((1 << BITS) - 1)], len(offs) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(row: np.ndarray, col: np.ndarray, is_p: np.ndarray, n_features: int, prior: float, epochs: int = 150, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights of the features, then the bias, by Adam on the non-negative risk with the logistic loss; where the
    corrected part turns negative its gradient is taken back, as the method asks. row, col: the features of each text;
    is_p: which texts are confirmed, the others are unlabelled."""
    n = len(is_p)
    n_p, n_u = int(is_p.sum()), n - int(is_p.sum())
    w = np.append(np.zeros(n_features), np.log(prior / (1 - prior)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, epochs + 1):
        z = np.bincount(row, w[col], n) + w[-1]
        grad = risk_gradient(z, is_p, n_p, n_u, prior)
        grad = np.append(np.bincount(col, grad[row], n_features), grad.sum())
        grad[:-1] += decay * w[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


def risk_gradient(z: np.ndarray, is_p: np.ndarray, n_p: int, n_u: int, prior: float) -> np.ndarray:
    """Of each text's logit: the gradient of the non-negative risk, or against that of its corrected part where this is negative."""
    s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    below = np.log1p(np.exp(np.clip(z, -40, 40)))  # the loss of a negative label
    corrected = np.where(is_p, -prior * s / n_p, s / n_u)
    if below[~is_p].mean() - prior * below[is_p].mean() < 0:
        return -corrected
    return np.where(is_p, -prior * (1 - s) / n_p, 0.0) + corrected


SAMPLE = pa.schema([("positive", pa.bool_()), ("features", pa.list_(pa.int32()))])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, buf, offs in tn.chunks(b["text"]):
            row, feature = features(buf, offs)
            pairs = np.unique(row.astype(np.int64) << BITS | feature)
            at = np.searchsorted(pairs >> BITS, np.arange(hi - lo + 1)).astype(np.int32)
            yield batch(SAMPLE, {"positive": b["positive"][lo:hi], "features": pa.ListArray.from_arrays(pa.array(at), pa.array((pairs & ((1 << BITS) - 1)).astype(np.int32)))})


def telling(sample: DataFrame, n_p: int, n_u: int, kept: int) -> DataFrame:
    """The features (feature) that tell the two sets of a sample apart most, by a z-score of their odds over 3.5."""
    seen = sample.select("positive", F.explode("features").alias("feature")).groupBy("feature")
    p, u = F.count(F.when(F.col("positive"), 1)) + F.lit(0.5), F.count(F.when(~F.col("positive"), 1)) + F.lit(0.5)
    odds = F.log(p / (n_p + 1)) - F.log(u / (n_u + 1))
    gains = seen.agg((F.abs(odds) / F.sqrt(1 / p + 1 / u)).alias("gain"))
    return gains.where("gain > 3.5").orderBy(F.desc("gain"), "feature").limit(kept).select("feature")


def only(sample: DataFrame, chosen: np.ndarray) -> pa.Table:
    """The sample with each text's features as places in chosen, which is sorted; the others are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, ends = b["features"].flatten().to_numpy(), np.append(0, np.cumsum(pc.list_value_length(b["features"]).to_numpy()))
            place = np.searchsorted(chosen, flat)
            has = chosen[np.minimum(place, len(chosen) - 1)] == flat
            at = np.append(0, np.cumsum(has))[ends].astype(np.int32)
            yield batch(SAMPLE, {"positive": b["positive"], "features": pa.ListArray.from_arrays(pa.array(at), pa.array(place[has].astype(np.int32)))})

    return sample.mapInArrow(run, "positive boolean, features array<int>").toArrow()


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 0):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(parts)) == part


NOTHING = Model(np.zeros(1 << BITS), -40.0)


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 3000, max_unlabelled: int = 9000, kept: int = 6000) -> Model:
    """A model from the rows that are not held out; labels has doc_id and toxic. The sample stays in a table; what
    comes to the driver is ``kept`` features at most and which texts of the sample have them."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").alias("id"), "toxic").where(~held_out("id") & F.col("toxic").isNotNull())
    n, share = known.agg(F.count("*"), F.avg("toxic")).first()
    if not n or not share:
        return NOTHING
    toxic = known.where("toxic = 1").orderBy(F.xxhash64(F.col("id"), F.lit(17)), "id").limit(max_positive).select("id", F.lit(True).alias("positive"))
    ids = docs.select(F.col("doc_id").alias("id")).where(~held_out())
    rest = ids.orderBy(F.xxhash64(F.col("id"), F.lit(29)), "id").limit(max_unlabelled).select("id", F.lit(False).alias("positive"))
    wanted = toxic.unionByName(rest)  # bounded by the two limits
    own = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    with Scratch(spark) as scratch:
        found = own.join(F.broadcast(wanted), own["doc_id"] == wanted["id"]).select("positive", "text").mapInArrow(_sample, "positive boolean, features array<int>")
        sample = scratch.keep(found, "sample")
        count = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
        n_p, n_u = count.get(True, 0), count.get(False, 0)
        if not n_p or not n_u:
            return NOTHING
        chosen = np.sort(telling(sample, n_p, n_u, kept).toArrow()["feature"].to_numpy())
        if not len(chosen):
            return NOTHING
        has = only(sample, chosen)
    is_p = has["positive"].to_numpy()
    size = pc.list_value_length(has["features"]).to_numpy()
    col = pc.list_flatten(has["features"]).to_numpy()
    w = fit(np.repeat(np.arange(len(size), dtype=np.int32), size), col, is_p, len(chosen), min(0.9, max(1e-3, float(share))))
    weights = np.zeros(1 << BITS)
    weights[chosen] = w[:-1]
    return Model(weights, float(w[-1]))


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(model.weights).astype(np.int32), model.weights[model.weights != 0], model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, bias = sent.value
        own = Model(np.zeros(1 << BITS), bias)
        own.weights[at] = values
        for b in batches:
            for lo, hi, buf, offs in tn.chunks(b["text"], 1 << 20):
                s = own.score(buf, offs)
                yield batch(SCORED, {"doc_id": b["doc_id"][lo:hi], "held_out": b["held_out"][lo:hi], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score below the limit."""
    sent = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(model.weights).astype(np.int32), model.weights[model.weights != 0], model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, bias = sent.value
        own = Model(np.zeros(1 << BITS), bias)
        own.weights[at] = values
        for b in batches:
            for lo, hi, buf, offs in tn.chunks(b["text"], 1 << 20):
                yield b.slice(lo, hi - lo).filter(pa.array(own.score(buf, offs) < limit))

    return docs.mapInArrow(run, docs.schema)
