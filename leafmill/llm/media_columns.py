"""Media columns: lossless WebP.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are stored as grey images 64 samples wide and up
to 128 high, one after another: each a WebP file of its own with prefix codes that fit it and, where that makes it
smaller, back-references. The stored files are decoded by the decoder of the whole format, and features are computed from
the samples read back. ``pixels`` decodes any column of lossless WebP by the same decoder.

Defined results: null text is empty, that is 64 zero bytes; equal texts give equal files; bytes that are no lossless
WebP give a null image and a message. Repeated rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from . import webp
from .common import batch

UNIT, HIGH = 64, 128
TILE = UNIT * HIGH
CHUNK = 12 << 20
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("media", pa.binary())])


def padded(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The payloads of texts end to end, and their offsets."""
    size = np.diff(offs)
    room = np.maximum((size + UNIT - 1) // UNIT, 1) * UNIT
    at = np.append(0, np.cumsum(room))
    out = np.zeros(at[-1], np.uint8)
    out[np.repeat(at[:-1] - offs[:-1], size) + np.arange(len(buf))] = buf
    return out, at


def tiles(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the images that payloads are cut into, and the first image of each payload."""
    many = (np.diff(at) + TILE - 1) // TILE
    first = np.append(0, np.cumsum(many))
    nth = np.arange(first[-1]) - np.repeat(first[:-1], many)
    return np.append(np.repeat(at[:-1], many) + nth * TILE, at[-1]), first


def feature(samples: np.ndarray, at: np.ndarray) -> list[str]:
    """Of each payload, how full 16 ranges of sample values are against the fullest, as hexadecimal digits, and the mean."""
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    bins = np.bincount(row * 16 + (samples >> 4), minlength=n * 16).reshape(n, 16)
    digits = (bins * 15 + bins.max(1, keepdims=True) // 2) // bins.max(1, keepdims=True)
    mean = tn.sums(samples, at) // np.diff(at)
    return ["".join(map("0123456789abcdef".__getitem__, d)) + f"{m:02x}" for d, m in zip(digits.tolist(), mean.tolist(), strict=True)]


def store(df: DataFrame, media: bool = False) -> DataFrame:
    """Per row: doc_id, sizes and digests of the payload read back and of the stored files, and a feature; with media, the files."""
    schema = pa.schema([f for f in OUT if media or f.name != "media"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tn.chunks(b["text"], CHUNK):
                data, at = padded(buf, offs)
                cut, first = tiles(at)
                files = webp.encode_grey(data, cut, UNIT)
                stored = [b"".join(files[i:j]) for i, j in zip(first.tolist(), first[1:].tolist())]
                back, ends = webp.decode_grey([x for f in stored for x in split(f)])
                where = ends[first]
                view = memoryview(back.tobytes())
                own = [view[i:j] for i, j in zip(where.tolist(), where[1:].tolist())]
                yield batch(schema, {"doc_id": b["doc_id"][lo:hi], "n_bytes": np.diff(offs), "payload_bytes": np.diff(where), "payload_sha256": [hashlib.sha256(x).hexdigest() for x in own], "tail_crc32": [zlib.crc32(x[-UNIT:]) for x in own], "media_bytes": [len(x) for x in stored], "media_sha256": [hashlib.sha256(x).hexdigest() for x in stored], "feature": feature(back, where), "media": stored})

    sql = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * media
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, sql)


def split(media: bytes) -> list[bytes]:
    """The files that stand one after another in a stored form."""
    out, at = [], 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or len(media) < at + 12:
            raise ValueError("no WebP file")
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at:end])
        at = end
    return out


def _parts(media: bytes | None) -> tuple[list[bytes], str | None]:
    """The files of a stored form, or what is wrong with it."""
    try:
        return (split(media), None) if media else ([], "no image")
    except ValueError as e:
        return [], str(e)


PIXELS = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary())])


def pixels(df: DataFrame, column: str) -> DataFrame:
    """The frame's other columns with ``images`` (width, height, rows of red, green, blue, alpha) and ``error``."""
    rest = [f for f in df.schema if f.name not in (column, "images", "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            images, errors = [], []
            parts = [_parts(x) for x in b[column].to_pylist()]
            found = iter(webp.decode_all([f for files, _ in parts for f in files]))
            for files, wrong in parts:
                own = [next(found) for _ in files]
                wrong = next((str(a) for a in own if isinstance(a, ValueError)), wrong)
                images.append(None if wrong else [{"width": a.shape[1], "height": a.shape[0], "rgba": webp.rgba(a).tobytes()} for a in own])
                errors.append(wrong)
            yield pa.RecordBatch.from_arrays([*(b[f.name] for f in rest), pa.array(images, pa.list_(PIXELS)), pa.array(errors, pa.string())], [*(f.name for f in rest), "images", "error"])

    sql = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "images array<struct<width:int,height:int,rgba:binary>>, error string"])
    return df.select(*(f"`{f.name}`" for f in rest), column).mapInArrow(run, sql)
