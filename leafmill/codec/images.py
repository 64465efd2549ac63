"""Images for stamps: PNG files to colours and opacity."""

from __future__ import annotations

import math
import struct
import zlib
from typing import NamedTuple

import numpy as np

from .filters import unpredict


class Image(NamedTuple):
    width: int
    height: int
    rgb: bytes
    alpha: bytes | None  # None: opaque throughout


def from_rgba(pixels: np.ndarray) -> Image:
    """Of rows of red, green, blue, alpha."""
    alpha = pixels[..., 3]
    return Image(pixels.shape[1], pixels.shape[0], pixels[..., :3].tobytes(), None if (alpha == 255).all() else alpha.tobytes())


# Fixed values of the format: first column and row, and the steps, of each pass of an interlaced file.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _samples(raw: bytes, width: int, height: int, channels: int, depth: int, scaled: bool) -> np.ndarray:
    """Rows of pixels of 8-bit samples from filtered rows; samples of fewer bits are scaled up unless they are indices."""
    row = (width * channels * depth + 7) // 8
    x = np.frombuffer(unpredict(raw, {"Predictor": 15, "Columns": width, "Colors": channels, "BitsPerComponent": depth}), np.uint8).reshape(height, row)
    if depth == 16:
        x = x[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(x, axis=1)
        bits = bits[:, : bits.shape[1] // depth * depth].reshape(height, -1, depth)
        x = (bits * (1 << np.arange(depth)[::-1])).sum(2)[:, : width * channels]
        if scaled:
            x = x * 255 // ((1 << depth) - 1)
    return x.reshape(height, width, channels).astype(np.uint8)


def _interlaced(raw: bytes, width: int, height: int, channels: int, depth: int, scaled: bool) -> np.ndarray:
    """The pixels of seven smaller images, each filtered by itself."""
    out, at = np.zeros((height, width, channels), np.uint8), 0
    for x, y, across, down in PASSES:
        wide, high = len(range(x, width, across)), len(range(y, height, down))
        if wide and high:
            size = high * ((wide * channels * depth + 7) // 8 + 1)
            out[y::down, x::across] = _samples(raw[at : at + size], wide, high, channels, depth, scaled)
            at += size
    return out


def read_png(data: bytes) -> Image:
    """PNG of any colour type and depth, interlaced or not."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, parts, palette, clear = 8, [], None, b""
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    x = (_interlaced if laced else _samples)(zlib.decompress(b"".join(parts)), width, height, channels, depth, colour != 3)
    out = np.full((height, width, 4), 255, np.uint8)
    if colour == 3:
        out[..., :3] = palette[x[..., 0]]
        table = np.full(256, 255, np.uint8)
        table[: len(clear)] = np.frombuffer(clear, np.uint8)
        out[..., 3] = table[x[..., 0]]
    else:
        out[..., :3] = x[..., :3] if channels >= 3 else x[..., :1]
        if channels in (2, 4):
            out[..., 3] = x[..., -1]
    return from_rgba(out)


def fit_rotated(width: float, height: float, page_width: float, page_height: float, angle: float, scale: float) -> tuple[float, float]:
    """The largest size of an image whose bounding box, once turned, fits into a share of the page both ways."""
    aspect, t = height / width, math.radians(angle)
    c, s = abs(math.cos(t)), abs(math.sin(t))
    w = min(page_width * scale / (c + aspect * s), page_height * scale / (s + aspect * c))
    return w, w * aspect
