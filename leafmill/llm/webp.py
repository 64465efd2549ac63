"""Lossless WebP in Python and numpy: a decoder of the whole format, an encoder, and text payloads as grey images.

``decode_all`` is the one decoder. It reads the headers, transforms and prefix codes of each file, then decodes all
images side by side, a pixel of each a step: prefix codes, back-references and the colour cache. The predictor is
inverted side by side too; cross-colour, subtract-green and palette transforms are inverted by image. Small images that
carry transforms and code groups are read one after another.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache
from typing import NamedTuple

import numpy as np

from . import textnum as tn

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
GREEN, OTHER, DISTANCE = 280, 256, 40
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
BLACK = 0xFF000000


class Bits:
    """Bits of a byte string, least first."""

    def __init__(self, data: bytes):
        self.all, self.at, self.size = int.from_bytes(data[:4096], "little"), 0, 8 * len(data)
        self.data = data
        self.base = 0

    def peek(self, n: int) -> int:
        off = self.at - self.base
        if off + n > 32768 - 64 and self.at >> 3 < len(self.data) or off < 0:
            start = self.at >> 3
            self.base, self.all = start << 3, int.from_bytes(self.data[start : start + 4096], "little")
            off = self.at - self.base
        return (self.all >> off) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > self.size:
            raise ValueError("the image ends early")
        out = self.peek(n)
        self.at += n
        return out


@lru_cache(maxsize=16)
def reversed_bits(n: int) -> np.ndarray:
    x, out = np.arange(1 << n), np.zeros(1 << n, np.int64)
    for _ in range(n):
        out = out << 1 | x & 1
        x = x >> 1
    return out


class Code:
    """A prefix code: one symbol without bits, or a table by the next ``width`` bits of symbol << 4 | length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.single, self.width, self.table = None, 0, None
        if len(used) <= 1:
            self.single = int(used[0]) if len(used) else 0
            return
        size = lengths[used]
        width = int(size.max())
        order = np.argsort(size, kind="stable")
        used, size = used[order], size[order]
        flat = np.repeat(used << 4 | size, 1 << (width - size))
        if len(flat) != 1 << width:
            raise ValueError("a prefix code is not complete")
        self.width, self.table = width, flat[reversed_bits(width)]

    def read(self, bits: Bits) -> int:
        if self.table is None:
            return self.single
        x = int(self.table[bits.peek(self.width)])
        bits.at += x & 15
        return x >> 4


def single(symbol: int) -> Code:
    out = Code.__new__(Code)
    out.single, out.width, out.table = symbol, 0, None
    return out


@lru_cache(maxsize=256)
def meta_code(lengths: tuple[int, ...]) -> tuple[list[int], int]:
    """The table of a code for code lengths and the mask of the bits that index it."""
    code = Code(np.array(lengths))
    return (code.table.tolist(), (1 << code.width) - 1) if code.table is not None else ([code.single << 4], 0)


def read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        n = bits.read(1) + 1
        first = bits.read(8 if bits.read(1) else 1)
        if n == 1:
            return single(first)
        second = bits.read(8)
        lengths = np.zeros(size, np.int64)
        lengths[[first, second]] = 1
        return Code(lengths)
    small = [0] * 19
    n = 4 + bits.read(4)
    ahead = bits.peek(57)
    for i, k in enumerate(LENGTH_ORDER[:n]):
        small[k] = ahead >> 3 * i & 7
    bits.at += 3 * n
    table, mask = meta_code(tuple(small))
    left = size if not bits.read(1) else 2 + bits.read(2 + 2 * bits.read(3))
    lengths = np.zeros(size, np.int64)
    found, at, before, ahead, used = [], 0, 8, bits.peek(4096), 0
    while at < size and left:
        left -= 1
        if used > 4000:
            bits.at += used
            ahead, used = bits.peek(4096), 0
        x = table[ahead >> used & mask]
        used += x & 15
        x >>= 4
        if x < 16:
            if x:
                found.append((at, 1, x))
                before = x
            at += 1
        elif x == 16:
            n = 3 + (ahead >> used & 3)
            used += 2
            found.append((at, n, before))
            at += n
        else:
            k = 3 if x == 17 else 7
            at += (3 if x == 17 else 11) + (ahead >> used & (1 << k) - 1)
            used += k
    bits.at += used
    if at > size or bits.at > bits.size:
        raise ValueError("too many code lengths")
    for i, n, x in found:
        if n == 1:
            lengths[i] = x
        else:
            lengths[i : i + n] = x
    return Code(lengths)


def read_codes(bits: Bits, cache: int) -> list[Code]:
    return [read_code(bits, n) for n in (GREEN + (1 << cache if cache else 0), OTHER, OTHER, OTHER, DISTANCE)]


def read_number(bits: Bits, prefix: int) -> int:
    """A length or distance from its prefix and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> list[int]:
    """An entropy-coded image as ARGB numbers."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, block, across = None, 0, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        groups = [p >> 8 & 0xFFFF for p in read_pixels(bits, across, (height + (1 << block) - 1) >> block, False)]
    codes = [read_codes(bits, cache_bits) for _ in range(max(groups) + 1 if groups else 1)]
    out: list[int] = []
    cache, shift, cached, total = [0] * (1 << cache_bits), 32 - cache_bits, 0, width * height

    def catch_up(cached: int) -> int:
        for p in out[cached:]:
            cache[(p * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift] = p
        return len(out)

    while (at := len(out)) < total:
        green, red, blue, alpha, distance = codes[groups[(at // width >> block) * across + (at % width >> block)]] if groups else codes[0]
        x = green.read(bits)
        if x < 256:
            out.append(red.read(bits) << 16 | x << 8 | blue.read(bits) | alpha.read(bits) << 24)
        elif x < GREEN:
            n = read_number(bits, x - 256)
            far = read_number(bits, distance.read(bits))
            if far <= len(NEAR):
                dx, dy = NEAR[far - 1]
                far = max(1, dx + dy * width)
            else:
                far -= len(NEAR)
            if far > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            for k in range(n):
                out.append(out[at + k - far])
        else:
            cached = catch_up(cached)
            out.append(cache[x - GREEN])
        if bits.at > bits.size:
            raise ValueError("the image ends early")
    return out


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _split(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _join(c) -> int:
    out = 0
    for x in c:
        out = out << 8 | min(255, max(0, x))
    return out


def _nearer(left: int, top: int, corner: int) -> int:
    to_left = to_top = 0
    for a, b, c in zip(_split(left), _split(top), _split(corner), strict=True):
        to_left += abs(b - c)
        to_top += abs(a - c)
    return left if to_left < to_top else top


def predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """What a predictor mode makes of the pixels to the left, above, above right and above left."""
    if mode == 0:
        return BLACK
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode <= 9:
        return _average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        return _nearer(left, top, corner)
    if mode == 12:
        return _join(a + b - c for a, b, c in zip(_split(left), _split(top), _split(corner), strict=True))
    if mode == 13:
        return _join(a + int((a - c) / 2) for a, c in zip(_split(_average(left, top)), _split(corner), strict=True))
    return BLACK


def add_pixels(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def subtract_pixels(a: int, b: int) -> int:
    return _join((x - y) & 255 for x, y in zip(_split(a), _split(b), strict=True))


def prediction_at(pixels: list[int], i: int, width: int, modes: list[int], block: int, across: int) -> int:
    x, y = i % width, i // width
    if not y:
        return pixels[i - 1] if x else BLACK
    if not x:
        return pixels[i - width]
    mode = modes[(y >> block) * across + (x >> block)] >> 8 & 15
    return predicted(mode, pixels[i - 1], pixels[i - width], pixels[i - width + 1], pixels[i - width - 1])


def _signed(x: int) -> int:
    return x - 256 if x > 127 else x


def cross_colour(p: int, element: int, undo: bool) -> int:
    """Take what green and red foretell of red and blue away from a pixel, or give it back."""
    red_blue, green_blue, green_red = (_signed(element >> k & 255) for k in (16, 8, 0))
    a, red, green, blue = _split(p)
    sign, own = 1 if undo else -1, red
    red = red + sign * (green_red * _signed(green) >> 5) & 255
    blue = blue + sign * ((green_blue * _signed(green) >> 5) + (red_blue * _signed(red if undo else own) >> 5)) & 255
    return a << 24 | red << 16 | green << 8 | blue


def chunks(data: bytes) -> tuple[bytes, int]:
    """The VP8L payload of the first file in data, and where that file ends."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    end = 8 + struct.unpack_from("<I", data, 4)[0]
    at = 12
    while at + 8 <= min(end, len(data)):
        n = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + n], end
        at += 8 + n + (n & 1)
    raise ValueError("no lossless image in the file")


def header(bits: Bits) -> tuple[int, int]:
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("a version that is not known")
    return width, height


class Image(NamedTuple):
    """What stands before the pixels of a file: its size, the width of the coded image, the transforms, and the codes."""

    width: int
    height: int
    own: int
    steps: list[tuple]
    cache_bits: int
    block: int
    across: int
    groups: list[int] | None
    codes: list[list[Code]]
    at: int
    payload: bytes


def parse(data: bytes) -> Image:
    payload = chunks(data)[0]
    bits = Bits(payload)
    width, height = header(bits)
    steps: list[tuple] = []
    own, seen = width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            across = (own + (1 << block) - 1) >> block
            steps.append((kind, own, block, across, read_pixels(bits, across, (height + (1 << block) - 1) >> block, False)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            colours = read_pixels(bits, n, 1, False)
            for i in range(1, n):
                colours[i] = add_pixels(colours[i], colours[i - 1])
            fold = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, own, fold, n, colours))
            own = (own + (1 << fold) - 1) >> fold
        else:
            steps.append((kind, own, 0, 0, []))
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, block, across = None, 0, 0
    if bits.read(1):
        block = bits.read(3) + 2
        across = (own + (1 << block) - 1) >> block
        groups = [p >> 8 & 0xFFFF for p in read_pixels(bits, across, (height + (1 << block) - 1) >> block, False)]
    codes = [read_codes(bits, cache_bits) for _ in range(max(groups) + 1 if groups else 1)]
    return Image(width, height, own, steps, cache_bits, block, across, groups, codes, bits.at, payload)


CHECK = 64  # steps between two looks at lanes that ran out of bits; a step takes 16 bytes at most


class Lanes:
    """Images decoded side by side, the largest first; a step decodes or copies the next pixel of every image that has one.

    ``pos`` is the place of each lane's next bit, ``left`` how many pixels it still copies and ``far`` from how far back.
    """

    def __init__(self, images: list[Image]):
        self.images = images
        size = np.array([x.own * x.height for x in images])
        self.size, self.off = size, np.cumsum(size) - size
        self.out = np.zeros(int(size.sum()), np.uint32)
        raw = np.frombuffer(b"".join(x.payload for x in images) + bytes(16 * (CHECK + 2)), np.uint8)
        ahead = raw[:-3].astype(np.uint32)  # the 32 bits from each byte on
        for k in (1, 2, 3):
            ahead |= raw[k : len(raw) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
        self.ahead = ahead
        start = np.cumsum([0, *(len(x.payload) for x in images)])
        self.pos = start[:-1] * 8 + np.array([x.at for x in images], np.int64)
        self.end = start[1:] * 8
        every = [c for x in images for codes in x.codes for c in codes]
        sizes = np.array([1 if c.table is None else len(c.table) for c in every])
        self.table = np.concatenate([np.array([c.single << 4]) if c.table is None else c.table for c in every]).astype(np.int32)
        self.base, self.mask = (np.ascontiguousarray(x.reshape(-1, 5).T) for x in (np.cumsum(sizes) - sizes, sizes - 1))
        self.group = np.cumsum([0, *(len(x.codes) for x in images)])[:-1]
        self.width = np.array([x.own for x in images])
        alone = np.array([all(c.table is None for codes in x.codes for c in codes[1:4]) and len(x.codes) == 1 for x in images])
        self.grey = bool(alone.all())
        self.fixed = np.array([x.codes[0][1].single << 16 | x.codes[0][2].single | x.codes[0][3].single << 24 for x in images], np.int64) if self.grey else None
        self.grouped = any(x.groups for x in images)
        self.greatest = max(int(c[0].table.max()) >> 4 if c[0].table is not None else c[0].single for x in images for c in x.codes)
        self.left, self.far = np.zeros(len(images), np.int64), np.zeros(len(images), np.int64)
        self.bad = np.zeros(len(images), bool)
        if self.grouped:
            maps = [np.array(x.groups or [0]) for x in images]
            self.map, self.map_off = np.concatenate(maps), np.cumsum([0, *(len(m) for m in maps)])[:-1]
            self.block = np.array([x.block if x.groups else 31 for x in images])  # without groups all pixels are in one block
            self.across = np.array([x.across for x in images])
        self.cached = any(x.cache_bits for x in images)
        if self.cached:
            room = np.array([1 << x.cache_bits for x in images])
            self.cache, self.cache_off = np.zeros(int(room.sum()), np.uint32), np.cumsum(room) - room
            self.shift = np.array([32 - x.cache_bits for x in images])

    def symbol(self, lane, group, k: int) -> np.ndarray:
        """The next symbol of lanes by their k-th code."""
        p = self.pos[lane]
        x = self.table[self.base[k][group] + (self.ahead[p >> 3] >> (p & 7) & self.mask[k][group])]
        self.pos[lane] = p + (x & 15)
        return x >> 4

    def number(self, lane: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """Lengths or distances from their prefixes and extra bits."""
        extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
        p = self.pos[lane]
        more = self.ahead[p >> 3] >> (p & 7) & ((1 << extra) - 1)
        self.pos[lane] = p + extra
        return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << extra) + more) + 1

    def begin_copy(self, step: int, lane: np.ndarray, group: np.ndarray, symbol: np.ndarray) -> None:
        n = self.number(lane, symbol - 256)
        code = self.number(lane, self.symbol(lane, group, 4).astype(np.int64))
        near = code <= len(NEAR)
        dx, dy = NEAR_XY[np.where(near, code - 1, 0)].T
        far = np.where(near, np.maximum(1, dx + dy * self.width[lane]), code - len(NEAR))
        wrong = (far > step) | (step + n > self.size[lane])
        self.bad[lane[wrong]] = True
        self.left[lane] = np.where(wrong, 0, n)
        self.far[lane] = np.where(wrong, 0, far)

    def step(self, i: int, many: int) -> None:
        """Pixel i of the first ``many`` lanes."""
        at = self.off[:many] + i
        copies = self.left[:many] > 0 if self.greatest >= 256 else None
        lane = np.arange(many) if copies is None or not copies.any() else np.flatnonzero(~copies)
        if len(lane):
            group = self.group[lane]
            if self.grouped:
                x, y = i % self.width[lane], i // self.width[lane]
                group = group + self.map[self.map_off[lane] + (y >> self.block[lane]) * self.across[lane] + (x >> self.block[lane])]
            symbol = self.symbol(lane, group, 0).astype(np.int64)
            if self.greatest >= 256:
                special = symbol >= 256
                if special.any():
                    back = special & (symbol < GREEN)
                    if back.any():
                        self.begin_copy(i, lane[back], group[back], symbol[back])
                    kept = symbol >= GREEN
                    if kept.any():
                        self.out[at[lane[kept]]] = self.cache[self.cache_off[lane[kept]] + symbol[kept] - GREEN] if self.cached else 0
                    plain = ~special
                    lane, group, symbol = lane[plain], group[plain], symbol[plain]
            if self.grey:
                self.out[at[lane]] = self.fixed[lane] | symbol << 8
            elif len(lane):
                red, blue, alpha = (self.symbol(lane, group, k).astype(np.int64) for k in (1, 2, 3))
                self.out[at[lane]] = red << 16 | symbol << 8 | blue | alpha << 24
        if copies is not None:
            lane = np.flatnonzero(self.left[:many])
            if len(lane):
                self.out[at[lane]] = self.out[at[lane] - self.far[lane]]
                self.left[lane] -= 1
        if self.cached:
            p = self.out[at]
            self.cache[self.cache_off[:many] + ((p.astype(np.int64) * CACHE_MULTIPLIER & 0xFFFFFFFF) >> self.shift[:many])] = p

    def run(self) -> list[np.ndarray | None]:
        """The pixels of each image; None where its bits make no image."""
        falling = -self.size
        for i in range(int(self.size[0])):
            self.step(i, len(self.size) if i < self.size[-1] else int(np.searchsorted(falling, -i, "left")))
            if not i % CHECK:  # a lane out of bits goes on at its end, and is no image
                self.bad |= self.pos > self.end
                np.minimum(self.pos, self.end, out=self.pos)
        self.bad |= self.pos > self.end
        return [None if self.bad[k] else self.out[o : o + n] for k, (o, n) in enumerate(zip(self.off.tolist(), self.size.tolist(), strict=True))]


NEAR_XY = np.array(NEAR)


def _channels(p: np.ndarray) -> list[np.ndarray]:
    return [p >> k & 255 for k in (24, 16, 8, 0)]


def _packed(channels) -> np.ndarray:
    a, r, g, b = (np.clip(c, 0, 255) for c in channels)
    return a << 24 | r << 16 | g << 8 | b


def _mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _modes(mode: np.ndarray, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What predictor modes make of the neighbours of pixels, each pixel by its own mode."""
    out = np.full(len(mode), BLACK, np.int64)
    nearer = lambda: np.where(sum(abs(t - c) for t, c in zip(_channels(top), _channels(corner))) < sum(abs(x - c) for x, c in zip(_channels(left), _channels(corner))), left, top)
    ways = {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: _mean(_mean(left, right), top),
        6: lambda: _mean(left, corner), 7: lambda: _mean(left, top), 8: lambda: _mean(corner, top), 9: lambda: _mean(top, right),
        10: lambda: _mean(_mean(left, corner), _mean(top, right)), 11: nearer,
        12: lambda: _packed(x + t - c for x, t, c in zip(_channels(left), _channels(top), _channels(corner))),
        13: lambda: _packed(a + np.sign(a - c) * (abs(a - c) // 2) for a, c in zip(_channels(_mean(left, top)), _channels(corner))),
    }
    for k in np.unique(mode).tolist():
        if k in ways:
            own = mode == k
            out[own] = ways[k]()[own]
    return out


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def unpredict(images: list[tuple[np.ndarray, int, int, int, list[int]]]) -> list[np.ndarray]:
    """Images (residues, width, block, blocks across, modes) with what their neighbours foretell added, side by side."""
    order = sorted(range(len(images)), key=lambda k: -len(images[k][0]))
    parts = [images[k] for k in order]
    size = np.array([len(x[0]) for x in parts])
    off = np.cumsum(size) - size
    flat = np.concatenate([x[0] for x in parts]).astype(np.int64)
    width, block, across = (np.array([x[j] for x in parts]) for j in (1, 2, 3))
    table = np.concatenate([np.array(x[4], np.int64) >> 8 & 15 for x in parts])
    table_off = np.cumsum([0, *(len(x[4]) for x in parts)])[:-1]
    for i in range(int(size[0])):
        m = int(np.searchsorted(-size, -i, "left"))
        at, w = off[:m] + i, width[:m]
        x, y = i % w, i // w
        mode = table[table_off[:m] + (y >> block[:m]) * across[:m] + (x >> block[:m])]
        mode = np.where(y == 0, np.where(x == 0, 0, 1), np.where(x == 0, 2, mode))
        before = lambda far: flat[at - np.minimum(far, i)]
        flat[at] = _sum(flat[at], _modes(mode, before(1), before(w), before(w - 1), before(w + 1)))
    out: list = [None] * len(images)
    for k, o, n in zip(order, off.tolist(), size.tolist(), strict=True):
        out[k] = flat[o : o + n]
    return out


def _bytes_signed(x: np.ndarray) -> np.ndarray:
    return (x & 255 ^ 128) - 128


def undo(p: np.ndarray, step: tuple, height: int) -> np.ndarray:
    """An image without its cross-colour, subtract-green or palette transform."""
    kind, own, block, across, table = step
    if kind == SUBTRACT_GREEN:
        return p & 0xFF00FF00 | ((p >> 16) + (p >> 8) & 255) << 16 | (p + (p >> 8)) & 255
    y, x = np.divmod(np.arange(own * height), own)
    if kind == CROSS_COLOUR:
        e = np.array(table, np.int64)[(y >> block) * across + (x >> block)]
        green = _bytes_signed(p >> 8)
        red = (p >> 16) + (_bytes_signed(e) * green >> 5) & 255
        blue = p + (_bytes_signed(e >> 8) * green >> 5) + (_bytes_signed(e >> 16) * _bytes_signed(red) >> 5) & 255
        return p & 0xFF00FF00 | red << 16 | blue
    wide, each = (own + (1 << block) - 1) >> block, 8 >> block
    nth = p[y * wide + (x >> block)] >> 8 + (x & (1 << block) - 1) * each & (1 << each) - 1
    return np.array(table + [0] * (256 - across), np.int64)[nth]


def decode_all(files: list[bytes]) -> list[np.ndarray | ValueError]:
    """Of each file the first image as rows of ARGB numbers, or what is wrong with it."""
    out: list = [None] * len(files)
    found: list[tuple[int, Image]] = []
    for i, data in enumerate(files):
        try:
            found.append((i, parse(data)))
        except (ValueError, IndexError) as e:
            out[i] = ValueError(str(e) or "no image")
    if not found:
        return out
    found.sort(key=lambda x: -x[1].own * x[1].height)
    pixels = {}
    for (i, _), p in zip(found, Lanes([x for _, x in found]).run(), strict=True):
        if p is None:
            out[i] = ValueError("the image's bits end early or point outside it")
        else:
            pixels[i] = p.astype(np.int64)
    images = dict(found)
    todo = {i: list(images[i].steps) for i in pixels}
    while todo:
        for i, steps in todo.items():
            while steps and steps[-1][0] != PREDICTOR:
                pixels[i] = undo(pixels[i], steps.pop(), images[i].height)
        todo = {i: steps for i, steps in todo.items() if steps}
        last = [(i, steps.pop()) for i, steps in todo.items()]
        for (i, _), p in zip(last, unpredict([(pixels[i], *step[1:]) for i, step in last]) if last else [], strict=True):
            pixels[i] = p
    for i, p in pixels.items():
        out[i] = p.astype(np.uint32).reshape(images[i].height, images[i].width)
    return out


def rgba(argb: np.ndarray) -> np.ndarray:
    """Rows of pixels of red, green, blue, alpha."""
    return np.stack([argb >> k & 255 for k in (16, 8, 0, 24)], -1).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """The first image of data as rows of pixels of red, green, blue, alpha."""
    argb = decode_all([data])[0]
    if isinstance(argb, ValueError):
        raise argb
    return rgba(argb)


# Writing


def code_lengths(counts: list[int], limit: int = 15) -> list[int]:
    """Lengths of a Huffman code; counts are flattened until none is over the limit."""
    lengths = [0] * len(counts)
    used = [i for i, c in enumerate(counts) if c]
    if len(used) < 2:
        for i in used:
            lengths[i] = 1
        return lengths
    floor = 1
    while True:
        heap = [(max(counts[i], floor), n, i) for n, i in enumerate(used)]
        heapq.heapify(heap)
        parent, n = {}, len(used)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            key = -1 - n
            parent[a[2]], parent[b[2]] = key, key
            heapq.heappush(heap, (a[0] + b[0], n, key))
            n += 1
        depth = {heap[0][2]: 0}
        for key in reversed(parent):
            depth[key] = depth[parent[key]] + 1
        if max(depth[i] for i in used) <= limit:
            for i in used:
                lengths[i] = depth[i]
            return lengths
        floor *= 4


def codes_of(lengths) -> list[int]:
    """Canonical codes, bits reversed so that they are read least bit first."""
    out, code, at = [0] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - at
        at = n
        out[s] = int(format(code, f"0{n}b")[::-1], 2)
        code += 1
    return out


class Writer:
    def __init__(self):
        self.parts: list[tuple[int, int]] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.parts.append((value, n))

    def number(self) -> tuple[int, int]:
        text = "".join(format(v, f"0{n}b")[::-1] for v, n in self.parts)
        return int(text[::-1], 2) if text else 0, len(text)

    def bytes(self) -> bytes:
        value, n = self.number()
        return value.to_bytes((n + 7) // 8, "little")


@lru_cache(maxsize=1)
def _meta() -> tuple[list[int], list[int]]:
    """A fixed code for code lengths: 0-15 and the two runs of zeros."""
    lengths = [4] * 14 + [5, 5, 0, 5, 5]
    lengths = code_lengths([6 if n == 4 else 3 if n == 5 else 0 for n in lengths])
    return lengths, codes_of(lengths)


def put_code(w: Writer, lengths: list[int]) -> None:
    """Write a prefix code."""
    used = [i for i, n in enumerate(lengths) if n]
    if len(used) <= 1 and (not used or used[0] < 256):
        s = used[0] if used else 0
        w.put(1, 1)
        w.put(0, 1)
        w.put(int(s > 1), 1)
        w.put(s, 8 if s > 1 else 1)
        return
    w.put(0, 1)
    meta, codes = _meta()
    w.put(15, 4)
    for k in LENGTH_ORDER:
        w.put(meta[k], 3)
    w.put(0, 1)
    if len(used) == 1:  # a single symbol beyond the simple form takes part in a code of one
        lengths = list(lengths)
    i = 0
    while i < len(lengths):
        n = 0
        while i + n < len(lengths) and not lengths[i + n] and n < 138:
            n += 1
        if n >= 11:
            w.put(codes[18], meta[18])
            w.put(n - 11, 7)
        elif n >= 3:
            w.put(codes[17], meta[17])
            w.put(n - 3, 3)
        else:
            n = 1
            w.put(codes[lengths[i]], meta[lengths[i]])
        i += n


def put_number(value: int) -> tuple[int, int, int]:
    """Prefix, extra bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1


def put_pixels(w: Writer, pixels: list[int], width: int, main: bool, cache_bits: int = 0, copies: bool = False, reach: int = 4096) -> None:
    """Write an entropy-coded image; copies: with back-references to what stood up to ``reach`` pixels before."""
    symbols: list[tuple] = []
    cache, shift = [None] * (1 << cache_bits), 32 - cache_bits
    seen: dict[tuple, int] = {}
    i = 0
    while i < len(pixels):
        n = 0
        if copies and i + 3 <= len(pixels):
            far = seen.get(tuple(pixels[i : i + 3]))
            if far is not None and i - far <= reach:
                while i + n < len(pixels) and pixels[far + n] == pixels[i + n] and n < 4096:
                    n += 1
        if n >= 3:
            dist = i - far
            code = next((k + 1 for k, (dx, dy) in enumerate(NEAR) if dx + dy * width == dist), dist + len(NEAR))
            symbols.append(("copy", n, code))
        else:
            n, p = 1, pixels[i]
            at = (p * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift if cache_bits else 0
            symbols.append(("cache", at, 0) if cache_bits and cache[at] == p else ("pixel", p, 0))
        for p in pixels[i : i + n]:
            if cache_bits:
                cache[(p * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift] = p
        for k in range(i, i + n):
            seen[tuple(pixels[k : k + 3])] = k
        i += n
    counts = [[0] * n for n in (GREEN + (1 << cache_bits if cache_bits else 0), OTHER, OTHER, OTHER, DISTANCE)]
    for kind, x, y in symbols:
        if kind == "pixel":
            for table, k in zip(counts, (8, 16, 0, 24)):
                table[x >> k & 255] += 1
        elif kind == "copy":
            counts[0][256 + put_number(x)[0]] += 1
            counts[4][put_number(y)[0]] += 1
        else:
            counts[0][GREEN + x] += 1
    if sum(1 for c in counts[0] if c) == 1:
        counts[0][0 if not counts[0][0] else 1] += 1
    lengths = [code_lengths(c) for c in counts]
    codes = [codes_of(x) for x in lengths]
    single = [sum(1 for n in x if n) < 2 for x in lengths]
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    for x in lengths:
        put_code(w, x)
    put = lambda t, s: None if single[t] else w.put(codes[t][s], lengths[t][s])
    for kind, x, y in symbols:
        if kind == "pixel":
            for t, k in zip(range(4), (8, 16, 0, 24)):
                put(t, x >> k & 255)
        elif kind == "copy":
            for t, base, v in ((0, 256, x), (4, 0, y)):
                prefix, extra, n = put_number(v)
                put(t, base + prefix)
                w.put(extra, n)
        else:
            put(0, GREEN + x)


def wrapped(payload: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def put_header(w: Writer, width: int, height: int, alpha: bool) -> None:
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(int(alpha), 1)
    w.put(0, 3)


def encode(image: np.ndarray, predictor: int | None = None, colour: int | None = None, subtract: bool = False, palette: bool = False, cache_bits: int = 0, copies: bool = True, block: int = 3) -> bytes:
    """A WebP file of rows of pixels of red, green, blue, alpha. predictor: a mode; colour: a cross-colour element."""
    height, width = image.shape[:2]
    w = Writer()
    put_header(w, width, height, bool((image[..., 3] != 255).any()))
    a = image.astype(np.uint32)
    pixels = (a[..., 3] << 24 | a[..., 0] << 16 | a[..., 1] << 8 | a[..., 2]).ravel().tolist()
    own = width
    if palette:
        table = sorted(set(pixels))
        n = len(table)
        if n > 256:
            raise ValueError("too many colours")
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(n - 1, 8)
        put_pixels(w, [table[0], *(subtract_pixels(b, a) for a, b in zip(table, table[1:]))], n, False)
        fold = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
        each, nth = 8 >> fold, {p: i for i, p in enumerate(table)}
        own = (width + (1 << fold) - 1) >> fold
        packed = []
        for y in range(height):
            line = pixels[y * width : (y + 1) * width]
            for x in range(own):
                g = 0
                for k, p in enumerate(line[x << fold : (x + 1) << fold]):
                    g |= nth[p] << k * each
                packed.append(BLACK | g << 8)
        pixels = packed
    across, down = (own + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
    if predictor is not None:
        modes = [BLACK | predictor << 8] * (across * down)
        w.put(1, 1)
        w.put(PREDICTOR, 2)
        w.put(block - 2, 3)
        put_pixels(w, modes, across, False)
        pixels = [subtract_pixels(p, prediction_at(pixels, i, own, modes, block, across)) for i, p in enumerate(pixels)]
    if colour is not None:
        w.put(1, 1)
        w.put(CROSS_COLOUR, 2)
        w.put(block - 2, 3)
        put_pixels(w, [BLACK | colour] * (across * down), across, False)
        pixels = [cross_colour(p, colour, False) for p in pixels]
    if subtract:
        w.put(1, 1)
        w.put(SUBTRACT_GREEN, 2)
        pixels = [p & 0xFF00FF00 | ((p >> 16) - (p >> 8) & 255) << 16 | (p - (p >> 8)) & 255 for p in pixels]
    w.put(0, 1)
    put_pixels(w, pixels, own, True, cache_bits, copies)
    return wrapped(w.bytes())


# Grey images side by side


LEAST_COPY, MOST_COPY = 8, 263


@lru_cache(maxsize=4)
def distance_codes(width: int, most: int) -> np.ndarray:
    """The code of every distance below ``most``: that of a near pixel, or the distance itself behind those."""
    out = np.arange(most) + len(NEAR)
    for k in range(len(NEAR) - 1, -1, -1):
        far = NEAR[k][0] + NEAR[k][1] * width
        if 0 < far < most:
            out[far] = k + 1
    return out


def numbers(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefixes, extra bits and their number of lengths or distances."""
    v = value - 1
    high = np.frexp(np.maximum(v, 1))[1].astype(np.int64) - 1
    extra = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + (v >> np.maximum(high - 1, 0) & 1)), np.where(v < 4, 0, v & (1 << extra) - 1), extra


def copies(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every sample how many from it on can be copied, 0 or LEAST_COPY at least, and from how far back in its image:
    from where samples of the same hash stood last. Equal hashes stand for equal samples until ``_exact`` has compared."""
    n = len(data)
    length, far = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < 2 * LEAST_COPY:
        return length, far
    p, inverse = tn.prefix(tn.BYTE[data]), tn.powers(tn.R_INV, n + 1)
    start = np.flatnonzero(np.arange(n) + LEAST_COPY <= np.repeat(at[1:], np.diff(at)))
    image = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))[start]
    key = tn.mix((p[start + LEAST_COPY] - p[start]) * inverse[start] + image)
    order = np.argsort(key.astype(np.uint16), kind="stable")  # by digits: 16 bits are sorted by counting
    order = order[np.argsort((key >> np.uint64(16)).astype(np.uint16)[order], kind="stable")]
    sorted_key = key[order]
    same = sorted_key[1:] == sorted_key[:-1]
    i, j = start[order[1:][same]], start[order[:-1][same]]
    room = np.minimum(at[np.searchsorted(at, i, "right")] - i, MOST_COPY)
    have = np.full(len(i), LEAST_COPY)
    for step in (128, 64, 32, 16, 8, 4, 2, 1):
        fits = np.flatnonzero(have + step <= room)
        a, b = i[fits] + have[fits], j[fits] + have[fits]
        have[fits] += step * ((p[a + step] - p[a]) * inverse[a] == (p[b + step] - p[b]) * inverse[b])
    length[i], far[i] = have, i - j
    return length, far


def parsed(length: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The samples at which symbols begin if every copy is taken where it is met: all that are reached from the images'
    first samples, by steps doubled over and over and then taken from the longest."""
    n = len(length)
    hops = [np.append(np.minimum(np.arange(n) + np.maximum(length, 1), n), n)]
    most = int(np.diff(at).max())
    while 1 << len(hops) < most:
        hops.append(hops[-1][hops[-1]])
    seen = np.zeros(n + 1, bool)
    seen[at[:-1]] = True
    for hop in reversed(hops):  # a hop over the end of an image lands where the next one begins, or on a place reached from there
        seen[hop[np.flatnonzero(seen[:n])]] = True
    return np.flatnonzero(seen[:n])


def _exact(data: np.ndarray, start: np.ndarray, length: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which copies give the samples that stand there."""
    nth = np.repeat(np.cumsum(length) - length, length)
    at = np.repeat(start, length) + np.arange(int(length.sum())) - nth
    wrong = data[at] != data[at - np.repeat(far, length)]
    return np.bincount(np.repeat(np.arange(len(start)), length), wrong, len(start)) == 0


def _bits_of(counts: np.ndarray) -> np.ndarray:
    """About how many bits the symbols of each row take."""
    total = counts.sum(1, keepdims=True)
    return np.where(counts > 0, counts * (np.log2(np.maximum(total, 1)) - np.log2(np.maximum(counts, 1))), 0).sum(1)


def encode_grey(data: np.ndarray, at: np.ndarray, width: int = 64) -> list[bytes]:
    """Files of grey images of the given width; image i has the samples data[at[i]:at[i + 1]]. Each is written with
    back-references if that is about to make it smaller."""
    files: list[bytes] = []
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 18), "right")) - 1)
        files += _encode_grey(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], width)
        lo = hi
    return files


def _encode_grey(data: np.ndarray, at: np.ndarray, width: int) -> list[bytes]:
    n, size = len(at) - 1, np.diff(at)
    image = np.repeat(np.arange(n), size)
    plain = np.bincount(image * GREEN + data, minlength=n * GREEN).reshape(n, GREEN)
    length, far = copies(data, at)
    begin = parsed(length, at)
    sure = length[begin] > 0
    taken = begin[sure]
    if not _exact(data, taken, length[taken], far[taken]).all():  # equal hashes of different samples
        length[:] = 0
        begin, taken = np.arange(len(data)), taken[:0]
    prefix, extra, extra_bits = numbers(length[taken])
    way = distance_codes(width, int(size.max()) + 1)[far[taken]]
    far_prefix, far_extra, far_bits = numbers(way)
    literal = begin[length[begin] == 0]
    mixed = np.bincount(image[literal] * GREEN + data[literal], minlength=n * GREEN) + np.bincount(image[taken] * GREEN + 256 + prefix, minlength=n * GREEN)
    mixed, ways = mixed.reshape(n, GREEN), np.bincount(image[taken] * DISTANCE + far_prefix, minlength=n * DISTANCE).reshape(n, DISTANCE)
    more = np.bincount(image[taken], extra_bits + far_bits, n) + 5 * ((ways > 0).sum(1) + (mixed[:, 256:] > 0).sum(1)) + 60
    better = (_bits_of(mixed) + _bits_of(ways) + more < _bits_of(plain)) & (ways.sum(1) > 0)
    counts = np.where(better[:, None], mixed, plain)
    # symbols in order: all samples of the images without copies, else literals and copies, which are two items
    begins = np.zeros(len(data), bool)
    begins[begin] = True
    begins |= ~better[image]
    start = np.flatnonzero(begins)
    own = image[start]
    copy = better[own] & (length[start] > 0)
    nth = np.full(len(data), -1)
    nth[taken] = np.arange(len(taken))
    k = nth[start[copy]]
    symbol = data[start].astype(np.int64)
    symbol[copy] = 256 + prefix[k]
    green, distance = np.zeros((n, GREEN), np.int64), np.zeros((n, DISTANCE), np.int64)
    heads = []
    for i in range(n):
        few = np.flatnonzero(counts[i])
        lengths, codes = _code(counts[i], few)
        green[i, few] = [c << 4 | b for c, b in zip(codes, lengths, strict=True)]
        if better[i]:
            some = np.flatnonzero(ways[i])
            far_lengths, far_codes = _code(ways[i], some)
            distance[i, some] = [c << 4 | b for c, b in zip(far_codes, far_lengths, strict=True)]
            heads.append(grey_head(width, int(size[i]) // width, few.tolist(), lengths, some.tolist(), far_lengths))
        else:
            heads.append(grey_head(width, int(size[i]) // width, few.tolist(), lengths, [0], [0]))
    x = green[own, symbol]
    value, bit = x >> 4, x & 15
    value[copy] |= extra[k] << bit[copy]
    bit[copy] += extra_bits[k]
    y = distance[own[copy], far_prefix[k]]
    second, second_bit = (y >> 4) | far_extra[k] << (y & 15), (y & 15) + far_bits[k]
    place = np.flatnonzero(copy) + 1
    value, bit, own = np.insert(value, place, second), np.insert(bit, place, second_bit), np.insert(own, place, own[copy])
    return _files(heads, value, bit, np.searchsorted(own, np.arange(n + 1)))


def _code(counts: np.ndarray, used: np.ndarray) -> tuple[list[int], list[int]]:
    """Lengths and codes of the used symbols; a single one takes no bits."""
    if len(used) == 1:
        return [0], [0]
    lengths = code_lengths(counts[used].tolist(), 12)
    return lengths, codes_of(lengths)


def _files(heads: list[tuple[int, int]], value: np.ndarray, bit: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Files from what stands before the pixels (bits as a number, and how many) and the items (bits, how many) of each."""
    ends = np.append(0, np.cumsum(bit))
    before = ends[first[:-1]]
    head_bits = np.array([x[1] for x in heads])
    total = (head_bits + ends[first[1:]] - before + 7) // 8
    room = (total + 7) // 8 * 8
    base = np.cumsum(room) - room
    place = ends[:-1] + np.repeat(head_bits + base * 8 - before, np.diff(first))
    word = place >> 5
    value = value.astype(np.int64) << (place & 31)
    words = int((base[-1] + room[-1]) // 4 + 4)
    out = np.bincount(word, value & 0xFFFFFFFF, words)
    over = np.flatnonzero(value >> 32)
    out += np.bincount(word[over] + 1, value[over] >> 32, words)
    raw = out.astype(np.uint64).astype(np.uint32).view(np.uint8)
    files = []
    for i, (number, bits) in enumerate(heads):
        own = raw[base[i] : base[i] + total[i]]
        head = np.frombuffer(number.to_bytes((bits + 7) // 8, "little"), np.uint8)
        own[: len(head)] |= head
        files.append(wrapped(own.tobytes()))
    return files


@lru_cache(maxsize=1)
def _grey_parts() -> tuple[tuple[int, int], list[tuple[int, int]], tuple[int, int]]:
    """What stands before the green code, the bits of each code length, and what stands before a code's lengths."""
    before, lead = Writer(), Writer()
    for value, n in ((1, 1), (SUBTRACT_GREEN, 2), (0, 1), (0, 1), (0, 1)):
        before.put(value, n)
    meta, codes = _meta()
    for value, n in ((0, 1), (15, 4), *((meta[k], 3) for k in LENGTH_ORDER), (0, 1)):
        lead.put(value, n)
    return before.number(), list(zip(codes, meta, strict=True)), lead.number()


def _lengths(head: int, n: int, used: list[int], lengths: list[int], size: int) -> tuple[int, int]:
    """A number of n bits with a prefix code put after them: simple for one symbol below 256, else as lengths."""
    _, code, (lead, lead_bits) = _grey_parts()
    if len(used) == 1 and used[0] < 256:
        return head | (1 | int(used[0] > 1) << 2 | used[0] << 3) << n, n + (11 if used[0] > 1 else 4)
    head |= lead << n
    n += lead_bits
    zero, zero_bits = code[0]
    short, short_bits = code[17]
    long, long_bits = code[18]
    at = 0
    for s, x in zip([*used, size], [*lengths, 0], strict=True):
        gap = s - at
        while gap >= 11:
            k = min(gap, 138)
            head |= (long | (k - 11) << long_bits) << n
            n += long_bits + 7
            gap -= k
        if gap >= 3:
            head |= (short | (gap - 3) << short_bits) << n
            n += short_bits + 3
            gap = 0
        for _ in range(gap):
            head |= zero << n
            n += zero_bits
        if s < size:
            value, bits = code[x]
            head |= value << n
            n += bits
        at = s + 1
    return head, n


def grey_head(width: int, height: int, used: list[int], lengths: list[int], far: list[int], far_lengths: list[int]) -> tuple[int, int]:
    """The bits before the pixels of a grey image by its green and distance codes, as a number and their count."""
    (head, n), _, _ = _grey_parts()
    head, n = _lengths(head, n, used, lengths, GREEN)
    for only in (0, 0, 255):
        head, n = _lengths(head, n, [only], [0], OTHER)
    head, n = _lengths(head, n, far, far_lengths, DISTANCE)
    return 0x2F | width - 1 << 8 | height - 1 << 22 | head << 40, n + 40


def decode_grey(files: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The green samples of images, end to end, and where each image starts."""
    found = decode_all(files)
    for x in found:
        if isinstance(x, ValueError):
            raise x
    at = np.append(0, np.cumsum([x.size for x in found]))
    return np.concatenate([x.ravel() for x in found] or [np.zeros(0, np.uint32)]).view(np.uint8)[1::4], at
