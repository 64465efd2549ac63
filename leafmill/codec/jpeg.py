"""Baseline JPEG in numpy: enough to write an image anew at a lower quality."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

# Fixed values of the format: the luminance and chrominance tables at quality 50 and the order of coefficients.
LUMA = "16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"
CHROMA = "17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99"
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


@lru_cache(maxsize=1)
def basis() -> np.ndarray:
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * n + 1) * k * np.pi / 16)


def tables(quality: int) -> list[np.ndarray]:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t.split(), int) * scale + 50) // 100, 1, 255) for t in (LUMA, CHROMA)]


class _Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.table = np.zeros(1 << 16, np.int32)
        code, k = 0, 0
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                self.table[code << (16 - n) : (code + 1) << (16 - n)] = symbols[k] << 8 | n
                code, k = code + 1, k + 1
            code <<= 1
        self.list = self.table.tolist()


def decode(data: bytes) -> np.ndarray:
    """Rows of pixels of one or three channels as stored (grey, or luminance and two colour differences)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    at, quant, huff, restart = 2, {}, {}, 0
    while True:
        if data[at] != 0xFF:
            raise ValueError("a broken JPEG file")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        n = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if kind == 0xDB:
            while body:
                if body[0] >> 4:
                    raise ValueError("a table of 16 bits")
                quant[body[0] & 15], body = np.frombuffer(body[1:65], np.uint8).astype(int), body[65:]
        elif kind == 0xC4:
            while body:
                total = sum(body[1:17])
                huff[body[0]], body = _Huffman(body[1:17], body[17 : 17 + total]), body[17 + total :]
        elif kind == 0xC0:
            height, width, many = struct.unpack_from(">HHB", body, 1)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(many)]
        elif 0xC1 <= kind <= 0xCF:
            raise ValueError("no baseline JPEG")
        elif kind == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif kind == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    across, down = max(p[1] for p in parts), max(p[2] for p in parts)
    wide, high = -(-width // (8 * across)), -(-height // (8 * down))
    blocks = [np.zeros((high * v, wide * h, 64)) for _, h, v, _ in parts]
    scan = data[at:]
    pieces = _restarts(scan)
    unit, total = 0, wide * high
    for piece in pieces:
        bits, pos = int.from_bytes(piece + b"\xff" * 8, "big"), 0
        size = 8 * len(piece) + 64
        last = [0] * len(parts)
        chunk, base = 0, -1
        for _ in range(restart or total):
            if unit >= total or pos > size - 64:
                break
            my, mx = divmod(unit, wide)
            for c, (own, h, v, q) in enumerate(parts):
                dc, ac = huff[chosen[own] >> 4].list, huff[16 | chosen[own] & 15].list
                for k in range(h * v):
                    out = blocks[c][my * v + k // h, mx * h + k % h]
                    i = 0
                    while i < 64:
                        if base < 0 or pos - base > 4000:
                            base = pos
                            chunk = bits >> max(0, size - pos - 4096) & (1 << 4096) - 1 if size - pos >= 4096 else (bits & (1 << (size - pos)) - 1) << 4096 - (size - pos)
                        x = (dc if i == 0 else ac)[chunk >> 4080 - (pos - base) & 0xFFFF]
                        pos += x & 255
                        s = x >> 8
                        if not x:
                            raise ValueError("a code that is not known")
                        if i and s == 0:
                            break
                        if i:
                            i += s >> 4
                            s &= 15
                        value = 0
                        if s:
                            if pos - base > 4000:
                                base = pos
                                chunk = bits >> max(0, size - pos - 4096) & (1 << 4096) - 1 if size - pos >= 4096 else (bits & (1 << (size - pos)) - 1) << 4096 - (size - pos)
                            value = chunk >> 4096 - (pos - base) - s & (1 << s) - 1
                            pos += s
                            if value < 1 << s - 1:
                                value -= (1 << s) - 1
                        if i == 0:
                            last[c] += value
                            value = last[c]
                        if i < 64:
                            out[ZIGZAG[i]] = value * quant[q][i]
                        i += 1
            unit += 1
    planes = []
    b = basis()
    for (_, h, v, _), x in zip(parts, blocks, strict=True):
        x = x.reshape(x.shape[0], x.shape[1], 8, 8)
        plane = np.einsum("ki,yxkl,lj->yixj", b, x, b).reshape(x.shape[0] * 8, x.shape[1] * 8) + 128
        planes.append(plane.repeat(down // v, 0).repeat(across // h, 1)[:height, :width])
    return np.clip(np.round(np.stack(planes, -1)), 0, 255).astype(np.uint8)


def _restarts(scan: bytes) -> list[bytes]:
    """The entropy-coded stretches of a scan without their stuffing."""
    out, at, last = [], 0, 0
    while (at := scan.find(b"\xff", at)) >= 0 and at + 1 < len(scan):
        if scan[at + 1] == 0:
            at += 2
        elif 0xD0 <= scan[at + 1] <= 0xD7:
            out.append(scan[last:at])
            at = last = at + 2
        else:
            break
    out.append(scan[last : at if at >= 0 else len(scan)])
    return [x.replace(b"\xff\x00", b"\xff") for x in out]


def _code(counts: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A table segment's body and the codes for symbols by falling count, none of ones alone."""
    symbols = sorted(counts, key=lambda s: (-counts[s], s))
    need, lengths = len(symbols) + 1, []
    depth = max(1, (need - 1).bit_length())
    short = (1 << depth) - need  # a code of two lengths: complete but for its last word
    lengths = [depth - 1] * short + [depth] * (len(symbols) - short) if depth > 1 else [1] * len(symbols)
    rows, codes, code, at = [0] * 16, {}, 0, lengths[0] if lengths else 1
    for s, n in zip(symbols, lengths, strict=True):
        code <<= n - at
        at = n
        codes[s] = (code, n)
        code += 1
        rows[n - 1] += 1
    return bytes(rows) + bytes(symbols), codes


def encode(pixels: np.ndarray, quality: int) -> bytes:
    """A baseline file of one or three channels as stored, without subsampling."""
    height, width, many = pixels.shape
    quant = [q[ZIGZAG] for q in tables(quality)]
    down, across = -(-height // 8), -(-width // 8)
    padded = np.pad(pixels, ((0, down * 8 - height), (0, across * 8 - width), (0, 0)), "edge").astype(float) - 128
    b, rows = basis(), []
    for c in range(many):
        x = padded[..., c].reshape(down, 8, across, 8)
        y = np.einsum("ki,yixj,lj->yxkl", b, x, b).reshape(-1, 64)[:, ZIGZAG]
        rows.append(np.round(y / quant[min(c, 1)]).astype(int))
    stacked = np.stack(rows, 1)
    last, tokens, counts = [0] * many, [], [{}, {}]
    for unit in stacked:
        for c in range(many):
            own = unit[c]
            steps = [(0, int(own[0]) - last[c])]
            last[c] = int(own[0])
            at = 0
            for i in np.flatnonzero(own[1:]).tolist():
                gap = i - at
                while gap > 15:
                    steps.append((0xF0, 0))
                    gap -= 16
                steps.append((gap << 4, int(own[i + 1])))
                at = i + 1
            if at < 63:
                steps.append((0, 0))
            for k, (run, v) in enumerate(steps):
                n = abs(v).bit_length()
                s = run | n
                counts[k > 0][s] = counts[k > 0].get(s, 0) + 1
                tokens.append((k > 0, s, v if v >= 0 else v + (1 << n) - 1, n))
    made = [_code(x) for x in counts]
    bits = "".join(format(made[t][1][s][0], f"0{made[t][1][s][1]}b") + (format(v, f"0{n}b") if n else "") for t, s, v, n in tokens)
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") if bits else b""
    segment = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + segment(0xDB, b"".join(bytes([i]) + bytes(q.astype(np.uint8)) for i, q in enumerate(quant[: 2 if many > 1 else 1])))
    out += segment(0xC0, struct.pack(">BHHB", 8, height, width, many) + b"".join(bytes([c + 1, 0x11, min(c, 1)]) for c in range(many)))
    out += segment(0xC4, b"\x00" + made[0][0]) + segment(0xC4, b"\x10" + made[1][0])
    out += segment(0xDA, bytes([many]) + b"".join(bytes([c + 1, 0x00]) for c in range(many)) + b"\x00\x3f\x00")
    return out + scan + b"\xff\xd9"


def recompress(data: bytes, quality: int) -> bytes:
    """The image at a lower quality; as it is where that is no smaller or it cannot be read."""
    try:
        out = encode(decode(data), quality)
    except (ValueError, KeyError, IndexError, struct.error):
        return data
    return out if len(out) < len(data) else data
