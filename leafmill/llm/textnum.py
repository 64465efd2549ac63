"""Text as numpy arrays: the bytes of an Arrow string column, its words, and polynomial hashes of any span.

Words are runs of bytes other than 0x20 and 0x09-0x0D. No UTF-8 sequence holds those bytes, so working on bytes
gives the words of the text. Hashes are 64-bit polynomials over random byte values with a final mix; span hashes
come from prefix sums, so any number of windows costs one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with avalanche (the splitmix finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(salt) * U(0xD1B54A32D192ED03))


BYTE = seeds(256, 1)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
FOLD[ord("0") : ord("9") + 1] = ord("0")
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
R = int(seeds(1, 7)[0] | U(1))
R_INV = pow(R, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n-1 modulo 2 ** 64; short ones are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 4096), base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= CHUNK * 2:
            _powers[base] = have
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = the sum of values[i:j] times rising powers."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(R, len(values)), out=out[1:])
    return out


def spans(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] from their prefix sums."""
    return mix((p[end] - p[start]) * powers(R_INV, len(p))[start] + (end - start).astype(U))


def windows(p: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n values."""
    m = max(0, len(p) - n)
    return mix((p[n:] - p[:m]) * powers(R_INV, len(p))[:m]) if m else np.zeros(0, U)


def view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null: empty) and its offsets into them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, off, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of runs of rows of about limit bytes, one row at least."""
    buf, offs = view(col)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; a run ends where a row ends."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:], after[-1], after[:-1] = False, mask[:-1], False, mask[1:]
    edge = offs[:-1][offs[:-1] < n]
    before[edge] = False
    after[edge[edge > 0] - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the number of the first word that starts in or after it."""
    start, end = runs(~SPACE[buf], offs)
    return start, end, np.searchsorted(start, offs)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = BYTE) -> np.ndarray:
    return spans(prefix(values[buf]), start, end)


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the first item of each row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values by row."""
    p = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=p[1:])
    return p[first[1:]] - p[first[:-1]]


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.subtract.at(edge, end, 1)
    return np.cumsum(edge[:-1]) > 0
