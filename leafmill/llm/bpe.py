"""Byte-level BPE by a pair occurrence index.

The distinct pieces of a batch lie end to end in one symbol array. An index maps each adjacent pair that has a rank to
all its positions; ranks are taken in ascending order from a heap of those active, all positions of a rank are merged
at once, and only the lists of the pairs beside them change. A merge can only give rise to pairs of a higher rank, so
each rank is taken once. Pieces are found, and told apart by a 64-bit hash, as arrays.

Defined results: null text is empty; an empty text has no ids; the strings of special tokens are encoded as these
tokens. Repeated rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import batch

# Fixed value of the vocabulary's format: the pattern that splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The format's printable letter of each byte: itself where printable, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges as parallel arrays sorted by pair, and special tokens of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.letter = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.letter[b] = vocab[c]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.left, self.right, self.made = left.astype(np.int32), right.astype(np.int32), made
        # open addressing: a pair's rank sits within a few slots of its hash
        self.bits = 18
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, len(merges), np.int32)
        todo, at = np.arange(len(merges)), self.slot(left << 20 | right)
        self.probes = 0
        while len(todo):
            free = self.keys[at] < 0
            slots, first = np.unique(at[free], return_index=True)
            take = todo[free][first]
            self.keys[slots], self.ranks[slots] = (left << 20 | right)[take], take
            rest = ~np.isin(todo, take)
            todo, at = todo[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1
        self.none = len(merges)
        self.cut = "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = self.slot(key)
        out = np.where(self.keys[at] == key, self.ranks[at], self.none)
        miss = np.flatnonzero((out == self.none) & (self.keys[at] >= 0))
        for _ in range(self.probes):
            if not len(miss):
                break
            at = (self.slot(key[miss]) if _ == 0 else at) + 1 & ((1 << self.bits) - 1)
            hit = self.keys[at] == key[miss]
            out[miss[hit]] = self.ranks[at[hit]]
            on = ~hit & (self.keys[at] >= 0)
            miss, at = miss[on], at[on]
        return out

    def merge(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of pieces that lie end to end in data, and the offset of each piece's ids."""
        n = len(data)
        sym = self.letter[data]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[offs[1:] - 1], before[offs[:-1]] = n, -1
        alive = np.ones(n, bool)
        ranks = np.full(n, self.none, np.int32)
        inner = np.flatnonzero(after < n)
        ranks[inner] = self.rank(sym[inner], sym[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(r: np.ndarray, at: np.ndarray) -> None:
            order = np.argsort(r, kind="stable")
            r, at = r[order], at[order]
            edge = np.flatnonzero(r[1:] != r[:-1]) + 1
            for x, part in zip(r[np.append(0, edge)].tolist(), np.split(at, edge), strict=True):
                if x in index:
                    index[x].append(part)
                else:
                    index[x] = [part]
                    heapq.heappush(active, x)

        ranked = np.flatnonzero(ranks < self.none).astype(np.int32)
        if len(ranked):
            add(ranks[ranked], ranked)
        while active:
            r = heapq.heappop(active)
            at = index.pop(r)
            at = at[0] if len(at) == 1 else ascending(np.concatenate(at))
            at = at[ranks[at] == r]
            if self.left[r] == self.right[r] and len(at) > 1:  # a run of one symbol pairs up from its left
                near = np.flatnonzero(np.append(True, after[at[:-1]] != at[1:]))
                place = np.arange(len(at)) - np.repeat(near, np.diff(np.append(near, len(at))))
                at = at[place % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            far = after[gone]
            sym[at] = self.made[r]
            alive[gone], ranks[gone] = False, self.none
            after[at] = far
            has = far < n
            before[far[has]] = at[has]
            back = before[at]
            prior = back[back >= 0]
            here = at[has]
            ranks[at] = self.none
            pos = np.concatenate([prior, here])
            if len(pos):
                pos = ascending(pos)
                pos = pos[alive[pos]]
                new = self.rank(sym[pos], sym[after[pos]])
                ranks[pos] = new
                good = new < self.none
                if good.any():
                    add(new[good], pos[good])
        count = np.zeros(n + 1, np.int64)
        np.cumsum(alive, out=count[1:])
        return sym[alive], count[offs]

    def merge_by_rounds(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As merge, but every piece applies its own lowest rank once a round; for callers that need ids only."""
        ids, ends, piece = [], [], np.arange(len(offs) - 1)
        sym, size = self.letter[data].astype(np.int32), np.diff(offs)
        while len(piece):
            at = np.zeros(len(size) + 1, np.int64)
            np.cumsum(size, out=at[1:])
            rank = np.full(len(sym), self.none, np.int32)
            if len(sym) > 1:
                rank[:-1] = self.rank(sym[:-1], sym[1:])
            rank[at[1:] - 1] = self.none
            low = np.minimum.reduceat(rank, at[:-1])
            done = low == self.none
            here = np.repeat(low, size)
            out = np.repeat(done, size)
            ids.append(sym[out])
            ends.append(np.stack([piece[done], size[done]]))
            hit = (rank == here) & ~out
            pos = np.flatnonzero(hit)
            if len(pos):
                near = np.flatnonzero(np.append(True, pos[1:] != pos[:-1] + 1))
                place = np.arange(len(pos)) - np.repeat(near, np.diff(np.append(near, len(pos))))
                pos = pos[place % 2 == 0]
                sym[pos] = self.made[rank[pos]]
                out[pos + 1] = True
            left = ~out
            count = np.zeros(len(sym) + 1, np.int64)
            np.cumsum(left, out=count[1:])
            size = np.diff(count[at])[~done]
            sym, piece = sym[left], piece[~done]
        flat, order = np.concatenate(ids), np.concatenate(ends, axis=1)
        size = np.zeros(len(offs) - 1, np.int64)
        size[order[0]] = order[1]
        have = np.cumsum(order[1]) - order[1]
        start = np.zeros(len(size), np.int64)
        start[order[0]] = have
        first = np.append(0, np.cumsum(size))
        return flat[ranges(start, size)], first

    def encode(self, buf: np.ndarray, offs: np.ndarray, by_index: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that lie end to end as UTF-8, and the offset of each text's ids."""
        if self.special and any(x.encode() in memoryview(buf).tobytes() for x in self.special):
            return self._with_special(buf, offs, by_index)
        start, end, hashed = hashed_pieces(buf, offs)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        _, which, nth = np.unique(hashed, return_index=True, return_inverse=True)
        size = (end - start)[which]
        at = np.append(0, np.cumsum(size))
        data = buf[ranges(start[which], size)]
        ids, first = (self.merge if by_index else self.merge_by_rounds)(data, at)
        count = np.diff(first)[nth]
        total = np.append(0, np.cumsum(count))
        return ids[ranges(first[nth], count)], total[np.searchsorted(start, offs)]

    def _with_special(self, buf: np.ndarray, offs: np.ndarray, by_index: bool) -> tuple[np.ndarray, np.ndarray]:
        """Texts cut at the strings of special tokens; the parts between are texts of their own."""
        raw, cut = buf.tobytes(), regex.compile(self.cut.encode())
        parts, owner = [], []
        for i, (lo, hi) in enumerate(zip(offs.tolist(), offs[1:].tolist())):
            last = lo
            for m in cut.finditer(raw, lo, hi):
                parts += [raw[last : m.start()], m.group().decode()]
                last = m.end()
            parts.append(raw[last:hi])
            owner += [i] * (len(parts) - len(owner))
        plain = [b"" if isinstance(x, str) else x for x in parts]
        at = np.append(0, np.cumsum([len(x) for x in plain]))
        joined = np.frombuffer(b"".join(plain), np.uint8)
        start, end, hashed = hashed_pieces(joined, at)
        ids, first = np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        if len(start):
            _, which, nth = np.unique(hashed, return_index=True, return_inverse=True)
            size = (end - start)[which]
            got, where = (self.merge if by_index else self.merge_by_rounds)(joined[ranges(start[which], size)], np.append(0, np.cumsum(size)))
            count = np.diff(where)[nth]
            ids, first = got[ranges(where[nth], count)], np.append(0, np.cumsum(count))[np.searchsorted(start, at)]
        out, sizes = [], np.zeros(len(offs) - 1, np.int64)
        for k, x in enumerate(parts):
            got = np.array([self.special[x]], np.int32) if isinstance(x, str) else ids[first[k] : first[k + 1]]
            out.append(got)
            sizes[owner[k]] += len(got)
        return np.concatenate(out), np.append(0, np.cumsum(sizes))

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        data = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        try:
            data.decode()
        except UnicodeDecodeError:
            data = data.decode("utf-8", "replace").encode()
        return data


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] places, then the same of start[1], and so on."""
    total = np.cumsum(size)
    return np.repeat(start - (total - size), size) + np.arange(total[-1] if len(total) else 0)


def ascending(x: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])]


LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 4


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point in the pattern."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, what in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        out[[ord(c) for c in regex.findall(what, every)]] = kind
    return out


def pieces(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the pieces into which the pattern splits texts that lie end to end."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    kind = classes()[buf[lead]]
    wide = np.flatnonzero(buf[lead] >= 0xC2)
    if len(wide):
        cp = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        kind[wide] = classes()[cp[wide]]
    text = np.searchsorted(lead, offs)
    m = len(lead)
    fresh = np.ones(m, bool)
    fresh[1:] = kind[1:] != kind[:-1]
    edge = np.zeros(m + 1, bool)
    edge[text] = True
    fresh |= edge[:m]
    at = np.flatnonzero(fresh)
    end = np.append(at[1:], m)
    run = kind[at]
    b = buf[lead]
    # white space before something else gives its last character away: to what follows, or, unless a space, alone
    before = (run == BLANK) & ~edge[end]
    last = end[before] - 1
    fresh[last] = True
    space = b[last] == 0x20
    fresh[last[space] + 1] = False
    # an apostrophe that starts its run, takes no space and is followed by one of the endings
    tick = at[(run == OTHER) & (b[at] == 0x27) & (end - at == 1) & ~edge[end]]
    tick = tick[fresh[tick]]
    if len(tick):
        c = np.append(b, [0, 0])
        stop = np.append(edge, True)
        one, two = c[tick + 1], np.where(stop[np.minimum(tick + 2, m)], 0, c[np.minimum(tick + 2, m)])
        short = np.isin(one, list(b"stmd"))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for which, k in ((short, 2), (long, 3)):
            t = tick[which]
            fresh[t + 1] = False
            rest = t + k
            rest = rest[rest < m]
            fresh[rest] = True
    start = lead[fresh]
    return start, np.append(start[1:], n)


def hashed_pieces(buf: np.ndarray, offs: np.ndarray, limit: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the pieces, found a stretch of texts at a time to stay in the processor's cache."""
    out: list[tuple] = []
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        b = buf[offs[lo] : offs[hi]]
        s, e = pieces(b, offs[lo : hi + 1] - offs[lo])
        out.append((s + offs[lo], e + offs[lo], tn.word_hashes(b, s, e)))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


BATCH_BYTES = 24 << 20


def gathered(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of text, so that an index serves many rows."""
    have, size = [], 0
    for b in batches:
        for lo, hi, buf, _ in tn.chunks(b["text"], limit):
            have.append(b.slice(lo, hi - lo))
            size += len(buf)
            if size >= limit:
                yield pa.Table.from_batches(have).combine_chunks().to_batches()[0]
                have, size = [], 0
    if have:
        yield pa.Table.from_batches(have).combine_chunks().to_batches()[0]


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32()))])


def encode_decode(df: DataFrame, path: str | None = None, ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, digests of the ids and of the text decoded from them; with ids, the ids too."""
    path = path or default_vocabulary()
    schema = pa.schema([f for f in OUT if ids or f.name != "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for part in gathered(batches):
            found, at = vocab.encode(*tn.view(part["text"]))
            cols: dict = {"doc_id": part["doc_id"], "n_tokens": np.diff(at), "ids_sha256": [], "decoded_sha256": [], "ids": []}
            for i, j in zip(at.tolist(), at[1:].tolist()):
                a = found[i:j]
                cols["ids_sha256"].append(hashlib.sha256(decimals(a)).hexdigest())
                cols["decoded_sha256"].append(hashlib.sha256(vocab.decode(a)).hexdigest())
                if ids:
                    cols["ids"].append(a.astype(np.int32))
            yield batch(schema, cols)

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)


@lru_cache(maxsize=1)
def _decimal_strings() -> list[str]:
    return [str(i) for i in range(1 << 17)]


def decimals(ids: np.ndarray) -> bytes:
    return ",".join(map(_decimal_strings().__getitem__, ids.tolist())).encode()

