"""Tokens and objects of PDF syntax."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple


class Name(str):
    """A PDF name, without its slash."""


class Op(str):
    """A keyword or an operator."""


class Ref(NamedTuple):
    num: int
    gen: int


class Stream:
    """A dictionary with the bytes that follow it, as stored."""

    def __init__(self, entries: dict, raw: bytes):
        self.entries, self.raw = entries, raw


BLANK = b"\x00\t\n\x0c\r "
GAP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
NAME = re.compile(rb"/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*)")
WORD = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
HEXES = re.compile(rb"<([^>]*)>?")
LITERAL = re.compile(rb"[()\\]")
ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
REFERENCE = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
# What most tokens are: a number; a literal without brackets and escapes; a word; a name without escapes.
TOKEN = re.compile(rb"[\x00\t\n\x0c\r ]*(?:([+-]?(?:\d+\.?\d*|\.\d+))|\(([^()\\]*)\)|([A-Za-z'\"][^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|/([^\x00\t\n\x0c\r ()<>\[\]{}/%#]*+)(?!#))")
END = object()
CLOSE_ARRAY, CLOSE_DICT = Op("]"), Op(">>")
DEEPEST = 200


def hex_bytes(text: bytes) -> bytes:
    """Bytes of hexadecimal digits, other characters skipped; an odd last digit counts as its byte's first half."""
    if len(text) % 2 == 0 and text.isalnum():
        try:
            return bytes.fromhex(text.decode())
        except ValueError:
            pass
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", text)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


WORDS = {"true": True, "false": False, "null": None}


@lru_cache(maxsize=4096)
def word_of(raw: bytes):
    word = raw.decode("latin-1")
    return WORDS.get(word, Op(word))


@lru_cache(maxsize=4096)
def name_of(raw: bytes) -> Name:
    return Name(raw.decode("latin-1"))


class Scanner:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = GAP.match(self.data, self.at).end()

    def _literal(self) -> bytes:
        out, depth, at = bytearray(), 1, self.at + 1
        while True:
            m = LITERAL.search(self.data, at)
            if not m:
                out += self.data[at:]
                self.at = len(self.data)
                return bytes(out)
            out += self.data[at : m.start()]
            c, at = m.group(), m.end()
            if c == b"(":
                depth += 1
                out += c
            elif c == b")":
                depth -= 1
                if not depth:
                    self.at = at
                    return bytes(out)
                out += c
            else:
                octal = re.compile(rb"[0-7]{1,3}").match(self.data, at)
                if octal:
                    out.append(int(octal.group(), 8) & 255)
                    at = octal.end()
                    continue
                c = self.data[at : at + 1]
                if c in (b"\r", b"\n"):
                    at += 2 if self.data[at : at + 2] == b"\r\n" else 1
                else:
                    out += ESCAPED.get(c, c)
                    at += 1

    def value(self, refs: bool = True, depth: int = 0):
        """The next object or operator; END at the end. Every call moves on by a byte at least."""
        m = TOKEN.match(self.data, self.at)
        if m:
            kind = m.lastindex
            raw = m[kind]
            if kind == 1:
                if refs and (ref := REFERENCE.match(self.data, m.start(1))):
                    self.at = ref.end()
                    return Ref(int(ref[1]), int(ref[2]))
                self.at = m.end()
                return float(raw) if b"." in raw else int(raw)
            self.at = m.end()
            return bytes(raw) if kind == 2 else word_of(raw) if kind == 3 else name_of(raw)
        self.skip()
        data, at = self.data, self.at
        if at >= len(data):
            return END
        c = data[at]
        if c == 0x28:
            return self._literal()
        if c == 0x2F:
            m = NAME.match(data, at)
            self.at = m.end()
            raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[1])
            return Name(raw.decode("utf-8", "surrogateescape") if raw.isascii() else raw.decode("latin-1"))
        if c == 0x3C:
            if data[at + 1 : at + 2] == b"<":
                self.at += 2
                return self._dict(refs, depth)
            m = HEXES.match(data, at)
            self.at = m.end()
            return hex_bytes(m[1])
        if c == 0x5B:
            self.at += 1
            out = []
            while (x := self.value(refs, depth + 1) if depth < DEEPEST else END) is not END and x is not CLOSE_ARRAY:
                out.append(x)
            return out
        if refs and 0x30 <= c <= 0x39 and (m := REFERENCE.match(data, at)):
            self.at = m.end()
            return Ref(int(m[1]), int(m[2]))
        if m := NUMBER.match(data, at):
            self.at = m.end()
            return float(m.group()) if b"." in m.group() else int(m.group())
        if m := WORD.match(data, at):
            self.at = m.end()
            word = m.group().decode("latin-1")
            return WORDS.get(word, Op(word))
        if c == 0x5D:
            self.at += 1
            return CLOSE_ARRAY
        if data[at : at + 2] == b">>":
            self.at += 2
            return CLOSE_DICT
        self.at += 1  # a stray bracket
        return Op(chr(c))

    def _dict(self, refs: bool, depth: int) -> dict:
        out: dict = {}
        while depth < DEEPEST:
            key = self.value(refs, depth + 1)
            if key is END or key is CLOSE_DICT:
                break
            if not isinstance(key, Name):
                continue
            x = self.value(refs, depth + 1)
            if x is END or x is CLOSE_DICT:
                break
            out[str(key)] = x
        return out


def number(x) -> float:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else 0.0


def matmul(a: list[float], b: list[float]) -> list[float]:
    """The affine map a, then b."""
    return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]]


def apply(m: list[float], x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


IDENTITY = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
