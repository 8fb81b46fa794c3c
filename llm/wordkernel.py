"""Vectorised word handling for operators that work on Arrow batches.

Texts are joined into one byte array, worked on in pieces of bounded size, and
words are found and hashed for all texts of a piece at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Bytes of text worked on at once; one longer text is a piece of its own.
PIECE = 1 << 21
#: Words longer than this are hashed one by one with a cryptographic function.
LONG_WORD = 256

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    values = values ^ (values >> np.uint64(30))
    values = values * _MIX1
    values = values ^ (values >> np.uint64(27))
    values = values * _MIX2
    return values ^ (values >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        base_inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        size = max(n, PIECE + 4096)
        steps = np.ones(size, np.uint64)
        steps[1:] = _BASE
        _powers = np.cumprod(steps)
        steps[1:] = base_inverse
        _inverse = np.cumprod(steps)
    return _powers, _inverse


def digest64(data: bytes) -> int:
    """64-bit hash of a byte string."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` holding about PIECE bytes each, at least one text."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > PIECE:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".,;:!?")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts.

    ``start`` and ``end`` are byte positions in ``raw``; the words of text ``i``
    are ``bounds[i]:bounds[i + 1]``; ``code`` holds 64-bit hashes. With ``parted``
    a single mark of ``.,;:!?`` at a word's end, after an ASCII letter, is a word of its own.
    """

    def __init__(self, texts: list[bytes], lower: bool, parted: bool = False):
        joined = b"\n".join(texts) + b"\n"
        self.bytes = joined.translate(LOWER.tobytes()) if lower else joined
        self.raw = raw = np.frombuffer(self.bytes, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_end = np.cumsum(lengths)
        inside = ~SPACE[raw]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        self.start, self.end = edge[0::2], edge[1::2]
        if parted and len(self.start):
            closing = (self.end - self.start > 1) & _CLOSING[raw[self.end - 1]] & _LETTER[raw[self.end - 2]]
            at = np.flatnonzero(closing) + 1
            self.start = np.insert(self.start, at, self.end[closing] - 1)
            stem = np.flatnonzero(closing) + np.arange(len(at))
            self.end = np.insert(self.end, at, self.end[closing])
            self.end[stem] -= 1
        self.bounds = np.concatenate(([0], np.searchsorted(self.start, self.text_end)))
        self.code = span_codes(self.bytes, self.start, self.end)


def span_codes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges ``start[i]:end[i]`` of ``data``."""
    raw = np.frombuffer(data, np.uint8)
    powers, inverse = _power_tables(len(raw) + 1)
    terms = BYTE_CODE[raw]
    terms *= powers[: len(raw)]
    sums = np.empty(len(terms) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(terms, out=sums[1:])
    codes = (sums[end] - sums[start]) * inverse[start]
    codes = mix(codes ^ (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG_WORD):
        codes[i] = digest64(data[start[i] : end[i]])
    return codes


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive codes of one text."""
    n = len(codes) - size + 1
    if n <= 0:
        return codes[:0]
    out = codes[:n].copy()
    for k in range(1, size):
        out = mix(out + _BASE) ^ codes[k : k + n]
    return mix(out)
