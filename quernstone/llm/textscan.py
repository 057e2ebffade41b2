"""Vectorised word scanning of Arrow string columns.

A word is a maximal run of letters, digits and other signs of the lower-cased text; ASCII punctuation, and the blanks,
quotation marks, dashes and other punctuation of SEPARATORS, part words, and each character of LONE (kana and ideographs,
which are written without blanks) is a word of its own. scan() has another kind of word too. Words are represented by 64-bit polynomial hashes, computed for a whole
chunk of documents at once, so that no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in one chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 256 << 10

BASE = 0x9E3779B97F4A7C55
MASK = (1 << 64) - 1
WORD = np.zeros(256, np.bool_)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    WORD[_c] = True
WORD[128:] = True
BLANK = np.zeros(256, np.bool_)
BLANK[list(b" \t\n\v\f\r")] = True

#: Ranges of characters beyond ASCII that part words, that are blanks, and that are words of their own.
SEPARATORS = ((0x80, 0xA9), (0xAB, 0xB1), (0xB4, 0xB4), (0xB6, 0xB8), (0xBB, 0xBB), (0xBF, 0xBF), (0x2000, 0x206F), (0x3000, 0x3004), (0x3008, 0x303F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20))
BLANKS = ((0x85, 0x85), (0xA0, 0xA0), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
LONE = ((0x3040, 0x9FFF),)


def _table(ranges: tuple[tuple[int, int], ...]) -> np.ndarray:
    out = np.zeros(1 << 16, np.bool_)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


_SEPARATOR, _BLANK, _LONE = _table(SEPARATORS), _table(BLANKS), _table(LONE)


def wide(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, number of bytes, code point) of the characters of two or three bytes that may be in one of the tables."""
    two = np.flatnonzero(data == 0xC2)
    three = np.flatnonzero((data == 0xE2) | ((data >= 0xE3) & (data <= 0xE9)) | (data == 0xEF))
    low = lambda at: data[at].astype(np.int64) & 0x3F
    code = np.concatenate([0x80 | low(two + 1), (data[three].astype(np.int64) & 15) << 12 | low(three + 1) << 6 | low(three + 2)])
    return np.concatenate([two, three]), np.repeat([2, 3], [len(two), len(three)]), code


def word_class(form: str) -> str:
    """Regular expression of a word, code points being written as form.format(hexadecimal)."""
    parts, at = [], 0x80
    for a, b in sorted((*SEPARATORS, *LONE)):
        if at < a:
            parts.append((at, a - 1))
        at = b + 1
    parts.append((at, 0x10FFFF))
    span = lambda a, b: form.format(f"{a:08X}") + "-" + form.format(f"{b:08X}")
    return "[" + "".join(span(*x) for x in LONE) + "]|[a-z0-9" + "".join(span(*x) for x in parts) + "]+"


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n) modulo 2**64, kept for the life of the process."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(1 << 12, 1 << (n + 1).bit_length())
        step = np.full(size, base & MASK, np.uint64)
        step[0] = 1
        have = _powers[base] = np.multiply.accumulate(step)
    return have


INVERSE = pow(BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of a chunk: byte ranges in data, hashes, and ptr, the documents' ranges of words (CSR)."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    ptr: np.ndarray

    @property
    def docs(self) -> np.ndarray:
        """The document index of each word."""
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def strings(column: pa.Array | pa.ChunkedArray, lower: bool = True) -> pa.Array:
    """The column as one string array, nulls as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.utf8_lower(column) if lower else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large_string array and its offsets, the first being 0."""
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes of text, or of one row."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to


def scan(column: pa.Array, hashes: bool = True, stem: int = 0, spaced: bool = False) -> Words:
    """Words of a large_string array that strings() made; with stem, hashes are of their first stem bytes only.

    With spaced, words are what stands between white space, as people count them (and each character of LONE); their
    hashes pass over all bytes that are in no other kind of word, and are equal for all words of nothing but such signs.
    """
    data, offsets = raw(column)
    n = len(data)
    inside = WORD[data]
    word = ~BLANK[data] if spaced else inside
    apart = np.zeros(0, np.int64)
    if (data > 127).any():
        at, size, code = wide(data)
        for k in range(3):
            there = size > k
            inside[at[there & _SEPARATOR[code]] + k] = False
            if spaced:
                word[at[there & _BLANK[code]] + k] = False
        lone = at[_LONE[code]]
        apart = np.concatenate([lone, lone + 3])
        apart = apart[(apart > 0) & (apart < n)]
    before, after = np.empty(n, np.bool_), np.empty(n, np.bool_)
    if n:
        before[0], before[1:] = False, word[:-1]
        after[-1], after[:-1] = False, word[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges], after[edges - 1] = False, False
        before[apart], after[apart - 1] = False, False
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    ptr = np.searchsorted(start, offsets)
    h = np.zeros(0, np.uint64)
    if hashes and len(start) and spaced:
        before = np.concatenate(([0], np.cumsum(inside)))
        inner = data[inside]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((inner.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(inner))[: len(inner)])))
        h = mix((total[before[end]] - total[before[start]]) * powers(INVERSE, len(inner))[before[start]])
    elif hashes and len(start):
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n)[:n], out=total[1:])
        upto = np.minimum(end, start + stem) if stem else end
        h = mix((total[upto] - total[start]) * powers(INVERSE, n)[start])
    return Words(data, offsets, start, end, h, ptr)


GRAM = 0xD1342543DE82EF95
GRAM_INVERSE = pow(GRAM, -1, 1 << 64)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of size consecutive words, over the whole chunk; index i is the window of words i .. i+size-1."""
    n = len(h)
    if n < size:
        return np.zeros(0, np.uint64)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(h * powers(GRAM, n)[:n], out=total[1:])
    return mix((total[size:] - total[:-size]) * powers(GRAM_INVERSE, n)[: n - size + 1])


def starts(ptr: np.ndarray, size: int) -> np.ndarray:
    """Word indices at which a window of size words lies within one document."""
    n = int(ptr[-1])
    if n < size:
        return np.zeros(0, np.int64)
    ends = np.repeat(ptr[1:], np.diff(ptr))[: n - size + 1]
    return np.flatnonzero(np.arange(n - size + 1) + size <= ends)
