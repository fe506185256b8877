"""Vectorised splitting of whole Arrow text columns into hashed words.

All texts of a block are handled as one byte vector: separators and case come from 256-entry
tables, and a word's 64-bit hash is the difference of two prefix sums of a polynomial modulo
2**64, so no Python code runs per word. Blocks hold whole texts and about BLOCK bytes; one text
longer than that is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_PIECE = 1 << 14
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACES = (0x20, *range(0x09, 0x0E))


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def space_table() -> np.ndarray:
    """True for the bytes of words [^\\x20\\x09-\\x0D]+."""
    table = np.ones(256, dtype=bool)
    table[list(_SPACES)] = False
    return table


_LOWER, _INWORD = lower_table(), space_table()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with good avalanche on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, exponents 0..n-1."""
    global _powers
    up, down = _powers
    if len(up) < n:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(down, out=down)
        if n <= 16 * BLOCK:
            _powers = up, down
    return up, down


@dataclass
class Words:
    """Words of a block of texts: hash, start and end byte (in data), and first word of each text."""

    data: np.ndarray  # lower-cased bytes
    offsets: np.ndarray  # byte offsets of the texts, one more than texts
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # word index where each text begins, one more than texts


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive whole texts."""
    data, offsets = utf8(column)
    n, a = len(column), 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def split(data: np.ndarray, offsets: np.ndarray, inword: np.ndarray = _INWORD, lower: np.ndarray = _LOWER) -> Words:
    raw = data.tobytes().translate(lower.tobytes())
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64))
    inside = np.frombuffer(raw.translate(inword.tobytes()), bool)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[offsets < n]
    begins[edges] = inside[edges]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:]
    last = offsets[(offsets > 0) & (offsets <= n)] - 1
    finishes[last] = inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    up, down = _powers_to(n)
    sums = np.zeros(n + 1, np.uint64)
    for i in range(0, n, _PIECE):  # pieces that stay in the cache
        own = sums[i + 1 : i + 1 + _PIECE]
        np.add(data[i : i + _PIECE], np.uint64(1), out=own)
        own *= up[i : min(i + _PIECE, n)]
        own[:1] += sums[i : i + 1]
        np.cumsum(own, out=own)
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(data, offsets, hashes, starts, ends, np.searchsorted(starts, offsets))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The hashes that split() gives these words, none of them empty."""
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return split(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], ends]), np.ones(256, bool), np.arange(256, dtype=np.uint8)).hashes


def word_hash(word: bytes) -> int:
    """The hash that split() gives this word."""
    return int(word_hashes([word])[0])
