"""Sets of five-word shingles as sorted 64-bit hashes, for whole Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from kirana.llm.common import mix64, utf8

WORDS = 5
#: Bytes of text worked on at once (a longer text is a slice of its own).
SLICE = 1 << 21

_rng = np.random.default_rng(20240501)
_LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_LETTER[[9, 10, 11, 12, 13, 32]] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_PLACE = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0xD1342543DE82EF95)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or of one text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end
        first = end


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and, for each text, the number of the first word (length + 1)."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = _LOWER[raw]
    inside = _IS_WORD[low]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[heads] = inside[heads]
    at = np.flatnonzero(starts)
    first = np.searchsorted(at, offsets)
    if not len(at):
        return np.zeros(0, np.uint64), first
    length = np.diff(at, append=len(raw))
    place = np.arange(len(raw)) - np.repeat(at, length) if at[0] == 0 else np.concatenate([np.zeros(at[0], np.int64), np.arange(at[0], len(raw)) - np.repeat(at, length)])
    value = _LETTER[low] * _powers(int(length.max()) + int(at[0]) + 1)[place]
    letters = np.add.reduceat(inside, at, dtype=np.int64).astype(np.uint64)
    return mix64(np.add.reduceat(value, at) + letters * _LENGTH), first


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, repeats included, and where each text's begin (length + 1)."""
    word, first = words(raw, offsets)
    n = np.diff(first)
    many = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(many)])
    padded = np.concatenate([word, np.zeros(WORDS, np.uint64)])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], many)
    short = np.repeat(np.where(n < WORDS, n, WORDS), many)
    out = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        out += np.where(k < short, padded[at + k] * _PLACE[k], np.uint64(0))
    return mix64(out + short.astype(np.uint64)), begin


def sets(column: pa.Array) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    raw, offsets = utf8(column)
    out: list[np.ndarray] = []
    for a, z in slices(offsets):
        got, begin = shingles(raw[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a])
        out += [np.unique(got[begin[k]:begin[k + 1]]) for k in range(z - a)]
    return out
