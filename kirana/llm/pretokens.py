"""Pre-tokens of byte-level files for whole Arrow columns: boundaries by array operations over bytes.

Covers texts of the characters that ``split.RARE`` leaves and without the first letters
of a special token; all others are left to the tokenizer file's own rules.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from kirana.llm.common import mix64, utf8
from kirana.llm.shingles import slices
from kirana.llm.split import _LETTER, _NUMBER, _SPACE, RARE, Splitter

_L, _N, _S, _MARK, _RARE = range(5)
_TOP = 0x3000


def _classes() -> np.ndarray:
    kinds = [(re.compile(RARE.pattern), _RARE), (re.compile(_LETTER), _L), (re.compile(_NUMBER), _N), (re.compile(f"[{_SPACE}]"), _S)]
    return np.array([next((k for p, k in kinds if p.match(chr(c))), _MARK) for c in range(_TOP)] + [_RARE], np.uint8)


_CLASS = _classes()
_rng = np.random.default_rng(20240803)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE, _LENGTH = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B185EBCA87)


def _points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each character begins, and its code point (the top of the table for four bytes)."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    first = raw[at]
    point = first.astype(np.int32)
    many = np.flatnonzero(first >= 0xC0)
    lead = point[many]
    one = raw[np.minimum(at[many] + 1, len(raw) - 1)].astype(np.int32) & 0x3F
    two = raw[np.minimum(at[many] + 2, len(raw) - 1)].astype(np.int32) & 0x3F
    point[many] = np.where(lead < 0xE0, (lead & 0x1F) << 6 | one, np.where(lead < 0xF0, (lead & 0x0F) << 12 | one << 6 | two, _TOP))
    return at, point


def boundaries(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which pieces begin, and whether a text holds a rare character."""
    at, point = _points(raw)
    kind = _CLASS[np.minimum(point, _TOP)]
    heads = np.searchsorted(at, offsets)
    seen = np.concatenate([[0], np.cumsum(kind == _RARE)])
    rare = seen[heads[1:]] > seen[heads[:-1]]
    n = len(at)
    new = np.zeros(n + 1, bool)
    new[heads] = True
    space, blank = kind == _S, point == 32
    differs = np.ones(n, bool)
    differs[1:] = kind[1:] != kind[:-1]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    before_word = np.zeros(n, bool)  # the next character is of the same text and no white space
    before_word[:-1] = ~space[1:] & ~new[1:n]
    start = new[:n] | np.where(space, differs | before_word, differs & ~after_blank)
    # contractions: an apostrophe that begins a piece takes one or two letters with it
    quote = np.flatnonzero(start & (point == 39))
    padded = np.concatenate([point, np.zeros(3, np.int32)])
    ends = np.concatenate([new, np.ones(3, bool)])
    a, b = padded[quote + 1], padded[quote + 2]
    here = ~ends[quote + 1]
    pair = here & ~ends[quote + 2] & ((b == ord("e")) & ((a == ord("r")) | (a == ord("v"))) | (b == ord("l")) & (a == ord("l")))
    one = here & np.isin(a, [ord(c) for c in "stmd"])
    took = np.where(one, 1, np.where(pair, 2, 0))
    quote, took = quote[took > 0], took[took > 0]
    start[quote + 1] = False
    follow = quote + took + 1
    start[follow[follow < n]] = True
    return at[start], rare


class Frequencies:
    """Frequencies of pre-tokens and numbers of special tokens for batches of texts."""

    def __init__(self, split: Splitter):
        self.split = split
        self.marks = [m.encode()[:2] for m in split.marks]

    def _apart(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that may hold a special token."""
        out = np.zeros(len(offsets) - 1, bool)
        for m in self.marks:
            hit = raw == m[0]
            if len(m) > 1:
                hit = hit[:-1] & (raw[1:] == m[1])
            out[np.searchsorted(offsets, np.flatnonzero(hit), "right") - 1] = True
        return out

    def _by_library(self, text: str) -> tuple[Counter, int]:
        out: Counter = Counter()
        parts = self.split.parts(text)
        for part in parts[::2]:
            out.update(p.decode() for p in self.split.by_library(part))
        return out, len(parts) // 2

    def of(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]]:
        """For slices [a, z) of a column: where each text's entries begin in (numbers of pieces, times), the pieces, and each text's special tokens."""
        raw, offsets = utf8(column)
        for a, z in slices(offsets):
            yield a, z, *self._slice(column.slice(a, z - a), raw[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a])

    def _slice(self, column: pa.Array, raw: np.ndarray, offsets: np.ndarray):
        many = len(offsets) - 1
        begin, rare = boundaries(raw, offsets) if len(raw) else (np.zeros(0, np.int64), np.zeros(many, bool))
        rare |= self._apart(raw, offsets)
        length = np.diff(begin, append=len(raw))
        doc = np.searchsorted(offsets, begin, "right") - 1
        if len(begin):
            power = np.full(int(length.max()), _BASE, np.uint64)
            power[0] = 1
            value = _BYTE[raw] * np.multiply.accumulate(power)[np.arange(len(raw)) - np.repeat(begin, length)]
            code = mix64(np.add.reduceat(value, begin) + length.astype(np.uint64) * _LENGTH)
        else:
            code = np.zeros(0, np.uint64)
        keep = ~rare[doc]
        begin, length, doc, code = begin[keep], length[keep], doc[keep], code[keep]
        _, one, which = np.unique(code, return_index=True, return_inverse=True)
        pair, times = np.unique(doc * max(1, len(one)) + which, return_counts=True)
        doc, which = np.divmod(pair, max(1, len(one)))
        size = length[one]
        ends = np.concatenate([[0], np.cumsum(size)])
        letters = raw[np.arange(ends[-1]) + np.repeat(begin[one] - ends[:-1], size)]
        words = pa.StringArray.from_buffers(len(one), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(letters)))
        pieces, special = words.to_pylist(), np.zeros(many, np.int64)
        if rare.any():  # their pieces come behind, then all are put in order of their text
            more_doc, more, more_times = [], [], []
            for k in np.flatnonzero(rare).tolist():
                found, special[k] = self._by_library(column[k].as_py())
                more_doc += [k] * len(found)
                more += found.keys()
                more_times += found.values()
            doc = np.concatenate([doc, np.array(more_doc, np.int64)])
            which = np.concatenate([which, len(pieces) + np.arange(len(more))])
            times = np.concatenate([times, np.array(more_times, np.int64)])
            order = np.argsort(doc, kind="stable")
            doc, which, times = doc[order], which[order], times[order]
            pieces += more
        return np.searchsorted(doc, np.arange(many + 1)), which, times, pieces, special
