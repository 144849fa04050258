"""Byte-pair encoding with contiguous rank arrays.

Words of equal length are encoded together.  A matrix row holds the parts of
one word, a second matrix the ranks of adjacent parts; every step finds the
smallest rank of each row, deletes that boundary and refreshes the two
neighbouring ranks.  Every row that still has a merge loses exactly one
boundary in a step, so both matrices stay contiguous.
"""

from __future__ import annotations

import heapq
import json

import numpy as np

NONE = np.int32(2**31 - 1)
#: Longer words go through a heap, whose time is n log n instead of n squared.
SHORT = 128
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    letters = dict(zip(plain, map(chr, plain))) | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Ranks:
    """Merge ranks of a tokenizer file, with lookups for arrays of pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        suffix = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for t, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = t
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        self.unletter = {c: b for b, c in enumerate(letters)}
        left = np.array([vocab[a] for a, _ in merges], np.uint64)
        right = np.array([vocab[b] for _, b in merges], np.uint64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.pairs = {(int(a), int(b)): r for r, (a, b) in enumerate(zip(left, right))}
        # open addressing, at most a quarter full
        bits = max(10, (4 * len(merges)).bit_length())
        self._shift, self._slots = np.uint64(64 - bits), 1 << bits
        self._keys = np.full(self._slots, np.iinfo(np.uint64).max, np.uint64)
        self._rank = np.full(self._slots, NONE, np.int32)
        for r, key in enumerate(((left << np.uint64(32)) | right).tolist()):
            at = ((key * int(_SPREAD)) & (2**64 - 1)) >> (64 - bits)
            while self._rank[at] != NONE:
                at = (at + 1) % self._slots
            self._keys[at], self._rank[at] = key, r

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair (NONE where there is no merge)."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = ((key * _SPREAD) >> self._shift).astype(np.int64)
        out = self._rank[at]
        open_ = np.flatnonzero((out != NONE) & (self._keys[at] != key))
        while len(open_):
            at[open_] = (at[open_] + 1) % self._slots
            out[open_] = self._rank[at[open_]]
            open_ = open_[(out[open_] != NONE) & (self._keys[at[open_]] != key[open_])]
        return out

    def encode_short(self, raw: np.ndarray):
        """Yield (row numbers, id matrix) for the words in a byte matrix of one length."""
        parts = self.first[raw]
        parts[:, -1] = self.last[raw[:, -1]]
        rows = np.arange(len(raw))
        n, width = parts.shape
        ranks = self.of(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, width - 1)
        while width > 1 and len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            live = best != NONE
            if not live.all():
                yield rows[~live], parts[~live]
                rows, parts, ranks, at, best = rows[live], parts[live], ranks[live], at[live], best[live]
                if not len(rows):
                    return
            k = np.arange(len(rows))
            parts[k, at] = self.made[best]
            step = np.arange(width - 1)
            parts = np.take_along_axis(parts, step + (step > at[:, None]), axis=1)
            step = np.arange(width - 2)
            ranks = np.take_along_axis(ranks, step + (step >= at[:, None]), axis=1)
            width -= 1
            for side in (at - 1, at):  # the pairs that now touch the new part
                ok = np.flatnonzero((side >= 0) & (side < width - 1))
                ranks[ok, side[ok]] = self.of(parts[ok, side[ok]], parts[ok, side[ok] + 1])
        if len(rows):
            yield rows, parts

    def encode_long(self, word: bytes) -> list[int]:
        """The same merges, smallest rank and then leftmost first, over a linked list."""
        parts = [*self.first[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.last[word[-1]])]
        n = len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1)
                if (r := self.pairs.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k]
            if parts[k] != a or j >= n or parts[j] != b:
                continue
            parts[k], parts[j] = int(self.made[r]), -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for x in (before[k], k):
                y = after[x] if x >= 0 else n
                if y < n and (s := self.pairs.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (s, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        out: list[list[int]] = [[] for _ in words]
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for length, at in by_length.items():
            if length > SHORT:
                for k in at:
                    out[k] = self.encode_long(words[k])
            elif length:
                raw = np.frombuffer(b"".join([words[k] for k in at]), np.uint8).reshape(-1, length)
                for rows, ids in self.encode_short(raw):
                    for k, got in zip(rows.tolist(), ids.tolist()):
                        out[at[k]] = got
        return out

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Number of ids of each word."""
        out = np.zeros(len(words), np.int64)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for length, at in by_length.items():
            if length > SHORT:
                out[at] = [len(self.encode_long(words[k])) for k in at]
            elif length:
                where = np.array(at)
                raw = np.frombuffer(b"".join([words[k] for k in at]), np.uint8).reshape(-1, length)
                for rows, ids in self.encode_short(raw):
                    out[where[rows]] = ids.shape[1]
        return out


_LOADED: dict[str, Ranks] = {}


def ranks(path: str) -> Ranks:
    """The ranks of a tokenizer file, read once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Ranks(path)
    return _LOADED[path]
