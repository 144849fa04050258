"""Cutting texts into the pieces that byte-pair encoding works on.

Texts of common characters take a fast path over ``re``; any other text goes
through the tokenizer file's own normaliser and splitter, so that the rules
for rare characters are the library's.
"""

from __future__ import annotations

import re

from kirana.llm.bpe import Ranks, ranks

#: Up to U+024F there are no combining marks, so NFC changes nothing, and
#: lower-casing does not depend on the neighbours.  The separators U+001C to
#: U+001F are left out because str.split and the tokenizers differ on them.
RARE = re.compile("[^\t-\r\x00-\x08\x0e-\x1b\x20-ɏ‐-‧€]")
_OTHER_NUMBERS = "\xb2\xb3\xb9\xbc-\xbe"
_LETTER = rf"[^\W\d_{_OTHER_NUMBERS}]"
_NUMBER = rf"[\d{_OTHER_NUMBERS}]"
_SPACE = "\t-\r \x85\xa0"
_MARK = rf"(?:_|[^\w{_SPACE}])"
_CONTRACTION = "'s|'t|'re|'ve|'m|'ll|'d"
WORD_PIECE = re.compile(rf"{_CONTRACTION}|{_LETTER}+|{_NUMBER}|{_MARK}+")
BYTE_PIECE = re.compile(rf"{_CONTRACTION}| ?{_LETTER}+| ?{_NUMBER}+| ?{_MARK}+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: White space for which cutting at single spaces could change the pieces.
ODD_SPACE = re.compile("[\t\x0b-\r\x85\xa0]")


class Splitter:
    """Splits texts as one tokenizer file does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.ranks: Ranks = ranks(path)
        self.lowers = self.library.normalizer is not None
        specials = sorted(self.ranks.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")")
        self.marks = [s[:2] for s in specials]

    def parts(self, text: str) -> list[str]:
        """The text cut at special tokens, which stand at odd places."""
        if any(m in text for m in self.marks):
            return self.special.split(text)
        return [text]

    def by_library(self, part: str) -> list[bytes]:
        if self.library.normalizer is not None:
            part = self.library.normalizer.normalize_str(part)
        back = self.ranks.unletter
        return [bytes([back[c] for c in piece]) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]


def byte_chunks(part: str) -> list[str]:
    """Chunks of a common text whose pieces, one chunk after the other, are those
    of the text: cut before each space that stands between other characters."""
    if ODD_SPACE.search(part) or "  " in part or "\n\n" in part or " \n" in part or "\n " in part:
        return [part]
    first, *rest = part.split(" ")
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


_LOADED: dict[str, Splitter] = {}


def splitter(path: str) -> Splitter:
    if path not in _LOADED:
        _LOADED[path] = Splitter(path)
    return _LOADED[path]
