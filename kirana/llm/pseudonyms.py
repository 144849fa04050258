"""Format-preserving pseudonyms for personal data (operator 4).

Card numbers (Luhn), social security numbers, phone numbers, IPv4 addresses,
dates and e-mail addresses are found and validated; each value is permuted
within its own format by a keyed Feistel network, so that equal values stay
equal in all documents and the pseudonym passes the same validation.  A value is a
number in a mixed radix (digits, letters, days); the network works on the bits
of that range and walks its cycle until it is inside again.

Formats: dates of 1900 to 2099 as 1987-02-28 (also before a time, T10:00), 28/02/1987,
28.02.1987 or, where only that is a date, 02/28/1987 and 02.28.1987; phones as +1 (017) 555-7713
with single spaces or hyphens, or (555) 123-4567 and 555-123-4567 with an area from 200;
social security numbers with hyphens only, as nine plain digits may be any number; IPv4 and
e-mail addresses.  Card numbers are whole digit groups with single spaces or hyphens between; in a run of
groups every span of 13 to 19 digits is tried, the longer first, then the earlier.

Defined results: null and empty texts hold nothing and come back as "";
repeated rows and null keys return a row each; an empty table returns no rows;
other columns are not read.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from kirana.llm.common import prepare, texts

KEY = b"public demonstration key"
ROUNDS = 8
_FIRST, _DAYS = dt.date(1900, 1, 1).toordinal(), 73049
_PLAIN = (
    r"(?<![\w-])(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2})(?:(?=T[0-9]{2}:[0-9]{2})|(?![\w-]))"
    r"|(?<![\w./-])(?P<day>[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\w/-]|\.\d)"
    r"|(?<![\w-])(?P<local>\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![\w-])"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])")
PLAIN = re.compile(_PLAIN)
FOUND = re.compile(
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?<![\w.])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?![\w]|\.\d)"
    rf"|{_PLAIN}"
    r"|(?<!\w)(?P<phone>\+\d{1,3} ?\(?\d{2,4}\)?(?:[ -]?\d{3,4}){2})(?!\w)"
    r"|(?<![\w-])(?P<card>(?=(?:[ -]?[0-9]){13})[0-9]+(?:[ -][0-9]+)*)(?![\w-])")
#: Digits of a card number.
CARD = range(13, 20)


def permute(value: int, size: int, name: str, key: bytes = KEY) -> int:
    """A keyed permutation of range(size)."""
    if size < 2:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for k in range(ROUNDS):
            mixed = hashlib.blake2b(f"{name}:{size}:{k}:{right}".encode(), key=key, digest_size=16).digest()
            left, right = right, left ^ (int.from_bytes(mixed, "big") & mask)
        value = (left << half) | right
        if value < size:
            return value


def _symbols(text: str, name: str, key: bytes) -> str:
    """Digits stay digits, letters stay letters of their case, anything else stays."""
    kinds = [("0", 10) if "0" <= c <= "9" else ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else ("", 1) for c in text]
    value, size = 0, 1
    for c, (base, radix) in zip(text, kinds):
        value, size = value * radix + (ord(c) - ord(base) if base else 0), size * radix
    value, out = permute(value, size, name + re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", text))), key), []
    for c, (base, radix) in zip(reversed(text), reversed(kinds)):
        value, digit = divmod(value, radix)
        out.append(chr(ord(base) + digit) if base else c)
    return "".join(reversed(out))


def luhn_digit(payload: str) -> str:
    total = sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(payload)))
    return str(-total % 10)


def _like(form: str, digits: str) -> str:
    """The digits in place of those of a form."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in form)


def pseudonym(kind: str, value: str, key: bytes = KEY) -> str | None:
    """The pseudonym of a value, or None where it is not valid."""
    digits = "".join(c for c in value if "0" <= c <= "9")
    if kind == "card":
        if luhn_digit(digits[:-1]) != digits[-1]:
            return None
        body = _symbols(digits[:-1], kind, key)
        return _like(value, body + luhn_digit(body))
    if kind == "ip":
        parts = [int(p) for p in value.split(".")]
        if max(parts) > 255:
            return None
        number = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, kind, key)
        return ".".join(str(b) for b in number.to_bytes(4, "big"))
    if kind == "date":
        try:
            day = dt.date.fromisoformat(value).toordinal() - _FIRST
        except ValueError:
            return None
        return dt.date.fromordinal(_FIRST + permute(day, _DAYS, kind, key)).isoformat() if 0 <= day < _DAYS else None
    if kind == "day":
        first, second, year = int(value[:2]), int(value[3:5]), int(value[6:])
        # day first; month first only where the day shows it, and then it goes on to show it
        swapped = second > 12
        try:
            day = dt.date(year, *((first, second) if swapped else (second, first))).toordinal() - _FIRST
        except ValueError:
            return None
        if not 0 <= day < _DAYS:
            return None
        day = permute(day, _DAYS, "date", key)
        while swapped and dt.date.fromordinal(_FIRST + day).day <= 12:
            day = permute(day, _DAYS, "date", key)
        got = dt.date.fromordinal(_FIRST + day)
        return _like(value, f"{got.month:02d}{got.day:02d}{got.year}" if swapped else f"{got.day:02d}{got.month:02d}{got.year}")
    if kind == "local":
        number = int(digits) - 2 * 10**9
        return _like(value, str(permute(number, 8 * 10**9, kind, key) + 2 * 10**9)) if number >= 0 else None
    if kind == "ssn":
        area, group, serial = (int(p) for p in value.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        place = area - 1 - (area > 666)
        number = permute((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, kind, key)
        place, rest = divmod(number, 99 * 9999)
        return f"{place + 1 + (place >= 665):03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"
    if kind == "phone":
        code = re.match(r"\+\d{1,3}(?=[ (])|\+\d", value)[0]
        return code + _symbols(value[len(code):], kind, key)
    local, host = value.rsplit("@", 1)
    return _symbols(local, kind, key) + "@" + host


def _cards(run: str) -> list[tuple[int, int]]:
    """Card numbers of a run of digit groups: whole groups, the longer first, then the earlier; none overlap."""
    groups = [m.span() for m in re.finditer("[0-9]+", run)]
    digits = [int(c) for c in run if c.isdecimal()]
    # Luhn sums up to each digit, with every second digit doubled from the first or from the second one on
    sums = [[0, *itertools.accumulate(d if k % 2 == odd else sum(divmod(2 * d, 10)) for k, d in enumerate(digits))] for odd in (0, 1)]
    ends = [0, *itertools.accumulate(b - a for a, b in groups)]
    valid = []
    for k, (start, _) in enumerate(groups):
        for n in range(k + 1, len(ends)):
            size, known = ends[n] - ends[k], sums[(ends[n] - 1) % 2]
            if size >= CARD.stop:
                break
            if size in CARD and (known[ends[n]] - known[ends[k]]) % 10 == 0:
                valid.append((-size, start, groups[n - 1][1]))
    taken: set[int] = set()
    out = []
    for _, start, end in sorted(valid):
        if not any(p in taken for p in range(start, end)):
            taken.update(range(start, end))
            out.append((start, end))
    return sorted(out)


def _in_run(text: str, start: int, end: int, key: bytes) -> Iterator[tuple[int, int, str]]:
    """Start, end and pseudonym of what a run of digit groups holds: dates and social security numbers, and cards between them."""
    at = start
    for m in [*PLAIN.finditer(text, start, end), None]:
        got = m and pseudonym(m.lastgroup, m[0], key)
        if m and got is None:
            continue
        for a, b in _cards(text[at:m.start() if m else end]):
            yield at + a, at + b, pseudonym("card", text[at + a:at + b], key)
        if m:
            yield *m.span(), got
            at = m.end()


def mask(text: str, key: bytes = KEY) -> tuple[str, int]:
    """The text with pseudonyms, and how many values were replaced."""
    count, out, done, at = 0, [], 0, 0
    while m := FOUND.search(text, at):
        start, at = m.span()
        if m.lastgroup == "card":
            # an address may begin with the last word of the run
            last = text.rfind(" ", start, at) + 1
            if last and (after := FOUND.match(text, last)) and after.lastgroup in ("email", "ip", "day"):
                at = last - 1
            found = _in_run(text, start, at, key)
        else:
            got = pseudonym(m.lastgroup, m[0], key)
            found = [] if got is None else [(start, at, got)]
        for a, b, got in found:
            out += text[done:a], got
            count, done = count + 1, b
    return "".join(out) + text[done:], count


def pseudonymised(docs: DataFrame, key: str = "doc_id", text: str = "text", secret: bytes = KEY) -> DataFrame:
    """One row per document: the key, ``text`` with pseudonyms, and ``n_replaced``."""
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [mask(t, secret) for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64())], [key, "text", "n_replaced"])

    return docs.select(key, text).mapInArrow(work, f"`{key}` {dict(docs.dtypes)[key]}, text string, n_replaced long")
