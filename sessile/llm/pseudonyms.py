"""Personal data replaced by format-preserving pseudonyms.

A value that its own rules confirm (check digits, ranges, calendar) is permuted
within its format by a keyed Feistel network over its digits, letters or days, so
a card number stays a valid card number, a date a date, and equal values have equal
pseudonyms in all documents. With the key the permutation can be undone.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessile.llm.common import arrow_rows, table

ROUNDS = 10
#: For tests and the registered query; a deployment passes its own.
KEY = b"sessile"

#: Dates are permuted among the days of these years.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
MONTHS = "January February March April May June July August September October November December".split()
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


class Feistel:
    """Keyed permutations of numbers below any bound, one for each tweak."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, i: int, tweak: bytes, half: int, bound: int) -> int:
        h = hashlib.blake2b(b"%d|%d|%d|%s" % (i, bound, half, tweak), key=self.key, digest_size=32 + bound.bit_length() // 8)
        return int.from_bytes(h.digest(), "big") % bound if h.digest_size <= 64 else 0

    def _walk(self, x: int, size: int, tweak: bytes, back: bool) -> int:
        low = math.isqrt(size - 1) + 1
        high = -(-size // low)
        while True:
            a, b = divmod(x, low)
            # a < high, b < low; odd rounds change one half, even rounds the other.
            for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
                step = -1 if back else 1
                if i % 2:
                    a = (a + step * self._round(i, tweak, b, high)) % high
                else:
                    b = (b + step * self._round(i, tweak, a, low)) % low
            x = a * low + b
            if x < size:
                return x

    def permute(self, x: int, size: int, tweak: bytes, back: bool = False) -> int:
        """A permutation of 0 .. size - 1; values outside are walked on until they fall inside."""
        return self._walk(x, size, tweak, back) if size > 1 else x

    def characters(self, text: str, tweak: bytes, back: bool = False) -> str:
        """Permute digits among digits and letters among letters of their case, 20 characters at a time, each part under the parts before it."""
        at = [i for i, c in enumerate(text) if c in DIGITS or c in LOWER or c in UPPER]
        out = list(text)
        for start in range(0, len(at), 20):
            part = at[start : start + 20]
            sets = [next(s for s in (DIGITS, LOWER, UPPER) if text[i] in s) for i in part]
            x, size = 0, 1
            for i, s in zip(part, sets, strict=True):
                x, size = x * len(s) + s.index(text[i]), size * len(s)
            known = (text if not back else "".join(out))[: part[0]].encode()
            shape = "".join(str(len(s)) for s in sets).encode()
            x = self.permute(x, size, tweak + b"|" + shape + b"|" + known, back)
            for i, s in zip(reversed(part), reversed(sets), strict=True):
                x, d = divmod(x, len(s))
                out[i] = s[d]
        return "".join(out)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def _refill(text: str, digits: str) -> str:
    """Put digits in the places of the text's digits."""
    left = iter(digits)
    return "".join(next(left) if c in DIGITS else c for c in text)


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def card(f: Feistel, m: re.Match, back: bool) -> str | None:
    d = _digits(m[0])
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = str(f.permute(int(d[:-1]), 10 ** (len(d) - 1), b"card|%d" % len(d), back)).zfill(len(d) - 1)
    return _refill(m[0], body + luhn_digit(body))


def address4(f: Feistel, m: re.Match, back: bool) -> str | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = f.permute(int.from_bytes(bytes(map(int, parts)), "big"), 2**32, b"ipv4", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def phone(f: Feistel, m: re.Match, back: bool) -> str | None:
    """North American numbers (area and exchange do not start with 0 or 1), else digits after a country code.

    After +1, numbers that break that rule are permuted among those that break it.
    """
    d = _digits(m[0])
    if m[0].startswith("+") and not d.startswith("1"):
        if not 8 <= len(d) <= 15:
            return None
        tail = f.permute(int(d[2:]), 10 ** (len(d) - 2), b"phone|" + d[:2].encode() + b"|%d" % len(d), back)
        return _refill(m[0], d[:2] + str(tail).zfill(len(d) - 2))
    lead, d = ("1", d[1:]) if len(d) == 11 and d[0] == "1" or m[0].startswith("+") else ("", d)
    if len(d) != 10 or d[0] in "01" or d[3] in "01":
        if not m[0].startswith("+") or not 7 <= len(d) <= 14:
            return None
        tail = d
        while True:
            tail = str(f.permute(int(tail), 10 ** len(d), b"phone|1|%d" % len(d), back)).zfill(len(d))
            if len(d) != 10 or tail[0] in "01" or tail[3] in "01":
                return _refill(m[0], "1" + tail)
    x = ((int(d[:3]) - 200) * 800 + int(d[3:6]) - 200) * 10000 + int(d[6:])
    x = f.permute(x, 800 * 800 * 10000, b"nanp", back)
    rest, line = divmod(x, 10000)
    area, exchange = divmod(rest, 800)
    return _refill(m[0], f"{lead}{area + 200}{exchange + 200}{line:04d}")


def social(f: Feistel, m: re.Match, back: bool) -> str | None:
    """Areas 001-665 and 667-899, groups 01-99, serials 0001-9999."""
    a, g, s = map(int, m[0].split("-"))
    if not (0 < a < 900 and a != 666 and g and s):
        return None
    area = a - 1 - (a > 666)
    x = f.permute((area * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, b"ssn", back)
    x, s = divmod(x, 9999)
    area, g = divmod(x, 99)
    a = area + 1 + (area >= 665)
    return f"{a:03d}-{g + 1:02d}-{s + 1:04d}"


def account(f: Feistel, m: re.Match, back: bool) -> str | None:
    """IBAN: the two check digits make the number 1 modulo 97; country and format stay."""
    raw = m[0].replace(" ", "")
    if not 15 <= len(raw) <= 34:
        return None

    def rest(country: str, check: str, body: str) -> int:
        return int("".join(str(int(c, 36)) for c in body + country + check)) % 97

    if rest(raw[:2], raw[2:4], raw[4:]) != 1:
        return None
    body = f.characters(raw[4:], b"iban|" + raw[:2].encode(), back)
    new = raw[:2] + f"{98 - rest(raw[:2], '00', body):02d}" + body
    left = iter(new)
    return "".join(c if c == " " else next(left) for c in m[0])


def _day(f: Feistel, year: int, month: int, day: int, back: bool, days: range = range(1, 32)) -> datetime.date | None:
    """The pseudonym of a date, among the dates with such days of the month."""
    try:
        found = datetime.date(year, month, day)
    except ValueError:
        return None
    if not FIRST_DAY <= found <= LAST_DAY:
        return None
    while True:
        found = FIRST_DAY + datetime.timedelta(f.permute((found - FIRST_DAY).days, (LAST_DAY - FIRST_DAY).days + 1, b"date", back))
        if found.day in days:
            return found


def _two(like: str, n: int) -> str:
    """Without a leading zero only where the original had none and none is needed."""
    return f"{n:02d}" if len(like) == 2 else str(n)


def date_ymd(f: Feistel, m: re.Match, back: bool) -> str | None:
    y, s, mo, d = m["y"], m["s"], m["m"], m["d"]
    new = _day(f, int(y), int(mo), int(d), back)
    return new and f"{new.year:04d}{s}{new.month:02d}{s}{new.day:02d}"


def date_dmy(f: Feistel, m: re.Match, back: bool) -> str | None:
    """Day first, or month first where only that is a date."""
    a, s, b, y = int(m["a"]), m["s2"], int(m["b"]), int(m["y2"])
    if b <= 12:
        new = _day(f, y, b, a, back)
        return new and f"{new.day:02d}{s}{new.month:02d}{s}{new.year:04d}"
    # Days beyond 12 only, so that the pseudonym too is a date with the month first alone.
    new = _day(f, y, a, b, back, range(13, 32))
    return new and f"{new.month:02d}{s}{new.day:02d}{s}{new.year:04d}"


def date_named(f: Feistel, m: re.Match, back: bool) -> str | None:
    new = _day(f, int(m["y3"]), MONTHS.index(m["name"]) + 1, int(m["d3"]), back)
    return new and f"{new.day} {MONTHS[new.month - 1]} {new.year:04d}"


def date_month_first(f: Feistel, m: re.Match, back: bool) -> str | None:
    """A leading zero stays one."""
    zero = m["d4"][0] == "0"
    new = _day(f, int(m["y4"]), MONTHS.index(m["name4"]) + 1, int(m["d4"]), back, range(1, 10 if zero else 32))
    return new and f"{MONTHS[new.month - 1]} {'0' if zero else ''}{new.day}, {new.year:04d}"


def mail(f: Feistel, m: re.Match, back: bool) -> str | None:
    """The name and the host's first label are permuted; the registered domain stays."""
    user, host = m[0].rsplit("@", 1)
    first, dot, rest = host.partition(".")
    if "." in rest:
        return f.characters(user, b"mail|" + rest.encode(), back) + "@" + f.characters(first, b"host|" + rest.encode(), back) + dot + rest
    return f.characters(user, b"mail|" + host.encode(), back) + "@" + host


def _hexadecimal(f: Feistel, value: str, back: bool) -> str:
    out = []
    for i in range(0, len(value), 24):
        part, known = value[i : i + 24], (value if not back else "".join(out))[:i].encode()
        out.append(format(f.permute(int(part, 16), 16 ** len(part), b"hex|%d|" % len(part) + known, back), f"0{len(part)}x"))
    return "".join(out)


def secret(f: Feistel, m: re.Match, back: bool) -> str | None:
    """Keys and tokens named as such: hexadecimal stays hexadecimal, in its case."""
    value = m["secret"]
    if re.fullmatch(r"[0-9a-f]+", value):
        new = _hexadecimal(f, value, back)
    elif re.fullmatch(r"[0-9A-F]+", value):
        # Walked on until a letter shows the case.
        new = _hexadecimal(f, value.lower(), back)
        while new.isdigit():
            new = _hexadecimal(f, new, back)
        new = new.upper()
    else:
        new = f.characters(value, b"secret", back)
    return m[0][: m.start("secret") - m.start()] + new + m[0][m.end("secret") - m.start() :]


#: Kind, pattern, replacement; of patterns that match at one place the first that validates counts.
KINDS: tuple[tuple[str, str, Callable], ...] = (
    ("secret", r"(?<![A-Za-z0-9])(?ai:api[_-]?key|secret|token|password|passwd|access[_-]?key)\s*[=:]\s*[\"']?(?P<secret>[A-Za-z0-9_\-+/]{8,})", secret),
    ("mail", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", mail),
    ("account", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", account),
    ("date", r"(?<![\d.\-/])(?P<y>\d{4})(?P<s>[-/.])(?P<m>\d{2})(?P=s)(?P<d>\d{2})(?![\d\-/])", date_ymd),
    ("address", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)", address4),
    ("date", r"(?<![\d.\-/])(?P<a>\d{2})(?P<s2>[-/.])(?P<b>\d{2})(?P=s2)(?P<y2>\d{4})(?![\d\-/])", date_dmy),
    ("date", rf"(?<!\d)(?P<d3>\d{{1,2}}) (?P<name>{'|'.join(MONTHS)}) (?P<y3>\d{{4}})(?!\d)", date_named),
    ("date", rf"(?<![A-Za-z])(?P<name4>{'|'.join(MONTHS)}) (?P<d4>\d{{1,2}}), (?P<y4>\d{{4}})(?!\d)", date_month_first),
    ("social", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])", social),
    ("phone", r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)", phone),
    ("card", r"(?<!\d)(?:\d{13,19}|\d{4}(?P<g>[ -])\d{4}(?P=g)\d{4}(?P=g)\d{4}|\d{4}(?P<h>[ -])\d{6}(?P=h)\d{5})(?!\d)", card),
)
#: Cheap signs that a text may hold any of them.
_SIGN = re.compile(r"[0-9@]|(?ai:key|secret|token|passw)")
_HAS = {"secret": re.compile(r"(?ai:key|secret|token|passw)"), "mail": re.compile("@")}


def replace(text: str, feistel: Feistel, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of what was found in the text given."""
    if not _SIGN.search(text):
        return text, []
    digits = any(c in text for c in DIGITS)
    found: list[tuple[int, int, str, str]] = []
    for kind, pattern, change in _COMPILED:
        if kind in _HAS and not _HAS[kind].search(text) or kind not in _HAS and not digits:
            continue
        for m in pattern.finditer(text):
            # Found spans stand in order and apart, so only the neighbours of the place can overlap.
            k = bisect_left(found, (m.start(),))
            if (k == 0 or found[k - 1][1] <= m.start()) and (k == len(found) or found[k][0] >= m.end()):
                new = change(feistel, m, back)
                if new is not None:
                    found.insert(k, (m.start(), m.end(), kind, new))
    out, at = [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [(kind, a, b) for a, b, kind, _ in found]


_COMPILED = tuple((k, re.compile(p), c) for k, p, c in KINDS)


def replace_batches(key: bytes, back: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(key)
        spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            done = [replace(x, feistel, back) if x else (x, []) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x for x, _ in done], pa.string()), pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in done], spans)], ["doc_id", "text", "spans"]
            )

    return run


def pseudonymise(docs: DataFrame, key: bytes = KEY, back: bool = False) -> DataFrame:
    """Per document: doc_id, text (with pseudonyms), spans (kind, start, end in the text given).

    A null text stays null and an empty one empty. Values in the format of a kind that
    fail its rules stay as they are. Whole texts are read; rows that repeat each give
    a row; other columns are ignored. With back, pseudonyms become the values again.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_rows(docs.select("doc_id", "text")).mapInArrow(replace_batches(key, back), f"doc_id {kind}, text string, spans array<struct<kind:string,start:int,end:int>>")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents")).select("doc_id", F.size("spans").cast("long").alias("n_found"), "text", "spans")
