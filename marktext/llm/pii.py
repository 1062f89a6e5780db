"""Personal data under format-preserving pseudonyms.

Numbers, dates, addresses and secrets are found by pattern and validated (check digits, calendar,
ranges).  Each is permuted within its format by a keyed Feistel network: the positions are a
mixed-radix number, cut into two halves, and in every round one half is shifted by a keyed hash
of the other.  This is a bijection, so equal values keep equal pseudonyms in all documents,
different ones never meet, and the key's owner can undo it.  Where only some values of a format
are valid the permutation is repeated until it falls on a valid one (cycle walking), which keeps
it a bijection; check digits are computed anew.  Nothing is looked up or gathered, so the
operator is one pass over each text.
"""

from __future__ import annotations

import datetime
import re
from bisect import bisect
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                     T.StructField("stop", T.IntegerType()), T.StructField("pseudonym", T.StringType())])


def feistel(digits: list[int], radixes: list[int], key: bytes, tweak: str, undo: bool = False) -> list[int]:
    """Keyed permutation of all sequences with ``0 <= digits[i] < radixes[i]``; ``undo`` inverts it."""
    half = len(digits) // 2
    sizes = [prod(radixes[:half]), prod(radixes[half:])]
    parts = []
    for lo, hi in ((0, half), (half, len(digits))):
        v = 0
        for d, r in zip(digits[lo:hi], radixes[lo:hi]):
            v = v * r + d
        parts.append(v)
    # The hash is longer than the half it shifts, by 64 bits, so its remainder is even enough.
    for k in reversed(range(ROUNDS)) if undo else range(ROUNDS):
        i = k % 2
        seed = f"{tweak}|{radixes}|{k}|{parts[1 - i]}".encode()
        need = (sizes[i].bit_length() + 64 + 7) // 8
        out = b"".join(blake2b(seed + bytes([j]), key=key, digest_size=64).digest() for j in range(-(-need // 64)))
        shift = int.from_bytes(out[:need], "big")
        parts[i] = (parts[i] + (-shift if undo else shift)) % sizes[i]
    result = []
    for v, (lo, hi) in zip(parts, ((0, half), (half, len(digits)))):
        piece = []
        for r in reversed(radixes[lo:hi]):
            v, d = divmod(v, r)
            piece.append(d)
        result += piece[::-1]
    return result


def _walk(digits: list[int], radixes: list[int], valid: Callable[[list[int]], bool], key: bytes, tweak: str) -> list[int]:
    out = feistel(digits, radixes, key, tweak)
    while not valid(out):
        out = feistel(out, radixes, key, tweak)
    return out


def luhn_digit(payload: list[int]) -> int:
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(payload)))
    return -total % 10


def _refill(shape: str, digits: list[int]) -> str:
    """``shape`` with its ASCII digits replaced in order."""
    it = iter(digits)
    return "".join(str(next(it)) if "0" <= c <= "9" else c for c in shape)


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def _alphabetic(text: str, key: bytes, kind: str, letters: int = 26) -> str:
    """Permutes ASCII letters and digits, each in its own alphabet; case and all else stay."""
    at = [i for i, c in enumerate(text) if c.isascii() and c.isalnum()]
    radix = [10 if text[i].isdigit() else letters for i in at]
    low = [ord(text[i]) - 48 if text[i].isdigit() else ord(text[i].lower()) - 97 for i in at]
    new = list(text)
    if len(at) == 1:  # a network needs two halves: shift the only position
        low, radix, extra = [0, *low], [1, *radix], 1
    else:
        extra = 0
    for i, d, r in zip(at, feistel(low, radix, key, kind)[extra:], radix[extra:]):
        c = chr(48 + d) if r == 10 else chr(97 + d)
        new[i] = c.upper() if text[i].isupper() else c
    return "".join(new)


def _card(m: re.Match, key: bytes) -> str | None:
    d = _digits(m[0])
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or not any(d):
        return None
    new = [d[0], *feistel(d[1:-1], [10] * (len(d) - 2), key, f"card{d[0]}")]  # the first digit names the network
    return _refill(m[0], [*new, luhn_digit(new)])


def _phone(m: re.Match, key: bytes) -> str | None:
    country, d = _digits(m["cc"]), _digits(m["nsn"])
    if not 7 <= len(country) + len(d) <= 15 or len(d) < 6:
        return None
    return m["cc"] + _refill(m["nsn"], feistel(d, [10] * len(d), key, f"phone{country}"))


def _ssn_ok(d: list[int]) -> bool:
    area, group, serial = d[0] * 100 + d[1] * 10 + d[2], d[3] * 10 + d[4], d[5] * 1000 + d[6] * 100 + d[7] * 10 + d[8]
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def _ssn(m: re.Match, key: bytes) -> str | None:
    d = _digits(m[0])
    return _refill(m[0], _walk(d, [10] * 9, _ssn_ok, key, "ssn")) if _ssn_ok(d) else None


def _ip(m: re.Match, key: bytes) -> str | None:
    parts = m[0].split(".")
    octets = [int(p) for p in parts]
    if max(octets) > 255 or any(len(p) > 1 and p[0] == "0" for p in parts):
        return None
    return ".".join(map(str, feistel(octets, [256] * 4, key, "ip")))


def _iban_mod(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(m: re.Match, key: bytes) -> str | None:
    plain = m[0].replace(" ", "").upper()
    if not 15 <= len(plain) <= 34 or _iban_mod(plain[4:] + plain[:4]) != 1:
        return None
    body = _alphabetic(plain[4:], key, "iban" + plain[:2])
    check = 98 - _iban_mod(body + plain[:2] + "00")
    it = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(it) for c in m[0])


_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
           "November", "December")


def _shift_day(day: datetime.date, key: bytes) -> datetime.date | None:
    at = day.toordinal() - FIRST_DAY
    n = LAST_DAY - FIRST_DAY + 1
    if not 0 <= at < n:
        return None
    side = 1 << (n.bit_length() + 1) // 2
    a, b = _walk(list(divmod(at, side)), [side, side], lambda d: d[0] * side + d[1] < n, key, "date")
    return datetime.date.fromordinal(FIRST_DAY + a * side + b)


def _as_date(y: str, m: str, d: str) -> datetime.date | None:
    try:
        return datetime.date(int(y), int(m), int(d))
    except ValueError:
        return None


def _date(m: re.Match, key: bytes) -> str | None:
    if m["iy"]:
        day = _as_date(m["iy"], m["im"], m["id"])
        new = day and _shift_day(day, key)
        return new and f"{new.year:04d}{m['isep']}{new.month:02d}{m['isep']}{new.day:02d}"
    if m["mon"]:
        day = _as_date(m["my"], str(1 + [x.lower() for x in _MONTHS].index(m["mon"].lower())), m["md"])
        new = day and _shift_day(day, key)
        return new and f"{_MONTHS[new.month - 1]} {new.day}{m['mc']}{new.year:04d}"
    # Day first with dots; with slashes month first where that is a date.
    orders = [("a", "b")] if m["ssep"] == "." else [("b", "a"), ("a", "b")]
    for dd, mm in orders:
        if day := _as_date(m["sy"], m[mm], m[dd]):
            new = _shift_day(day, key)
            if new is None:
                return None
            both = {dd: f"{new.day:02d}", mm: f"{new.month:02d}"}
            return f"{both['a']}{m['ssep']}{both['b']}{m['ssep']}{new.year:04d}"
    return None


def _email(m: re.Match, key: bytes) -> str | None:
    local, _, domain = m[0].rpartition("@")
    return f"{_alphabetic(local, key, 'email' + domain.lower())}@{domain}" if re.search("[A-Za-z0-9]", local) else None


def _secret(m: re.Match, key: bytes) -> str | None:
    # Hexadecimal in: hexadecimal out, position by position.
    value = m["value"]
    new = feistel([int(c, 16) for c in value], [16] * len(value), key, "secret")
    text = "".join(f"{d:x}" for d in new)
    return m[0].replace(value, text.upper() if value.upper() == value else text)


def _card_parts(text: str) -> Iterator[tuple[int, int]]:
    """Parts of a run of digit groups that may be a card: from the start of each group 13 to 19
    digits up to the end of a group, the longest first.  Only the last group may have fewer than
    four digits, or lists of small numbers would hold a card by chance at almost every place."""
    groups = [m.span() for m in re.finditer("[0-9]+", text)]
    for k, (a, _) in enumerate(groups):
        n, ends = 0, []
        for start, stop in groups[k:k + 19]:
            n += stop - start
            if n > 19:
                break
            if n >= 13:
                ends.append(stop)
            if stop - start < 4:
                break
        for stop in reversed(ends):
            yield a, stop


#: Length of an IBAN by its country.
_IBAN_LENGTH = {c: int(n) for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in cs.split()}
_IBAN_START = re.compile("(?<![0-9A-Z])[A-Z]{2}[0-9]{2}")


def _iban_parts(text: str) -> Iterator[tuple[int, int]]:
    """Parts of a match that may be an IBAN: from each start the country's length, or for other
    countries every end of a group, the longest first."""
    for m in _IBAN_START.finditer(text):
        at = [i for i in range(m.start(), min(m.start() + 68, len(text))) if text[i] != " "][:34]
        size = _IBAN_LENGTH.get(m[0][:2])
        for n in [size] if size else range(len(at), 14, -1):
            if n <= len(at) and (at[n - 1] + 1 == len(text) or text[at[n - 1] + 1] == " "):
                yield m.start(), at[n - 1] + 1


#: Kinds whose pattern may take more than the value: the parts of a failed match to try.
PARTS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {"iban": _iban_parts, "card": _card_parts}
_ANY = re.compile(r"(?s).+")


def _values(kind: str, m: re.Match, fn: Callable, key: bytes) -> Iterator[tuple[int, int, str]]:
    """Range and new name of the value of a match, or else of the valid parts within it."""
    if (new := fn(m, key)) is not None:
        yield m.start(), m.end(), new
    elif kind in PARTS:
        done = 0
        for a, b in PARTS[kind](m[0]):
            if a >= done and (new := fn(_ANY.fullmatch(m[0][a:b]), key)) is not None:
                done = b
                yield m.start() + a, m.start() + b, new


#: Kinds in order of precedence: pattern and the function that validates and renames.
KINDS: list[tuple[str, str, Callable]] = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),
    ("secret", r"(?i:token|secret|api[_-]?key|password|passwd)\s{0,3}[=:]\s{0,3}[\"']?(?P<value>[0-9A-Fa-f]{16,128})(?![0-9A-Za-z])", _secret),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,34}(?![0-9A-Za-z]))++", _iban),
    ("date", r"(?<![0-9.\-/])(?:(?P<iy>[0-9]{4})(?P<isep>[-/])(?P<im>[0-9]{2})(?P=isep)(?P<id>[0-9]{2})"
             r"|(?P<a>[0-9]{1,2})(?P<ssep>[./])(?P<b>[0-9]{1,2})(?P=ssep)(?P<sy>[0-9]{4})"
             rf"|(?P<mon>(?i:{'|'.join(_MONTHS)})) (?P<md>[0-9]{{1,2}})(?P<mc>,? )(?P<my>[0-9]{{4}}))(?![0-9]|[\-/.][0-9])", _date),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", _ip),
    ("phone", r"(?<![0-9+])(?P<cc>\+[1-9][0-9]{0,2})(?P<nsn>(?:[ .\-]?\(?[0-9]{2,4}\)?){2,5})(?![0-9])", _phone),
    ("ssn", r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])", _ssn),
    ("card", r"(?<![0-9.\-])[0-9](?:[ \-]?[0-9]){12,}+", _card),
]


@lru_cache(1)
def _patterns() -> list[tuple[str, re.Pattern, Callable]]:
    return [(kind, re.compile(pattern), fn) for kind, pattern, fn in KINDS]


#: Only texts with one of these can hold anything; a cheap first look.
_SPOT = re.compile("[0-9@=:]")


def pseudonymise(text: str, key: bytes, kinds: set[str] | None = None) -> tuple[str, list[dict]]:
    """The text with its personal data renamed, and the spans ``kind, start, stop, pseudonym`` in
    the original (code points).  Where kinds overlap the earlier one in ``KINDS`` wins."""
    if not _SPOT.search(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []  # in order, without overlaps
    for kind, pattern, fn in _patterns():
        if kinds is not None and kind not in kinds:
            continue
        for m in pattern.finditer(text):
            for a, b, new in _values(kind, m, fn, key):
                i = bisect(found, (a,))
                if (i == 0 or found[i - 1][1] <= a) and (i == len(found) or b <= found[i][0]):
                    found.insert(i, (a, b, kind, new))
    out, at = [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    out.append(text[at:])
    return "".join(out), [{"kind": k, "start": a, "stop": b, "pseudonym": n} for a, b, k, n in found]


def pseudonymise_documents(docs: DataFrame, key: str, text_col: str = "text", spans_col: str = "spans",
                           kinds: set[str] | None = None) -> DataFrame:
    """``docs`` with personal data in ``text_col`` renamed under ``key``, plus ``spans_col``.

    Null texts stay null with no spans, empty ones empty; every row is returned once, whatever
    repeats.  A column named ``spans_col`` is replaced; other columns pass through.
    """
    docs = docs.select(*[column(c) for c in docs.columns if c != spans_col])
    secret = blake2b(key.encode(), digest_size=64).digest()
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(spans_col, T.ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("pseudonym", pa.string())]))
        for b in batches:
            texts, spans = [], []
            for t in b.column(at):
                new, where = (None, []) if not t.is_valid else pseudonymise(t.as_py(), secret, kinds)
                texts.append(new)
                spans.append(where)
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], names=[*b.schema.names, spans_col])

    return docs.withColumn(text_col, column(text_col).cast("string")).mapInArrow(run, schema)
