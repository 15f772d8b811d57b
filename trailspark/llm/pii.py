"""PII: values are replaced by pseudonyms of the same format.

A value found and validated (check digits, octet ranges, calendar) is turned into a number of
its format's domain, permuted there by a keyed Feistel network, and written back in the same
format. The permutation is one to one, so equal values stay linked across documents and
unequal ones stay apart, without any table of seen values. Who has the key can invert it.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.llm.common import table

ROUNDS = 8
DEMO_KEY = b"change this key"  # the registered query's; callers bring their own
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()

#: One alternative a kind; the longest forms come first.
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-]))"
    r"|(?P<secret>(?<![A-Za-z0-9])AKIA[A-Z2-7]{16}(?![A-Za-z0-9])"
    r"|(?:(?<=password=)|(?<=token=)|(?<=token = \")|(?<=token=\"))[0-9a-f]{16,64}(?![0-9A-Za-z]))"
    r"|(?P<date>(?<![\w-])[12]\d{3}-[01]\d-[0-3]\d(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[.-])[2-9]\d{2}[ .-]?\d{4}(?!\w))"
    r"|(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    r"|(?P<card>(?<![\w-])(?:\d{13,19}|\d{4}([ -])\d{4}\8\d{4}\8\d{1,7}|\d{4}([ -])\d{6}\9\d{5})(?![\w-]))"
)
_CANDIDATE = re.compile(r"[0-9@]|AKIA")
_DIGITS = "0123456789"


def feistel(value: int, size: int, key: bytes, tweak: str, inverse: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1.

    The network works on the least square lattice that holds the domain; values that land
    outside are permuted again until they fall inside (cycle walking).
    """
    if size < 2:
        return value
    side = isqrt(size - 1) + 1

    def mix(number: int, half: int) -> int:
        return int.from_bytes(blake2b(b"%d:%d" % (number, half), key=key, person=tweak.encode()[:16], digest_size=16).digest())

    while True:
        left, right = divmod(value, side)
        if inverse:
            for number in reversed(range(ROUNDS)):
                left, right = (right - mix(number, left)) % side, left
        else:
            for number in range(ROUNDS):
                left, right = right, (left + mix(number, right)) % side
        value = left * side + right
        if value < size:
            return value


def luhn_digit(body: str) -> str:
    """The check digit that belongs behind ``body``."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _refill(form: str, digits: str) -> str:
    """``form`` with its digits replaced in order."""
    fresh = iter(digits)
    return "".join(next(fresh) if c in _DIGITS else c for c in form)


def _only_digits(value: str) -> str:
    return "".join(c for c in value if c in _DIGITS)


def _alphabets(value: str, sets: tuple[str, ...], permute: Callable[[int, int, str], int], kind: str) -> str:
    """Permutes the characters of ``value`` that are in ``sets``, each within its set."""
    bases = [next((s for s in sets if c in s), None) for c in value]
    number, size = 0, 1
    for c, base in zip(value, bases):
        if base:
            size *= len(base)
            number = number * len(base) + base.index(c)
    number = permute(number, size, kind)
    out = list(value)
    for i in reversed(range(len(value))):
        if bases[i]:
            number, digit = divmod(number, len(bases[i]))
            out[i] = bases[i][digit]
    return "".join(out)


_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def pseudonym(kind: str, value: str, key: bytes, inverse: bool = False) -> str | None:
    """The value's pseudonym, or None if it is not a valid one of its kind."""

    def permute(number: int, size: int, tweak: str) -> int:
        return feistel(number, size, key, tweak, inverse)

    digits = _only_digits(value)
    if kind == "email":
        local, _, domain = value.partition("@")
        return _alphabets(local, (_LOWER, _UPPER, _DIGITS), permute, "email") + "@" + domain
    if kind == "secret":
        if value.startswith("AKIA"):
            return "AKIA" + _alphabets(value[4:], (_UPPER + "234567",), permute, "aws")
        return _alphabets(value, (_DIGITS + "abcdef",), permute, "hex")
    if kind == "date":
        try:
            day = dt.date.fromisoformat(value).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        return dt.date.fromordinal(FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date")).isoformat()
    if kind == "ssn":
        area, middle, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        if area in (0, 666) or area >= 900 or not middle or not serial:
            return None
        index = (area - 1 if area < 666 else area - 2, middle - 1, serial - 1)
        number = permute((index[0] * 99 + index[1]) * 9999 + index[2], 898 * 99 * 9999, "ssn")
        rest, serial = divmod(number, 9999)
        area, middle = divmod(rest, 99)
        return f"{area + 1 if area < 665 else area + 2:03d}-{middle + 1:02d}-{serial + 1:04d}"
    if kind == "phone":
        lead, own = digits[:-10], digits[-10:]
        number = ((int(own[:3]) - 200) * 800 + int(own[3:6]) - 200) * 10_000 + int(own[6:])
        number = permute(number, 800 * 800 * 10_000, "phone")
        rest, line = divmod(number, 10_000)
        area, exchange = divmod(rest, 800)
        return _refill(value, f"{lead}{area + 200}{exchange + 200}{line:04d}")
    if kind == "ip":
        octets = value.split(".")
        if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
            return None
        number = permute(int.from_bytes(bytes(map(int, octets))), 1 << 32, "ip")
        return ".".join(map(str, number.to_bytes(4)))
    if len(digits) < 13 or len(digits) > 19 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = f"{permute(int(digits[:-1]), 10 ** (len(digits) - 1), f'card{len(digits)}'):0{len(digits) - 1}d}"
    return _refill(value, body + luhn_digit(body))


def replace_values(text: str, key: bytes) -> tuple[str, list[dict]]:
    """The text with pseudonyms, and kind, start and end of each in the new text."""
    out, spans, at, length = [], [], 0, 0
    for match in PATTERN.finditer(text):
        kind, value = match.lastgroup, match.group()
        new = pseudonym(kind, value, key)
        if new is None:
            continue
        out += [text[at : match.start()], new]
        length += match.start() - at
        spans.append({"kind": kind, "start": length, "end": length + len(new)})
        length += len(new)
        at = match.end()
    out.append(text[at:])
    return "".join(out), spans


def pseudonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms and ``found`` (kind, start, end in code points) of every row.

    Null texts stay null, texts without a valid value stay as they are, and rows stay as many.
    Values that fail validation (check digit, calendar, ranges) are not touched.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("found", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch["text"].to_pylist(), [[] for _ in range(batch.num_rows)]
            for i, text in enumerate(texts):
                if text and _CANDIDATE.search(text):
                    texts[i], found[i] = replace_values(text, key)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string()), pa.array(found, schema.types[2])], schema=schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, text string, found array<struct<kind string, start int, end int>>")


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymised(table(spark, sf_dir, "documents"), DEMO_KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda f: f["kind"]))), ",")
    return found.select("doc_id", "text", F.size("found").alias("n_found"), kinds.alias("kinds"))
