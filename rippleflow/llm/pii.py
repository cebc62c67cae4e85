"""Format-preserving pseudonyms for personal data.

Candidates are found by pattern and kept only if they hold as what they look like: cards by the
Luhn sum, IBANs by the remainder of 97, addresses by their octets, social security numbers by
their ranges, phone numbers by their ranges or a country code with the area in brackets, dates by
the calendar. A value is numbered within the set of all valid values of its format and moved by a
keyed Feistel network over that set, walking on until the result lies in the set. So a pseudonym is valid again, has the same layout, and equal values get
equal pseudonyms in every document. A date in several layouts is one value.

Not changed: mail domains, country codes, the leading digit of a card, dates outside 1900 to 2099,
and secrets such as passwords, which are not personal data.

Defined cases: a missing text stays missing with no spans; an empty or clean text comes back as it
is; repeated rows are treated alike; result columns (``text``, ``pii_count``, ``pii_spans``)
replace input columns of the same names.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleflow.llm.common import arrow_schema, as_array, steps

ROUNDS = 8
FIRST_DAY = dt.date(1900, 1, 1).toordinal()
DAYS = dt.date(2099, 12, 31).toordinal() - FIRST_DAY + 1
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

TRIGGER = re.compile("[0-9@]")
CANDIDATE = re.compile(
    r"""(?P<email>(?<![\w.+-])[A-Za-z0-9_][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
    |(?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d))
    |(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?:[ ][A-Z0-9]{4}){2,7}(?:[ ][A-Z0-9]{1,4})?)(?!\w))
    |(?P<phone>(?<![\w(])(?:\+1[ .-]?\(\d{3}\)[ .-]?\d{3}|(?:\+?1[ .-]?)?(?:\([2-9]\d\d\)[ .-]?|[2-9]\d\d[ .-])[2-9]\d\d)[ .-]\d{4}(?![\w-]))
    |(?P<line>(?<![\w+])\+[2-9]\d(?:[ .-]?\d{2,4}){2,4}(?![\w-]))
    |(?P<card>(?<![\w.-])(?:\d{13,19}|\d{4}(?P<s4>[ -])\d{4}(?P=s4)\d{4}(?P=s4)\d{4}|\d{4}(?P<s6>[ -])\d{6}(?P=s6)\d{5})(?![\w-]))
    |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
    |(?P<date>(?<![\w./-])(?:\d{4}-\d\d-\d\d|\d\d?(?P<s2>[./])\d\d?(?P=s2)\d{4})(?![\w-]|[./]\d))""",
    re.VERBOSE | re.ASCII)


class Pseudonyms:
    """Keyed permutations of the valid values of each format."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def move(self, value: int, count: int, kind: str) -> int:
        """A permutation of 0 .. count - 1."""
        if count < 2:
            return value
        a = math.isqrt(count - 1) + 1
        b = -(-count // a)
        while True:
            left, right = divmod(value, b)
            for turn in range(ROUNDS):
                if turn % 2:
                    right = (right + self._round(kind, count, turn, left)) % b
                else:
                    left = (left + self._round(kind, count, turn, right)) % a
            value = left * b + right
            if value < count:
                return value

    def _round(self, kind: str, count: int, turn: int, half: int) -> int:
        data = f"{kind}|{count}|{turn}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=16).digest(), "big")

    def characters(self, text: str, kind: str) -> str:
        """Letters and digits are moved together; classes, case and other characters stay."""
        sets = [next((s for s in (LOWER, UPPER, DIGITS) if c in s), "") for c in text]
        number, count = 0, 1
        for c, s in zip(text, sets):
            if s:
                number, count = number * len(s) + s.index(c), count * len(s)
        shape = "".join({LOWER: "a", UPPER: "A", DIGITS: "0", "": "."}[s] for s in sets)
        number, out = self.move(number, count, f"{kind}:{shape}"), []
        for c, s in zip(reversed(text), reversed(sets)):
            if s:
                number, k = divmod(number, len(s))
                c = s[k]
            out.append(c)
        return "".join(reversed(out))

    def email(self, text: str) -> str:
        local, _, domain = text.rpartition("@")
        return self.characters(local, "email@" + domain.lower()) + "@" + domain

    def ip(self, text: str) -> str | None:
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255:
            return None
        moved = self.move(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
        return ".".join(str(b) for b in moved.to_bytes(4, "big"))

    def card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if luhn(digits) or digits[0] == "0":
            return None
        body = len(digits) - 2
        moved = digits[0] + str(self.move(int(digits[1:-1]), 10 ** body, "card")).zfill(body)
        return fill(text, moved + str(-luhn(moved + "0") % 10))

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or remainder(plain) != 1:
            return None
        moved = plain[:2] + "00" + self.characters(plain[4:], "iban" + plain[:2])
        return fill(text, f"{moved[:2]}{98 - remainder(moved):02d}{moved[4:]}", r"[A-Z0-9]")

    def phone(self, text: str) -> str:
        """Numbers with a possible area and office move among these, others among the others."""
        digits = re.sub(r"\D", "", text)
        lead, number = digits[:-10], int(digits[-10:])
        kind = possible(number)
        while True:
            number = self.move(number, 10 ** 10, "phone")
            if possible(number) == kind:
                return fill(text, lead + str(number).zfill(10))

    def line(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if not 8 <= len(digits) <= 15:
            return None
        rest = len(digits) - 3  # country code and the first digit after it stay
        moved = self.move(int(digits[3:]), 10 ** rest, "line" + digits[:3])
        return fill(text, digits[:3] + str(moved).zfill(rest))

    def ssn(self, text: str) -> str | None:
        area, group, serial = (int(x) for x in text.split("-"))
        areas = [x for x in range(1, 900) if x != 666]
        if area not in areas or not group or not serial:
            return None
        number = (areas.index(area) * 99 + group - 1) * 9_999 + serial - 1
        rest, serial = divmod(self.move(number, len(areas) * 99 * 9_999, "ssn"), 9_999)
        return f"{areas[rest // 99]:03d}-{rest % 99 + 1:02d}-{serial + 1:04d}"

    def date(self, text: str) -> str | None:
        parts = re.split(r"[-./]", text)
        sign = re.search(r"[-./]", text)[0]
        iso, day_first = sign == "-", sign == "." or int(parts[0]) > 12
        order = (0, 1, 2) if iso else (2, 1, 0) if day_first else (2, 0, 1)
        try:
            number = dt.date(*(int(parts[i]) for i in order)).toordinal() - FIRST_DAY
        except ValueError:
            return None
        if not 0 <= number < DAYS:
            return None
        day = dt.date.fromordinal(FIRST_DAY + self.move(number, DAYS, "date"))
        for i, value in zip(order, (day.year, day.month, day.day)):
            parts[i] = str(value).zfill(len(parts[i]))
        return sign.join(parts)

    def replace(self, text: str) -> tuple[str, list[dict]]:
        """The text with its pseudonyms, and their kinds and places in it (in code points)."""
        out, spans, done, at = [], [], 0, 0
        for m in CANDIDATE.finditer(text):
            kind = m.lastgroup
            new = getattr(self, kind)(m[0])
            if new is None:
                continue
            out += [text[done:m.start()], new]
            at += m.start() - done
            spans.append({"kind": "phone" if kind == "line" else kind, "start": at,
                          "length": len(new)})
            at, done = at + len(new), m.end()
        return ("".join(out) + text[done:], spans) if spans else (text, [])


def possible(number: int) -> bool:
    """Whether area and office of ten digits start with 2 to 9."""
    return number >= 2 * 10 ** 9 and number // 10 ** 6 % 10 >= 2


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def remainder(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def fill(layout: str, characters: str, pattern: str = r"\d") -> str:
    """``layout`` with its places of ``pattern`` taken by ``characters``, in order."""
    source = iter(characters)
    return re.sub(pattern, lambda _: next(source), layout, flags=re.ASCII)


SPANS = "array<struct<kind:string,start:int,length:int>>"


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """All input columns with ``text`` replaced, plus ``pii_count`` and ``pii_spans``."""
    import pyarrow as pa

    rest = [c for c in docs.columns if c.lower() not in ("text", "pii_count", "pii_spans")]
    kept = docs.select(*[F.col(f"`{c}`") for c in rest], F.col("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    schema += f", pii_count int, pii_spans {SPANS}"
    layout = arrow_schema(schema)

    def run(batches):
        pseudonyms = Pseudonyms(key.encode())
        for batch in (part for whole in batches for part in steps(whole)):
            texts, spans = batch.column(len(rest)).to_pylist(), []
            for i, text in enumerate(texts):
                found = []
                if text and TRIGGER.search(text):
                    texts[i], found = pseudonyms.replace(text)
                spans.append(found)
            columns = [*batch.columns[:-1], texts, [len(s) for s in spans], spans]
            yield pa.RecordBatch.from_arrays(
                [as_array(c, f.type) for c, f in zip(columns, layout)], schema=layout)

    return kept.mapInArrow(run, schema)
