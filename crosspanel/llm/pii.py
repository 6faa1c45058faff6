"""Personal data: format-preserving pseudonyms from a keyed Feistel permutation.

Recognised values are validated (calendar dates, Luhn and mod-97 checks, address ranges),
read as a number of the set of all values of their format, permuted inside that set by a
keyed Feistel network with cycle walking, and written back in the same layout with fresh
check digits.  The permutation depends on the key and the kind only, so equal values get
equal pseudonyms in every document, whatever separators they carry, and different values
stay different.  The dates of the format are those of 1900 to 2099; others aren't personal data here and stay.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from crosspanel.llm.frames import map_batches
from crosspanel.llm.textbytes import column_bytes, text_slices

ROUNDS = 10
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()

_PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?!\w))"
    r"|(?P<date>(?<![\w.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9]{2}|(?![\w-]))|(?:[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\w-])))"
    r"|(?P<ip>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\w-]|\.[0-9]))"
    r"|(?P<phone>(?<![\w.+-])(?:(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
    r"|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5})(?![\w-]))",
    re.ASCII,
)
_LIKELY = re.compile("[0-9@]")
_MARKED = np.zeros(256, dtype=bool)
_MARKED[48:58] = _MARKED[ord("@")] = True


@dataclass(frozen=True)
class Pseudonymiser:
    """Keyed permutations of the recognised formats."""

    key: bytes

    def permute(self, kind: str, value: int, size: int) -> int:
        """Place of ``value`` under the permutation of ``range(size)`` that belongs to ``kind``."""
        return _permute(self.key, kind, value, size)

    def digits(self, kind: str, digits: str) -> str:
        return str(self.permute(f"{kind}{len(digits)}", int(digits), 10 ** len(digits))).zfill(len(digits)) if digits else ""

    def symbols(self, kind: str, text: str) -> str:
        """Permute the letters and digits of a text by class; everything else stays.

        Letter case is a layout, so spellings that differ in case are one value.
        """
        radix = [10 if c.isdigit() else 26 if c.isalpha() else 0 for c in text]
        value = size = 0
        for c, r in zip(text, radix, strict=True):
            if r:
                value = value * r + (int(c) if r == 10 else ord(c.lower()) - 97)
                size = (size or 1) * r
        if not size:
            return text
        shape = "".join("9" if r == 10 else "a" if r else c for c, r in zip(text, radix, strict=True))
        value = self.permute(kind + shape, value, size)
        out = []
        for c, r in zip(reversed(text), reversed(radix), strict=True):
            if r:
                value, x = divmod(value, r)
                n = str(x) if r == 10 else chr(97 + x)
                out.append(n.upper() if c.isupper() else n)
            else:
                out.append(c)
        return "".join(reversed(out))

    def pseudonym(self, kind: str, text: str) -> str | None:
        """The replacement of a candidate, or None when it isn't a valid value."""
        return getattr(self, f"_{kind}")(text)

    def _email(self, text: str) -> str:
        local, _, host = text.rpartition("@")
        name, _, top = host.rpartition(".")
        both = self.symbols("email", f"{local}@{name}")
        return f"{both}.{top}"

    def _card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if len(digits) < 13 or luhn(digits[:-1]) != digits[-1] or not digits.strip("0"):
            return None
        body = self.digits("card", digits[:-1])
        return relaid(text, body + luhn(body))

    def _iban(self, text: str) -> str | None:
        flat = text.replace(" ", "")
        if not 15 <= len(flat) <= 34 or mod97(flat[4:] + flat[:4]) != 1:
            return None
        body = self.symbols("iban" + flat[:2], flat[4:])
        return relaid(text, f"{flat[:2]}{98 - mod97(f'{body}{flat[:2]}00'):02d}{body}")

    def _ssn(self, text: str) -> str | None:
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        place = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        place, serial = divmod(self.permute("ssn", place, 898 * 99 * 9999), 9999)
        area, group = divmod(place, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def _ip(self, text: str) -> str | None:
        parts = [int(x) for x in text.split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
            return None
        value = self.permute("ip", int.from_bytes(bytes(parts), "big"), 1 << 32)
        return ".".join(map(str, value.to_bytes(4, "big")))

    def _phone(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if not 8 <= len(digits) <= 15:
            return None
        # The last ten digits identify a line with or without its country code.
        return relaid(text, digits[:-10] + self.digits("phone", digits[-10:]))

    def _date(self, text: str) -> str | None:
        a, b, c = (int(x) for x in re.split(r"[-/.]", text))
        if "-" in text:
            parts = a, b, c
        else:  # month first with slashes, day first with dots, the other order if only that one exists
            day_first = "." in text
            parts = (c, b, a) if day_first and b <= 12 or not day_first and a > 12 else (c, a, b)
        try:
            day = dt.date(*parts).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        new = dt.date.fromordinal(FIRST_DAY + self.permute("date", day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1))
        return f"{new:%Y-%m-%d}" if "-" in text else f"{new:%d.%m.%Y}" if "." in text else f"{new:%m/%d/%Y}"

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of what was replaced in the input."""
        out, spans, at = [], [], 0
        pos = 0
        while m := _PATTERN.search(text, pos):
            kind, start, end = m.lastgroup, m.start(), m.end()
            new = self.pseudonym(kind, m[0])
            if new is None and kind == "iban":
                # A neighbouring word may have been taken in: try the shorter ends.
                for x in reversed([start + g.start() for g in _GAP.finditer(m[0])]):
                    if new := self.pseudonym(kind, text[start:x]):
                        end = x
                        break
            if new is None and kind == "card" and (phone := _PATTERN_PHONE.match(text, start)):
                kind, end, new = "phone", phone.end(), self.pseudonym("phone", phone[0])
            if new is None:
                pos = _after(text, m)
                continue
            out += [text[at:start], new]
            spans.append((kind, start, end))
            at = pos = end
        return "".join([*out, text[at:]]), spans


_PATTERN_PHONE = re.compile(_PATTERN.pattern[_PATTERN.pattern.index("(?P<phone>") :], re.ASCII)
_GAP = re.compile("[ -]")
_DIGITS = re.compile(r"[A-Za-z0-9]+")


def _after(text: str, m: re.Match) -> int:
    """Where to search on after an invalid candidate: behind its first run of letters and digits."""
    return m.start() + (_DIGITS.search(m[0]).end() if _DIGITS.search(m[0]) else 1)


@lru_cache(maxsize=50_000)
def _permute(key: bytes, kind: str, value: int, size: int) -> int:
    if size < 2:
        return value
    a = isqrt(size - 1) + 1
    b = -(-size // a)
    while True:  # cycle walking: leave the rectangle a x b only inside the set
        left, right = divmod(value, b)
        for r in range(0, ROUNDS, 2):
            left = (left + _round(key, kind, r, right)) % a
            right = (right + _round(key, kind, r + 1, left)) % b
        value = left * b + right
        if value < size:
            return value


def _round(key: bytes, kind: str, r: int, half: int) -> int:
    message = f"{kind}:{r}:{half}".encode()
    return int.from_bytes(hashlib.blake2b(message, key=key, digest_size=32).digest(), "big")


def luhn(body: str) -> str:
    """The check digit of a payload."""
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def relaid(layout: str, symbols: str) -> str:
    """Put symbols in the places that hold letters and digits in ``layout``."""
    it = iter(symbols)
    return "".join(next(it) if c.isalnum() else c for c in layout)


_SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])


def pseudonymise(docs: DataFrame, key: bytes, column: str = "pii") -> DataFrame:
    """All columns of ``docs`` with pseudonyms in ``text``, plus the replaced spans of the input.

    Spans are (kind, start, end) in code points.  A null text stays null and, like an empty
    one, has no spans.  An input column called like the output is replaced.
    """
    names = Pseudonymiser(key)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            data, starts, ends = column_bytes(part.column("text"))
            at = part.schema.names.index("text")
            spans: list[list[dict[str, object]]] = [[] for _ in range(part.num_rows)]
            changed = {}
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                if not _MARKED[data[a:b]].any():
                    continue
                lines, found, begin = data[a:b].tobytes().decode("utf-8", "replace").split("\n"), [], 0
                for n, line in enumerate(lines):  # no format spans lines
                    if _LIKELY.search(line):
                        lines[n], hits = names.replace(line)
                        found += [(k, s + begin, e + begin) for k, s, e in hits]
                    begin += len(line) + 1
                if found:
                    changed[i] = "\n".join(lines)
                    spans[i] = [{"kind": k, "start": s, "end": e} for k, s, e in found]
            columns = list(part.columns)
            if changed:
                columns[at] = pa.array([changed.get(i, v) for i, v in enumerate(columns[at].to_pylist())], columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], [*part.schema.names, column])

    base = docs.drop(column)
    return map_batches(base, run, StructType([*base.schema, StructField(column, ArrayType(_SPAN))]))
