"""Format-preserving pseudonyms of personal data by keyed Feistel permutations (operator 1).

Each kind of value is recognised by its form, validated where its form can be (checksums, calendars, octets) and then
permuted within the set of all valid values of its form: a card number stays a card number with a right check digit, a date
stays a date in its notation and width. A permutation depends on the key, the kind and the form alone, so equal values have
equal pseudonyms in every document, different ones have different pseudonyms, and whoever holds the key can undo it
(``forward=False``). Detection looks at each document by itself: the work is one pass without a shuffle.

Kinds: card (13 to 19 digits with a right Luhn digit; other long numbers are left alone), iban, ssn, phone (with +
and country code, or in 3-3-4 form), ip, date (ISO, day.month.year, month/day/year, day/month/year where only that can be meant, with
month names), email (the part before the @), secret (hexadecimal runs of 32 and more digits).

Where a match fails its check, shorter ends are tried (an IBAN's by the length of its country, a card's and a phone number's at the ends of their
groups), then the other kinds at the same place, then the next place, so a number or word beside a value doesn't hide it. A card number has one separator throughout.

Forms of dates: days and months of one digit, of two digits with a leading zero, and of two digits that need none are written
differently, so a date is permuted among the dates that are written with as many characters in each field. Dates with slashes
whose day is over 12 read in one order only and are permuted among those of their order; the others read as month/day and
are permuted among themselves. North American phone numbers share one permutation whatever their notation, with or without
country code, so they stay linked; country codes stay as they are where a separator or the plus and a known code show them.
Letters of an email address outside Latin-1 are permuted within their block of 32 code points, as far as it has letters of the same category.

Defined cases: a null text stays null and has no spans; empty texts stay empty; texts of any length are read whole;
repeated rows give repeated results; other columns stay as they are, even if they are called like a result column
(results are returned beside the key only); an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import calendar
import datetime as dt
import functools
import hashlib
import math
import re
import string
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10


class Feistel:
    """Keyed permutations of the integers below any bound."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: str, n: int, i: int, x: int) -> int:
        if n.bit_length() > 384:
            # Longer than two digests: numbers as bytes, as Python writes no number of over 4300 digits, and a result as long as a half.
            own = b"|".join([tweak.encode(), n.to_bytes(n.bit_length() // 8 + 1, "big"), str(i).encode(), x.to_bytes(x.bit_length() // 8 + 1, "big")])
            return int.from_bytes(hashlib.shake_256(hashlib.blake2b(own, key=self.key).digest()).digest(n.bit_length() // 16 + 16), "big")
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{n}|{i}|{x}".encode(), key=self.key, digest_size=24).digest(), "big")

    def permute(self, x: int, n: int, tweak: str, forward: bool = True) -> int:
        """A permutation of 0..n-1. Halves are residues of two moduli whose product is just over n; values that land beyond n walk on."""
        if n < 2:
            return x
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(x, b)
            for i in range(ROUNDS) if forward else reversed(range(ROUNDS)):
                sign = 1 if forward else -1
                if i % 2:
                    right = (right + sign * self._round(tweak, n, i, left)) % b
                else:
                    left = (left + sign * self._round(tweak, n, i, right)) % a
            x = left * b + right
            if x < n:
                return x


#: Characters that are permuted among themselves.
CLASSES = (string.digits, string.ascii_lowercase, string.ascii_uppercase, "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7), "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7))


@functools.lru_cache(10_000)
def alphabet_of(c: str) -> str:
    """The characters that ``c`` is permuted among: its class, or the letters or digits of its sort in its block of 32 code points; nothing if it is neither."""
    for own in CLASSES:
        if c in own:
            return own
    sort, first = unicodedata.category(c), ord(c) & ~31
    if sort[0] not in "LN":
        return ""
    return "".join(x for x in map(chr, range(first, first + 32)) if unicodedata.category(x) == sort and x not in _IN_CLASSES)


_IN_CLASSES = frozenset("".join(CLASSES))
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22,
    "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: How card numbers are usually grouped.
CARD_GROUPS = ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4])
#: Country calling codes of one and two digits; all others have three.
CODES = ("1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def luhn(digits: str) -> int:
    """The check digit that belongs after ``digits``."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 - i % 2)
        total += x - 9 * (x > 9)
    return -total % 10


def _iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _refill(form: str, chars: str, of: Callable[[str], bool]) -> str:
    """``form`` with its characters of one sort replaced, one by one, by ``chars``."""
    left = iter(chars)
    return "".join(next(left) if of(c) else c for c in form)


def _is_digit(c: str) -> bool:
    return c in string.digits


@functools.lru_cache(64)
def dates_of(form: str, of_month: int, of_day: int) -> list[tuple[int, int, int]]:
    """All dates of a form whose month and day are written in the given ways (0: by name), in order."""

    def fits(number: int, sort: int) -> bool:
        return sort == 0 or (number < 10) == (sort in (1, 2))

    def reads(month: int, day: int) -> bool:
        return {"d/m": day > 12, "m/d": day > 12, "either": day <= 12}.get(form, True)

    out = []
    for year in range(Pseudonyms.FIRST, Pseudonyms.LAST + 1):
        for month in range(1, 13):
            if fits(month, of_month):
                out += [(year, month, day) for day in range(1, calendar.monthrange(year, month)[1] + 1) if fits(day, of_day) and reads(month, day)]
    return out


class Pseudonyms:
    """Finds values of all kinds in a text and permutes them."""

    #: Kinds in the order in which they claim characters.
    FORMS = (
        ("email", r"(?<![\w.%+-])[\w][\w.%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
        ("secret", r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])"),
        ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30}(?![0-9A-Za-z])"),
        ("phone", r"(?<![\w+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![\w(+])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"),
        ("number", r"(?<![\w.,-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]|[.,-][0-9])"),
        ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
        ("ip", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
        ("date", r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9]|[./-][0-9])|(?<!\w)(?:(?:%(m)s) [0-9]{1,2}, [0-9]{4}|[0-9]{1,2} (?:%(m)s) [0-9]{4})(?!\w)" % {"m": "|".join(calendar.month_name[1:])}),
    )
    #: A text without one of these holds no value of any kind.
    HINT = re.compile(r"[0-9]|@")
    FIRST, LAST = 1900, 2099

    def __init__(self, key: bytes, forward: bool = True):
        self.feistel, self.forward = Feistel(key), forward
        self.pattern = re.compile("|".join(f"(?P<{k}>{p})" for k, p in self.FORMS))
        self.each = {k: re.compile(p) for k, p in self.FORMS}
        self.of = functools.lru_cache(100_000)(self._of)

    def _permute(self, x: int, n: int, tweak: str) -> int:
        return self.feistel.permute(x, n, tweak, self.forward)

    def _digits(self, digits: str, tweak: str) -> str:
        return str(self._permute(int(digits), 10 ** len(digits), f"{tweak}{len(digits)}")).zfill(len(digits)) if digits else ""

    def _chars(self, s: str, tweak: str) -> str:
        """Characters of each alphabet, in their places, as one number of that alphabet's base."""
        places: dict[str, list[int]] = {}
        for i, c in enumerate(s):
            if len(alphabet_of(c)) > 1:
                places.setdefault(alphabet_of(c), []).append(i)
        out = list(s)
        for alphabet, at in places.items():
            x = functools.reduce(lambda v, i, a=alphabet: v * len(a) + a.index(s[i]), at, 0)
            x = self._permute(x, len(alphabet) ** len(at), f"{tweak}{ord(alphabet[0])}.{len(at)}")
            for i in reversed(at):
                x, d = divmod(x, len(alphabet))
                out[i] = alphabet[d]
        return "".join(out)

    @staticmethod
    def _sort_of(number: int, text: str) -> int:
        """How a day or month is written: 1 digit, 2 digits with a leading zero, 2 without."""
        return 1 if len(text) == 1 else 2 if number < 10 else 3

    def _date(self, value: str) -> str | None:
        """A date among all dates whose fields are written alike."""
        m = re.fullmatch(r"(\d+)([-./])(\d+)[-./](\d+)|([A-Z][a-z]+) (\d+), (\d+)|(\d+) ([A-Z][a-z]+) (\d+)", value)
        if m[2] == "-":
            form, (y, mo, da) = "ISO", (m[1], m[3], m[4])
        elif m[2] == ".":
            form, (y, mo, da) = ".", (m[4], m[3], m[1])
        elif m[2]:
            day_first = int(m[1]) > 12
            either = not day_first and int(m[3]) <= 12
            form, (y, mo, da) = ("d/m" if day_first else "m/d" if not either else "either"), (m[4], m[3] if day_first else m[1], m[1] if day_first else m[3])
        else:
            name = m[5] or m[9]
            form, (y, mo, da) = ("name d" if m[5] else "d name"), (m[7] or m[10], f"{list(calendar.month_name).index(name):02d}", m[6] or m[8])
        month, day, year = int(mo), int(da), int(y)
        try:
            dt.date(year, month, day)
        except ValueError:
            return None
        if not self.FIRST <= year <= self.LAST:
            return None
        named = "name" in form
        sorts = (0 if named else self._sort_of(month, mo), self._sort_of(day, da))
        ranks = dates_of(form, *sorts)
        year, month, day = ranks[self._permute(bisect.bisect_left(ranks, (year, month, day)), len(ranks), f"date{form}{sorts}")]
        d, mm = (f"{day:02d}" if sorts[1] == 2 else str(day)), (f"{month:02d}" if sorts[0] == 2 else str(month))
        name = calendar.month_name[month]
        return {"ISO": f"{year}-{mm}-{d}", ".": f"{d}.{mm}.{year}", "d/m": f"{d}/{mm}/{year}", "m/d": f"{mm}/{d}/{year}", "either": f"{mm}/{d}/{year}", "name d": f"{name} {d}, {year}", "d name": f"{d} {name} {year}"}[form]

    def _phone(self, value: str) -> str | None:
        digits = "".join(filter(_is_digit, value))
        if value[0] == "+":
            code = next((c for c in CODES if digits.startswith(c)), digits[:3])
            if 7 <= len(digits) <= 15 and len(digits) - len(code) >= 4:
                left = iter(code + self._digits(digits[len(code) :], f"phone+{code}."))
                return "".join(next(left) if _is_digit(c) else c for c in value)
            return None
        return _refill(value, self._digits(digits, "phone+1."), _is_digit) if len(digits) == 10 else None

    def _of(self, kind: str, value: str) -> tuple[str, str] | None:
        """Kind and pseudonym of a value of the given form, or nothing if it isn't valid."""
        digits = "".join(filter(_is_digit, value))
        if kind == "number":
            if int(digits[-1]) == luhn(digits[:-1]):
                payload = self._digits(digits[:-1], "card")
                return "card", _refill(value, payload + str(luhn(payload)), _is_digit)
            return None
        if kind == "iban":
            bare = value.replace(" ", "")
            if _iban_check(bare[:2], bare[4:]) != int(bare[2:4]):
                return None
            rest = self._chars(bare[4:], "iban" + bare[:2])
            return kind, _refill(value, f"{bare[:2]}{_iban_check(bare[:2], rest):02d}{rest}", lambda c: c != " ")
        if kind == "ssn":
            area, group, serial = map(int, value.split("-"))
            if area in (0, 666) or area > 899 or not group or not serial:
                return None
            rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
            rank, serial = divmod(self._permute(rank, 898 * 99 * 9999, "ssn"), 9999)
            area, group = divmod(rank, 99)
            area += 1
            return kind, f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"
        if kind == "phone":
            new = self._phone(value)
            return (kind, new) if new else None
        if kind == "ip":
            octets = [int(x) for x in value.split(".")]
            if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
                return None
            return kind, ".".join(map(str, self._permute(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip").to_bytes(4, "big")))
        if kind == "date":
            new = self._date(value)
            return (kind, new) if new else None
        if kind == "secret":
            new = f"{self._permute(int(value, 16), 16 ** len(value), f'secret{len(value)}'):0{len(value)}x}"
            return kind, new.upper() if value.upper() == value else new
        local, at, host = value.partition("@")
        return kind, self._chars(local, "email") + at + host

    def apply(self, text: str) -> tuple[str, list[dict]]:
        """The text with pseudonyms, and the spans replaced in the original: kind, start, end, pseudonym."""
        if not self.HINT.search(text):
            return text, []
        out, spans, at, look = [], [], 0, 0
        while m := self.pattern.search(text, look):
            found = self._at(text, m.start())
            if found is None:  # nothing valid begins here
                look = m.start() + 1
                continue
            kind, new, end = found
            out += [text[at : m.start()], new]
            spans.append({"kind": kind, "start": m.start(), "end": end, "pseudonym": new})
            at = look = end
        return "".join([*out, text[at:]]) if spans else text, spans

    def _at(self, text: str, start: int) -> tuple[str, str, int] | None:
        """Kind, pseudonym and end of the first valid value that begins at ``start``: kinds in their order, of each the ends that it may have."""
        for kind, form in self.each.items():
            m = form.match(text, start)
            for value in self._ends(kind, m[0]) if m else ():
                found = self.of(kind, value)
                if found:
                    return *found, start + len(value)
        return None

    @staticmethod
    def _ends(kind: str, value: str) -> Iterator[str]:
        """What a match may stand for: it may have taken words or numbers behind the value."""
        if kind == "iban" and value[:2] in IBAN_LENGTHS:
            at = [i for i, c in enumerate(value) if c != " "]
            n = IBAN_LENGTHS[value[:2]]
            if len(at) >= n and (len(at) == n or value[at[n - 1] + 1] == " "):
                yield value[: at[n - 1] + 1]
            return
        if kind not in ("iban", "number", "phone"):
            yield value
            return
        marks = [i for i, c in enumerate(value) if c in " -." and i]
        ends = [len(value), *reversed(marks)]
        if kind == "number":
            # A card has one separator throughout; the usual groups come before longer numbers that begin with them.
            marks = [i for i, c in enumerate(value) if c in " -"]
            ends = [e for e in ends if len({value[i] for i in marks if i < e}) <= 1 and 13 <= sum(map(_is_digit, value[:e])) <= 19]
            usual = [e for e in ends if [len(g) for g in re.split("[ -]", value[:e])] in CARD_GROUPS]
            ends = [*usual, *(e for e in ends if e not in usual)]
        if kind == "iban":
            ends = [e for e in ends if sum(c != " " for c in value[:e]) >= 15]
        for e in ends:
            yield value[:e]


_SPANS = "array<struct<kind: string, start: int, end: int, pseudonym: string>>"


def pseudonymise(docs: DataFrame, secret: bytes, key: str = "doc_id", text: str = "text", forward: bool = True) -> DataFrame:
    """(key, text, spans): texts with pseudonyms, and for each value its kind, its place in the original and its pseudonym."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Pseudonyms(secret, forward)
        for part in parts:
            done = [(None, []) if x is None else names.apply(x) for x in part["text"]]
            yield pd.DataFrame({"key": part["key"], "text": pd.Series([d[0] for d in done], dtype=object), "spans": pd.Series([d[1] for d in done], dtype=object)})

    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    made = slim.mapInPandas(run, f"key {slim.schema['key'].dataType.simpleString()}, text string, spans {_SPANS}")
    return made.select(F.col("key").alias(key), F.col("text").alias(text), "spans")


#: Where the key of the query is looked for, in the session's settings; Spark hides settings of such names in its pages and logs.
KEY_SETTING = "spark.terravane.pseudonym.secret"


def op1_pseudonyms(spark: SparkSession, sf_dir: str, secret: bytes | None = None) -> DataFrame:
    """Every document with its personal data under pseudonyms; the key comes from the caller or from ``KEY_SETTING``. Only a local session has one for tests."""
    given = secret or (spark.conf.get(KEY_SETTING, None) or "").encode()
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{KEY_SETTING} must hold the key of the pseudonyms")
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), given or b"for tests only")
