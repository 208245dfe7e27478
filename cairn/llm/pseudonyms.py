"""Format-preserving Feistel pseudonyms for validated numbers and dates, and for mailbox names.

A value is found by its pattern and validated (check digits, octets, calendar).  Its number, in a domain of
exactly the values of its format, is permuted by a keyed balanced Feistel network with cycle walking, and
written back in the same layout: separators stay, check digits are made anew.  The permutation depends on
the key, the kind and the length alone, so equal values have equal pseudonyms in all documents and
layouts, different values have different ones, and the holder of the key can undo it.

A date keeps whether its day is above 12, which settles the order of day and month with slashes: such dates are
read as month/day where that is a date, and as day/month otherwise, before and after.  It also keeps whether day and
month are below 10, so that each is written with as many digits as before.  A mailbox is closed to all other kinds, so
numbers, dates and addresses in its name change once, as the name.  A phone number keeps its
calling code, found by the digits whatever the layout, and whether the rest begins with 0 or, under code 1 and
without a code, is a valid number of that plan (area and exchange from 2 on).  Any such rest of n digits has the
pseudonym that it has under other codes only if it is of the same class there.

Kinds: card (Luhn, 13 to 19 digits), iban (ISO 13616, modulo 97), ssn, phone, ipv4, date (1900 to 2099) and
email (letters and digits of the mailbox name; the domain stays).  What fails validation is left alone.
"""

from __future__ import annotations

import datetime
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import document_groups

KINDS = ("card", "iban", "ssn", "phone", "ipv4", "date", "email")
_ROUNDS = 8
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: Registered length of an IBAN by country (ISO 13616).
# fmt: off
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28,
    "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24,
    "FI": 18, "FK": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27,
    "JO": 30,
    "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25,
    "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30,
    "NI": 28, "NL": 18, "NO": 15,
    "OM": 23,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29,
    "RO": 24, "RS": 22, "RU": 33,
    "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26,
    "UA": 29,
    "VA": 22, "VG": 24,
    "XK": 20,
    "YE": 30,
}
# fmt: on
#: Calling codes of one and two digits (ITU E.164); all others have three.
CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_PATTERN = re.compile(
    r"(?P<iban>(?<![^\W_])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![^\W_]))"
    r"|(?P<card>(?<![\w.+-])(?:\d{13,19}|\d{4}(?P<s>[ -])\d{4}(?P=s)\d{4}(?P=s)\d{1,7}|\d{4}(?P<r>[ -])\d{6}(?P=r)\d{4,5})(?![\w-]|\.\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\w/-]|\.\d))"
    r"|(?P<ipv4>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d))"
)
_DIGIT = re.compile("[0-9]")
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])(?P<email>[A-Za-z0-9._%+-]+)@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")


class Feistel:
    """Keyed permutation of the whole numbers below `size`."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size, self.half = size, max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.seed = hashlib.blake2b(tweak.encode(), key=hashlib.sha256(key).digest(), digest_size=32).digest()

    def _round(self, i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(i.to_bytes(1, "big") + x.to_bytes((self.half + 7) // 8, "big"), key=self.seed).digest(), "big") & self.mask

    def forward(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for i in range(_ROUNDS):
                a, b = b, a ^ self._round(i, b)
            x = a << self.half | b
            if x < self.size:
                return x

    def backward(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for i in reversed(range(_ROUNDS)):
                a, b = b ^ self._round(i, a), a
            x = a << self.half | b
            if x < self.size:
                return x


def luhn_digit(payload: str) -> int:
    """Check digit that makes payload valid."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _kind_of_day(ordinal: int) -> tuple[bool, bool, bool]:
    """What a date keeps: whether its day is above 12, and how many digits day and month have."""
    d = datetime.date.fromordinal(ordinal)
    return d.day > 12, d.day < 10, d.month < 10


def _in_layout(old: str, new: str) -> str:
    """The characters of new at the letters and digits of old."""
    rest = iter(new)
    return "".join(next(rest) if c.isalnum() else c for c in old)


def _ends(s: str) -> list[int]:
    """Where an IBAN at the beginning of s may end: at its country's length, or else at any token border, the last first."""
    ends = [len(s), *(i for i in range(len(s) - 1, 0, -1) if s[i] == " ")]
    own = IBAN_LENGTHS.get(s[:2])
    return sorted(ends, key=lambda i: len(s[:i].replace(" ", "")) != own)


class Pseudonymizer:
    def __init__(self, key: bytes, undo: bool = False):
        self.key, self.undo, self.nets, self.known = key, undo, {}, {}

    def _move(self, kind: str, size: int, x: int, valid=None) -> int:
        net = self.nets.get((kind, size))
        if net is None:
            net = self.nets[kind, size] = Feistel(self.key, f"{kind}/{size}", size)
        while True:  # a walk along the permutation's cycle ends, at x itself if need be
            x = net.backward(x) if self.undo else net.forward(x)
            if valid is None or valid(x):
                return x

    def _digits(self, kind: str, digits: str, valid=None) -> str:
        return str(self._move(kind, 10 ** len(digits), int(digits), valid)).zfill(len(digits))

    def card(self, s: str) -> str | None:
        digits = re.sub(r"\D", "", s)
        if not 13 <= len(digits) <= 19 or len(set(digits)) == 1 or luhn_digit(digits[:-1]) != int(digits[-1]):
            return None
        payload = self._digits("card", digits[:-1], lambda x: x > 0)
        return _in_layout(s, payload + str(luhn_digit(payload)))

    def iban(self, s: str) -> str | None:
        whole = s.replace(" ", "")
        number = lambda t: int("".join(str(int(c, 36)) for c in t))
        if not 15 <= len(whole) <= 34 or number(whole[4:] + whole[:4]) % 97 != 1:
            return None
        body = self._mixed("iban", whole[4:])
        return _in_layout(s, whole[:2] + f"{98 - number(body + whole[:2] + '00') % 97:02d}" + body)

    def ssn(self, s: str) -> str | None:
        good = lambda x: (a := x // 1_000_000) not in (0, 666) and a < 900 and x // 10_000 % 100 and x % 10_000
        digits = s.replace("-", "")
        return _in_layout(s, self._digits("ssn", digits, good)) if good(int(digits)) else None

    def phone(self, s: str) -> str | None:
        digits = re.sub(r"\D", "", s)
        code = next((digits[:k] for k in (1, 2) if digits[:k] in CODES), digits[:3]) if s[0] == "+" else ""
        rest = digits[len(code) :]
        if not 6 <= len(rest) <= 12 or len(digits) > 15:
            return None
        if code in ("", "1") and len(rest) == 10:
            kind, of = "phone-nanp", lambda x: x // 10**9 > 1 and x // 10**6 % 10 > 1
        else:
            kind, of = "phone", lambda x: x >= 10 ** (len(rest) - 1)
        own = of(int(rest))
        return _in_layout(s, code + self._digits(kind, rest, lambda x: of(x) == own))

    def ipv4(self, s: str) -> str | None:
        parts = [int(p) for p in s.split(".")]
        if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in s.split(".")):
            return None
        x = self._move("ipv4", 1 << 32, int.from_bytes(bytes(parts), "big"))
        return ".".join(map(str, x.to_bytes(4, "big")))

    def date(self, s: str) -> str | None:
        mark = next(c for c in s if not c.isdigit())
        parts = s.split(mark)
        orders = {"-": [(0, 1, 2)], ".": [(2, 1, 0)], "/": [(2, 0, 1), (2, 1, 0)]}[mark]
        for order in orders:
            try:
                day = datetime.date(*(int(parts[i]) for i in order)).toordinal()
            except ValueError:
                continue
            if _FIRST_DAY <= day <= _LAST_DAY:
                same = lambda x: _kind_of_day(_FIRST_DAY + x) == _kind_of_day(day)
                new = datetime.date.fromordinal(_FIRST_DAY + self._move("date", _LAST_DAY - _FIRST_DAY + 1, day - _FIRST_DAY, same))
                out = [""] * 3
                for i, v in zip(order, (new.year, new.month, new.day), strict=True):
                    out[i] = str(v).zfill(len(parts[i]))
                return mark.join(out)
        return None

    def _mixed(self, kind: str, s: str) -> str:
        """Letters become letters and digits digits; case and other characters stay."""
        letters, digits = [c for c in s if "a" <= c.lower() <= "z"], [c for c in s if "0" <= c <= "9"]
        if letters:
            x = 0
            for c in letters:
                x = x * 26 + ord(c.lower()) - 97
            x = self._move(f"{kind}-letters", 26 ** len(letters), x)
            for i in range(len(letters) - 1, -1, -1):
                x, d = divmod(x, 26)
                letters[i] = chr(d + (65 if letters[i].isupper() else 97))
        if digits:
            digits = list(self._digits(f"{kind}-digits", "".join(digits)))
        one, two = iter(letters), iter(digits)
        return "".join(next(one) if "a" <= c.lower() <= "z" else next(two) if "0" <= c <= "9" else c for c in s)

    def email(self, s: str) -> str | None:
        return self._mixed("email", s)

    def _new(self, kind: str, s: str) -> str | None:
        if (kind, s) not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[kind, s] = getattr(self, kind)(s)
        return self.known[kind, s]

    def text(self, t: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and how many of each kind.

        Mailboxes are found first and are closed to all other kinds, before and after: both ways the same spans are found.
        """
        found: dict[str, int] = {}
        changes: list[tuple[int, int, str]] = []
        open_ = t
        if "@" in t:
            out, at = [], 0
            for m in _EMAIL.finditer(t):
                changes.append((m.start(), m.end("email"), self._new("email", m["email"])))
                out += [t[at : m.start()], "x" * (m.end() - m.start())]
                at = m.end()
            open_ = "".join([*out, t[at:]])
            if changes:
                found["email"] = len(changes)

        at = 0 if _DIGIT.search(open_) else len(open_)  # all other kinds have digits
        while m := _PATTERN.search(open_, at):
            kind = next(k for k in KINDS if k in m.re.groupindex and m[k] is not None)
            at = m.end()
            for end in _ends(m[kind]) if kind == "iban" else [len(m[kind])]:
                new = self._new(kind, m[kind][:end])
                if new is not None:
                    found[kind] = found.get(kind, 0) + 1
                    at = m.start() + end
                    changes.append((m.start(), at, new))
                    break
            else:  # a failed number may have taken the beginning of the next
                if kind == "iban" and " " in m[0]:
                    at = m.start() + m[0].find(" ")

        out, at = [], 0
        for start, end, new in sorted(changes):
            out += [t[at:start], new]
            at = end
        return "".join([*out, t[at:]]), found


def _task(key: bytes, undo: bool):
    def run(batches):
        own = Pseudonymizer(key, undo)
        for rows, texts in document_groups(batches):
            out = [own.text(t.decode()) if t else (None if t is None else "", {}) for t in texts]
            counts = [pa.array([c.get(k, 0) for _, c in out], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([t for t, _ in out], pa.string()), *counts], ["doc_id", "text", *(f"n_{k}" for k in KINDS)])

    return run


def pseudonymize(docs: DataFrame, key: bytes, *, undo: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, the text with pseudonyms, and n_<kind> for each kind.

    A null text stays null and an empty one empty.  A text of any length is read whole.  Where two values could
    begin at one place, the first kind of IBAN, card, phone, ssn, date and address takes it.  Repeated rows change
    alike.  No row gives no row.  Other columns are ignored.  undo turns pseudonyms back under the same key,
    to the text as it was.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_task(key, undo), "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS))
