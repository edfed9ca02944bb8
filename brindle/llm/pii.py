"""Format-preserving pseudonyms of personal data.

Numbers and dates are validated (card and account check digits, number ranges,
the calendar), mapped to an index within their format, permuted there by a keyed
Feistel network with cycle walking and written back with the same separators.
The permutation depends on the key and the kind only, so equal values
have equal pseudonyms in all documents and formats, different values different
ones, and whoever holds the key can undo it (but for dates with strokes or hyphens whose
day and month could change places).

Kinds: e-mail addresses (the registered domain stays), telephone numbers (a country code after ``+`` or
``00`` stays and is told by its first digits, so spaces do not matter), IPv4 addresses, payment cards (Luhn stays valid), IBANs (check digits
stay valid), US social security numbers, dates in five forms (the time of a timestamp stays), access keys
and assigned secrets (letters stay letters, digits digits).  A national number is told from an international one
by its signs alone: without ``+``, ``00`` or the North American form its country is not known.

Defined results: a null text stays null; an empty text stays empty; a text of any length is read whole; what does not
validate is left alone, but for valid cards and IBANs of whole groups within it (undoing
these fails should the pseudonym and the groups beside it happen to be valid as a whole); repeated rows have equal results; an empty table gives no
rows; all columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROUNDS = 10
#: For tests and examples; a deployment passes its own.
EXAMPLE_KEY = b"example key, replace in use"


class Feistel:
    """A keyed permutation of range(size), for each kind and size."""

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()

    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        out, block = b"", 0
        while len(out) < size:
            out += hmac.digest(self.key, b"%b|%d|%d|%d" % (tweak, i, block, half), "sha256")
            block += 1
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def permute(self, value: int, size: int, kind: str, undo: bool = False) -> int:
        if size < 2:
            return value
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        mask, tweak = (1 << bits) - 1, b"%b|%d" % (kind.encode(), size)
        while True:
            left, right = value >> bits, value & mask
            for i in reversed(range(ROUNDS)) if undo else range(ROUNDS):
                if undo:
                    left, right = right ^ self._round(tweak, i, left, bits), left
                else:
                    left, right = right, left ^ self._round(tweak, i, right, bits)
            value = left << bits | right
            if value < size:
                return value


def luhn_digit(payload: str) -> int:
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(payload))))
    return -total % 10


def is_card(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == int(digits[-1]) and len(set(digits)) > 1


def iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def phone_form(plus: bool, digits: str) -> tuple[int, str, bool]:
    """(digits that stay, country code or "", whether it is a North American number)."""
    lead, code = 2 * (not plus and digits.startswith("00")), ""
    if plus or lead:
        code = next((c for c in SHORT_CODES if digits.startswith(c, lead)), digits[lead : lead + 3])
    elif len(digits) == 11 and digits[0] == "1":
        code = "1"
    rest = digits[lead + len(code) :]
    american = code in ("", "1") and len(rest) == 10 and rest[0] in "23456789" and rest[3] in "23456789"
    if not (plus or lead or american):
        code = ""
    return lead + len(code), code, american


def _with_digits(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


# What is looked for. A value is not part of a longer word or number.
PATTERNS = {
    "secret": r"""(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)["']?\s?(?:=\s?["']?|:\s?["']?(?=\S*\d)))(?P<secret_value>[A-Za-z0-9_+/.~-]{6,})""",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:ghp_|sk_live_|xoxb-)[A-Za-z0-9-]{16,}",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "date": r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?:(?=T\d)|(?![\w/-]|\.\d))",
    "card": r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?![\w-]|\.\d)|(?<![\w.])\+\d{8,14}(?!\w)",
}
SCAN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
#: Kinds with check digits whose pattern may take words beside the value: parts are tried if the whole fails.
PARTS = {k: re.compile(PATTERNS[k]) for k in ("iban", "card")}
#: A text without any of these has nothing that is looked for.
MAY_HAVE = re.compile(r"[0-9@=:]|AKIA|ASIA|ghp_|sk_live_|xoxb-")
#: Country codes of one and of two digits; all others have three (fixed values).
SHORT_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: A date is permuted within the days of so many years, counted from 1900.
BLOCK_YEARS = 200


class Pseudonyms:
    """Finds personal data and gives each value its pseudonym (``undo``: the value of a pseudonym)."""

    def __init__(self, key: bytes = EXAMPLE_KEY, undo: bool = False):
        self.feistel, self.undo = Feistel(key), undo
        self.known: dict[tuple[str, str], str | None] = {}

    def _permute(self, value: int, size: int, kind: str) -> int:
        return self.feistel.permute(value, size, kind, self.undo)

    def letters(self, text: str, kind: str, hexadecimal: bool = True) -> str:
        """Letters for letters and digits for digits; a run in hexadecimal stays hexadecimal."""
        if len(text) > 48:
            return "".join(self.letters(text[i : i + 48], f"{kind}{i}", hexadecimal) for i in range(0, len(text), 48))
        hexa = hexadecimal and re.fullmatch(r"[0-9a-f]{16,}", text)
        sets = ["0123456789abcdef" if hexa else "0123456789" if "0" <= c <= "9" else "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if "A" <= c <= "Z" else c for c in text]
        value, size = 0, 1
        for c, s in zip(text, sets):
            value, size = value * len(s) + s.index(c), size * len(s)
        value, out = self._permute(value, size, kind + "".join(s[0] for s in sets)), []
        for s in reversed(sets):
            value, at = divmod(value, len(s))
            out.append(s[at])
        return "".join(reversed(out))

    def secret(self, m: str) -> str:
        return self.letters(m, "secret")

    def access_key(self, m: str) -> str:
        head = re.match(r"AKIA|ASIA|ghp_|sk_live_|xoxb-", m).group()
        return head + self.letters(m[len(head) :], "access key")

    def email(self, m: str) -> str:
        local, _, domain = m.rpartition("@")
        labels = domain.split(".")
        return ".".join([self.letters(local, "local") + "@" + (self.letters(labels[0], "host") if len(labels) > 2 else labels[0]), *labels[1:]])

    def ip(self, m: str) -> str | None:
        parts = [int(x) for x in m.split(".")]
        if max(parts) > 255:
            return None
        return ".".join(map(str, self._permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip").to_bytes(4, "big")))

    def card(self, m: str) -> str | None:
        digits = re.sub(r"\D", "", m)
        if not is_card(digits):
            return self.phone(m) if m != digits else None
        n = len(digits) - 2
        payload = digits[0] + f"{self._permute(int(digits[1:-1]), 10**n, 'card' + digits[0]):0{n}d}"
        return _with_digits(m, payload + str(luhn_digit(payload)))

    def iban(self, m: str) -> str | None:
        plain = m.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
            return None
        body = self.letters(plain[4:], "iban" + plain[:2], False)
        made = plain[:2] + f"{98 - iban_rest(plain[:2] + '00' + body):02d}" + body
        rest = iter(made)
        return "".join(c if c == " " else next(rest) for c in m)

    def ssn(self, m: str) -> str | None:
        area, group, serial = map(int, m.split("-"))
        areas = [a for a in range(1, 900) if a != 666]
        if area not in areas or not group or not serial:
            return None
        value = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
        value, serial = divmod(self._permute(value, len(areas) * 99 * 9999, "ssn"), 9999)
        area, group = divmod(value, 99)
        return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"

    def date(self, m: str) -> str | None:
        parts = re.split(r"\D", m)
        year_first = len(parts[0]) == 4
        year, month, day = map(int, parts if year_first else reversed(parts))
        american = not year_first and (("/" in m and day <= 12) or ("." not in m and month > 12))
        if american:  # month first: with strokes if it can be, with hyphens only if the other order is no date
            month, day = day, month
        try:
            at = date(year, month, day).toordinal()
        except ValueError:
            return None
        first = 1900 + (year - 1900) // BLOCK_YEARS * BLOCK_YEARS
        if first < 1 or first + BLOCK_YEARS > 9999:
            return None
        low = date(first, 1, 1).toordinal()
        size = date(first + BLOCK_YEARS, 1, 1).toordinal() - low
        new = date.fromordinal(low + self._permute(at - low, size, f"date{first}"))
        sign = re.search(r"\D", m).group()
        if year_first:
            return f"{new.year:04d}{sign}{new.month:02d}{sign}{new.day:02d}"
        a, b = (new.month, new.day) if american else (new.day, new.month)
        return f"{a:0{len(parts[0])}d}{sign}{b:0{len(parts[1])}d}{sign}{new.year:04d}"

    def phone(self, m: str) -> str | None:
        digits = re.sub(r"\D", "", m)
        lead, code, american = form = phone_form(m[0] == "+", digits)
        if not 8 <= len(digits) - 2 * (m[0] != "+" and digits.startswith("00")) <= 15:
            return None
        rest = digits[lead:]
        while True:  # a value that is no number of the same form is permuted again
            if american:
                value, last = divmod(self._permute(((int(rest[:3]) - 200) * 800 + int(rest[3:6]) - 200) * 10_000 + int(rest[6:]), 800 * 800 * 10_000, "phone"), 10_000)
                a, b = divmod(value, 800)
                rest = f"{a + 200}{b + 200}{last:04d}"
            else:
                rest = f"{self._permute(int(rest), 10 ** len(rest), 'phone' + code):0{len(rest)}d}"
            if phone_form(m[0] == "+", digits[:lead] + rest) == form:
                return _with_digits(m, digits[:lead] + rest)

    def value(self, kind: str, text: str) -> str | None:
        at = (kind, text)
        if at not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[at] = getattr(self, kind)(text)
        return self.known[at]

    def _part(self, kind: str, text: str, start: int, end: int) -> tuple[int, int, str] | None:
        """(start, end, pseudonym) of the first, then longest valid card or IBAN of whole groups from within a match that fails."""
        for at in [start, *(m.end() for m in re.compile("[ -]").finditer(text, start, end))] if kind in PARTS else []:
            m = PARTS[kind].match(text, at)
            stop = m.end() if m else 0
            while stop > at:
                own = text[at:stop]
                if kind == "iban" or 13 <= len(digits := re.sub(r"\D", "", own)) and is_card(digits):
                    if (new := self.value(kind, own)) is not None:
                        return at, stop, new
                stop = max(text.rfind(" ", at, stop), text.rfind("-", at, stop))
        return None

    def __call__(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of each in it."""
        if not MAY_HAVE.search(text):
            return text, []
        out, spans, at, size, low = [], [], 0, 0, 0
        while m := SCAN.search(text, low):
            kind = m.lastgroup if m.lastgroup != "secret_value" else "secret"
            start, end = m.span("secret_value") if kind == "secret" else m.span()
            low = m.end()
            new = self.value(kind, text[start:end])
            if new is None:
                if not (part := self._part(kind, text, start, end)):
                    continue
                start, end, new = part
                low = end
            if kind == "card" and not is_card(re.sub(r"\D", "", text[start:end])):
                kind = "phone"
            out += [text[at:start], new]
            size += start - at
            spans.append((kind, size, size + len(new)))
            size, at = size + len(new), end
        if not spans:
            return text, []
        return "".join(out) + text[at:], spans


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def pseudonymise(docs: DataFrame, key: bytes = EXAMPLE_KEY, text_col: str = "text", spans_col: str | None = None, undo: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in its text, and if asked for their places as array<struct<kind, start, end>>."""
    at = docs.columns.index(text_col)
    # Fields are told by place: names may clash.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = T.StructType([*plain.schema.fields, *([T.StructField("spans", SPANS)] if spans_col else [])])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, undo)
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                columns = list(batch.columns)
                done = [(None, None) if t is None else names(t) for t in columns[at].to_pylist()]
                columns[at] = pa.array([t for t, _ in done], columns[at].type)
                if spans_col:
                    columns.append(pa.array([None if s is None else [dict(zip(("kind", "start", "end"), x)) for x in s] for _, s in done], kind))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return plain.mapInArrow(run, schema).toDF(*docs.columns, *([spans_col] if spans_col else []))
