"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their validation (Luhn, IBAN check digits, real calendar
days, octets up to 255, assignable social security numbers, lengths of telephone numbers) are permuted
within their own format by a keyed Feistel network: a card stays a valid card of the same
network and length, a date a real date in the same notation. Letters and digits of mail
addresses are permuted class by class. The permutation depends on the key, the kind and
the value only, so equal values get equal pseudonyms in every document and task, nothing
is looked up or shuffled, and whoever has the key can undo it.

A null text stays null; a text without findings stays as it is. Repeated rows stay
repeated, with equal pseudonyms; an empty table gives an empty one.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import parts, small_batches
from .common import own_name

KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")
#: Feistel rounds; eight or more keep the halves apart at any domain size.
ROUNDS = 10
#: Pseudonyms kept in a worker before it starts anew.
CACHE = 100_000
#: First days of the spans of time that dates are permuted within; the last one is the end.
ERAS = tuple(datetime.date(y, 1, 1).toordinal() for y in (1, 1900, 2100)) + (datetime.date.max.toordinal() + 1,)
#: English month names.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")

_MONTH = "|".join(MONTHS)
_FIND = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9]))"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b)"
    r"|(?P<date>(?<![\w.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"
    rf"|(?:{_MONTH}) [0-9]{{1,2}}, [0-9]{{4}}|[0-9]{{1,2}} (?:{_MONTH}) [0-9]{{4}})(?:(?![\w-]|\.[0-9])|(?=T[0-9]{{2}})))"
    r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9]))"
    r"|(?P<card>(?<![\w.-])[2-6][0-9](?:[ -]?[0-9]){11,17}(?![\w]|[.-][0-9]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w.+-])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,5}\)?){2,6}(?!\w)"
    r"|(?<![\w.+-])(?:1[ .-]?)?\(?[0-9]{3}(?:\)[ .-]?|[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-]|\.[0-9]))"
)
#: A text without a digit or an at sign holds nothing to find.
_MAYBE = re.compile(r"[0-9@]")


#: Countries by the characters of their IBANs; those of other countries may have any length.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN_LENGTH = {country: n for n, some in IBAN_LENGTHS.items() for country in some.split()}


class Permutation:
    """Keyed permutations of ranges of integers: an unbalanced Feistel network with cycle walking."""

    def __init__(self, key: bytes):
        self.key = hmac.new(key, b"feistel", hashlib.sha256).digest()

    def _round(self, tweak: bytes, k: int, half: int, modulus: int) -> int:
        size = (modulus.bit_length() + 7) // 8 + 8
        width = (half.bit_length() + 7) // 8 or 1
        seed = hashlib.blake2b(k.to_bytes(1, "big") + tweak + b"\0" + half.to_bytes(width, "big"), key=self.key, digest_size=min(64, max(16, size)))
        digest = seed.digest()
        while len(digest) < size:
            digest += hashlib.blake2b(digest, key=self.key).digest()
        return int.from_bytes(digest[:size], "big") % modulus

    @staticmethod
    def _sides(n: int) -> tuple[int, int]:
        a = 1 << ((n - 1).bit_length() + 1) // 2
        return a, -(-n // a)

    def _walk(self, x: int, n: int, tweak: bytes, forward: bool) -> int:
        a, b = self._sides(n)
        tweak += b"|" + str(n).encode()
        while True:
            left, right = divmod(x, b)
            for k in range(ROUNDS) if forward else reversed(range(ROUNDS)):
                if k % 2 == 0:
                    f = self._round(tweak, k, right, a)
                    left = (left + (f if forward else -f)) % a
                else:
                    f = self._round(tweak, k, left, b)
                    right = (right + (f if forward else -f)) % b
            x = left * b + right
            if x < n:
                return x

    def apply(self, x: int, n: int, tweak: str) -> int:
        """The image of 0 <= x < n."""
        return self._walk(x, n, tweak.encode(), True) if n > 1 else x

    def undo(self, x: int, n: int, tweak: str) -> int:
        return self._walk(x, n, tweak.encode(), False) if n > 1 else x


Mapping = Callable[[int, int, str], int]


def luhn_digit(digits: str) -> str:
    """The check digit that makes ``digits`` plus it pass."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _iban_check(country: str, body: str) -> str:
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _put(shape: str, symbols: str) -> str:
    """``shape`` with its letters and digits replaced in order."""
    it = iter(symbols)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _by_class(value: str, move: Mapping, tweak: str) -> str:
    """Letters and digits (ASCII) permuted together, each within its class; other characters stay."""
    bases = [10 if c in "0123456789" else 26 if c.isascii() and c.isalpha() else 1 for c in value]
    n = x = 0
    for c, b in zip(value, bases, strict=True):
        if b > 1:
            n, x = max(n, 1) * b, x * b + (int(c) if b == 10 else ord(c.lower()) - 97)
    if n < 2:
        return value
    shape = "".join(c if b == 1 else "0" if b == 10 else "A" if c.isupper() else "a" for c, b in zip(value, bases, strict=True))
    y = move(x, n, f"{tweak}|{shape}")
    out = []
    for c, b in zip(reversed(shape), reversed(bases), strict=True):
        if b == 1:
            out.append(c)
        else:
            y, d = divmod(y, b)
            out.append(str(d) if b == 10 else chr(d + (65 if c == "A" else 97)))
    return "".join(reversed(out))


def _email(value: str, move: Mapping) -> str:
    local, _, domain = value.partition("@")
    name, _, top = domain.rpartition(".")
    return f"{_by_class(local, move, 'local')}@{_by_class(name, move, 'domain')}.{top}"


def _card(value: str, move: Mapping) -> str | None:
    digits = re.sub(r"[ -]", "", value)
    if len(set(digits)) < 2 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    inner = digits[1:-1]
    y = f"{move(int(inner), 10 ** len(inner), 'card' + digits[0]):0{len(inner)}d}"
    return _put(value, digits[0] + y + luhn_digit(digits[0] + y))


def _iban(value: str, move: Mapping) -> str | None:
    flat = value.replace(" ", "")
    country, check, body = flat[:2], flat[2:4], flat[4:]
    if not 15 <= len(flat) <= 34 or _iban_check(country, body) != check:
        return None
    made = _by_class(body, move, "iban" + country)
    return _put(value, country + _iban_check(country, made) + made)


def _ssn(value: str, move: Mapping) -> str | None:
    area, group, serial = map(int, value.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    index = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rest, serial = divmod(move(index, 898 * 99 * 9999, "ssn"), 9999)
    area, group = divmod(rest, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(value: str, move: Mapping) -> str | None:
    digits = re.sub(r"[^0-9]", "", value)
    plus = value[0] == "+"
    if not 8 + 2 * (not plus) <= len(digits) <= 15:
        return None
    if digits[0] == "1" and plus or not plus:  # ten digits, area code and exchange from 200
        code, own = digits[:-10], digits[-10:]
        if code not in ("1", "1" * plus) or own[0] in "01" or own[3] in "01":
            return None
        index = (int(own[:3]) - 200) * 8_000_000 + (int(own[3:6]) - 200) * 10_000 + int(own[6:])
        area, rest = divmod(move(index, 800 * 8_000_000, "phone1"), 8_000_000)
        return _put(value, f"{code}{area + 200}{rest // 10_000 + 200}{rest % 10_000:04d}")
    code = re.match(r"\+([0-9]+)", value)[1][:3]  # the digits up to the first break stay
    if len(code) == len(digits):
        code = digits[:2]
    own = digits[len(code) :]
    if len(own) < 5:
        return None
    return _put(value, code + f"{move(int(own), 10 ** len(own), 'phone' + code):0{len(own)}d}")


def _unassigned(value: str, move: Mapping) -> str | None:
    """Telephone numbers of the ten-digit plan with an area code or exchange below 200, among themselves."""
    digits = re.sub(r"[^0-9]", "", value)
    plus = value[0] == "+"
    code, own = digits[:-10], digits[-10:]
    if len(own) != 10 or code not in ("1", "1" * plus) or own[0] not in "01" and own[3] not in "01":
        return None
    low = 200 * 10**7  # area codes below 200; after them, exchanges below 200 of the other areas
    index = int(own) if own[0] in "01" else low + (int(own[:3]) - 200) * 2_000_000 + int(own[3:])
    y = move(index, low + 800 * 2_000_000, "phone0")
    if y < low:
        return _put(value, f"{code}{y:010d}")
    area, rest = divmod(y - low, 2_000_000)
    return _put(value, f"{code}{area + 200}{rest:07d}")


def _ip(value: str, move: Mapping) -> str | None:
    octets = value.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    y = move(int.from_bytes(bytes(map(int, octets)), "big"), 2**32, "ip")
    return ".".join(map(str, y.to_bytes(4, "big")))


def _day(day: datetime.date, move: Mapping) -> datetime.date:
    """The image of a day, in its own span of ``ERAS``."""
    at = day.toordinal()
    first, end = next((a, b) for a, b in zip(ERAS, ERAS[1:], strict=False) if a <= at < b)
    return datetime.date.fromordinal(first + move(at - first, end - first, f"date{first}"))


def _date(value: str, move: Mapping) -> str | None:
    """Slashed dates are month first where that is a day of the calendar, else day first."""
    numbers = [int(x) for x in re.findall("[0-9]+", value)]
    orders = ["ymd"] if re.match("[0-9]{4}", value) else ["md", "dm"] if "/" in value else ["dm"] if "." in value else [""]
    named = next((k for k, m in enumerate(MONTHS, 1) if m in value), 0)
    for order in orders:
        y, m, d = (numbers if order == "ymd" else (numbers[-1], named, numbers[0]) if named else (numbers[2], numbers[0], numbers[1]) if order == "md" else (numbers[2], numbers[1], numbers[0]))
        try:
            new = _day(datetime.date(y, m, d), move)
        except ValueError:
            continue
        if named:
            return f"{MONTHS[new.month - 1]} {new.day}, {new.year:04d}" if value[0].isalpha() else f"{new.day} {MONTHS[new.month - 1]} {new.year:04d}"
        if order == "ymd":
            return f"{new.year:04d}-{new.month:02d}-{new.day:02d}".replace("-", value[4])
        mark = "/" if "/" in value else "."
        while order == "dm" and mark == "/" and new.day <= 12:  # else it would be read as month first
            new = _day(new, move)
        first, second = (new.month, new.day) if order == "md" else (new.day, new.month)
        wide = 2 if value[0] == "0" or value.split(mark)[1][0] == "0" or len(value) == 10 else 1
        return f"{first:0{wide}d}{mark}{second:0{wide}d}{mark}{new.year:04d}"
    return None


_MAKE: dict[str, Callable[[str, Mapping], str | None]] = {"email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "unassigned": _unassigned, "ip": _ip, "date": _date}


class Pseudonyms:
    """Finds and replaces; remembers recent values."""

    def __init__(self, key: str):
        self.move = Permutation(key.encode()).apply
        self.known: dict[tuple[str, str], str | None] = {}

    def of(self, kind: str, value: str) -> str | None:
        """The pseudonym of a value, None where the value isn't valid."""
        at = (kind, value)
        if at not in self.known:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[at] = _MAKE[kind](value, self.move)
        return self.known[at]

    def _valid(self, kind: str, value: str) -> str | None:
        made = self.of(kind, value)
        return self.of("unassigned", value) if made is None and kind == "phone" else made  # by format alone

    def spans(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of all findings, leftmost first."""
        at = 0
        while m := _FIND.search(text, at):
            kind, value = m.lastgroup, m[0]
            made = self._valid(kind, value)
            if made is None:
                value, made = next(((v, x) for v in _shorter(kind, value) if (x := self._valid(kind, v)) is not None), (value, None))
            if made is None:  # what starts with a failed match may hold another kind
                at = m.start() + 1
                while at < m.end() and text[at - 1].isalnum() and text[at].isalnum():
                    at += 1
                continue
            at = m.start() + len(value)
            yield m.start(), at, kind, made

    def replace(self, text: str) -> tuple[str, list[dict]]:
        if not _MAYBE.search(text):
            return text, []
        out, found, at = [], [], 0
        for a, b, kind, made in self.spans(text):
            out += [text[at:a], made]
            found.append({"start": a, "end": b, "kind": kind})
            at = b
        return ("".join(out) + text[at:] if found else text), found


def _card_lengths(digits: str) -> Sequence[int]:
    """The lengths that the card networks of a number's first digits use."""
    two, four = int(digits[:2]), int(digits[:4])
    if digits[0] == "4":
        return 13, 16, 19
    if two in (34, 37):
        return (15,)
    if two in (30, 36, 38, 39):
        return range(14, 20)
    if 51 <= two <= 55 or 2221 <= four <= 2720:
        return (16,)
    if 3528 <= four <= 3589 or two == 62:
        return range(16, 20)
    return range(13, 20)


def _shorter(kind: str, value: str) -> Iterator[str]:
    """What starts a failed match and may be valid itself: up to a break between groups, the longest first."""
    if kind not in ("card", "iban", "phone"):
        return
    for k in range(len(value) - 1, 0, -1):
        if value[k] in " .-(" and value[k - 1] not in " .-(":
            flat = re.sub(r"[^0-9A-Z]", "", value[:k])
            if kind == "phone" or kind == "card" and len(flat) in _card_lengths(flat) or kind == "iban" and len(flat) == _IBAN_LENGTH.get(flat[:2], len(flat)):
                yield value[:k]


_workers: dict[str, Pseudonyms] = {}


def pseudonymise(docs: DataFrame, key: str, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and the spans of the originals.

    key: the secret of the permutation. ``spans`` is an array of (start, end, kind) in
    code points of the original text, empty where there is nothing; it is null for a
    null text. A column of the input with that name is kept: the new one gets a number.
    """
    small_batches(docs)
    spans = own_name(docs, spans)
    kind = T._parse_datatype_string("array<struct<start:int,end:int,kind:string>>")
    schema = T.StructType([*docs.schema.fields, T.StructField(spans, kind)])
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _workers:
            _workers.clear()
            _workers[key] = Pseudonyms(key)
        for part in parts(batches):
            made = [(None, None) if t is None else _workers[key].replace(t) for t in part.column(where).to_pylist()]
            columns = part.columns
            columns[where] = pa.array([m[0] for m in made], part.column(where).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([m[1] for m in made], arrow)], names=schema.names)

    return docs.mapInArrow(run, schema)
