"""PII (operator 5): format-preserving pseudonyms from keyed Feistel permutations.

Each kind of value (e-mail, phone, card, IBAN, social security number, IPv4 address, date) is validated,
turned into a number of its format's own range, permuted within that range by a keyed cipher, and written
back in the same format, check digits included. Equal values get equal pseudonyms in all documents,
whatever their separators, and no value is its own pseudonym.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm import common

KINDS = ("email", "iban", "card", "ssn", "phone", "ipv4", "date")


class Permutation:
    """A keyed permutation of 0 .. size-1 without fixed points.

    A Feistel network over two halves of nearly equal range, walked until it falls inside the range, gives
    a permutation P; the result is P backwards of (P + 1 modulo size), which never is the value itself.
    """

    ROUNDS = 8

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.secret = hashlib.blake2b(key + tweak.encode() + b":%x" % size, digest_size=32).digest()
        self.left = 1
        while self.left * self.left < size:
            self.left <<= 1
        self.right = -(-size // self.left)
        self.width = (self.left.bit_length() + 7) // 8

    def _round(self, number: int, half: int) -> int:
        """64 bits more than a half has, so that the remainder by its range is even."""
        made = hashlib.shake_256(self.secret + bytes([number]) + half.to_bytes(self.width, "big"))
        return int.from_bytes(made.digest(self.width + 8), "big")

    def _forward(self, value: int) -> int:
        a, b = divmod(value, self.right)
        for r in range(self.ROUNDS):
            if r % 2:
                b = (b + self._round(r, a)) % self.right
            else:
                a = (a + self._round(r, b)) % self.left
        return a * self.right + b

    def _backward(self, value: int) -> int:
        a, b = divmod(value, self.right)
        for r in reversed(range(self.ROUNDS)):
            if r % 2:
                b = (b - self._round(r, a)) % self.right
            else:
                a = (a - self._round(r, b)) % self.left
        return a * self.right + b

    def _walk(self, step, value: int) -> int:
        value = step(value)
        while value >= self.size:
            value = step(value)
        return value

    def __call__(self, value: int) -> int:
        if self.size < 2:
            return value
        return self._walk(self._backward, (self._walk(self._forward, value) + 1) % self.size)


#: Ranges that a character stays in.
_CLASSES = ("01", "23456789", "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _permuted(text: str, classes: list[str | None], key: bytes, tweak: str) -> str:
    """text with each character replaced by one of its class, as one number in mixed radix; None: it stays."""
    size, value = 1, 0
    for c, cls in zip(text, classes, strict=True):
        if cls:
            size *= len(cls)
            value = value * len(cls) + cls.index(c)
    value = Permutation(key, tweak, size)(value)
    out = []
    for c, cls in zip(reversed(text), reversed(classes), strict=True):
        if cls:
            value, at = divmod(value, len(cls))
            c = cls[at]
        out.append(c)
    return "".join(reversed(out))


def _refill(shape: str, symbols: str) -> str:
    """shape with its letters and digits replaced in order."""
    it = iter(symbols)
    return "".join(next(it) if c.isalnum() else c for c in shape)


#: What a digit counts where Luhn's rule doubles it.
_DOUBLED = {str(d): sum(divmod(2 * d, 10)) for d in range(10)}


def luhn_digit(digits: str) -> str:
    return str(-(sum(map(int, digits[-2::-2])) + sum(map(_DOUBLED.__getitem__, digits[::-2]))) % 10)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


#: Letters of a local part that are permuted as one number: as many as a valid one has (RFC 5321).
LOCAL = 64


def email(found: str, key: bytes) -> str | None:
    """The local part changes, letters to letters and digits to digits; the domain stays. Case doesn't count.

    A local part over LOCAL characters is cut in pieces, each with a permutation of its own.
    """
    local, _, domain = found.rpartition("@")
    low = local.lower()
    out, changed = [], False
    for at in range(0, len(low), LOCAL):
        piece = low[at : at + LOCAL]
        classes = [_CLASSES[2] if c.isdigit() else _CLASSES[3] if c.isalpha() else None for c in piece]
        changed |= any(classes)
        out.append(_permuted(piece, classes, key, f"email{at}@{domain.lower()}") if any(classes) else piece)
    return f"{''.join(out)}@{domain}" if changed else None


def _card_digits(found: str) -> str:
    """The digits of a valid card number, else nothing."""
    digits = found.replace(" ", "").replace("-", "")
    return digits if 13 <= len(digits) <= 19 and luhn_digit(digits[:-1]) == digits[-1] and digits.strip(digits[0]) else ""


def card(found: str, key: bytes) -> str | None:
    """13 to 19 digits with a right Luhn digit; the first digit stays, and the Luhn digit is made right again."""
    digits = _card_digits(found)
    if not digits:
        return None
    body = _permuted(digits[:-1], [None] + [_CLASSES[2]] * (len(digits) - 2), key, "card")
    return _refill(found, body + luhn_digit(body))


def iban(found: str, key: bytes) -> str | None:
    """Check digits modulo 97 right; country stays, the account changes class by class, check digits follow."""
    plain = found.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    account = plain[4:]
    account = _permuted(account, [_CLASSES[2] if c.isdigit() else _CLASSES[4] for c in account], key, "iban" + plain[:2])
    check = 98 - _mod97(account + plain[:2] + "00")
    return _refill(found, plain[:2] + f"{check:02d}" + account)


def ssn(found: str, key: bytes) -> str | None:
    """Area 001-899 but 666, group 01-99, serial 0001-9999."""
    area, group, serial = int(found[:3]), int(found[4:6]), int(found[7:])
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(Permutation(key, "ssn", 898 * 99 * 9999)(value), 9999)
    area, group = divmod(value, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def phone(found: str, key: bytes) -> str | None:
    """10 digits after the country's: each stays in 0-1 or 2-9 where numbering plans tell these apart."""
    digits = re.sub(r"\D", "", found)
    code = "" if len(digits) == 10 else digits[: len(digits) - 10]
    own = digits[len(code) :]
    classes = [next(cls for cls in _CLASSES if c in cls) if i in (0, 3) else _CLASSES[2] for i, c in enumerate(own)]
    return _refill(found, code + _permuted(own, classes, key, "phone"))


def ipv4(found: str, key: bytes) -> str | None:
    octets = [int(x) for x in found.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in found.split(".")):
        return None
    value = Permutation(key, "ipv4", 1 << 32)(int.from_bytes(bytes(octets), "big"))
    return ".".join(map(str, value.to_bytes(4, "big")))


_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049  # 1900 to 2099


def date(found: str, key: bytes) -> str | None:
    """A calendar day of 1900 to 2099 as y-m-d, d.m.y or m/d/y, two digits each for day and month."""
    mark = next(c for c in found if not c.isdigit())
    a, b, c = map(int, found.split(mark))
    y, m, d = {"-": (a, b, c), ".": (c, b, a), "/": (c, a, b)}[mark]
    try:
        at = datetime.date(y, m, d).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    if not 0 <= at < _DAYS:
        return None
    new = datetime.date.fromordinal(Permutation(key, "date", _DAYS)(at) + _FIRST_DAY)
    return {"-": f"{new.year:04d}-{new.month:02d}-{new.day:02d}", ".": f"{new.day:02d}.{new.month:02d}.{new.year:04d}", "/": f"{new.month:02d}/{new.day:02d}/{new.year:04d}"}[mark]


_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_NUMBERS = re.compile(
    r"(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9.+-])(?:"
    r"(?P<card>[0-9](?:[ -]?[0-9]){12,18})(?![0-9])"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"
    r"|(?P<ipv4>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9]|\.[0-9])"
    r"|(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])"
    r")"
    r"|(?<![A-Za-z0-9])(?P<phone>\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])"
)
_MAKE = {"email": email, "card": card, "iban": iban, "ssn": ssn, "phone": phone, "ipv4": ipv4, "date": date}
_DIGIT = re.compile("[0-9]")


#: The alternatives of _NUMBERS one by one, to try what a match that fails its check leaves.
_ALONE = {
    kind: re.compile(rf"{before}(?:{pattern}){after}")
    for kind, before, pattern, after in (
        ("iban", "(?<![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", "(?![A-Za-z0-9])"),
        ("card", "(?<![A-Za-z0-9.+-])", "[0-9](?:[ -]?[0-9]){12,18}", "(?![0-9])"),
        ("ssn", "(?<![A-Za-z0-9.+-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "(?![0-9-])"),
        ("ipv4", "(?<![A-Za-z0-9.+-])", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", r"(?![0-9]|\.[0-9])"),
        ("date", "(?<![A-Za-z0-9.+-])", r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}", "(?![0-9])"),
        ("phone", "(?<![A-Za-z0-9])", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}", "(?![0-9])"),
    )
}
_JOINED = re.compile("-[0-9]")


def _ends(kind: str, text: str, start: int) -> list[int]:
    """Where a value of the kind from start can end, the longest first; iban and card can stop at each separator."""
    m = _ALONE[kind].match(text, start)
    if not m:
        return []
    shorter = [e for e in range(m.end() - 1, start, -1) if text[e] in " -" and text[e - 1] not in " -"] if kind in ("iban", "card") else []
    return [m.end(), *shorter]


def _number_at(text: str, start: int, key: bytes, free: Callable[[int, int], bool]) -> tuple[int, int, str, str] | None:
    """The valid number from start: IBAN, whole values of a fixed shape, cards, values of a shape with a hyphen and digits after.

    A card that stops inside a run of digits gives way to a longer one from a later start in it.
    """

    def tried(kind: str, end: int):
        new = _MAKE[kind](text[start:end], key) if free(start, end) else None
        return (start, end, kind, new) if new else None

    shapes = [(kind, end) for kind in ("ssn", "ipv4", "date", "phone") for end in _ends(kind, text, start)]
    for kind, end in [*(("iban", e) for e in _ends("iban", text, start)), *(x for x in shapes if not _JOINED.match(text, x[1]))]:
        if got := tried(kind, end):
            return got
    for i, end in enumerate(_ends("card", text, start)):
        if got := tried("card", end):
            n = sum(map(str.isdigit, text[start:end]))
            later = ((s, e) for s in range(start + 1, end) for e in _ends("card", text, s)) if i else ()
            if not any(sum(map(str.isdigit, text[s:e])) > n and free(s, e) and _card_digits(text[s:e]) for s, e in later):
                return got
    return next(filter(None, (tried(*x) for x in shapes)), None)


def emails(text: str) -> list[tuple[int, int]]:
    """(start, end) of local parts with a domain of two labels or more, leftmost and non-overlapping.

    Each @ looks left and right, never past the last one: linear in the text.
    """
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return found


def replacements(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym), by start, without overlaps: e-mails first, then numbers from left to right.

    Where no kind has a valid value from a start, the search goes on from the next one. Linear in the text
    but for the search in the e-mails, which is logarithmic for each number.
    """
    found = []
    for start, end in emails(text):
        new = email(text[start:end], key)
        if new:
            found.append((start, end, "email", new))
    if _DIGIT.search(text):
        starts, ends = [f[0] for f in found], [f[1] for f in found]

        def free(start: int, end: int) -> bool:
            i = bisect_left(starts, end)  # the last e-mail that starts before end
            return not i or ends[i - 1] <= start

        at = 0
        while m := _NUMBERS.search(text, at):
            got = _number_at(text, m.start(), key, free)
            if got:
                found.append(got)
            at = got[1] if got else m.start() + 1
    return sorted(found)


FOUND = T.StructField("pii", T.ArrayType(T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)]), False), False)


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with personal data in text replaced, and pii: kind, start and end (code points of the old text).

    Narrow. Null text stays null and has no pii. Repeated rows stay. A column pii of docs is replaced.
    Values that fail validation (a wrong check digit, no such day) stay as they are.
    """
    names = docs.columns if keep is None else keep

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        texts, flat, ends = [], [], [0]
        for t in common.texts_of(part, text):
            found = replacements(t, key) if t else []
            if found:
                pieces, done = [], 0
                for start, end, _, new in found:
                    pieces += [t[done:start], new]
                    done = end
                t = "".join([*pieces, t[done:]])
                flat += found
            texts.append(t)
            ends.append(len(flat))
        parts = pa.StructArray.from_arrays([pa.array([f[2] for f in flat], pa.string()), pa.array([f[0] for f in flat], pa.int64()), pa.array([f[1] for f in flat], pa.int64())], fields=[pa.field("kind", pa.string(), False), pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False)])
        return [pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)]

    made = common.add_columns(docs, [T.StructField(text, T.StringType(), True), FOUND], compute, text, keep)
    return made.select(*[c for c in names if c.lower() != "pii"], *([text] if text not in names else []), "pii")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms, and how many values of each kind were found.

    A null text stays null with no values, an empty one empty; repeated rows each have their row.
    """
    made = pseudonymise(common.table(spark, sf_dir, "documents").select("doc_id", "text"), b"a key of the operator's owner")
    return made.select("doc_id", "text", *[F.size(F.expr(f"filter(pii, p -> p.kind = '{kind}')")).cast("long").alias(f"n_{kind}") for kind in KINDS], "pii")
