"""Personal data replaced by format-preserving Feistel pseudonyms.

A value that is found and validated - card and account numbers, dates, telephone numbers, network
addresses, national ids, mail addresses, keys and passwords - is permuted, under a secret key,
within the set of values of its own format.  The permutation depends on nothing else, so equal
values get equal pseudonyms in every document and on every executor, different ones stay
different, and nothing is shuffled or looked up.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import trimmed


ROUNDS = 8
#: Dates are permuted among the days of these years.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _round(key: bytes, tweak: str, i: int, value: int, modulus: int) -> int:
    size = (modulus.bit_length() + 7) // 8
    digest = hashlib.blake2b(f"{tweak}|{i}|{value}|{modulus}".encode(), key=key, digest_size=min(64, size + 8)).digest()
    return int.from_bytes(digest, "big") % modulus


def permute(key: bytes, tweak: str, value: int, modulus: int) -> int:
    """A keyed permutation of range(modulus): an alternating Feistel network over a * b >= modulus, cycle-walked."""
    if modulus < 2:
        return value
    a = 1
    while a * a < modulus:
        a <<= 1
    b = -(-modulus // a)
    while True:
        left, right = divmod(value, b)  # left < a, right < b
        for i in range(0, ROUNDS, 2):
            left = (left + _round(key, tweak, i, right, a)) % a
            right = (right + _round(key, tweak, i + 1, left, b)) % b
        value = left * b + right
        if value < modulus:
            return value


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def permute_symbols(key: bytes, tweak: str, text: str) -> str:
    """Digits become digits, small letters small letters, capitals capitals; everything else stays."""
    kinds = [next((k for k in (DIGITS, LOWER, UPPER) if c in k), None) for c in text]
    value, modulus = 0, 1
    for c, k in zip(text, kinds, strict=True):
        if k:
            value, modulus = value * len(k) + k.index(c), modulus * len(k)
    value = permute(key, tweak + "".join("-" if k is None else k[0] for k in kinds), value, modulus)
    out = list(text)
    for i in range(len(text) - 1, -1, -1):
        if k := kinds[i]:
            value, at = divmod(value, len(k))
            out[i] = k[at]
    return "".join(out)


def fill(pattern: str, digits: str) -> str:
    """``pattern`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in pattern)


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def card(key: bytes, text: str) -> str | None:
    digits = only_digits(text)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = permute_symbols(key, "card", digits[:-1])
    return fill(text, body + luhn_digit(body))


def address(key: bytes, text: str) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = permute(key, "ipv4", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
    return ".".join(map(str, value.to_bytes(4, "big")))


def date(order: str) -> Callable[[bytes, str], str | None]:
    """``order`` as ``ymd``; the separators and the width of a written day or month stay as formats, not as digits."""

    def change(key: bytes, text: str) -> str | None:
        numbers = re.findall("[0-9]+", text)
        got = dict(zip(order, map(int, numbers), strict=True))
        try:
            day = datetime.date(got["y"], got["m"], got["d"]).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        to = datetime.date.fromordinal(FIRST_DAY + permute(key, "date", day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1))
        new = iter([f"{ {'y': to.year, 'm': to.month, 'd': to.day}[c]:0{4 if c == 'y' else 2}d}" for c in order])
        return re.sub("[0-9]+", lambda _: next(new), text)

    return change


def telephone(key: bytes, text: str) -> str | None:
    digits = only_digits(text)
    if not 7 <= len(digits) <= 15:
        return None
    country = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)
    keep = len(only_digits(country[0])) if country else 0
    return fill(text, digits[:keep] + permute_symbols(key, f"tel{digits[:keep]}", digits[keep:]))


def social(key: bytes, text: str) -> str | None:
    area, group, serial = text.split("-")
    if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
        return None
    digits = only_digits(text)
    while True:  # walk on to a valid number: still a permutation of the valid ones
        digits = permute_symbols(key, "ssn", digits)
        if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000":
            return fill(text, digits)


def iban_check(country: str, body: str) -> str:
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(number) % 97:02d}"


def account(key: bytes, text: str) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_check(plain[:2], plain[4:]) != plain[2:4]:
        return None
    body = permute_symbols(key, "iban" + plain[:2], plain[4:])
    it = iter(plain[:2] + iban_check(plain[:2], body) + body)
    return "".join(" " if c == " " else next(it) for c in text)


def mail(key: bytes, text: str) -> str | None:
    local, _, domain = text.rpartition("@")
    return permute_symbols(key, "mail" + domain.lower(), local) + "@" + domain


def secret(key: bytes, text: str) -> str | None:
    return permute_symbols(key, "secret", text)


def hexadecimal(key: bytes, text: str) -> str | None:
    value = permute(key, f"hex{len(text)}", int(text, 16), 16 ** len(text))
    return f"{value:0{len(text)}x}"


def access_key(key: bytes, text: str) -> str | None:
    return text[:4] + permute_symbols(key, "access", text[4:])


#: Digits after the country code where all numbers of the country have as many.
NATIONAL = {"1": 10, "7": 10, "31": 9, "33": 9, "34": 9, "41": 9, "44": 10, "45": 8, "47": 8, "48": 9, "61": 9, "91": 10}


def whole(text: str) -> list[int]:
    """The ends to be tried for a match, in order: here only its own."""
    return [len(text)]


def longest_first(text: str) -> list[int]:
    """Its own end and those before a blank, as the next word may be no part of the value."""
    return [len(text)] + [i for i in range(len(text) - 1, 0, -1) if text[i] == " "]


def card_ends(text: str) -> list[int]:
    """Its own end, then those before a separator, while no group is shorter than three digits (a list of small numbers is no card)."""
    stop = next((m.start() for m in re.finditer("[0-9]+", text) if len(m[0]) < 3), len(text))
    return [len(text)] + [i for i in range(min(stop, len(text) - 1), 0, -1) if text[i] in " -"]


def telephone_ends(text: str) -> list[int]:
    """The end that fits the country's length; else where, of ten digits or more, a blank follows groups that had other marks; then the longest."""
    ends = longest_first(text)
    country = re.match(r"\+([0-9]{1,3})(?=[ .(-])", text)
    sure = [e for e in ends if country and len(only_digits(text[:e])) == len(country[1]) + NATIONAL.get(country[1], 99)]
    marked = re.search(r"[0-9][.\-][0-9]", text[country.end() + 1 :] if country else text)
    from_ = marked.start() + (country.end() + 1 if country else 0) if marked else len(text)
    apart = [e for e in reversed(ends) if from_ < e and len(only_digits(text[:e])) >= 10]
    return sure + apart + ends


#: kind, pattern, pseudonym or None where the value is not valid, ends to try.  The first that is valid at a place counts.
KINDS: list[tuple[str, str, Callable[[bytes, str], str | None], Callable[[str], list[int]]]] = [
    ("mail", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9À-ɏ][A-Za-z0-9À-ɏ._%+\-]{0,63}@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+", mail, whole),
    ("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", access_key, whole),
    ("hex_secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9])", hexadecimal, whole),
    ("secret", r"(?<=password=)[^\s\"',;]{6,}", secret, whole),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", account, longest_first),
    ("date_ymd", r"(?<![0-9A-Za-z.\-/])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-SU-Za-z\-]|T(?![0-9]{2}))", date("ymd"), whole),
    ("date_dmy", r"(?<![0-9A-Za-z.\-/])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9A-Za-z\-])", date("dmy"), whole),
    ("date_mdy", r"(?<![0-9A-Za-z.\-/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9A-Za-z\-/])", date("mdy"), whole),
    ("date_dmy", r"(?<![0-9A-Za-z.\-/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9A-Za-z\-/])", date("dmy"), whole),
    ("ipv4", r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])", address, whole),
    ("ssn", r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])", social, whole),
    ("card", r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{4,5}|[0-9]{4}-[0-9]{6}-[0-9]{4,5})(?![0-9A-Za-z])", card, whole),
    ("telephone", r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}(?![0-9A-Za-z])", telephone, telephone_ends),
    ("telephone", r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\) ?|[0-9]{3}[.\-])[0-9]{3}[.\-][0-9]{4}(?![0-9A-Za-z])", telephone, whole),
    ("card", r"(?<![0-9A-Za-z])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z])", card, card_ends),
]
#: The last kind, a card in unusual groups, gives way to any other value that begins within it.
UNUSUAL = len(KINDS) - 1
#: One scan for all kinds; a place without a digit, an @ or one of the marks can't start a value.
PATTERN = re.compile("|".join(f"({p})" for _, p, _, _ in KINDS))
SINGLE = [re.compile(p) for _, p, _, _ in KINDS]
TOKEN = re.compile("[0-9A-Za-z]+|.", re.DOTALL)
MAY_HOLD = re.compile(r"[0-9@]|password=")


def pseudonymize(text: str, key: bytes, known: dict[tuple[int, str], str | None]) -> tuple[str, list[str]]:
    """The text with pseudonyms and the kinds of the values replaced, in order.

    Where no kind is valid at a place, neither whole nor up to an earlier end, the scan goes on at the next token.
    """

    def valid(kind: int, at: int) -> tuple[int, str] | None:
        """(end, pseudonym) of the first valid end."""
        m = SINGLE[kind].match(text, at)
        for n in KINDS[kind][3](m[0]) if m else ():
            own = m[0][:n]
            if (kind, own) not in known:
                known[kind, own] = KINDS[kind][2](key, own)
            if known[kind, own] is not None:
                return at + n, known[kind, own]
        return None

    def holds_other(at: int, end: int) -> bool:
        return any(valid(kind, at + m.end()) for m in re.finditer("[ -]", text[at:end]) for kind in range(UNUSUAL))

    kinds, out, done, at, tried = [], [], 0, 0, 0
    while m := PATTERN.search(text, at):
        at, found = m.start(), None
        for kind in range(m.lastindex - 1, UNUSUAL):
            if found := valid(kind, at):
                break
        else:
            kind = UNUSUAL
            n = SINGLE[kind].match(text, at)
            if n and (at >= tried or min(map(len, re.findall("[0-9]+", n[0]))) > 2):  # small numbers are tried once, not from each of them on
                found = valid(kind, at)
                if found and holds_other(at, found[0]):
                    found = None
                tried = n.end()
        if found:
            out += text[done:at], found[1]
            kinds.append(KINDS[kind][0])
            done = at = found[0]
        else:
            at = TOKEN.match(text, at).end()
    return "".join(out) + text[done:], kinds


def replace_personal_data(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``pii_found`` long and ``pii_kinds`` (sorted, distinct).

    Other columns are kept as they are (columns of those two names are replaced).  A null text
    stays null, empty texts stay empty, repeated rows stay repeated.  No shuffle.
    """
    kept = docs.drop("pii_found", "pii_kinds")
    started = kept.withColumns({"pii_found": F.lit(0).cast("long"), "pii_kinds": F.array().cast("array<string>")})

    @trimmed
    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, str], str | None] = {}
        for b in batches:
            texts, found, kinds = [], [], []
            for text in b.column("text").to_pylist():
                own: list[str] = []
                if text and MAY_HOLD.search(text):
                    text, own = pseudonymize(text, key, known)
                texts.append(text)
                found.append(len(own))
                kinds.append(sorted(set(own)))
            if len(known) > 200_000:
                known.clear()
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            columns |= {"text": pa.array(texts, b.schema.field("text").type), "pii_found": pa.array(found, pa.int64()), "pii_kinds": pa.array(kinds, b.schema.field("pii_kinds").type)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=b.schema)

    return started.mapInArrow(change, started.schema)
