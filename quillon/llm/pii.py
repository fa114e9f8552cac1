"""PII: format-preserving pseudonyms from a keyed Feistel network.

Numbers and dates that pass their validation (card numbers by Luhn, IBANs by mod 97, IPv4 octets, North American and
international phone numbers, US social security numbers, calendar dates, e-mail addresses) are permuted by a key inside
the set of valid values of the same format: equal values get equal pseudonyms in every document, different values
different ones, and separators stay where they were. A day is one value in all notations, an address one in any case.

Whoever has the key can undo the pseudonyms. There is no default: callers give a secret one.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fresh, prepare

ROUNDS = 10


def feistel(x: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of 0 .. size - 1 without fixed points (for two values or more): a Feistel network, a keyed step
    that isn't 0, and the network backwards."""
    if size < 2:
        return x
    step = 1 + _round(key, tweak, size, 255, 0) % (size - 1)
    return _network((_network(x, size, key, tweak) + step) % size, size, key, tweak, back=True)


def _round(key: bytes, tweak: bytes, size: int, r: int, half: int) -> int:
    return int.from_bytes(hmac.digest(key, b"%b|%d|%d|%d" % (tweak, size, r, half), "sha256")[:16], "big")


def _network(x: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A generalised Feistel network on x = a * right + b, walked on until the value lies below size."""
    left = max(1, math.isqrt(size))
    right = -(-size // left)
    while True:
        a, b = divmod(x, right)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            f = _round(key, tweak, size, r, b if r % 2 == 0 else a) * (-1 if back else 1)
            if r % 2 == 0:
                a = (a + f) % left
            else:
                b = (b + f) % right
        x = a * right + b
        if x < size:
            return x


def _refill(template: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in template)


def luhn_digit(body: str) -> str:
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def card(text: str, key: bytes) -> str | None:
    """13 to 19 digits with a Luhn check: the first digit, the length and the check stay valid."""
    d = re.sub(r"\D", "", text)
    if not 13 <= len(d) <= 19 or len(set(d)) < 2 or luhn_digit(d[:-1]) != d[-1]:
        return None
    size = 10 ** (len(d) - 2)
    body = d[0] + str(feistel(int(d[1:-1]), size, key, b"card" + d[0].encode())).zfill(len(d) - 2)
    return _refill(text, body + luhn_digit(body))


def ipv4(text: str, key: bytes) -> str | None:
    """Four octets. Each keeps its number of digits and its first octet's range 1 to 223."""
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    spans = [_octets(len(p), i == 0) for i, p in enumerate(parts)]
    if any(int(p) not in s for p, s in zip(parts, spans, strict=True)):
        return None
    size, x = 1, 0
    for p, s in zip(parts, spans, strict=True):
        x, size = x * len(s) + (int(p) - s.start), size * len(s)
    y = feistel(x, size, key, b"ip" + "".join(str(len(p)) for p in parts).encode())
    out = []
    for s in reversed(spans):
        y, k = divmod(y, len(s))
        out.append(str(s.start + k))
    return ".".join(reversed(out))


def _octets(digits: int, first: bool) -> range:
    low, high = ((0, 9), (10, 99), (100, 255))[digits - 1]
    return range(max(low, 1), min(high, 223) + 1) if first else range(low, high + 1)


def phone(text: str, key: bytes) -> str | None:
    """North American numbers keep their country code and valid area and exchange codes; international ones (+) their
    country code of up to three digits and their length."""
    d = re.sub(r"\D", "", text)
    nanp = d[1:] if len(d) == 11 and d[0] == "1" else d if len(d) == 10 and not text.startswith("+") else ""
    if nanp:
        if nanp[0] not in "23456789" or nanp[3] not in "23456789":
            return None
        x = (int(nanp[0]) - 2) * 8 + int(nanp[3]) - 2
        rest = nanp[1:3] + nanp[4:]
        y = feistel(x * 10**8 + int(rest), 64 * 10**8, key, b"nanp")
        a, r = divmod(y, 10**8)
        r = str(r).zfill(8)
        return _refill(text, d[: len(d) - 10] + str(a // 8 + 2) + r[:2] + str(a % 8 + 2) + r[2:])
    if not text.startswith("+") or not 9 <= len(d) <= 15:
        return None
    keep = 1 if d[0] in "17" else 2
    return _refill(text, d[:keep] + str(feistel(int(d[keep:]), 10 ** (len(d) - keep), key, b"tel" + d[:keep].encode())).zfill(len(d) - keep))


def ssn(text: str, key: bytes) -> str | None:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = (int(x) for x in re.split(r"\D", text))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    y, serial = divmod(feistel(x, 898 * 99 * 9999, key, b"ssn"), 9999)
    area, group = divmod(y, 99)
    return _refill(text, f"{area + 1 + (area >= 665):03d}{group + 1:02d}{serial + 1:04d}")


def iban(text: str, key: bytes) -> str | None:
    """Mod 97 must be 1. Letters stay, digits of the account are permuted, the check digits made anew."""
    s = re.sub(r"\s", "", text)
    if not 15 <= len(s) <= 34 or _mod97(s[4:] + s[:4]) != 1:
        return None
    body = s[4:]
    digits = re.sub(r"\D", "", body)
    if not digits:
        return None
    new = _refill(body, str(feistel(int(digits), 10 ** len(digits), key, b"iban" + re.sub(r"\d", "9", s[:2] + body).encode())).zfill(len(digits)))
    made = iter(s[:2] + f"{98 - _mod97(new + s[:2] + '00'):02d}" + new)
    return "".join(c if c.isspace() else next(made) for c in text)


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73049  # to 2099-12-31


def date(text: str, key: bytes) -> str | None:
    """Days from 1900 to 2099 as year-month-day, or day and month in either order where both can be read; the format and the
    width stay, and a day has the same pseudonym in each notation."""
    parts, marks = re.split(r"[-/.]", text), re.findall(r"[-/.]", text)
    if marks[0] != marks[1]:
        return None
    try:
        orders = ["ymd"] if len(parts[0]) == 4 else ["mdy", "dmy"] if marks[0] == "/" else ["dmy", "mdy"]
        for order in orders:
            at = {c: int(p) for c, p in zip(order, parts, strict=True)}
            if 1900 <= at["y"] <= 2099 and 1 <= at["m"] <= 12 and 1 <= at["d"] <= 31:
                day = datetime.date(at["y"], at["m"], at["d"])
                break
        else:
            return None
    except ValueError:
        return None
    new = datetime.date.fromordinal(_FIRST_DAY + feistel(day.toordinal() - _FIRST_DAY, _DAYS, key, b"date"))
    value = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    return marks[0].join(value[c] for c in order)


def email(text: str, key: bytes) -> str | None:
    """Letters and digits of the local part, and of the domain but its last two labels, each in their own kind; other
    characters, the last two labels and the case of each place stay. Addresses that differ in case alone stay linked."""
    local, _, domain = text.rpartition("@")
    head, dot, tail = domain.rpartition(".")
    front, dot2, name = head.rpartition(".")
    return _kinds(local, key, b"local") + "@" + (_kinds(front, key, b"host") if front else "") + dot2 + (name if dot2 else _kinds(name, key, b"host")) + dot + tail


def _kinds(s: str, key: bytes, tweak: bytes) -> str:
    low = s.lower()
    base = [(10, "0") if c in "0123456789" else (26, "a") if "a" <= c <= "z" else None for c in low]
    size, x = 1, 0
    for c, b in zip(low, base, strict=True):
        if b:
            x, size = x * b[0] + ord(c) - ord(b[1]), size * b[0]
    y = feistel(x, size, key, tweak + "".join(b[1] if b else c for c, b in zip(low, base, strict=True)).encode())
    out = []
    for c, b in zip(reversed(s), reversed(base), strict=True):
        if b:
            y, k = divmod(y, b[0])
            new = chr(ord(b[1]) + k)
            c = new.upper() if "A" <= c <= "Z" else new
        out.append(c)
    return "".join(reversed(out))


# One scan; the first kind that fits at a place and passes its validation counts.
_KINDS = {
    "email": (r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}\b", email),
    "iban": (r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b", iban),
    "ipv4": (r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", ipv4),
    "date": (r"(?<![\w./-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?![\w/-]|\.\d)", date),
    "ssn": (r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", ssn),
    "card": (r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,4}(?: \d{3})?|\d{4}(?:-\d{4}){2}-\d{1,4}(?:-\d{3})?|\d{4}[ -]\d{6}[ -]\d{4,5})(?![\w-])", card),
    "phone": (r"(?<![\w.])\+\d{1,15}(?:[ .-]?\(\d{1,5}\)[ .-]?\d{1,12})?(?:[ .-]\d{1,12}){0,14}(?!\w|[.-]\d)|(?<![\w.])(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?![\w]|[.-]\d)", phone),
}
_SEPARATOR = re.compile(r"[ .-]")
#: How North American numbers are grouped.
_USUAL = re.compile(r"\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}")
_FINDERS = [(k, re.compile(p), f) for k, (p, f) in _KINDS.items()]
#: A place where any of them can begin: cheap, so that most of a text is passed over at once.
_ANY = re.compile(r"@|\d\D{0,2}\d\D{0,2}\d")


@lru_cache(maxsize=50_000)
def _pseudonym(kind: str, value: str, key: bytes) -> str | None:
    return _KINDS[kind][1](value, key)


def _part(kind: str, pattern: re.Pattern, text: str, m: re.Match, key: bytes) -> tuple[int, int, str] | None:
    """Start, end and pseudonym of the first valid part, between separators, of a match that isn't valid itself. Parts are
    chosen so that the valid ones hold the most digits together; of equal choices the one with more of the usual groups,
    then with the earlier and longer first part."""
    cuts = [m.start() + x.start() for x in _SEPARATOR.finditer(m[0])]
    starts, ends = [m.start(), *(c + 1 for c in cuts)], [*cuts, m.end()]
    best: list[tuple[tuple[int, int], tuple[int, int, str] | None]] = [((0, 0), None)] * (len(starts) + 1)
    for i in reversed(range(len(starts))):
        best[i] = best[i + 1]
        for j in range(i, len(ends)):
            if pattern.fullmatch(text, starts[i], ends[j]) and (new := _pseudonym(kind, text[starts[i] : ends[j]], key)) is not None:
                digits, usual = best[j + 1][0]
                size = digits + sum(c.isdigit() for c in new), usual + bool(_USUAL.fullmatch(new))
                if size >= best[i][0]:
                    best[i] = size, (starts[i], ends[j], new)
    return best[0][1]


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and kind, start and end (characters; the same in both texts) of each."""
    if not _ANY.search(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []
    left = text  # what is taken is blanked, so that a later kind ends where an earlier one begins
    for kind, pattern, _ in _FINDERS:
        if kind == "email" and "@" not in text:
            continue
        new_spans = []
        at = 0
        while m := pattern.search(left, at):
            # a match may have run on into the next number, or begun before the number
            new = _pseudonym(kind, m[0], key)
            part = (m.start(), m.end(), new) if new is not None else _part(kind, pattern, left, m, key)
            at = part[1] if part else m.start() + 1
            if part:
                new_spans.append((part[0], part[1], kind, part[2]))
        if new_spans:
            parts, at = [], 0
            for a, b, _, _ in new_spans:
                parts += [left[at:a], "\0" * (b - a)]
                at = b
            left = "".join(parts) + left[at:]
        found += new_spans
    if not found:
        return text, []
    found.sort()
    out, at = [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], [(kind, a, b) for a, b, kind, _ in found]


def scan(docs: DataFrame, key: bytes, text: str = "text", clean: str = "clean_text", spans: str = "pii") -> DataFrame:
    """docs with the pseudonymised text and its spans (kind, start, end). Pseudonyms are as long as what they stand for.

    A null text stays null and an empty one empty, without spans; repeated rows and other columns pass as they are."""
    if not key:
        raise ValueError("a key is needed")
    prepare(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    digest = hashlib.sha256(key).digest()

    def run(b: pa.RecordBatch):
        done = [(None, []) if x is None else pseudonymise(x, digest) for x in b.column(b.schema.names.index(text)).to_pylist()]
        return [pa.array([t for t, _ in done], pa.string()), pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in found] for _, found in done], kind)]

    return arrow_map(docs, docs.columns, f"`{clean}` string, `{spans}` array<struct<kind: string, start: long, end: long>>", run)


def replace(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """docs with pseudonyms in the text; all else as it was."""
    clean, spans = fresh(docs, "clean_text"), fresh(docs, "pii")
    done = scan(docs, key, text, clean, spans)
    return done.select(*[F.col(f"`{clean}`").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
