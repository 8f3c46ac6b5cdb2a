"""Typed values of tokens: exact numbers, instants, addresses, versions, and fields."""

from __future__ import annotations

import ipaddress
import re
from datetime import datetime, timezone
from decimal import Decimal, InvalidOperation
from fractions import Fraction
from urllib.parse import urlsplit

from .lexer import SIZE_UNITS, TIME_UNITS, UNITS

_AMOUNT = re.compile(r"([\d_.,]+(?:[eE][+-]?\d+)?)\s*(\D*)$")
#: Formats of instants that are tried in turn (fixed values).
FORMATS = ("%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%d %H:%M:%S%z", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d", "%H:%M:%S", "%b %d %H:%M:%S", "%d/%b/%Y:%H:%M:%S %z")

#: The commonest of them, read without trying.
_PLAIN = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})[T ]([0-9]{2}):([0-9]{2}):([0-9]{2})").fullmatch


def number(text: str) -> Decimal | None:
    """Exact value of a number: digits with _ groups, radix prefixes, exponents."""
    t = text.replace("_", "")
    try:
        if t[:2].lower() in ("0x", "0b", "0o"):
            return Decimal(int(t, 0))
        return Decimal(t)
    except (InvalidOperation, ValueError):
        return None


def instant(text: str) -> Decimal | None:
    """Seconds since 1970 in UTC; instants without a zone are UTC."""
    if m := _PLAIN(text):
        try:
            return Decimal(int(datetime(*map(int, m.groups()), tzinfo=timezone.utc).timestamp()))
        except ValueError:
            return None
    for f in FORMATS:
        try:
            d = datetime.strptime(text.replace(",", "."), f)
        except ValueError:
            continue
        d = d if d.tzinfo else d.replace(tzinfo=timezone.utc)
        return Decimal(int(d.timestamp())) + Decimal(d.microsecond) / 10**6
    return None


def version(text: str) -> tuple | None:
    """Precedence key: a release stands above its pre-releases, numeric parts below words."""
    m = re.fullmatch(r"v?(\d+(?:\.\d+)*)(?:-([0-9A-Za-z.-]+))?(?:\+.*)?", text)
    if not m:
        return None
    core = tuple(int(x) for x in m[1].split("."))
    core += (0,) * (3 - len(core))
    pre = tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in m[2].split(".")) if m[2] else ((2, 0, ""),)
    return core, pre


def address(text: str):
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return None
    return (a.version, int(a))


def value(kind: str, text: str):
    """The value that comparisons of a kind use; None if it has none."""
    if kind == "number":
        return number(text)
    if kind == "money":
        return number(text[1:].replace(",", ""))
    if kind == "percent":
        return number(text[:-1])
    if kind in ("bytesize", "duration"):
        m = _AMOUNT.match(text)
        unit = m and (SIZE_UNITS if kind == "bytesize" else TIME_UNITS).get(m[2].strip().lower())
        n = m and number(m[1])
        return n * unit if unit and n is not None else None
    if kind == "quantity":
        n, unit = measured(text)
        return None if n is None or unit not in UNITS else n * Decimal(UNITS[unit][1])
    if kind == "timestamp":
        return instant(text)
    if kind == "version":
        return version(text)
    if kind == "ip":
        return address(text)
    return None


def measured(text: str) -> tuple[Decimal | None, str]:
    """(number, unit) of a quantity as written."""
    m = re.match(r"[\d_]+(?:\.\d+)?", text)
    return (number(m[0]), text[m.end() :].strip()) if m else (None, "")


def field(kind: str, text: str, name: str):
    """A named part of a token as written, or None."""
    if name == "len":
        return Decimal(len(text))
    if kind == "quantity":
        n, unit = measured(text)
        return {"value": n, "unit": unit, "family": UNITS.get(unit, ("",))[0]}.get(name)
    if kind == "url":
        u = urlsplit(text)
        port = u.port or {"http": 80, "https": 443, "ftp": 21, "ssh": 22}.get(u.scheme)
        return {"scheme": u.scheme, "host": (u.hostname or ""), "port": None if port is None else Decimal(port), "path": u.path, "query": u.query}.get(name)
    if kind == "email":
        user, _, domain = text.rpartition("@")
        return {"user": user, "domain": domain.lower()}.get(name)
    if kind == "path":
        d, _, n = text.rpartition("/")
        return {"dir": d, "name": n, "ext": n.rpartition(".")[2] if "." in n else ""}.get(name)
    if kind == "creditcard":
        d = re.sub(r"\D", "", text)
        return {"last4": d[-4:], "issuer": {"4": "visa", "5": "mastercard", "3": "amex", "6": "discover"}.get(d[0], "other")}.get(name)
    if kind == "hash":
        return {"algo": {32: "md5", 40: "sha1", 64: "sha256"}[len(text)]}.get(name)
    if kind == "uuid":
        return {"version": Decimal(int(text[14], 16))}.get(name)
    if kind == "mac":
        return {"oui": text[:8].lower()}.get(name)
    if kind == "phone":
        return {"cc": re.match(r"\+(\d{1,3})", text)[1]}.get(name)
    if kind == "version":
        v = version(text)
        return None if v is None else {"major": Decimal(v[0][0]), "minor": Decimal(v[0][1]), "patch": Decimal(v[0][2]), "pre": ".".join(p[2] or str(p[1]) for p in v[1]) if v[1][0][0] < 2 else ""}.get(name)
    if kind == "cidr":
        return {"prefix": Decimal(text.rpartition("/")[2])}.get(name)
    if kind == "timestamp":
        m = re.match(r"(\d{4})-(\d\d)-(\d\d)(?:[T ](\d\d):(\d\d):(\d\d))?", text)
        return None if not m else dict(zip(("year", "month", "day", "hour", "minute", "second"), (None if x is None else Decimal(x) for x in m.groups()), strict=True)).get(name)
    return None


def quotient(total: Decimal, n: int) -> str:
    """An exact mean: decimal digits with the repetend in parentheses, or a ratio if that is long."""
    f = Fraction(total) / n
    sign, num, den = ("-" if f < 0 else ""), abs(f.numerator), f.denominator
    whole, rest = divmod(num, den)
    digits, at = "", {}
    while rest and rest not in at:
        if len(digits) > 40:
            return f"{f.numerator}/{f.denominator}"
        at[rest] = len(digits)
        digit, rest = divmod(rest * 10, den)
        digits += str(digit)
    if not digits:
        return f"{sign}{whole}"
    return f"{sign}{whole}.{digits}" if not rest else f"{sign}{whole}.{digits[: at[rest]]}({digits[at[rest] :]})"
