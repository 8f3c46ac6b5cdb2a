"""Functions of token texts: checksums, encodings, identifier forms, slices of addresses."""

from __future__ import annotations

import base64
import binascii
import ipaddress
import json
import math
import re
from collections import Counter
from urllib.parse import unquote, urlsplit

from .lexer import luhn

#: Letters of a vehicle number as digits, and the weights of its places (fixed values).
_VIN = {**{str(d): d for d in range(10)}, **dict(zip("ABCDEFGHJKLMNPRSTUVWXYZ", [1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 7, 9, 2, 3, 4, 5, 6, 7, 8, 9], strict=True))}
_VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
#: Ports that a scheme implies (fixed values).
_PORTS = {"http": 80, "https": 443, "ftp": 21, "ssh": 22}


def _spelled(text: str) -> str:
    """Letters as two-digit numbers, A = 10."""
    return "".join(str(int(c, 36)) for c in text)


def mod97(text: str) -> bool:
    """The check of international account numbers: the first four places go to the end, remainder 1."""
    t = re.sub(r"[ -]", "", text).upper()
    return re.fullmatch(r"[A-Z]{2}\d\d[A-Z0-9]{11,30}", t) is not None and int(_spelled(t[4:] + t[:4])) % 97 == 1


def gs1(text: str) -> bool:
    """The weighted check of trade item numbers: 3 and 1 in turn from the right, sum divisible by 10."""
    d = re.sub(r"[ -]", "", text)
    return d.isdigit() and len(d) in (8, 12, 13, 14) and sum(int(c) * (3 if k % 2 else 1) for k, c in enumerate(reversed(d))) % 10 == 0


def isbn(text: str) -> bool:
    d = re.sub(r"[ -]", "", text).upper()
    if re.fullmatch(r"\d{9}[\dX]", d):
        return sum((10 - k) * (10 if c == "X" else int(c)) for k, c in enumerate(d)) % 11 == 0
    return len(d) == 13 and d[:3] in ("978", "979") and gs1(d)


def vin(text: str) -> bool:
    t = text.upper()
    if len(t) != 17 or any(c not in _VIN for c in t):
        return False
    rest = sum(_VIN[c] * w for c, w in zip(t, _VIN_WEIGHTS, strict=True)) % 11
    return t[8] == ("X" if rest == 10 else str(rest))


def isin(text: str) -> bool:
    t = text.upper()
    return re.fullmatch(r"[A-Z]{2}[A-Z0-9]{9}\d", t) is not None and luhn(_spelled(t))


CHECKS = {"luhn": luhn, "mod97": mod97, "gs1": gs1, "isbn": isbn, "vin": vin, "isin": isin}


def octets(text: str, first: int, last: int | None = None) -> str | None:
    """Octets ``first`` to ``last`` (from 1) of an IPv4 address, as written."""
    part = text.split(".")
    return ".".join(part[first - 1 : last or first]) if len(part) == 4 else None


def groups(text: str, first: int, last: int | None = None) -> str | None:
    """Groups ``first`` to ``last`` (from 1) of an IPv6 address, written out."""
    try:
        part = ipaddress.IPv6Address(text).exploded.split(":")
    except ValueError:
        return None
    return ":".join(part[first - 1 : last or first])


def plain_url(text: str) -> str:
    """Scheme and host in lower case, no implied port, "/" for an empty path, escapes of plain characters undone."""
    u = urlsplit(text)
    host = (u.hostname or "") + ("" if u.port is None or _PORTS.get(u.scheme) == u.port else f":{u.port}")
    user = u.netloc.rpartition("@")[0]

    def escape(m: re.Match) -> str:
        c = unquote(m[0])
        return c if re.fullmatch(r"[A-Za-z0-9._~-]", c) else m[0].upper()

    path = re.sub(r"%[0-9A-Fa-f]{2}", escape, u.path) or "/"
    return f"{u.scheme.lower()}://{user + '@' if user else ''}{host}{path}" + (f"?{u.query}" if u.query else "") + (f"#{u.fragment}" if u.fragment else "")


def bits_per_byte(data: bytes) -> float:
    """Shannon entropy of a byte string."""
    n = len(data)
    return -sum(k / n * math.log2(k / n) for k in Counter(data).values()) if n else 0.0


def decoded(text: str) -> bytes | None:
    """Bytes of base64 text, of either alphabet, padded or not."""
    t = text.replace("-", "+").replace("_", "/").rstrip("=")
    try:
        return base64.b64decode(t + "=" * (-len(t) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def claim(token: str, name: str, part: int = 1) -> str | None:
    """A member of a web token's payload (part 1) or header (part 0); the signature is not checked."""
    parts = token.split(".")
    data = decoded(parts[part]) if len(parts) > part else None
    try:
        value = json.loads(data)[name] if data else None
    except (ValueError, KeyError, TypeError):
        return None
    return None if value is None else value if isinstance(value, str) else json.dumps(value)


def identifier(word: str) -> str:
    """The form of an identifier: SCREAM, Pascal, camel, snake, short or word."""
    if len(word) <= 2:
        return "short"
    if "_" in word.strip("_"):
        return "SCREAM" if word.upper() == word else "snake"
    if word.upper() == word and word.lower() != word:
        return "SCREAM"
    if re.search(r"[a-z0-9][A-Z]", word):
        return "Pascal" if word[0].isupper() else "camel"
    return "Pascal" if word[0].isupper() else "word"


def byte_class(c: str) -> str:
    """One of five classes of a character: letter, digit, blank, mark, other."""
    return "letter" if c.isalpha() else "digit" if c.isdigit() else "blank" if c.isspace() else "mark" if c.isascii() and c.isprintable() else "other"
