"""Typed tokens of text: one ordered alternation, bracket mates, nesting depth and lines."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass
from functools import lru_cache

#: Unit suffixes (fixed values).
SIZE_UNITS = {"b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "pb": 10**15, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40, "pib": 2**50}
TIME_UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9, "y": 365 * 86400 * 10**9}

#: Units of measure by family, in the family's base (fixed values); lengths of time are durations, sizes of data bytesizes.
FAMILIES = {
    "mass": {"mg": "1e-3", "g": "1", "kg": "1e3", "lb": "453.59237", "lbs": "453.59237", "oz": "28.349523125"},
    "length": {"nm": "1e-9", "mm": "1e-3", "cm": "1e-2", "km": "1e3", "ft": "0.3048", "yd": "0.9144", "mi": "1609.344"},
    "area": {"m²": "1", "m2": "1", "km²": "1e6", "km2": "1e6", "ha": "1e4"},
    "volume": {"ml": "1e-6", "mL": "1e-6", "cl": "1e-5", "dl": "1e-4", "l": "1e-3", "L": "1e-3", "m³": "1", "m3": "1"},
    "frequency": {"Hz": "1", "kHz": "1e3", "MHz": "1e6", "GHz": "1e9"},
    "voltage": {"mV": "1e-3", "V": "1", "kV": "1e3"},
    "current": {"mA": "1e-3", "A": "1"},
    "power": {"mW": "1e-3", "W": "1", "kW": "1e3", "MW": "1e6"},
    "energy": {"J": "1", "kJ": "1e3", "Wh": "3600", "kWh": "3.6e6"},
    "pressure": {"Pa": "1", "hPa": "1e2", "kPa": "1e3"},
    "force": {"N": "1", "kN": "1e3"},
}
UNITS = {u: (f, x) for f, us in FAMILIES.items() for u, x in us.items()}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_IP6 = r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?"
_DAY = r"\d{4}-\d{2}-\d{2}"
_CLOCK = r"\d{2}:\d{2}:\d{2}(?:[.,]\d+)?"
_MON = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_NUM = r"\d+(?:_\d+)*(?:\.\d+)?"
#: Kind and shape, first match wins.
CHAIN = (
    ("whitespace", r"\s+"),
    ("quoted", r'"(?:\\.|[^"\\\n])*"|(?<!\w)\'(?:\\.|[^\'\\\n])*\'(?!\w)'),
    ("url", r"[A-Za-z][A-Za-z0-9+.-]*://[^\s\"'<>()]+[^\s\"'<>().,;:!?]"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    ("phone", r"\+\d{1,3}(?:[ -]?\(?\d{2,4}\)?){2,4}(?!\d)"),
    ("uuid", r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}(?!\w)"),
    ("mac", r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\w:-])"),
    ("hash", r"(?:[0-9A-Fa-f]{64}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{32})(?!\w)"),
    ("hex", r"[0-9A-Fa-f]{33,}(?!\w)"),
    ("cidr", rf"{_IP4}/(?:3[0-2]|[12]?\d)(?![\w.])"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("timestamp", rf"{_DAY}(?:[T ]{_CLOCK}(?:Z|[+-]\d{{2}}:?\d{{2}})?)?(?!\w)|{_CLOCK}(?!\w)|{_MON} [ \d]\d {_CLOCK}|\d{{1,2}}/{_MON}/\d{{4}}:{_CLOCK} [+-]\d{{4}}"),
    ("ip", rf"(?:{_IP6})(?![\w:])|{_IP4}(?![\w]|\.\d)"),
    ("creditcard", r"(?:\d{4}[ -]?){3}\d{4}(?!\d)"),
    ("geo", r"-?\d{1,2}\.\d{3,}, ?-?\d{1,3}\.\d{3,}"),
    ("money", rf"[$€£¥]{_NUM}(?:,\d{{3}})*(?:\.\d+)?"),
    ("version", r"v?\d+\.\d+\.\d+(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?(?![\w.])"),
    ("bytesize", rf"{_NUM} ?(?:[KMGTP]i?B|B)(?!\w)"),
    ("percent", rf"{_NUM}%"),
    ("duration", rf"{_NUM}(?:ns|us|µs|ms|s|m|h|d|w|y)(?!\w)"),
    ("quantity", rf"{_NUM}(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?!\w)"),
    ("hexcolor", r"#(?:[0-9A-Fa-f]{6}|[0-9A-Fa-f]{3})(?!\w)"),
    ("path", r"(?<![<\w])(?:~|\.{1,2})?/(?:[\w.@+-]+/)*[\w.@+-]+|[A-Za-z]:\\[\w.\\-]+"),
    ("number", r"0x[0-9A-Fa-f]+|0b[01]+|0o[0-7]+|\d+(?:_\d+)*(?:\.\d+)?(?:[eE][+-]?\d+)?(?![^\W\d_])"),
    ("word", r"[^\W\d]\w*|\d+\w+"),
    ("open", r"[(\[{]"),
    ("close", r"[)\]}]"),
    ("punct", r"[^\w\s]"),
    ("other", r"."),
)
_CHAIN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in CHAIN), re.S)
_PAIR = {")": "(", "]": "[", "}": "{"}
KINDS = tuple(k for k, _ in CHAIN)


#: A line of nothing but short words and marks holds no other kind; its words and marks are counted at once.
_SIMPLE = re.compile(r"(?:[A-Za-zÀ-ÖØ-öø-ÿ]{1,31}(?![A-Za-zÀ-ÖØ-öø-ÿ])|[ .,;!?()\[\]{}])*").fullmatch
_WORDS = re.compile(r"[^\W\d_]+").findall


@dataclass(slots=True)
class Token:
    kind: str
    start: int
    end: int
    text: str
    line: int
    depth: int = 0
    mate: int = -1  # index among significant tokens


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed([c for c in digits if c.isdigit()])):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


@lru_cache(64)
def _chain(shapes: tuple[tuple[str, str], ...]) -> re.Pattern:
    """The alternation with declared shapes before the built-in kinds."""
    if not shapes:
        return _CHAIN
    for name, _ in shapes:
        if name in KINDS:
            raise ValueError(f"a shape can't be named {name}")
    blank, *rest = CHAIN
    return re.compile("|".join(f"(?P<{k}>{p})" for k, p in (blank, *[(n, f"(?:{p})(?!\\w)") for n, p in shapes], *rest)), re.S)


_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_AFTER = r"[.:](?:\s|\Z)|\Z"
#: A blank and what makes no size, card, phone or instant of the number before it.
_THEN = r" [AC-FHIJLNOQ-SU-Za-z(\[=\"]"
_ENDED = r"(?=[\s,;)]|\Z)"
#: Tokens that what follows them settles: no other kind of the chain can begin with their first mark, or go on as they do. <kind> stands where one ends.
_PLAIN = (
    rf"[{_LETTER}]{{1,31}}+(?=[=,;()\[\]{{}}\"'<>|!?&*^$\n\r\t]| (?![ \d])|{_AFTER})<word>",
    r"[=,;!?<>|&*^]<punct>",
    rf"[0-9]{{1,15}}+(?:(?=[=,;()\[\]{{}}\"<>|\n]|{_THEN}|{_AFTER})<number>|%{_ENDED}<percent>|(?:ms|s|ns|us|m|h|d|w|y){_ENDED}<duration>| ?(?:[KMGTP]i?B|B){_ENDED}<bytesize>"
    rf"|\.[0-9]{{1,15}}+(?:(?=[=;()\[\]{{}}\"<>|\n]|,(?! ?-?\d)|{_THEN}|\Z)<number>|%{_ENDED}<percent>|(?:ms|s|ns|us|m|h|d|w|y){_ENDED}<duration>| ?(?:[KMGTP]i?B|B){_ENDED}<bytesize>))",
    r"[(\[{]<open>",
    r"[)\]}]<close>",
    rf'"[^"\\\n]*"<quoted>',
    r"[.:%+#~@-](?=\s|\Z)<punct>",
    r"/(?<![<\w]/)(?:[\w.@+-]+/)*[\w.@+-]+<path>",
    rf"\$[0-9]{{1,15}}+(?:\.[0-9]{{1,15}}+)?{_ENDED.replace(',', '')}<money>",
    rf"[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(?=\s|\Z)<timestamp>",
    rf"{_IP4}{_ENDED}<ip>",
    rf"v[0-9]+\.[0-9]+\.[0-9]+{_ENDED}<version>",
)
_OF_LETTERS = ("url", "jwt", "uuid", "mac", "hash", "hex", "email", "timestamp", "ip", "version", "path", "word")
_OF_DIGITS = ("uuid", "mac", "hash", "hex", "cidr", "email", "timestamp", "ip", "creditcard", "geo", "version", "bytesize", "percent", "duration", "quantity", "number", "word")


@lru_cache(64)
def _quick(shapes: tuple[tuple[str, str], ...]) -> tuple[re.Pattern, tuple[str, ...]] | None:
    """The same alternation by first mark: (pattern, kind of each group); an empty group marks the begin and one the kind. None if a shape may be empty."""
    if any(re.fullmatch(p, "") for _, p in shapes):
        return None
    _chain(shapes)  # refuses names of built-in kinds
    chain, kinds, count = dict(CHAIN), ["", "blank"], 1

    def marked(kind: str, p: str) -> str:
        nonlocal count
        inner = re.compile(p).groups
        kinds.extend([""] * inner + [kind])
        count += inner + 1
        return f"(?:{p})()"

    parts = [marked(n, f"(?:{p})(?!\\w)") for n, p in shapes]
    for p in _PLAIN:
        ends = re.findall("<([a-z]+)>", p)
        kinds.extend(ends)
        count += len(ends)
        parts.append(re.sub("<[a-z]+>", "()", p))
    parts += ["(?=[A-Za-z])(?:" + "|".join(marked(k, chain[k]) for k in _OF_LETTERS) + ")"]
    parts += ["(?=[0-9])(?:" + "|".join(marked(k, chain[k]) for k in _OF_DIGITS) + ")"]
    parts += [marked(k, p) for k, p in CHAIN[1:]]
    parts += [marked("", r"\Z")]
    return re.compile(r"\s*+()(?:" + "|".join(parts) + ")", re.S), tuple(kinds)


def spans(text: str | None, shapes: tuple[tuple[str, str], ...] = ()) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the significant tokens in order."""
    text = text or ""
    quick = _quick(shapes)
    if quick is None:
        out = [(m.lastgroup, m.start(), m.end()) for m in _chain(shapes).finditer(text) if m.lastgroup != "whitespace"]
    else:
        kinds = quick[1]
        out = [(kinds[m.lastindex], m.start(1), m.end()) for m in quick[0].finditer(text)]
        while out and not out[-1][0]:
            out.pop()
    for k, (kind, a, b) in enumerate(out) if "creditcard" in [x[0] for x in out] else ():
        if kind == "creditcard" and not luhn(text[a:b]):
            out[k] = ("number" if text[a:b].isdigit() else "other", a, b)
    return out


def lex(text: str | None, blanks: bool = False, shapes: tuple[tuple[str, str], ...] = ()) -> list[Token]:
    """Significant tokens in order (with white space too if ``blanks``); null lexes as empty.

    Positions are characters. A closing bracket pairs with the nearest open one
    of its kind, or with none. ``shapes`` are kinds of their own, (name, regular
    expression), tried before the built-in ones.
    """
    if not blanks:
        text = text or ""
        found = spans(text, shapes)
        if "\n" not in text:
            return paired([Token(k, a, b, text[a:b], 1) for k, a, b in found], True)
        out, line, at = [], 1, 0
        for k, a, b in found:
            line += text.count("\n", at, a)
            at = a
            out.append(Token(k, a, b, text[a:b], line))
        return paired(out, True)
    out = []
    line = 1
    for m in _chain(shapes).finditer(text or ""):
        kind, s = m.lastgroup, m.group()
        if kind == "creditcard" and not luhn(s):
            kind = "number" if s.isdigit() else "other"
        out.append(Token(kind, m.start(), m.end(), s, line))
        line += s.count("\n")
    return paired(out)


class Lazy:
    """Tokens of a text that are made when they are looked at, without mates and depths."""

    __slots__ = ("text", "found", "made", "breaks")

    def __init__(self, text: str, found: list[tuple[str, int, int]]) -> None:
        self.text, self.found = text, found
        self.made: dict[int, Token] = {}
        self.breaks: list[int] | None = None

    def __len__(self) -> int:
        return len(self.found)

    def __getitem__(self, i):
        t = self.made.get(i) if not isinstance(i, slice) else [self[k] for k in range(*i.indices(len(self.found)))]
        if t is None:
            kind, a, b = self.found[i]
            if self.breaks is None:
                self.breaks = [m.start() for m in re.finditer("\n", self.text)]
            t = self.made[i] = Token(kind, a, b, self.text[a:b], bisect.bisect_left(self.breaks, a) + 1)
        return t


def paired(tokens: list[Token], fresh: bool = False) -> list[Token]:
    """The same tokens with the mates and depths of their brackets; ``fresh`` ones have none yet."""
    if not fresh:
        for t in tokens:
            t.depth, t.mate = 0, -1
    stack: list[int] = []
    last = 0  # where the stack changed
    for k, t in enumerate(tokens):
        kind = t.kind
        if kind != "open" and kind != "close":
            continue
        if stack:
            for x in tokens[last : k + 1]:
                x.depth = len(stack)
        last = k + 1
        if kind == "open":
            stack.append(k)
        else:
            at = next((i for i in range(len(stack) - 1, -1, -1) if tokens[stack[i]].text == _PAIR[t.text]), None)
            if at is not None:
                t.mate, tokens[stack[at]].mate = stack[at], k
                del stack[at:]
                t.depth = len(stack)
    if stack:
        for x in tokens[last:]:
            x.depth = len(stack)
    return tokens


def count_kinds(text: str | None) -> dict[str, int]:
    """Significant tokens by kind, as ``lex`` finds them."""
    out: dict[str, int] = {}

    def add(kind: str, n: int) -> None:
        if n:
            out[kind] = out.get(kind, 0) + n

    hard: list[str] = []

    def slow() -> None:
        for m in _CHAIN.finditer("\n".join(hard)):
            kind = m.lastgroup
            if kind == "creditcard" and not luhn(m.group()):
                kind = "number" if m.group().isdigit() else "other"
            if kind != "whitespace":
                out[kind] = out.get(kind, 0) + 1
        hard.clear()

    for line in (text or "").split("\n"):
        # a token may cross a line end only between lines that are not simple
        if _SIMPLE(line):
            slow()
            add("word", len(_WORDS(line)))
            add("punct", sum(map(line.count, ".,;!?")))
            add("open", sum(map(line.count, "([{")))
            add("close", sum(map(line.count, ")]}")))
        else:
            hard.append(line)
    slow()
    return out
