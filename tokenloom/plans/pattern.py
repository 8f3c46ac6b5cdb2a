"""The pattern language: patterns over typed tokens, compiled to programs that are searched without recursion."""

from __future__ import annotations

import bisect
import fnmatch
import ipaddress
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from ..functions import values as V
from ..functions.lexer import KINDS, Lazy, Token, lex, paired, spans as lexed
from ..functions.units import ROLES, divide

#: One-letter atoms (fixed values).
LETTERS = {"N": "number", "W": "word", "Q": "quoted", "I": "ip", "C": "cidr", "U": "url", "E": "email", "T": "timestamp", "V": "version", "H": "hexcolor", "%": "percent", "Z": "bytesize", "$": "money", "D": "hash", "R": "duration", "L": "path", "P": "punct"}
#: Shapes that stand for a pattern.
LENSES = {
    "call": r"\W \B(.*)",
    "block": r"\B{.*}",
    "nesting": r"\B",
    "string": r"\Q",
    "number": r"\N",
    "ident": r"\W",
    "assignment": r'\W "="',
    "kv": r'\W [":" "="]',
    "flag": r'"-"{1,2} \W',
    "list": r'[\W \N \Q] ("," [\W \N \Q])+',
    "range": r'\N ("." "." | "-" | ":") \N',
}
CLASSES = {"d": r"[0-9]+", "w": r"[0-9A-Za-z_]+", "h": r"[0-9A-Fa-f]+", "a": r"[A-Za-z]+", "u": r"[A-Z]+", "l": r"[a-z]+"}


class PatternError(ValueError):
    """A pattern that can't be read, refused before any input is."""


class Input:
    """One text's tokens and the readings of them that tests share, each made when first asked for."""

    def __init__(self, text: str, tokens: list[Token], known: dict[str, set[str]] | None = None) -> None:
        self.text, self.tokens, self.known = text, tokens, known or {}
        self.origin = 0
        self.memo: dict = {}
        #: The text begins here; more may follow; what followed could have changed an answer since this was cleared.
        self.begun, self.open, self.hit = True, False, False

    def once(self, key, make):
        if key not in self.memo:
            self.memo[key] = make()
        return self.memo[key]

    def places(self, orbit: str | None) -> dict[str, list[int]]:
        """Token positions by content under an equivalence."""

        def make():
            out: dict[str, list[int]] = {}
            for i, t in enumerate(self.tokens):
                out.setdefault(canonical(t.text, orbit), []).append(i)
            return out

        return self.once(("places", orbit), make)

    def fields(self) -> list[int]:
        """The comma-parted field of its line that a token begins (from 1), 0 inside a field."""

        def make():
            out, n = [], 1
            for i, t in enumerate(self.tokens):
                new = i == 0 or self.tokens[i - 1].line < t.line
                n = 1 if new else n + (self.tokens[i - 1].text == ",")
                out.append(n if new or self.tokens[i - 1].text == "," else 0)
            return out

        return self.once("fields", make)

    def units(self) -> list:
        """The unit of each token, None for ends of statements and paired brackets."""

        def make():
            out: list = [None] * len(self.tokens)
            for u in divide(self.tokens):
                out[u.first : u.end] = [u] * (u.end - u.first)
            return out

        return self.once("units", make)

    def order(self) -> list[bool | None]:
        """Whether a timestamp is at or after the one before it; None for other tokens and the first."""

        def make():
            out, last = [], None
            for t in self.tokens:
                now = V.instant(t.text) if t.kind == "timestamp" else None
                out.append(None if now is None or last is None else now >= last)
                last = last if now is None else now
            return out

        return self.once("order", make)


Regs = tuple[int, ...]  # the reported start (-1: where the match began), then start and end of each register
Test = Callable[[Input, int, Regs], bool]


@dataclass
class Node:
    """A part of a pattern: op, its parts, and the fewest and most tokens that it takes (None: no bound)."""

    op: str
    arg: object = None
    parts: list[Node] = field(default_factory=list)
    low: int = 0
    high: int | None = 0
    #: What every match holds: ("kind", name) and ("word", text of a word or mark).
    needs: frozenset = frozenset()
    #: Known first tokens, see ``begins``, of a part whose inside isn't in ``parts``; or a function that lists the starts worth a run.
    first: object = None
    #: Holds only where a line begins.
    edge: bool = False
    #: (input, wanted) of each test for tokens of another input that the part makes, all of which must hold.
    asks: tuple = ()


def _add(a: int | None, b: int | None) -> int | None:
    return None if a is None or b is None else a + b


@dataclass
class Needs:
    """Kinds and words that stand in every input that a pattern matches."""

    kinds: frozenset[str]
    words: frozenset[str]


def begins(n: Node) -> tuple[frozenset[str], frozenset[str], bool] | None:
    """(kinds, texts, whether it may take no token): every match begins with a token of one of them; None if any token may begin one."""
    if n.op in ("zero", "save", "keep"):
        return frozenset(), frozenset(), True
    if n.op == "one":
        k, x = next(iter(n.needs), (None, None))
        return None if k is None else (frozenset([x]), frozenset(), False) if k == "kind" else (frozenset(), frozenset([x]), False)
    if n.op == "rep":
        got = begins(n.parts[0])
        return got and (got[0], got[1], got[2] or n.arg[0] == 0)
    if isinstance(n.first, tuple):
        return n.first
    if n.op not in ("seq", "alt", "sub") or not n.parts and n.op != "seq":
        return None
    kinds, texts, passes = frozenset(), frozenset(), n.op == "seq"
    for x in n.parts:
        got = begins(x)
        if got is None:
            return None
        kinds, texts = kinds | got[0], texts | got[1]
        passes = passes and got[2] if n.op == "seq" else passes or got[2]
        if n.op == "seq" and not passes:
            break
    return kinds, texts, passes


def flattened(n: Node) -> list[Node]:
    """The parts of a sequence in order."""
    return [y for x in n.parts for y in flattened(x)] if n.op == "seq" else [n]


def at_edge(n: Node) -> bool:
    """Whether every match begins where a line does."""
    if n.op == "seq":
        return at_edge(next((x for x in n.parts if x.op not in ("save", "keep")), Node("none")))
    return n.edge or n.op == "alt" and all(map(at_edge, n.parts))


def one(test: Test, *needs: tuple[str, str]) -> Node:
    return Node("one", test, [], 1, 1, frozenset(needs))


def zero(test: Test) -> Node:
    return Node("zero", test)


def sequence(parts: list[Node]) -> Node:
    low, high = 0, 0
    for n in parts:
        low, high = low + n.low, _add(high, n.high)
    return Node("seq", None, parts, low, high, frozenset().union(*[n.needs for n in parts]))


def choice(parts: list[Node], op: str = "alt", arg: object = None) -> Node:
    high = None if any(n.high is None for n in parts) else max(n.high for n in parts)
    return Node(op, arg, parts, min(n.low for n in parts), high, frozenset.intersection(*[n.needs for n in parts]))


#: Copies of a part that a counted repetition may unroll to.
UNROLL = 1000


class Program:
    """Instructions of a pattern, run by a search with an explicit stack.

    A state is an instruction and a position. Preference is depth first, so the
    first way to the end is the preferred one, and a state that failed once is
    never entered again, from whatever start: a scan takes time in proportion
    to text times pattern, and no recursion. Registers are part of a state only
    where a back-reference reads them.
    """

    def __init__(self, node: Node, read: frozenset[int]) -> None:
        self.code: list[list] = []
        self.read = tuple(sorted(read))
        self._emit(node)
        self.code.append(["end"])
        #: One way only: no state can be met twice.
        self.straight = all(x[0] in ("one", "zero", "save", "keep", "end") for x in self.code)

    def _emit(self, n: Node) -> None:
        code = self.code
        if n.op in ("one", "zero", "jump", "sub", "save", "keep"):
            code.append([n.op, n.arg])
        elif n.op == "seq":
            for x in n.parts:
                self._emit(x)
        elif n.op == "alt":
            ends = []
            for k, x in enumerate(n.parts):
                if k < len(n.parts) - 1:
                    split = ["split", len(code) + 1, None]
                    code.append(split)
                    self._emit(x)
                    jump = ["goto", None]
                    code.append(jump)
                    ends.append(jump)
                    split[2] = len(code)
                else:
                    self._emit(x)
            for j in ends:
                j[1] = len(code)
        elif n.op == "rep":
            lo, hi, greedy = n.arg
            for _ in range(lo):
                self._emit(n.parts[0])
            if hi is None and greedy and n.parts[0].op == "one":
                code.append(["many", n.parts[0].arg])
            elif hi is None:
                at = len(code)
                split = ["split", None, None]
                code.append(split)
                self._emit(n.parts[0])
                code.append(["goto", at])
                split[1], split[2] = (at + 1, len(code)) if greedy else (len(code), at + 1)
            else:
                splits = []
                for _ in range(hi - lo):
                    splits.append(["split", len(code) + 1, None])
                    code.append(splits[-1])
                    self._emit(n.parts[0])
                for split in splits:
                    split[2] = len(code)
                    if not greedy:
                        split[1], split[2] = split[2], split[1]
        else:
            raise AssertionError(n.op)

    def run(self, ctx: Input, start: int, regs: Regs, seen: set | None = None, end: int | None = None) -> tuple[int, Regs] | None:
        """(end, registers) of the preferred match from ``start``, at ``end`` if that is given."""
        if not self.straight:
            return next(self.ways(ctx, start, regs, seen, end), None)
        p, n = start, len(ctx.tokens)
        for op in self.code:
            name = op[0]
            if name == "one":
                if p >= n:
                    ctx.hit = True
                    return None
                if not op[1](ctx, p, regs):
                    return None
                p += 1
            elif name == "zero":
                if p >= n:
                    ctx.hit = True
                if not op[1](ctx, p, regs):
                    return None
            elif name == "save":
                regs = (*regs[: op[1]], p, *regs[op[1] + 1 :])
            elif name == "keep":
                regs = (p, *regs[1:])
        return (p, regs) if end is None or p == end else None

    def ways(self, ctx: Input, start: int, regs: Regs, seen: set | None = None, end: int | None = None):
        """All ends in order of preference, each once."""
        code, tokens, read = self.code, ctx.tokens, self.read
        seen = set() if seen is None else seen
        stack = [(0, start, regs)]
        while stack:
            pc, p, regs = stack.pop()
            while True:
                key = (pc, p, *[regs[k] for k in read]) if read else (pc, p)
                if key in seen:
                    break
                seen.add(key)
                op = code[pc]
                name = op[0]
                if name == "one":
                    if p >= len(tokens):
                        ctx.hit = True
                    elif op[1](ctx, p, regs):
                        pc, p = pc + 1, p + 1
                        continue
                    break
                if name == "split":
                    stack.append((op[2], p, regs))
                    pc = op[1]
                elif name == "goto":
                    pc = op[1]
                elif name == "many":
                    to, test, n, known, single = [(pc + 1, p, regs)], op[1], len(tokens), key[2:], not read
                    while True:
                        if p >= n:
                            ctx.hit = True
                            break
                        if not test(ctx, p, regs):
                            break
                        p += 1
                        key = (pc, p) if single else (pc, p) + known
                        if key in seen:
                            break
                        seen.add(key)
                        to.append((pc + 1, p, regs))
                    stack.extend(to)
                    break
                elif name == "zero":
                    if p >= len(tokens):
                        ctx.hit = True
                    if not op[1](ctx, p, regs):
                        break
                    pc += 1
                elif name == "save":
                    regs = (*regs[: op[1]], p, *regs[op[1] + 1 :])
                    pc += 1
                elif name == "keep":
                    regs = (p, *regs[1:])
                    pc += 1
                elif name == "jump":
                    to = op[1](ctx, p, regs)
                    stack.extend((pc + 1, q, regs) for q in reversed(to))
                    break
                elif name == "sub":
                    stack.extend((pc + 1, q, r) for q, r in reversed(op[1](ctx, p, regs)))
                    break
                else:
                    if end is None or p == end:
                        yield p, regs
                    break


def edits(a: list | str, b: list | str, most: int) -> int:
    """Edit distance of two sequences, or most + 1 beyond it."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def canonical(text: str, orbit: str | None) -> str:
    """A text's representative under an equivalence."""
    if orbit in (None, "exact"):
        return text
    if orbit == "case":
        return text.lower()
    if orbit == "fold":
        return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    if orbit == "numeric":
        n = V.number(text)
        return text if n is None else str(n.normalize())
    if orbit == "ip":
        a = V.address(text)
        return text if a is None else str(ipaddress.ip_address(a[1]) if a[0] == 4 else ipaddress.IPv6Address(a[1]))
    if orbit == "time":
        i = V.instant(text)
        return text if i is None else str(i.normalize())
    if orbit == "shape":
        return re.sub(r"[0-9]", "0", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", text)))
    if orbit and orbit.startswith("subnet"):
        bits = int(orbit.partition("/")[2] or 24)
        try:
            return str(ipaddress.ip_network(f"{text}/{bits}", strict=False))
        except ValueError:
            return text
    if orbit == "domain":
        return text.rpartition("@")[2].lower()
    if orbit in ("day", "hour", "minute"):
        return text[: {"day": 10, "hour": 13, "minute": 16}[orbit]]
    if orbit == "first":
        return text[:1]
    raise PatternError(f"no such equivalence: {orbit}")


_COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _operand(kind: str, text: str):
    bare = kind in ("bytesize", "duration", "money", "percent") and re.fullmatch(r"[\d_.]+", text)
    v = V.number(text) if bare else V.value(kind, text)
    if v is None and kind == "version":
        v = V.version(text)
    return v


def _compared(kind: str, op: str, text: str) -> Test:
    want = _operand(kind, text)
    if kind == "quantity" and want is not None:
        # only quantities of one family compare
        family = V.field(kind, text, "family")
        compare = _COMPARE[op]
        return lambda c, p, r: V.field(kind, c.tokens[p].text, "family") == family and compare(V.value(kind, c.tokens[p].text), want)
    if want is None:
        raise PatternError(f"can't read {text!r} as a value of {kind}")
    compare = _COMPARE[op]

    def test(ctx, p, regs):
        have = V.value(kind, ctx.tokens[p].text)
        return have is not None and compare(have, want)

    return test


def _since(op: str, sign: str, text: str, slot: int) -> Test:
    """This instant against the one a register holds."""
    gap = V.value("duration", text)
    if gap is None:
        raise PatternError(f"can't read {text!r} as a duration")
    gap, compare = Decimal(gap) / 10**9 * (-1 if sign == "-" else 1), _COMPARE[op]

    def test(ctx, p, regs):
        a, b = regs[slot], regs[slot + 1]
        if a < 0 or b != a + 1:
            return False
        then, now = V.instant(ctx.tokens[a].text), V.instant(ctx.tokens[p].text)
        return then is not None and now is not None and compare(now - then, gap)

    return test


def _field(kind: str, name: str, op: str, want: str) -> Test:
    number = V.number(want)
    if name == "len" and number is not None and number == int(number):
        most, compare = int(number), _COMPARE["=" if op == ":" else op]
        return lambda ctx, p, regs: compare(len(ctx.tokens[p].text), most)

    def test(ctx, p, regs):
        have = V.field(kind, ctx.tokens[p].text, name)
        if have is None:
            return False
        if isinstance(have, Decimal):
            return number is not None and _COMPARE["=" if op == ":" else op](have, number)
        ok = fnmatch.fnmatchcase(have.lower() if name == "host" else have, want)
        return not ok if op == "!=" else ok

    return test


def _networks(net: str) -> Test:
    try:
        inside = ipaddress.ip_network(net, strict=False)
    except ValueError as e:
        raise PatternError(f"no network: {net}") from e

    def test(ctx, p, regs):
        text = ctx.tokens[p].text
        try:
            a = ipaddress.ip_network(text, strict=False)
        except ValueError:
            return False
        return a.version == inside.version and a.subnet_of(inside)

    return test


class Parser:
    """Recursive descent; each rule returns a Node. ``read``: register slots that later parts look at."""

    def __init__(self, source: str, within: Parser | None = None) -> None:
        self.s, self.i, self.orbit = source, 0, within and within.orbit
        self.names: list[str] = within.names if within else []
        self.read: list[int] = within.read if within else []
        self.joins: set[str] = within.joins if within else set()
        #: How often each other input is asked, and kinds of the tokens asked for where they are known.
        self.asked: dict[str, int] = within.asked if within else {}
        self.known: dict[str, list[frozenset[str]]] = within.known if within else {}
        #: Tokens that a test looks back at most; None: all before it.
        self.past: list[int | None] = within.past if within else []
        self.lets: dict[str, str] = within.lets if within else {}
        self.swapped: bool = within.swapped if within else False
        #: Declared kinds.
        self.own: frozenset[str] = within.own if within else frozenset()

    def error(self, what: str) -> PatternError:
        return PatternError(f"{what} at {self.i} in {self.s!r}")

    def blank(self) -> None:
        while self.i < len(self.s) and self.s[self.i].isspace():
            self.i += 1

    def take(self, x: str) -> bool:
        if self.s.startswith(x, self.i):
            self.i += len(x)
            return True
        return False

    def match(self, pattern: str) -> re.Match | None:
        m = re.compile(pattern).match(self.s, self.i)
        if m:
            self.i = m.end()
        return m

    def whole(self) -> Node:
        node = self.choice()
        self.blank()
        if self.i < len(self.s):
            raise self.error("unexpected text")
        return node

    def slot(self, name: str) -> int:
        """Where the register's start lies in a match's registers; its end follows."""
        if name not in self.names:
            self.names.append(name)
        return 1 + 2 * self.names.index(name)

    def program(self, node: Node) -> Program:
        return Program(node, frozenset(self.read))

    def choice(self) -> Node:
        arms, ops = [self.sequence()], []
        while True:
            self.blank()
            op = next((o for o in ("||", "|>", "|") if self.s.startswith(o, self.i)), None)
            if not op:
                break
            self.i += len(op)
            ops.append(op)
            arms.append(self.sequence())
        if not ops:
            return arms[0]
        if len(set(ops)) > 1:
            raise self.error("mixed choices")
        if ops[0] == "|":
            return choice(arms)
        programs = [self.program(a) for a in arms]
        if ops[0] == "||":

            def longest(ctx, p, regs):
                found = [w for x in programs for w in x.ways(ctx, p, regs)]
                return sorted(found, key=lambda w: -w[0])

            return choice(arms, "sub", longest)

        def committed(ctx, p, regs):
            return next(([w] for x in programs if (w := x.run(ctx, p, regs)) is not None), [])

        return choice(arms, "sub", committed)

    def sequence(self) -> Node:
        items = []
        while True:
            self.blank()
            if self.i >= len(self.s) or self.s[self.i] in ")]}|":
                break
            items.append(self.item())
        for k, x in enumerate(items):
            if x.op == "zero" and x.asks and (got := begins(sequence(items[k + 1 :]))) and not got[2] and not got[1]:
                self.known.setdefault(x.asks[0][0], []).append(got[0])
        return items[0] if len(items) == 1 else sequence(items)

    def item(self) -> Node:
        node = self.atom()
        while True:
            if m := self.match(r"\{(\d+)(,(\d*))?\}([?+]?)"):
                lo = int(m[1])
                node = self.repeat(node, lo, lo if not m[2] else int(m[3]) if m[3] else None, m[4])
            elif m := self.match(r"([*+?])([?+]?)"):
                lo, hi = {"*": (0, None), "+": (1, None), "?": (0, 1)}[m[1]]
                node = self.repeat(node, lo, hi, m[2])
            elif m := self.match(r":([A-Za-z_]\w*)"):
                k = self.slot(m[1])
                node = sequence([Node("save", k), node, Node("save", k + 1)])
            elif self.s.startswith("::", self.i):
                raise self.error("scoped registers are not built")
            else:
                return node

    def repeat(self, node: Node, lo: int, hi: int | None, how: str) -> Node:
        if max(lo, hi or 0) > UNROLL or hi is not None and hi < lo:
            raise self.error(f"a count must lie in 0..{UNROLL}, low to high")
        high = None if hi is None and node.high != 0 or node.high is None else node.high * (hi or 0)
        out = Node("rep", (lo, hi, (how != "?") != self.swapped), [node], lo * node.low, high, node.needs if lo else frozenset())
        return self.atomic(out) if how == "+" else out

    def atomic(self, node: Node) -> Node:
        program = self.program(node)
        return Node("sub", lambda ctx, p, regs: [] if (w := program.run(ctx, p, regs)) is None else [w], [], node.low, node.high, node.needs, begins(node))

    def balanced(self, close: str) -> str:
        depth, start = 1, self.i
        pair = {")": "(", "]": "[", "}": "{"}[close]
        while self.i < len(self.s) and depth:
            c = self.s[self.i]
            if c == '"':
                self.i = self.s.index('"', self.i + 1)
            depth += (c == pair) - (c == close)
            self.i += 1
        if depth:
            raise self.error("unclosed group")
        return self.s[start : self.i - 1]

    def sub(self, source: str) -> Node:
        return Parser(source, self).whole()

    def predicate(self, kind: str, source: str) -> tuple[Test, tuple]:
        """A value test {...}: clauses joined by commas, each a comparison, a range, a set, or a named field; and what it asks other inputs."""
        tests: list[Test] = []
        asks: list[tuple[str, bool]] = []
        for clause in source.split(","):
            clause = clause.strip()
            if m := re.fullmatch(r"(>=|<=|>|<)([+-])([^:]+):([A-Za-z_]\w*)", clause):
                if kind != "timestamp" or m[4] not in self.names:
                    raise self.error(f"the relative test {{{clause}}} is not built")
                k = self.slot(m[4])
                self.read += (k, k + 1)
                tests.append(_since(m[1], m[2], m[3], k))
            elif re.match(r"(>=|<=|>|<)\+", clause):
                raise self.error(f"the relative test {{{clause}}} is not built")
            elif m := re.fullmatch(r"in:@(\w+)", clause):
                asks.append((self.ask(m[1], kind), True))
                tests.append(lambda c, p, r, f=m[1]: c.tokens[p].text in c.known.get(f, ()))
            elif m := re.fullmatch(r"!=@(\w+)", clause):
                asks.append((self.ask(m[1], kind), False))
                tests.append(lambda c, p, r, f=m[1]: c.tokens[p].text not in c.known.get(f, ()))
            elif m := re.fullmatch(r"(>=|<=|!=|=|>|<)\s*(.+)", clause):
                tests.append(_compared(kind, m[1], m[2]))
            elif m := re.fullmatch(r"in:(.+)", clause):
                tests.append(_networks(m[1]))
            elif m := re.fullmatch(r"contains:(.+)", clause):
                want = m[1]
                tests.append(lambda c, p, r, x=want: c.tokens[p].kind == "cidr" and ipaddress.ip_address(x) in ipaddress.ip_network(c.tokens[p].text, strict=False))
            elif clause in ("v4", "v6"):
                tests.append(lambda c, p, r, n=int(clause[1]): (V.address(c.tokens[p].text) or (0,))[0] == n)
            elif m := re.fullmatch(r"([a-z]+[0-9]?)(>=|<=|!=|=|>|<|:)(.+)", clause):
                tests.append(_field(kind, *m.groups()))
            elif ".." in clause:
                lo, _, hi = clause.partition("..")
                if lo:
                    tests.append(_compared(kind, ">=", lo))
                if hi:
                    tests.append(_compared(kind, "<=", hi))
            else:
                raise self.error(f"can't read the test {{{clause}}}")
        test = tests[0] if len(tests) == 1 else lambda c, p, r: all(f(c, p, r) for f in tests)
        return test, tuple(asks)

    def ask(self, name: str, kind: str | None = None) -> str:
        """Another input is asked for a token, of one kind if that is given."""
        self.joins.add(name)
        self.asked[name] = self.asked.get(name, 0) + 1
        if kind:
            self.known.setdefault(name, []).append(frozenset([kind]))
        return name

    def kind_atom(self) -> Node | None:
        r"""\N, \{kind}, a declared name or a byte class, with an optional value test."""
        if m := self.match(r"\\\{(\w+)\}"):
            kind = {"qty": "quantity"}.get(m[1], m[1])
            if kind in self.lets:
                inner = Parser(self.lets[kind], self)
                inner.lets = {k: v for k, v in self.lets.items() if k != kind}  # a name can't be part of itself
                return inner.whole()
            if kind not in KINDS and kind not in self.own:
                raise self.error(f"no kind {kind}")
        elif m := self.match(r"\\([NWQICUETVHZDRLP%$])"):
            kind = LETTERS[m[1]]
        elif m := self.match(r"\\([dwhaul])"):
            shape = re.compile(CLASSES[m[1]])
            return one(lambda c, p, r: shape.fullmatch(c.tokens[p].text) is not None)
        else:
            return None
        if self.s.startswith("{", self.i) and not re.match(r"\{\d+(,\d*)?\}", self.s[self.i :]):
            self.i += 1
            test, asks = self.predicate(kind, self.balanced("}"))
            node = one(lambda c, p, r: c.tokens[p].kind == kind and test(c, p, r), ("kind", kind))
            node.asks = asks
            return node
        return one(lambda c, p, r: c.tokens[p].kind == kind, ("kind", kind))

    def literal(self) -> tuple[str, int]:
        m = self.match(r'"((?:\\.|[^"\\])*)"(?:~(\d+))?')
        if not m:
            raise self.error("expected a literal")
        return re.sub(r"\\(.)", r"\1", m[1]), int(m[2] or 0)

    def token_class(self) -> Test:
        """[A B], [^A], and && / -- between parts."""
        negated = self.take("^")
        groups: list[list[Test]] = []
        ops: list[str] = []
        part: list[Test] = []
        while True:
            self.blank()
            if self.take("]"):
                break
            if self.i >= len(self.s):
                raise self.error("unclosed class")
            if self.take("&&") or self.take("--"):
                ops.append(self.s[self.i - 2 : self.i])
                groups.append(part)
                part = []
            else:
                part.append(self.single())
        groups.append(part)
        if len(groups) == 1 and len(part) == 1:
            only = part[0]
            return (lambda c, p, r: not only(c, p, r)) if negated else only

        def test(c, p, r):
            ok = any(f(c, p, r) for f in groups[0])
            for op, g in zip(ops, groups[1:], strict=True):
                hit = any(f(c, p, r) for f in g)
                ok = ok and (hit if op == "&&" else not hit)
            return ok != negated

        return test

    def single(self) -> Test:
        """The test of an atom that takes one token."""
        node = self.atom()
        if node.op != "one":
            raise self.error("expected an atom of one token")
        return node.arg

    def atom(self) -> Node:
        s = self.s
        if self.match(r"\\A"):
            return zero(lambda c, p, r: p == 0 and c.begun)
        if self.match(r"\\z"):
            return zero(lambda c, p, r: p == len(c.tokens))
        if self.match(r"\\G"):
            return zero(lambda c, p, r: p == c.origin)
        if self.match(r"\\K"):
            return Node("keep")
        if m := self.match(r"\\B([(\[{])"):
            opening = m[1]
            inner = self.balanced({"(": ")", "[": "]", "{": "}"}[opening])
            return self.group(opening, self.sub(inner) if inner.strip() else None)
        if self.match(r"\\B"):
            return self.group(None, None)
        if node := self.kind_atom():
            return node
        if self.match(r'#"'):
            return self.silhouette()
        if self.take("^"):
            return Node("zero", lambda c, p, r: p < len(c.tokens) and (p == 0 or c.tokens[p - 1].line < c.tokens[p].line), edge=True)
        if self.take("$"):
            return zero(lambda c, p, r: p > 0 and (p == len(c.tokens) or c.tokens[p - 1].line < c.tokens[p].line))
        if self.take("."):
            return one(lambda c, p, r: True)
        if m := self.match(r"`((?:\\`|[^`])*)`"):
            shape = re.compile(m[1].replace("\\`", "`"))
            return one(lambda c, p, r: shape.fullmatch(c.tokens[p].text) is not None)
        if s.startswith('"', self.i):
            return self.literal_node()
        if self.take("["):
            return one(self.token_class())
        if self.match(r"\(\?>"):
            return self.atomic(self.sub(self.balanced(")")))
        if m := self.match(r"\(\?orbit:([\w/]+)\s"):
            canonical("", m[1])  # an unknown equivalence is refused here
            old, self.orbit = self.orbit, m[1]
            body = self.sub(self.balanced(")"))
            self.orbit = old
            return body
        if self.take("("):
            inner = self.balanced(")")
            if m := self.match(r"~(\d+)"):
                return self.near_group(inner, int(m[1]))
            return self.sub(inner)
        if m := self.match(r"=([a-z]+(?:/?\d+)?)\s+([A-Za-z_]\w*)"):
            return self.back(m[2], m[1])
        if m := self.match(r"=([A-Za-z_]\w*)"):
            return self.back(m[1], None)
        if m := self.match(r"(!?)~(<|>(\d+)|#)?(?:\{(\d+)(,(\d*))?\})?"):
            return self.look(m)
        if m := self.match(r"<|>|/"):
            return one(lambda c, p, r, x=m[0]: c.tokens[p].text == x)
        if m := self.match(r"@(\w+)"):
            return self.anchor(m[1])
        raise self.error("can't read the pattern")

    def literal_node(self) -> Node:
        text, k = self.literal()
        orbit = self.orbit
        want = [t.text for t in lex(text)] or [text]
        if k:
            key = canonical(text, orbit)
            return one(lambda c, p, r: edits(canonical(c.tokens[p].text, orbit), key, k) <= k)
        keys = [canonical(w, orbit) for w in want]
        exact = orbit in (None, "exact")
        kinds = {t.text: t.kind for t in lex(text)}
        parts = [one(lambda c, p, r, key=key: canonical(c.tokens[p].text, orbit) == key, *([("word", w)] if exact and kinds.get(w) in ("word", "punct") else [])) for key, w in zip(keys, want, strict=True)]
        return parts[0] if len(parts) == 1 else sequence(parts)

    def silhouette(self) -> Node:
        """#"W(N,N)": W a word, N a number, . any token, other marks themselves."""
        end = self.s.find('"', self.i)
        if end < 0:
            raise self.error("unclosed silhouette")
        said, self.i = self.s[self.i : end], end + 1
        kinds = {"W": "word", "N": "number"}
        parts = []
        for x in said:
            if not x.isspace():
                parts.append(one(lambda c, p, r, k=kinds[x]: c.tokens[p].kind == k, ("kind", kinds[x])) if x in kinds else one(lambda c, p, r: True) if x == "." else one(lambda c, p, r, x=x: c.tokens[p].text == x))
        return sequence(parts)

    def near_group(self, inner: str, most: int) -> Node:
        """A run of tokens that its atoms match with at most ``most`` tokens wrong, left out or too many."""
        p, tests = Parser(inner, self), []
        before = len(self.read)
        while True:
            p.blank()
            if p.i >= len(p.s):
                break
            node = p.atom()
            for x in node.parts if node.op == "seq" else [node]:
                if x.op != "one":
                    raise p.error("an edit group takes atoms of one token")
                tests.append(x.arg)
        free = before == len(self.read) and len(tests) > most
        key = object()

        def fits(ctx):
            """Which tests each token passes, where no register is read and no text can follow."""
            return ctx.once(key, lambda: [[bool(t(ctx, i, ())) for t in tests] for i in range(len(ctx.tokens))])

        def starts(ctx):
            # of the first most + 1 tokens one must fit, or they cost too much already
            said, n = [any(x) for x in fits(ctx)], most + 1
            return [at for at in range(len(said)) if at + n > len(said) or any(said[at : at + n])]

        def ends(ctx, at, regs):
            row, best = list(range(len(tests) + 1)), {}
            said = fits(ctx) if free and not ctx.open else None
            for n in range(len(tests) + most + 1):
                if row[-1] <= most and n:
                    best[n] = row[-1]
                if min(row) > most:
                    break
                if at + n >= len(ctx.tokens):
                    ctx.hit = True
                    break
                now = said[at + n] if said is not None else [t(ctx, at + n, regs) for t in tests]
                last, row = row, [n + 1]
                for j, t in enumerate(now):
                    row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (not t)))
            return [at + n for n in sorted(best, key=lambda n: (best[n], abs(n - len(tests)), n))]

        return Node("jump", ends, [], max(1, len(tests) - most), len(tests) + most, first=starts if free else None)

    def back(self, name: str, relation: str | None) -> Node:
        if name not in self.names:
            raise self.error(f"no register {name}")
        orbit = relation or self.orbit
        fuzzy = int(relation[4:] or 1) if relation and re.fullmatch(r"edit\d*", relation) else None
        if fuzzy is None:
            canonical("", orbit)
        k = self.slot(name)
        self.read += (k, k + 1)
        key = ("canonical", orbit)

        def ends(ctx, p, regs):
            a, b = regs[k], regs[k + 1]
            if a < 0 or b < a:
                return []
            if p + b - a > len(ctx.tokens):
                ctx.hit = True
                return []
            if b == a + 1 and fuzzy is None:
                x, y = ctx.tokens[p].text, ctx.tokens[a].text
                known = ctx.memo.get(key)
                if known is None:
                    known = ctx.memo[key] = {}
                for w in (x, y):
                    if w not in known:
                        known[w] = canonical(w, orbit)
                return [p + 1] if known[x] == known[y] else []
            for x, y in zip(ctx.tokens[p : p + b - a], ctx.tokens[a:b], strict=True):
                if edits(x.text, y.text, fuzzy) > fuzzy if fuzzy is not None else canonical(x.text, orbit) != canonical(y.text, orbit):
                    return []
            return [p + b - a]

        return Node("jump", ends, [], 0, None)

    def group(self, opening: str | None, body: Node | None) -> Node:
        """A bracket pair; what lies between must match ``body`` from end to end."""
        program = body and self.program(body)
        self.past.append(None)

        def ways(ctx, p, regs):
            if p >= len(ctx.tokens):
                ctx.hit = True
                return []
            t = ctx.tokens[p]
            ctx.hit |= t.kind == "open" and t.mate < 0
            if t.kind != "open" or t.mate < 0 or opening and t.text != opening:
                return []
            if program is None:
                return [(t.mate + 1, regs)]
            w = program.run(ctx, p + 1, regs, None, t.mate)
            return [] if w is None else [(t.mate + 1, w[1])]

        return Node("sub", ways, [], 2, None, frozenset([("kind", "open"), ("kind", "close")]) | (body.needs if body else frozenset()), (frozenset(["open"]), frozenset(), False))

    def look(self, m: re.Match) -> Node:
        negated, where = bool(m[1]), m[2] or ""
        lo = int(m[4]) if m[4] else 1
        hi = None if not m[4] or m[5] and not m[6] else int(m[6] or m[4])
        if self.s.startswith('"', self.i):
            text, _ = self.literal()

            def ahead(c, p, r):
                found = p < len(c.tokens) and c.text.find(text, c.tokens[p].start) >= 0
                c.hit |= not found
                return found != negated

            return zero(ahead)
        if not self.take("("):
            raise self.error("expected a group to look for")
        before = len(self.read)
        body = self.sub(self.balanced(")"))
        program = self.program(body)
        free = before == len(self.read)  # reads no register: its answer at a position is always the same
        key = object()

        def here(c, p, r):
            if not free:
                return program.run(c, p, r) is not None
            known = c.once(key, dict)
            if p not in known:
                known[p] = program.run(c, p, r) is not None
            return known[p]

        def counted(c, a, b, r):
            n = 0
            for q in range(a, b):
                n += here(c, q, r)
                if n >= lo and hi is None or hi is not None and n > hi:
                    break
            return lo <= n and (hi is None or n <= hi)

        if where == "<":
            low, high = body.low, body.high
            self.past.append(high)

            def behind(c, p, r):
                first = 0 if high is None else max(0, p - high)
                return any(program.run(c, a, r, None, p) is not None for a in range(p - low, first - 1, -1))

            return zero(lambda c, p, r: behind(c, p, r) != negated)
        if where.startswith(">"):
            reach = int(m[3])

            def close(c, p, r):
                c.hit |= p + reach > len(c.tokens)
                return counted(c, p, min(len(c.tokens), p + reach), r) != negated

            return zero(close)
        if where == "#":
            self.past.append(None)

            def inside(c, p, r):
                t = c.tokens[p] if p < len(c.tokens) else None
                c.hit |= t is not None and t.kind == "open" and t.mate < 0
                return (t is not None and t.kind == "open" and t.mate >= 0 and counted(c, p + 1, t.mate, r)) != negated

            return zero(inside)
        return zero(lambda c, p, r: here(c, p, r) != negated)

    def anchor(self, name: str) -> Node:
        orbit = self.orbit
        if name in LENSES:
            return self.sub(LENSES[name])
        if name == "super":
            self.past.append(None)
            want = m[1] if (m := self.match(r":([a-z]+)")) else None
            if want not in (None, *ROLES):
                raise self.error(f"no role {want}")

            def unit(c, p, r):
                c.hit = True  # a unit's role may hang on what follows it
                if p >= len(c.tokens):
                    return False
                u = c.units()[p]
                return u is not None and (u.first == p if want is None else u.role == want)

            return zero(unit)
        if name in ("echoed", "novel") and (m := self.match(r":@(\w+)")):
            want, other = name == "echoed", self.ask(m[1])
            return Node("zero", lambda c, p, r: p < len(c.tokens) and (c.tokens[p].text in c.known.get(other, ())) == want, asks=((other, want),))
        if name in ("order", "echo", "echoed", "novel", "nested"):
            self.past.append(None)
        if name == "order" and (m := self.match(r":(asc|desc)\b")):
            want = m[1] == "asc"
            return zero(lambda c, p, r: p < len(c.tokens) and c.order()[p] is want)
        nth = name == "echo" and self.match(r":nth")
        m = self.match(r"(>=|<=|=|>|<)(-?\d+)")
        op, n = (_COMPARE[m[1]], int(m[2])) if m else (None, 0)
        at = lambda c, p: c.places(orbit)[canonical(c.tokens[p].text, orbit)]

        def later(test: Test) -> Node:
            """A test that the rest of the text may change."""

            def run(c, p, r):
                c.hit = True
                return p < len(c.tokens) and test(c, p, r)

            return zero(run)

        if nth and m:

            def occurrence(c, p, r):
                places = at(c, p)
                want = n if n >= 0 else len(places) + n + 1
                return want > 0 and op(bisect.bisect_left(places, p) + 1, want)

            return later(occurrence) if n < 0 else zero(lambda c, p, r: p < len(c.tokens) and occurrence(c, p, r))
        if name == "echo" and m:
            return later(lambda c, p, r: op(len(at(c, p)), n))
        if name == "echoed":
            return later(lambda c, p, r: len(at(c, p)) > 1)
        if name == "novel":
            return zero(lambda c, p, r: p < len(c.tokens) and at(c, p)[0] == p)
        if name == "nested" and m:
            return zero(lambda c, p, r: p < len(c.tokens) and op(c.tokens[p].depth, n))
        if name.isdigit():
            return zero(lambda c, p, r: p < len(c.tokens) and c.fields()[p] == int(name))
        raise self.error(f"no anchor @{name}")


@dataclass
class Match:
    start: int
    end: int
    text: str
    line: int
    registers: dict[str, tuple[int, int, str, str]]


class Pattern:
    """A compiled pattern; ``names`` are its registers in order, ``joins`` the other inputs that it names."""

    def __init__(self, source: str, lets: dict[str, str] | None = None, orbit: str | None = None, ignore_case: bool = False, swap_greed: bool = False, shapes: dict[str, str] | None = None, kinds: dict[str, str] | None = None) -> None:
        """``lets``: patterns by name, for \\{name}; ``orbit``: the equivalence of literals and back-references; ``swap_greed``: ? marks the greedy form.

        ``shapes``: kinds of their own by regular expression, lexed before the
        built-in ones; ``kinds``: kinds by pattern, each of whose matches
        becomes one token, in turn.
        """
        p = Parser(source)
        self.shapes = tuple((shapes or {}).items())
        known = [*(shapes or {})]
        self.kinds: list[tuple[str, Pattern]] = []
        for name, form in (kinds or {}).items():
            self.kinds.append((name, Pattern(form, lets, shapes={n: "(?!)" for n in known})))
            known.append(name)
        p.own = frozenset(known)
        p.lets, p.orbit, p.swapped = lets or {}, orbit or ("case" if ignore_case else None), swap_greed
        if p.orbit:
            canonical("", p.orbit)
        self.source, node = source, p.whole()
        self.needs = Needs(*(frozenset(x for k, x in node.needs if k == w) for w in ("kind", "word")))
        self.names, self.joins = p.names, frozenset(p.joins)
        self.past = None if None in p.past else sum(p.past)
        self.program = p.program(node)
        got = begins(node)
        self.first = None if got is None or got[2] else got[:2]
        self.lengths = frozenset(map(len, self.first[1])) if self.first else frozenset()
        self.starts = node.first if callable(node.first) else None
        self.edge = at_edge(node)
        #: Looks at most tokens, so that they are better made at once.
        self.full = self.first is None or self.past is None or bool(self.kinds)
        own = bool(self.shapes or self.kinds)
        #: Kinds of the tokens that each other input is asked for; None where that isn't known.
        self.asked = {n: frozenset().union(*p.known.get(n, [])) if not own and len(p.known.get(n, [])) == k else None for n, k in p.asked.items()}
        flat = flattened(node)
        asks = [x for n in flat for x in n.asks]
        #: What the one token of a match must be in other inputs, where nothing else hangs on it: such matches can be told afterwards.
        self.apart = dict(asks) if asks and not own and len(asks) == sum(p.asked.values()) == len({*asks}) == len(dict(asks)) and sum(n.op == "one" for n in flat) == 1 and all(n.op in ("one", "zero", "save") for n in flat) else None

    def absent(self, text: str) -> bool:
        """Whether a text holds no match because a word that every match has or begins with is missing in it."""
        if any(w not in text for w in self.needs.words):
            return True
        return self.first is not None and not self.first[0] and not any(w in text for w in self.first[1])

    def candidates(self, ctx: Input):
        """Tokens that a match may begin at, in order; None for all."""
        if self.starts is not None:
            return self.starts(ctx)
        tokens = ctx.tokens
        if self.first is not None:
            kinds, texts = self.first
            if isinstance(tokens, Lazy):
                text, lengths = ctx.text, self.lengths
                if not texts:
                    return [i for i, x in enumerate(tokens.found) if x[0] in kinds]
                return [i for i, (k, a, b) in enumerate(tokens.found) if k in kinds or b - a in lengths and text[a:b] in texts]
            return [i for i, t in enumerate(tokens) if t.kind in kinds or t.text in texts]
        if self.edge:
            return [i for i, t in enumerate(tokens) if i == 0 or tokens[i - 1].line < t.line]
        return None

    def spans(self, ctx: Input, limit: int | None = None, start: int = 0):
        """(first token, end token, registers) of leftmost matches that don't overlap; an empty match is none.

        Over an open input it ends before the first start whose answer later
        text could change, and leaves that start in ``ctx.at``.
        """
        seen: set = set()
        blank = (-1,) * (1 + 2 * len(self.names))
        p, n = start, 0
        likely = None if ctx.open else self.candidates(ctx)
        if likely is not None:
            run = self.program.run
            for q in likely:
                if limit is not None and n >= limit:
                    break
                if q < p:
                    continue
                got = run(ctx, q, blank, seen)
                if got is None:
                    continue
                end, regs = got
                a = regs[0] if regs[0] >= 0 else q
                if seen:
                    seen.clear()
                if end <= a:
                    continue
                n += 1
                p = ctx.origin = max(end, q + 1)
                yield a, end, regs
            ctx.at = len(ctx.tokens)
            return
        while p < len(ctx.tokens) and (limit is None or n < limit):
            ctx.hit = False
            got = self.program.run(ctx, p, blank, seen)
            if ctx.open and ctx.hit:
                break
            if got is None:
                p += 1
                continue
            end, regs = got
            a = regs[0] if regs[0] >= 0 else p
            seen.clear()
            if end <= a:
                p += 1
                continue
            n += 1
            p = ctx.origin = max(end, p + 1)
            yield a, end, regs
        ctx.at = p

    def input(self, text: str, known: dict[str, set[str]] | None = None, full: bool = False) -> Input:
        """A text under the pattern's own shapes and kinds."""
        return Input(text, self.tokens(text) if full or self.full else Lazy(text, lexed(text, self.shapes)), known)

    def bound(self, ctx: Input, regs: Regs):
        """(name, start, end, kind) of the registers of a match, in characters."""
        tokens = ctx.tokens
        for k, n in enumerate(self.names):
            x, y = regs[1 + 2 * k], regs[2 + 2 * k]
            if 0 <= x < y:
                yield n, tokens[x].start, tokens[y - 1].end, tokens[x].kind if y == x + 1 else "run"

    def find(self, text: str | None, limit: int | None = None, known: dict[str, set[str]] | None = None, tokens: list[Token] | None = None) -> list[Match]:
        """Leftmost matches that don't overlap; ``known`` holds the tokens shared with each input that the pattern names."""
        text = text or ""
        if self.absent(text):
            return []
        ctx = self.input(text, known) if tokens is None or self.shapes or self.kinds else Input(text, tokens, known)
        tokens, out = ctx.tokens, []
        for a, e, bound in self.spans(ctx, limit):
            regs = {n: (x, y, text[x:y], kind) for n, x, y, kind in self.bound(ctx, bound)}
            first = tokens[a]
            end = tokens[e - 1].end
            out.append(Match(first.start, end, text[first.start : end], first.line, regs))
        return out

    def count(self, text: str | None) -> int:
        """Number of matches."""
        text = text or ""
        return 0 if self.absent(text) else sum(1 for _ in self.spans(self.input(text)))

    def tokens(self, text: str) -> list[Token]:
        """The text's tokens under the pattern's own shapes and kinds."""
        out = lex(text, shapes=self.shapes)
        for name, p in self.kinds:
            fused, at = [], 0
            for a, e, _ in p.spans(Input(text, out)):
                fused += out[at:a]
                fused.append(Token(name, out[a].start, out[e - 1].end, text[out[a].start : out[e - 1].end], out[a].line))
                at = e
            if at:
                out = paired([*fused, *out[at:]])
        return out

    def is_match(self, text: str | None) -> bool:
        return bool(self.find(text, 1))

    def find_at(self, text: str, start: int) -> Match | None:
        """The first match that begins at or after character ``start``."""
        return next((m for m in self.find(text) if m.start >= start), None)

    def shortest_match(self, text: str) -> int | None:
        """The least end of any match from the leftmost start, in characters."""
        tokens = self.tokens(text)
        ctx = Input(text, tokens)
        blank = (-1,) * (1 + 2 * len(self.names))
        for p in range(len(tokens)):
            ends = [e for e, _ in self.program.ways(ctx, p, blank) if e > p]
            if ends:
                return tokens[min(ends) - 1].end
        return None

    def split(self, text: str, most: int | None = None) -> list[str]:
        """The text between matches, in at most ``most`` parts."""
        out, at = [], 0
        for m in self.find(text, None if most is None else most - 1):
            out.append(text[at : m.start])
            at = m.end
        return [*out, text[at:]]

    def split_at_depth(self, text: str, depth: int) -> list[str]:
        """The text between the matches that begin at one bracket depth."""
        tokens, out, at = self.tokens(text), [], 0
        for a, e, _ in self.spans(Input(text, tokens)):
            if tokens[a].depth == depth:
                out.append(text[at : tokens[a].start])
                at = tokens[e - 1].end
        return [*out, text[at:]]


def escape(text: str) -> str:
    """A literal pattern for a text."""
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'
