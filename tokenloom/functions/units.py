"""Units: runs of tokens between statement ends, with the role that their form gives them."""

from __future__ import annotations

from dataclasses import dataclass

from .lexer import Token

ROLES = ("call", "assign", "kv", "list", "numeric", "plain")
#: What may stand before "=" to make it another operator (fixed values).
_OPERATORS = frozenset("=<>!+-*/%&|^:")


@dataclass(slots=True)
class Unit:
    first: int  # token
    end: int  # token after the last
    depth: int
    role: str


def role(part: list[Token], opens: bool) -> str:
    """The first role that fits; ``opens``: a bracket pair follows."""
    said = [t.text if t.kind == "punct" else "" for t in part]
    if opens and part[-1].kind == "word":
        return "call"
    for k, s in enumerate(said):
        if s == "=" and said[k + 1 : k + 2] != ["="] and not (k and said[k - 1] in _OPERATORS):
            return "assign"
    if part[0].kind == "word" and said[1:2] == [":"]:
        return "kv"
    if said.count(",") > 1:
        return "list"
    numbers, words = (sum(t.kind == k for t in part) for k in ("number", "word"))
    return "numeric" if numbers and numbers >= words else "plain"


def divide(tokens: list[Token]) -> list[Unit]:
    """Units end at ";", at a line's end and at brackets that have a mate; runs of nothing are no unit."""
    borders = [i for i, t in enumerate(tokens) if t.text == ";" or t.mate >= 0]
    out, depth, at = [], 0, 0
    for border in [*borders, len(tokens)]:
        cuts = [at, *[i for i in range(at + 1, border) if tokens[i].line > tokens[i - 1].line + tokens[i - 1].text.count("\n")], border]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                mate = tokens[border] if border < len(tokens) and b == border else None
                opens = mate is not None and mate.kind == "open" and mate.mate >= 0 and mate.line == tokens[b - 1].line
                out.append(Unit(a, b, depth, role(tokens[a:b], opens)))
        if border < len(tokens) and tokens[border].mate >= 0:
            depth = max(0, depth + (1 if tokens[border].kind == "open" else -1))
        at = border + 1
    return out
