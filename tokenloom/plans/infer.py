"""Patterns inferred from example texts: the most specific one that covers them all."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.lexer import Token, lex
from .pattern import escape


@dataclass
class Cell:
    """A place of the pattern: its kinds, its text where that never changes, and whether it may be missing."""

    kinds: tuple[str, ...]
    text: str | None
    optional: bool = False

    def merged(self, t: Token) -> Cell:
        kinds = self.kinds if t.kind in self.kinds else (*self.kinds, t.kind)
        return Cell(kinds, self.text if self.text == t.text else None, self.optional)

    def written(self) -> str:
        one = [rf"\{{{k}}}" for k in self.kinds]
        body = escape(self.text) if self.text is not None else one[0] if len(one) == 1 else "[" + " ".join(one) + "]"
        return body + ("?" if self.optional else "")


def align(cells: list[Cell], tokens: list[Token]) -> list[tuple[int, int]]:
    """Pairs (cell, token) of an alignment with the most kinds in common, then the most texts."""
    n, m = len(cells), len(tokens)
    best = [[(0, 0)] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1])
            if tokens[j].kind in cells[i].kinds:
                k, t = best[i + 1][j + 1]
                best[i][j] = max(best[i][j], (k + 1, t + (cells[i].text == tokens[j].text)))
    out, i, j = [], 0, 0
    while i < n and j < m:
        k, t = best[i + 1][j + 1]
        if tokens[j].kind in cells[i].kinds and best[i][j] == (k + 1, t + (cells[i].text == tokens[j].text)):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def infer(examples: list[str]) -> str:
    """A pattern that matches each example from its first token to its last; examples without tokens are ignored.

    Examples are aligned one after the other. Between aligned places, those
    left over on both sides are paired in order and take both kinds; what then
    remains on one side alone is optional.
    """
    told = [ts for x in examples if (ts := lex(x))]
    if not told:
        raise ValueError("no example has a token")
    cells = [Cell((t.kind,), t.text) for t in told[0]]
    for tokens in told[1:]:
        out: list[Cell] = []
        i = j = 0
        for a, b in [*align(cells, tokens), (len(cells), len(tokens))]:
            while i < a and j < b:
                out.append(cells[i].merged(tokens[j]))
                i, j = i + 1, j + 1
            out += [Cell(c.kinds, c.text, True) for c in cells[i:a]]
            out += [Cell((t.kind,), t.text, True) for t in tokens[j:b]]
            if a < len(cells):
                out.append(cells[a].merged(tokens[b]))
            i, j = a + 1, b + 1
        cells = out
    return r"\A " + " ".join(c.written() for c in cells) + r" \z"
