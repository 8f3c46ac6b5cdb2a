"""Declarations: shapes, kinds, names, tests, fields and rules of a pattern file."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reports, scan
from .pattern import Pattern, PatternError

_NAME = r"([A-Za-z_]\w*)"
_SAID = re.compile(r'"((?:\\.|[^"\\])*)"')


def _texts(said: str) -> list[str]:
    return [re.sub(r"\\(.)", r"\1", m) for m in _SAID.findall(said)]


@dataclass
class Declarations:
    """What a file declares, one declaration a line; # begins a comment line.

    shape NAME = `regular expression`        a kind of its own, lexed first
    kind NAME = PATTERN                      matches become one token
    let NAME = PATTERN                       stands for the pattern in \\{NAME}
    test NAME accepts "text" ... rejects "text" ...
    fields NAME {register} {[int]register} ...
    rule NAME [severity] "message" = PATTERN
    unless NAME = PATTERN, fix NAME = TEMPLATE, meta NAME key = value
    """

    shapes: dict[str, str] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)
    lets: dict[str, str] = field(default_factory=dict)
    tests: list[tuple[str, list[str], list[str]]] = field(default_factory=list)
    fields: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    rules: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def read(cls, text: str) -> Declarations:
        """Refuses lines that are no declaration, names declared twice, and patterns that can't be read."""
        out = cls()
        for n, line in enumerate(text.split("\n"), 1):
            line = line.strip()
            if line and not line.startswith("#"):
                try:
                    out._line(line)
                except PatternError as e:
                    raise PatternError(f"line {n}: {e}") from e
        for p in [*out.lets.values(), *out.kinds.values(), *[r["pattern"] for r in out.rules.values()]]:
            out.pattern(p)
        return out

    def _line(self, line: str) -> None:
        if m := re.fullmatch(rf"shape {_NAME} = `(.*)`", line):
            self._new(self.shapes, m[1], m[2])
            re.compile(m[2])
        elif m := re.fullmatch(rf"(kind|let) {_NAME} = (.*)", line):
            self._new(self.kinds if m[1] == "kind" else self.lets, m[2], m[3])
        elif m := re.fullmatch(rf"test {_NAME}(?: accepts((?: {_SAID.pattern})+))?(?: rejects((?: {_SAID.pattern})+))?", line):
            self.tests.append((m[1], _texts(m[2] or ""), _texts(m[4] or "")))
        elif m := re.fullmatch(rf"fields {_NAME}((?: \{{[^}}]*\}})+)", line):
            self._new(self.fields, m[1], [(x or "string", r) for x, r in re.findall(r"\{(?:\[(int|double|string)\])?(\w+)\}", m[2])])
        elif m := re.fullmatch(rf'rule {_NAME}(?: (error|warning|note))? "((?:\\.|[^"\\])*)" = (.*)', line):
            self._new(self.rules, m[1], {"name": m[1], "severity": m[2] or "warning", "message": m[3], "pattern": m[4], "meta": {}})
        elif (m := re.fullmatch(rf"(fix|unless) {_NAME} = (.*)", line)) and m[2] in self.rules:
            self.rules[m[2]][m[1]] = m[3]
        elif (m := re.fullmatch(rf"meta {_NAME} (\w+) = (.*)", line)) and m[1] in self.rules:
            self.rules[m[1]]["meta"][m[2]] = m[3]
        else:
            raise PatternError(f"can't read the declaration {line!r}")

    def _new(self, where: dict, name: str, what) -> None:
        taken = self.fields if where is self.fields else self.rules if where is self.rules else {**self.shapes, **self.kinds, **self.lets}
        if name in taken:
            raise PatternError(f"{name} is declared twice")
        where[name] = what

    @property
    def options(self) -> dict:
        """Options of ``Pattern`` and ``scan.matches``."""
        return {"lets": self.lets, "shapes": self.shapes, "kinds": self.kinds}

    def pattern(self, source: str) -> Pattern:
        return Pattern(source, **self.options)

    def failures(self) -> list[tuple[str, str, str]]:
        """(name, text, "accepts" or "rejects") of the tests that don't hold: a text is accepted if the name matches all of it."""
        out = []
        for name, good, bad in self.tests:
            p = self.pattern(rf"\A {self.rules[name]['pattern']} \z" if name in self.rules else rf"\A \{{{name}}} \z")
            out += [(name, t, "accepts") for t in good if not p.is_match(t)]
            out += [(name, t, "rejects") for t in bad if p.is_match(t)]
        return out

    def extract(self, docs: DataFrame, name: str) -> DataFrame:
        """(doc_id, m, fields...): the registers of a declared name's matches as typed columns; null where a field doesn't read."""
        found = scan.matches(docs, self.lets[name], **self.options)
        return found.select("doc_id", "m", *[F.element_at("registers", F.lit(r)).try_cast(t).alias(r) for t, r in self.fields[name]])

    def findings(self, docs: DataFrame) -> DataFrame:
        return reports.findings(docs, list(self.rules.values()), **self.options)

    def fixed(self, docs: DataFrame) -> DataFrame:
        return reports.fixed(docs, list(self.rules.values()), **self.options)
