"""Line readings of matches: context, inversion, whole lines, windows, splitting and counts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pattern import Pattern
from ..shipping import ship
from . import scan


def _per_text(docs: DataFrame, pattern: str, doc_id: str, text: str, schema: str, make) -> DataFrame:
    """Rows that ``make(pattern, text)`` gives for each text, after its id."""
    ship(docs.sparkSession)
    Pattern(pattern)
    names = ["doc_id", *[c.strip().split()[0] for c in schema.split(",")]]
    kinds = [pa.int64(), *[{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.strip().split()[1]] for c in schema.split(",")]]

    def run(batches):
        p = Pattern(pattern)
        for b in batches:
            rows = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows += [(doc, *r) for r in make(p, t.as_py())]
                if len(rows) >= scan.SLICE:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, f"doc_id long, {schema}")


def _lines(text: str | None) -> list[str]:
    """Lines without their ends; a last line end opens no line."""
    out = (text or "").split("\n")
    return out[:-1] if len(out) > 1 and out[-1] == "" else out


def _hit(p: Pattern, text: str | None, found: list | None = None) -> set[int]:
    """Numbers (from 1) of the lines that some match touches."""
    out: set[int] = set()
    for m in p.find(text) if found is None else found:
        out.update(range(m.line, m.line + m.text.count("\n") + 1))
    return out


def touched(docs: DataFrame, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rec, text) of the lines that a match touches."""

    def make(p, t):
        hit, said = _hit(p, t), _lines(t)
        return [(k, said[k - 1]) for k in sorted(hit) if k <= len(said)]

    return _per_text(docs, pattern, doc_id, text, "rec int, text string", make)


def untouched(docs: DataFrame, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rec, text) of the lines that no match touches."""

    def make(p, t):
        hit = _hit(p, t)
        return [(k, x) for k, x in enumerate(_lines(t), 1) if k not in hit]

    return _per_text(docs, pattern, doc_id, text, "rec int, text string", make)


def whole(docs: DataFrame, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rec, text) of the lines that one match covers from the first token to the last."""

    def make(p, t):
        said = _lines(t)
        at = [0]
        for x in said:
            at.append(at[-1] + len(x) + 1)
        return [(m.line, said[m.line - 1]) for m in p.find(t) if "\n" not in m.text and m.line <= len(said) and said[m.line - 1].strip() == m.text]

    return _per_text(docs, pattern, doc_id, text, "rec int, text string", make)


def context(docs: DataFrame, pattern: str, before: int, after: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rec, hit, text): touched lines with ``before`` and ``after`` lines around them, each once."""

    def make(p, t):
        hit, said = _hit(p, t), _lines(t)
        near = sorted({k for h in hit for k in range(max(1, h - before), min(len(said), h + after) + 1)})
        return [(k, k in hit, said[k - 1]) for k in near]

    return _per_text(docs, pattern, doc_id, text, "rec int, hit boolean, text string", make)


def split(docs: DataFrame, pattern: str, most: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, part, text): what lies between matches, parts from 0."""
    return _per_text(docs, pattern, doc_id, text, "part int, text string", lambda p, t: list(enumerate(p.split(t or "", most))))


def counts(docs: DataFrame, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lines, matches): touched lines and matches of the inputs that have any."""
    return _per_text(docs, pattern, doc_id, text, "lines long, matches long", lambda p, t: [(len(_hit(p, t, found)), len(found))] if (found := p.find(t)) else [])


def with_match(docs: DataFrame, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, found) of every input; a search ends with its first match."""
    return _per_text(docs, pattern, doc_id, text, "found boolean", lambda p, t: [(p.is_match(t),)])


def window(docs: DataFrame, first: int, last: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rec, text): lines ``first`` to ``last``, counted from 1, or from the end if negative; array functions only."""
    said = F.split(F.col(text), "\n", -1)
    said = F.when((F.size(said) > 1) & (F.element_at(said, -1) == ""), F.slice(said, 1, F.size(said) - 1)).otherwise(said)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), said.alias("_l")).withColumn("_n", F.size("_l"))
    a = F.greatest(F.lit(1), F.lit(first) if first > 0 else F.col("_n") + first + 1)
    b = F.least(F.col("_n"), F.lit(last) if last > 0 else F.col("_n") + last + 1)
    cut = F.when(a <= b, F.slice("_l", a, b - a + 1)).otherwise(F.array())
    return rows.select("doc_id", a.alias("_a"), F.posexplode(cut).alias("_k", "text")).select("doc_id", (F.col("_a") + F.col("_k")).cast("int").alias("rec"), "text")
