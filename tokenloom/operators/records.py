"""Records cut by brackets, by matches and by units."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexer import lex
from ..functions.units import divide
from ..plans.pattern import Pattern
from ..shipping import ship
from .scan import SLICE

_RECORD = "doc_id long, rec int, start int, end int, depth int, role string, text string"


def _cut(docs: DataFrame, doc_id: str, text: str, make) -> DataFrame:
    """Records (start, end, depth, role) that ``make(text)`` finds, in order, counted from 1."""
    ship(docs.sparkSession)
    kinds = (pa.int64(), *[pa.int32()] * 4, pa.string(), pa.string())
    names = ["doc_id", "rec", "start", "end", "depth", "role", "text"]

    def run(batches):
        for b in batches:
            rows = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py() or ""
                rows += [(doc, k, *r, t[r[0] : r[1]]) for k, r in enumerate(make(t), 1)]
                if len(rows) >= SLICE:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x) for k, x in enumerate(kinds)], names)
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x) for k, x in enumerate(kinds)], names)

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, _RECORD)


@lru_cache(64)
def _compiled(pattern: str) -> Pattern:
    return Pattern(pattern)


def blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A record for each bracket pair, outer ones before those within."""

    def make(t):
        ts = lex(t)
        return [(x.start, ts[x.mate].end, x.depth, "block") for x in ts if x.kind == "open" and x.mate >= 0]

    return _cut(docs, doc_id, text, make)


def units(docs: DataFrame, role: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A record for each unit (of one role), see ``functions.units``."""

    def make(t):
        ts = lex(t)
        return [(ts[u.first].start, ts[u.end - 1].end, u.depth, u.role) for u in divide(ts) if role in (None, u.role)]

    return _cut(docs, doc_id, text, make)


def spans(docs: DataFrame, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A record for each match."""
    Pattern(pattern)

    def make(t):
        return [(m.start, m.end, 0, "span") for m in _compiled(pattern).find(t)]

    return _cut(docs, doc_id, text, make)


def started(docs: DataFrame, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A record from each match to the next, or to the text's end; text before the first match is none."""
    Pattern(pattern)

    def make(t):
        at = [m.start for m in _compiled(pattern).find(t)]
        return [(a, b, 0, "record") for a, b in zip(at, [*at[1:], len(t)], strict=False)]

    return _cut(docs, doc_id, text, make)
