"""Summaries of inputs by which a scan leaves out those that can't match."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexer import KINDS, lex
from ..plans.pattern import Needs, Pattern
from ..shipping import ship

#: Bits of an input's filter of tokens, and probes.
BITS, PROBES = 2048, 4


def places(text: str) -> list[int]:
    """Filter positions of a token's lower-case text."""
    low = text.lower().encode()
    return [zlib.crc32(low, 0x9E3779B9 * k & 0xFFFFFFFF) % BITS for k in range(1, PROBES + 1)]


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, kinds, seen): text length, a bit for each kind of token, and a filter of words and marks; one row an input."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t, kinds, seen = t.as_py() or "", 0, np.zeros(BITS, bool)
                for x in lex(t):
                    kinds |= 1 << KINDS.index(x.kind)
                    if x.kind in ("word", "punct"):
                        seen[places(x.text)] = True
                rows.append((doc, len(t), kinds, np.packbits(seen).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x) for k, x in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "size", "kinds", "seen"])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "doc_id long, size long, kinds long, seen binary")


def save(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def stale(docs: DataFrame, index: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that the index lacks, or that have another length than when it was made."""
    have = index.select(F.col("doc_id").alias("_d"), F.col("size").alias("_n"))
    return docs.join(have, (F.col(doc_id).cast("long") == F.col("_d")) & (F.coalesce(F.length(text), F.lit(0)) == F.col("_n")), "left_anti")


def candidates(index: DataFrame, pattern: str) -> DataFrame:
    """(doc_id,) of the inputs that may match: all kinds and literals that every match needs are there. No input that matches is left out."""
    needs: Needs = Pattern(pattern).needs
    mask = sum(1 << KINDS.index(k) for k in needs.kinds)
    keep = F.col("kinds").bitwiseAND(F.lit(mask)) == mask
    at = sorted({p for w in needs.words for p in places(w)})
    for p in at:
        byte = F.conv(F.hex(F.substring("seen", p // 8 + 1, 1)), 16, 10).cast("int")
        keep = keep & (byte.bitwiseAND(F.lit(128 >> p % 8)) != 0)
    return index.filter(keep).select("doc_id")


def pruned(docs: DataFrame, index: DataFrame, pattern: str, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that a scan for ``pattern`` has to read."""
    keep = candidates(index, pattern).withColumnRenamed("doc_id", "_d")
    return docs.join(keep, F.col(doc_id).cast("long") == F.col("_d"), "left_semi")
