"""Best-fit packing of tokenized documents into fixed-capacity sequences."""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import _base as B
from . import tokens as K

_PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long", ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])


def pieces(docs: DataFrame, vocabulary: str, capacity: int, doc_id: str = "doc_id", text: str = "text", end_id: int = K.END_ID) -> DataFrame:
    """One row for each piece of each document's ids; only the first piece may be short of capacity."""
    schema, names, kinds = _PIECES

    def run(batches):
        enc = K.encoder(vocabulary)
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            ids = b.column(0).to_pylist()
            for first, texts in K.slices(b.column(1)):
                cols: list[list] = [[] for _ in names]
                for k, p in enumerate(enc.packed(texts)):
                    raw = np.frombuffer(p, dtype=enc.dtype).astype("<u4").tobytes() + end
                    n = len(raw) // 4
                    at, piece = 0, 0
                    size = n % capacity or min(n, capacity)
                    while at < n:
                        for c, v in zip(cols, (ids[first + k], piece, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])), strict=True):
                            c.append(v)
                        at, piece, size = at + size, piece + 1, capacity
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, schema)


@dataclass
class Run:
    """Documents of one length, by rank, that one superstep puts into gaps of one size, by rank."""

    step: int
    length: int
    rank: int  # of the first document
    n: int  # documents
    each: int  # documents a gap
    gap: int
    first: int  # rank of the first gap
    to: int = 0  # rank of the first gap under its new size


def sweep(step: int, pending: dict[int, list[int]], gaps: dict[int, int]) -> tuple[list[Run], dict[int, int]]:
    """One superstep's matching, by size classes: (runs, gaps left under their new sizes).

    Lengths go down, and each takes the next sizes of gaps that hold it, the
    tightest first. A gap takes documents of one length a superstep, as many as
    fit; the k-th document that asks for a size gets the k-th gap of it, so no
    two get the same place. ``pending`` holds (next rank, documents left) and is
    updated.
    """
    sizes, runs, used = sorted(gaps), [], dict.fromkeys(gaps, 0)
    for length in sorted(pending, reverse=True):
        at = bisect.bisect_left(sizes, length)
        while pending[length][1] and at < len(sizes):
            gap = sizes[at]
            rank, left = pending[length]
            bins, each = min(gaps[gap] - used[gap], left // (gap // length)), gap // length
            if not bins and used[gap] < gaps[gap]:
                bins, each = 1, left
            if not bins:
                at += 1
                continue
            runs.append(Run(step, length, rank, bins * each, each, gap, used[gap]))
            used[gap] += bins
            pending[length] = [rank + bins * each, left - bins * each]
        if not pending[length][1]:
            del pending[length]
    after = {g: n - used[g] for g, n in gaps.items() if n > used[g]}
    for r in runs:
        r.to = after.get(r.gap - r.each * r.length, 0)
        if r.gap > r.each * r.length:
            after[r.gap - r.each * r.length] = r.to + r.n // r.each
    return runs, after


_GAP = "gap long, rank long, seq long, used boolean, next_gap long, next_rank long"


def update(gaps: DataFrame, runs: list[Run]) -> DataFrame:
    """Each open gap after a superstep: whether it was used, its new size (0: full) and its rank there."""
    by: dict[int, list[Run]] = defaultdict(list)
    for r in runs:
        by[r.gap].append(r)
    table = {g: np.array([(r.first, r.n // r.each, r.gap - r.each * r.length, r.to) for r in rs], np.int64) for g, rs in by.items()}

    def run(batches):
        for b in batches:
            gap, rank = b.column(0).to_numpy(), b.column(1).to_numpy()
            used, size, place = np.zeros(len(gap), bool), gap.copy(), rank.copy()
            for g in np.unique(gap):
                if (t := table.get(int(g))) is None:
                    continue
                at = np.flatnonzero(gap == g)
                mine = t[np.searchsorted(t[:, 0], rank[at], side="right") - 1]
                taken = rank[at] < t[-1, 0] + t[-1, 1]
                used[at] = taken
                size[at] = np.where(taken, mine[:, 2], g)
                place[at] = np.where(taken, mine[:, 3] + rank[at] - mine[:, 0], rank[at] - t[-1, 0] - t[-1, 1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(used), pa.array(size), pa.array(place)], ["gap", "rank", "seq", "used", "next_gap", "next_rank"])

    return gaps.mapInArrow(run, _GAP)


def best_fit(items: DataFrame, capacity: int, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows of 1..capacity tokens, by bulk-synchronous best fit.

    Rows are range-sorted by length and ``order``; a row's rank among equal
    lengths comes from its global position, so a length that a third of all
    rows share is still spread over tasks. Open gaps are a distributed table of
    their own, by size and rank. In each superstep documents ask for the
    tightest gap that holds them; the sweep over sizes, of which there are at
    most ``capacity`` of either kind, settles which ranks meet, and a map over
    the gaps puts each under its new size and rank. What finds no gap has new
    sequences opened for the next superstep: as many as its tokens fill, and
    one for each document of over half the capacity. Few supersteps (about ten)
    are needed, as all sizes are matched in each. At last documents and the
    gaps used meet by (superstep, size, rank).

    Longer rows or rows below 1 are an error; an empty table gives an empty
    one; repeated rows are packed each; other columns pass through.
    """
    spark = items.sparkSession
    histogram = {r[0]: r[1] for r in items.groupBy(length).count().collect()}  # at most ``capacity`` rows
    if any(k is None or not 1 <= k <= capacity for k in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    total, first, at = sum(histogram.values()), {}, 0
    for size in sorted(histogram):
        first[size], at = at, at + histogram[size]
    parts = max(1, min(100_000, max(B.shuffle_parts(spark), total // 500_000)))
    rows, _ = B.ranked(items, [length, *order], parts, "pack")

    fresh = histogram.get(capacity, 0)  # documents of the whole capacity: a sequence each, by rank
    pending = {k: [0, n] for k, n in histogram.items() if k < capacity}
    sizes: dict[int, int] = {}
    gaps: DataFrame | None = None
    steps, history = [], []
    while pending:
        most = max(sizes, default=0)
        stuck = {k: n for k, (_, n) in pending.items() if k > most}
        if stuck:
            new = max(sum(n for k, n in stuck.items() if 2 * k > capacity), -(-sum(k * n for k, n in stuck.items()) // capacity))
            opened = spark.range(0, new, 1, max(1, min(parts, new // 500_000))).select(F.lit(capacity).cast("long").alias("gap"), (F.col("id") + sizes.get(capacity, 0)).alias("rank"), (F.col("id") + fresh).alias("seq"))
            gaps = opened if gaps is None else gaps.unionByName(opened)
            sizes[capacity], fresh = sizes.get(capacity, 0) + new, fresh + new
        runs, sizes = sweep(len(history), pending, sizes)
        after = B.stage(update(gaps.coalesce(max(1, min(parts, fresh // 500_000))), runs), "gaps")
        steps += runs
        history.append(after.filter("used").select(F.lit(len(history)).alias("_step"), F.col("gap").alias("_gap"), F.col("rank").alias("_grank"), "seq"))
        gaps = after.filter("next_gap > 0").select(F.col("next_gap").alias("gap"), F.col("next_rank").alias("rank"), "seq")

    by: dict[int, list[Run]] = defaultdict(list)
    for r in steps:
        by[r.length].append(r)
    table = {k: np.array([(r.rank, r.step, r.gap, r.first, r.each) for r in rs], np.int64) for k, rs in by.items()}
    names = [*items.columns]
    own = [f"_c{k}" for k in range(len(names))]  # a caller's names can't clash with ours
    told = spark.sparkContext.broadcast((first, table))

    def place(batches):
        first, table = told.value
        for b in batches:
            size, pos = b.column(names.index(length)).to_numpy(), b.column(len(names)).to_numpy()
            out = np.zeros((4, len(size)), np.int64)  # superstep, gap, its rank, offset
            for k in np.unique(size):
                at = np.flatnonzero(size == k)
                rank = pos[at] - first[int(k)]
                if int(k) == capacity:
                    out[:, at] = np.stack([np.full(len(at), -1), np.full(len(at), capacity), rank, np.zeros(len(at), np.int64)])
                    continue
                t = table[int(k)]
                r = t[np.searchsorted(t[:, 0], rank, side="right") - 1]
                i = rank - r[:, 0]
                out[:, at] = np.stack([r[:, 1], r[:, 2], r[:, 3] + i // r[:, 4], capacity - r[:, 2] + i % r[:, 4] * k])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *map(pa.array, out)], [*own, "_step", "_gap", "_grank", "_offset"])

    schema = StructType([StructField(o, f.dataType, f.nullable) for o, f in zip(own, items.schema.fields, strict=True)])
    for c in ("_step", "_gap", "_grank", "_offset"):
        schema = schema.add(c, LongType(), False)
    placed = rows.select(*names, "pos").mapInArrow(place, schema)
    whole = placed.filter("_step < 0").withColumn("seq", F.col("_grank"))
    out = whole
    if history:
        met = history[0]
        for h in history[1:]:
            met = met.unionByName(h)
        out = placed.filter("_step >= 0").join(met, ["_step", "_gap", "_grank"]).select(whole.columns).unionByName(whole)
    return out.select(*[F.col(o).alias(c) for o, c in zip(own, names, strict=True)], F.col("seq").alias("sequence_id"), F.col("_offset").alias("offset"))


def pack(docs: DataFrame, capacity: int = 1024, vocabulary: str | None = None, **names) -> DataFrame:
    """Pack whole documents into as few sequences of ``capacity`` tokens as bulk-synchronous best fit finds.

    One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. Null or empty text is a document of the end id alone; null ids and
    repeated rows are packed like any other; a very long text is cut into
    pieces, each packed by itself; an empty table gives no rows; other columns
    are ignored.
    """
    vocabulary = vocabulary or K.default_vocabulary()
    B.ship(docs.sparkSession)
    return best_fit(B.stage(pieces(docs, vocabulary, capacity, **names), "pieces"), capacity)
