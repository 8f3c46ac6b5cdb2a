"""Line dedup across documents with once-seen and twice-seen Bloom filters."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _base as B

#: Bits of a filter at most (128 MB): beyond it, more lines are suspected and confirmed exactly.
MAX_BITS = 1 << 30
#: Bits of a segment, the part of both filters that one reducing step holds.
SEGMENT_BITS = 1 << 22
#: Hashes that a task gathers before it gives them on.
CHUNK = 1 << 19
#: Stands for a null doc_id: one document, after all others.
LAST = (1 << 63) - 1

_BLANK = b" \t\n\x0b\x0c\r"
_UPPER_TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def keys_of(text: bytes, least: int) -> list[bytes | None]:
    """Each line's key: stripped, A-Z lower-cased; None if under ``least`` code points."""
    out: list[bytes | None] = []
    for line in text.translate(_UPPER_TO_LOWER).split(b"\n"):
        k = line.strip(_BLANK)
        n = len(k)
        out.append(k if n >= 4 * least or n >= least and len(k.decode()) >= least else None)
    return out


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two filter positions of each 64-bit hash, one row a hash."""
    mask = np.uint64(bits - 1)
    return np.stack([hashes & mask, hashes >> np.uint64(32) & mask], axis=1).astype(np.uint32)


def filter_bits(docs: DataFrame) -> int:
    """About 16 bits a line, from the size of the scan; a power of two."""
    want = max(1 << 16, B.scan_bytes(docs) // 3)
    return min(MAX_BITS, 1 << (int(want) - 1).bit_length())


def twice_filter(docs: DataFrame, text: str, least: int, bits: int) -> dict[int, bytes]:
    """Segments of the twice-seen filter (deflated bitmaps; absent: no bit set).

    A task gives each segment the sorted positions that its documents' distinct
    keys touch (its part of the once-seen filter), and those touched more than
    once. A reducing step counts them: touched by two tasks, or twice by one,
    is twice-seen. A key in two documents touches both its positions twice, so
    there are no false negatives. At most ``bits`` / 8 bytes reach the driver.
    """
    seg = min(SEGMENT_BITS, bits)

    def touch(batches):
        def given():
            pos = np.sort(_positions(np.array(hashes, dtype=np.uint64), bits).ravel())
            at, n = np.unique(pos, return_counts=True)
            cut = np.searchsorted(at, np.arange(0, bits + 1, seg, dtype=np.uint64))
            rows: tuple[list, list, list] = ([], [], [])
            for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if a < b:
                    rel = at[a:b] - np.uint32(k * seg)
                    rows[0].append(k)
                    rows[1].append(rel.tobytes())
                    rows[2].append(rel[n[a:b] > 1].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], ["segment", "once", "twice"])

        hashes: list[int] = []
        for b in batches:
            for t in b.column(0):
                v = t.as_buffer()
                if v is not None:
                    hashes.extend(map(xxhash.xxh3_64_intdigest, set(filter(None, keys_of(v.to_pybytes(), least)))))
                if len(hashes) >= CHUNK:
                    yield given()
                    hashes = []
        if hashes:
            yield given()

    def reduce(batches):
        now, once, twice = None, None, None

        for b in batches:
            for k, o, w in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if k != now:
                    if now is not None and twice.any():
                        yield _segment(now, twice)
                    now, once, twice = k, np.zeros(seg, dtype=bool), np.zeros(seg, dtype=bool)
                at = np.frombuffer(o, dtype=np.uint32)
                twice[at[once[at]]] = True
                once[at] = True
                twice[np.frombuffer(w, dtype=np.uint32)] = True
        if now is not None and twice.any():
            yield _segment(now, twice)

    parts = max(1, min(bits // seg, B.shuffle_parts(docs.sparkSession)))
    touched = docs.select(F.col(text).cast("binary")).mapInArrow(touch, "segment int, once binary, twice binary")
    found = touched.repartition(parts, "segment").sortWithinPartitions("segment").mapInArrow(reduce, "segment int, bitmap binary").collect()
    return {r.segment: bytes(r.bitmap) for r in found}


def _bitmap(told, name: str, bits: int) -> np.ndarray:
    """The filter as one packed array, opened once a worker."""

    def opened():
        seg = min(SEGMENT_BITS, bits)
        whole = np.zeros(bits // 8, dtype=np.uint8)
        for k, z in told.value.items():
            whole[k * seg // 8 : (k + 1) * seg // 8] = np.frombuffer(zlib.decompress(z), dtype=np.uint8)
        return whole

    return B.held(("filter", name), opened)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _spread(ids: np.ndarray) -> np.ndarray:
    """64-bit hashes of document ids."""
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def id_filter(ids: DataFrame, bits: int) -> dict[int, bytes]:
    """Segments of a filter that holds every id of a one-column frame; at most ``bits`` / 8 bytes reach the driver."""
    seg = min(SEGMENT_BITS, bits)

    def touch(batches):
        for b in batches:
            pos = np.unique(_positions(_spread(b.column(0).to_numpy()), bits).ravel())
            cut = np.searchsorted(pos, np.arange(0, bits + 1, seg, dtype=np.uint64))
            rows = [(k, (pos[x:y] - np.uint32(k * seg)).tobytes()) for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if x < y]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["segment", "at"])

    def reduce(batches):
        now, held = None, None
        for b in batches:
            for k, at in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if k != now:
                    if now is not None:
                        yield _segment(now, held)
                    now, held = k, np.zeros(seg, dtype=bool)
                held[np.frombuffer(at, dtype=np.uint32)] = True
        if now is not None:
            yield _segment(now, held)

    parts = max(1, min(bits // seg, B.shuffle_parts(ids.sparkSession)))
    dealt = ids.mapInArrow(touch, "segment int, at binary").repartition(parts, "segment").sortWithinPartitions("segment")
    return {r.segment: bytes(r.bitmap) for r in dealt.mapInArrow(reduce, "segment int, bitmap binary").collect()}


def _segment(k: int, held: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(np.packbits(held).tobytes(), 1)], pa.binary())], ["segment", "bitmap"])


def _has(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    pos = _positions(hashes, bits)
    return (bitmap[pos >> 3] >> (7 - (pos & 7).astype(np.uint8)) & 1).all(axis=1)


def dedup_lines(docs: DataFrame, least: int = 10, doc_id: str = "doc_id", text: str = "text", bits: int | None = None) -> DataFrame:
    """Drop every line whose key an earlier document holds too; keep the document rows.

    Returns the columns of ``docs`` with ``text`` replaced, then n_lines (before
    dropping) and n_dropped (columns of those names are replaced; columns of
    any other name pass through). Lines are split at \\n; a key is the line
    stripped of blanks with A-Z lower-cased; keys under ``least`` code points
    never count. A key found in two documents stays only in the smallest doc_id
    that holds it, all its lines there included. Rows of equal doc_id are one
    document, and so are all rows with a null id, which come last. A null text
    is one empty line and stays null. Whole texts are read, one at a time, so a
    very long one needs memory for itself alone. An empty table gives no rows.

    Of the lines only (document id, 128-bit digest of the key) of those move
    that the twice-seen filter suspects; each suspicion is confirmed by the
    digest. Of the documents only those move that lose a line, by a filter of
    their ids with few false positives; the others pass where they are.
    """
    spark = docs.sparkSession
    B.ship(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own = [f"_c{k}" for k in range(len(names))]  # a caller's names can't clash with ours
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(names, own, strict=True)])
    said, who = own[names.index(text)], own[names.index(doc_id)]
    rows = rows.withColumn("_id", F.coalesce(F.col(who).cast("long"), F.lit(LAST)))
    bits = bits or filter_bits(rows.select(said))
    told = spark.sparkContext.broadcast(twice_filter(rows.select(said), said, least, bits))
    tag = B.new_path(spark, "filter")

    def suspects(batches):
        twice = _bitmap(told, tag, bits)
        for b in batches:
            ids, found = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = v.as_buffer()
                keys = list(set(filter(None, keys_of(raw.to_pybytes(), least)))) if raw is not None else []
                if keys:
                    hit = np.flatnonzero(_has(twice, np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64), bits))
                    ids += [i] * len(hit)
                    found += [_digest(keys[k]) for k in hit]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["_id", "_key"])

    pairs = B.stage(rows.select("_id", F.col(said).cast("binary")).mapInArrow(suspects, "_id long, _key binary"), "keys")
    repeated = pairs.groupBy("_key").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).filter("_first < _last")
    repeated = B.stage(repeated.select("_key", "_first"), "repeated")
    losing = pairs.join(repeated, "_key").filter(F.col("_id") != F.col("_first"))
    losing = B.stage(losing.groupBy("_id").agg(F.collect_set("_key").alias("_drop")), "losing")
    B.drop(pairs, repeated)
    few = max(1 << 16, 16 * losing.count())
    few = min(MAX_BITS, 1 << (few - 1).bit_length())
    changed = spark.sparkContext.broadcast(id_filter(losing.select("_id"), few))
    tag2 = B.new_path(spark, "changed")
    n_lines = (F.coalesce(F.length(said) - F.length(F.replace(F.col(said), F.lit("\n"))), F.lit(0)) + 1).cast("long")

    def only(hits: bool):
        def run(batches):
            bitmap = _bitmap(changed, tag2, few)
            for b in batches:
                yield b.filter(pa.array(_has(bitmap, _spread(b.column(b.num_columns - 1).to_numpy()), few) == hits))

        return rows.mapInArrow(run, rows.schema)

    def cut(batches):
        for b in batches:
            texts, n, at = [], [], b.schema.get_field_index(said)
            for v, d in zip(b.column(at), b.column(b.num_columns - 1), strict=True):
                v, gone, dropped = v.as_py(), set(d.as_py() or ()), 0
                if gone and v is not None:
                    lines = v.split("\n")
                    stay = [x for x, k in zip(lines, keys_of(v.encode(), least), strict=True) if k is None or _digest(k) not in gone]
                    v, dropped = "\n".join(stay), len(lines) - len(stay)
                texts.append(v)
                n.append(dropped)
            cols = [pa.array(texts, b.column(k).type) if k == at else b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64())], [*b.schema.names[:-1], "_dropped"])

    joined = only(True).withColumn("_n", n_lines).join(losing, "_id", "left").select(*own, "_n", "_drop")
    joined = joined.mapInArrow(cut, T.StructType(joined.schema.fields[:-1]).add("_dropped", "long"))
    out = only(False).select(*own, n_lines.alias("_n"), F.lit(0).cast("long").alias("_dropped")).unionByName(joined)
    return out.select(*[F.col(n).alias(c) for n, c in zip(own, names, strict=True)], F.col("_n").alias("n_lines"), F.col("_dropped").alias("n_dropped"))
