"""Exact Jaccard self-join of documents on word shingles.

The index is a prefix index: shingles have one total order (a level of document
frequency, then hash), a set of n shingles is posted under its first
n - ceil(t n) + 1, and two sets whose similarity reaches t share a posting.
Shingles of one document need no posting at all. Lists of rare shingles give
their pairs at once. In a list of a frequent shingle each entry meets only a
leader of its size class at first; then two skips keep the work near the
answers:

* lists whose entries already lie in one component are skipped; of the others,
  entries are skipped by position: what is left of a set from its position on
  must reach the overlap that the smallest partner in the list needs;
* within a block a set's overlaps with all others are derived from those of the
  most similar set already answered: the posting lists of the few shingles in
  which both differ are subtracted or added.

Only components and numbers of links leave a block, never its pairs.

Shingle sets are made with numpy over the bytes of a batch: word hashes are
polynomial sums, shingle hashes mix five of them, 64 bits each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _base as B
from .graphs import components

#: Document frequencies above which a shingle moves to the next level.
LEVELS = (1, 16, 256)
#: Bits of the map from hash to level at most, for each level.
MAX_BITS = 1 << 30
#: Sets of one side of a block, and bytes of their hashes: long texts make smaller blocks.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Bytes of text that are hashed in one go.
CHUNK = 1 << 19

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


def _powers(n: int) -> np.ndarray:
    p = np.full(max(1, n), _STEP, dtype=_U)
    p[0] = 1
    return np.cumprod(p, dtype=_U)


def _words(buf: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word of a byte buffer; no word crosses ``breaks``."""
    solid = ~_BLANK[buf]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    edge = breaks[(breaks > 0) & (breaks < len(buf))]
    begin[edge] = solid[edge]
    at = np.flatnonzero(begin)
    if not len(at):
        return at, np.empty(0, _U)
    span = np.diff(at, append=len(buf))
    span[0] += at[0]
    place = np.arange(len(buf)) - np.repeat(at, span)
    place[: at[0]] = 0
    value = np.where(solid, (_FOLD[buf].astype(_U) + _U(1)) * _powers(int(place.max()) + 1)[np.maximum(place, 0)], _U(0))
    return at, _mix(np.add.reduceat(value, at))


def _long_words(raw: memoryview) -> np.ndarray:
    """Word hashes of one long text, in slices that end at a blank."""
    buf, out, at = np.frombuffer(raw, dtype=np.uint8), [], 0
    while at < len(buf):
        end = min(len(buf), at + CHUNK)
        while end < len(buf):
            stop = np.flatnonzero(_BLANK[buf[end : end + CHUNK]])
            if len(stop):
                end += int(stop[0])
                break
            end = min(len(buf), end + CHUNK)
        out.append(_words(buf[at:end], np.empty(0, np.int64))[1])
        at = end
    return np.concatenate(out) if out else np.empty(0, _U)


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each run of ``k`` words, unsorted; of all words if there are fewer."""
    coef = _powers(k + 1)[1:]
    n = len(words)
    if n < k:
        return _mix(np.array([np.sum(words * coef[:n]) + _U(n)], dtype=_U)) if n else np.empty(0, _U)
    total = np.zeros(n - k + 1, dtype=_U)
    for i in range(k):
        total += words[i : n - k + 1 + i] * coef[i]
    return _mix(total)


def sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a string column, in order."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    starts = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + CHUNK, side="right")) - 1)
        end = min(end, len(column))
        lo, hi = int(starts[row]), int(starts[end])
        if end == row + 1 and hi - lo > CHUNK:
            yield np.unique(_shingles(_long_words(memoryview(buf)[lo:hi]), k))
        else:
            cut = starts[row : end + 1] - lo
            at, words = _words(buf[lo:hi], cut)
            of = np.searchsorted(at, cut)
            full = _shingles(words, k) if len(words) >= k else np.empty(0, _U)
            for a, b in zip(of[:-1], of[1:], strict=True):
                yield np.unique(full[a : b - k + 1] if b - a >= k else _shingles(words[a:b], k))
        row = end


def required(n: int | np.ndarray, m: int | np.ndarray, t: int) -> np.ndarray:
    """Least intersection of sets of n and m with similarity t percent: 100 i >= t (n + m - i)."""
    return -(-t * (np.asarray(n, np.int64) + m) // (100 + t))


def prefix(n: int, t: int) -> int:
    return n - -(-t * n // 100) + 1


class Levels:
    """Frequency level of hashes: a bitmap for each level, coarser for the rarer, higher ones."""

    def __init__(self, bits: int, maps: list[bytes]) -> None:
        self.bits = bits
        self.maps = [np.frombuffer(zlib.decompress(m), dtype=np.uint8) for m in maps]

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), dtype=np.uint8)
        for k, m in enumerate(self.maps):
            at = h >> _U(64 - self.bits + 3 * (k > 0))
            out = np.where((m[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 > 0, np.uint8(k + 1), out)
        return out


def _pieces(values: np.ndarray, keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of ``values`` by the top bits of ``keys``."""
    if not len(values):
        return
    part = (keys >> _U(64 - parts.bit_length() + 1)).astype(np.int64) if parts > 1 else np.zeros(len(keys), np.int64)
    order = np.argsort(part, kind="stable")
    part, values = part[order], values[order]
    cut = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(cut, [*cut[1:], len(part)], strict=True):
        yield int(part[a]), values[a:b]


def _by_part(batches, column: int, dtype) -> Iterator[tuple[int, np.ndarray]]:
    """All values of each part, from rows (part, blob...) sorted by part."""
    now, got = None, []
    for b in batches:
        for p, raw in zip(b.column(0).to_pylist(), b.column(column), strict=True):
            if p != now and got:
                yield now, np.concatenate(got)
                got = []
            now = p
            got.append(np.frombuffer(raw.as_buffer().to_pybytes(), dtype=dtype))
    if got:
        yield now, np.concatenate(got)


def levels(docs: DataFrame, text: str, k: int, parts: int) -> tuple[int, list[bytes]]:
    """Document frequencies of all shingles, exact to 32 bits within a part, as level bitmaps.

    A task sends each part the sorted low halves of its documents' shingles;
    only the bitmaps, bounded by MAX_BITS, reach the driver. A hash that shares
    its bit with a more frequent one takes that level too, which keeps the
    order total and the join exact.
    """
    spark = docs.sparkSession
    tokens = max(1 << 14, B.scan_bytes(docs.select(text)) // 4)
    bits = min(MAX_BITS, 1 << (tokens - 1).bit_length()).bit_length() - 1
    shift = parts.bit_length() - 1

    def count(batches):
        def given(got):
            h = np.concatenate(got)
            rows = [(p, np.sort((v << _U(shift) >> _U(32)).astype(np.uint32)).tobytes()) for p, v in _pieces(h, h, parts)]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.binary())], ["part", "hashes"])

        got, size = [], 0
        for b in batches:
            for s in sets(b.column(0), k):
                got.append(s)
                size += len(s)
                if size >= 1 << 20:
                    yield given(got)
                    got, size = [], 0
        if size:
            yield given(got)

    def judge(batches):
        for p, v in _by_part(batches, 1, np.uint32):
            v.sort()
            at = np.flatnonzero(np.diff(v, prepend=v[0] - np.uint32(1)) != 0)
            if at[0] != 0:
                at = np.concatenate([[0], at])
            n = np.diff(at, append=len(v))
            # back to the top bits of the hash: part, then the 32 bits below it
            h = (_U(p) << _U(64 - shift) if shift else _U(0)) | v[at].astype(_U) << _U(32 - shift)
            out = [np.unique((h[n > least] >> _U(64 - bits + 3 * (j > 0))).astype(np.uint32)) for j, least in enumerate(LEVELS)]
            yield pa.RecordBatch.from_arrays([pa.array([j for j, x in enumerate(out) if len(x)], pa.int32()), pa.array([zlib.compress(np.diff(x, prepend=np.uint32(0)).tobytes(), 1) for x in out if len(x)], pa.binary())], ["level", "bits"])

    spread = min(parts, max(B.shuffle_parts(spark), 1))
    rows = docs.select(text).mapInArrow(count, "part int, hashes binary").repartition(spread, "part").sortWithinPartitions("part")
    maps = [np.zeros(1 << max(0, bits - 3 * (j > 0)), dtype=bool) for j in range(len(LEVELS))]
    for r in rows.mapInArrow(judge, "level int, bits binary").toLocalIterator():
        maps[r.level][np.cumsum(np.frombuffer(zlib.decompress(r.bits), dtype=np.uint32), dtype=np.uint32)] = True
    return bits, [zlib.compress(np.packbits(m, bitorder="little").tobytes(), 1) for m in maps]


POSTING = np.dtype([("token", "<u8"), ("set", "<u8"), ("n", "<u4"), ("pos", "<u4")])


def _name(s: np.ndarray, seed: int) -> int:
    return int(_mix(np.array([np.sum(_mix(s ^ _U(seed))) + _U(len(s))], dtype=_U)).view(np.int64)[0])


def index(docs: DataFrame, doc_id: str, text: str, k: int, t: int, parts: int, told, bits: int, key: int, seed: int) -> DataFrame:
    """Staged rows of four kinds.

    0: documents (doc_id, n, set, check); 1: sets (set, n, hashes); 2: postings
    of rare shingles by part; 3: those of shingles above the first level.
    ``set`` and ``check`` are two hashes of the set, 128 bits together.
    """

    def run(batches):
        lev, done, rare, often, size = B.held(("levels", key), lambda: Levels(bits, told.value)), set(), [], [], 0

        def given():
            rows = []
            if rare:
                v = np.concatenate(rare)
                rows += [(p, x.tobytes(), 2) for p, x in _pieces(v, v["token"], parts)]
            if often:
                v = np.concatenate(often)
                rows += [(0, v[at : at + 65536].tobytes(), 3) for at in range(0, len(v), 65536)]
            return rows

        def batch(docrows=(), setrows=(), postrows=()):
            d, s, p = list(docrows), list(setrows), list(postrows)
            no = [None]
            cols = [
                pa.array(no * (len(d) + len(s)) + [x[0] for x in p], pa.int32()),
                pa.array([x[0] for x in d] + no * (len(s) + len(p)), pa.int64()),
                pa.array([x[1] for x in d] + [x[1] for x in s] + no * len(p), pa.int64()),
                pa.array([x[2] for x in d] + [x[0] for x in s] + no * len(p), pa.int64()),
                pa.array([x[3] for x in d] + no * (len(s) + len(p)), pa.int64()),
                pa.array(no * len(d) + [x[2] for x in s] + no * len(p), pa.binary()),
                pa.array(no * (len(d) + len(s)) + [x[1] for x in p], pa.binary()),
                pa.array([0] * len(d) + [1] * len(s) + [x[2] for x in p], pa.int32()),
            ]
            return pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "n", "set", "check", "hashes", "postings", "kind"])

        for b in batches:
            docrows, setrows, held = [], [], 0
            for doc, s in zip(b.column(0).to_pylist(), sets(b.column(1), k), strict=True):
                n = len(s)
                name = _name(s, 2 * seed) if n else 0
                docrows.append((doc, n, name, _name(s, 2 * seed + 1) if n else 0))
                if not n or name in done:
                    continue
                done.add(name)
                level = lev.of(s)
                order = np.lexsort((s, level))[: prefix(n, t)]
                seen = np.flatnonzero(level[order] > 0)
                if len(seen):
                    p = np.empty(len(seen), dtype=POSTING)
                    p["token"], p["set"], p["n"], p["pos"] = s[order[seen]], _U(name & (1 << 64) - 1), n, seen
                    high = level[order[seen]] > 1
                    rare.append(p[~high])
                    often.append(p[high])
                    size += len(p)
                    setrows.append((name, n, s.tobytes()))
                    held += n
                if size >= 1 << 18:
                    yield batch(postrows=given())
                    rare, often, size = [], [], 0
                if held >= 1 << 18:
                    yield batch(docrows, setrows)
                    docrows, setrows, held = [], [], 0
            if docrows:
                yield batch(docrows, setrows)
        if size:
            yield batch(postrows=given())

    rows = docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "part int, doc_id long, n long, set long, check long, hashes binary, postings binary, kind int")
    return B.stage(rows, "index")


def _fits(a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
    """Length and position filters for postings of one token."""
    na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
    best = np.minimum(na - a["pos"], nb - b["pos"])
    return (100 * np.minimum(na, nb) >= t * np.maximum(na, nb)) & (best >= required(na, nb, t))


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])


def rare_pairs(rows: DataFrame, t: int, parts: int) -> DataFrame:
    """Pairs of the lists of rare shingles (of at most LEVELS[1] documents) that pass the filters."""
    spark = rows.sparkSession

    def probe(batches):
        for _, v in _by_part(batches, 1, POSTING):
            v = np.unique(v)
            cut = np.flatnonzero(np.diff(v["token"], prepend=v["token"][:1] - _U(1)) != 0)
            size = np.diff(cut, append=len(v))
            left, right = [np.empty(0, _U)], [np.empty(0, _U)]
            for g in np.unique(size[size > 1]):
                at = cut[size == g]
                x, y = np.triu_indices(g, 1)
                step = max(1, 200_000 // len(x))
                for s in range(0, len(at), step):
                    i = (at[s : s + step, None] + x).ravel()
                    j = (at[s : s + step, None] + y).ravel()
                    ok = _fits(v[i], v[j], t)
                    left.append(v["set"][i[ok]])
                    right.append(v["set"][j[ok]])
            yield _pair_batch(np.concatenate(left), np.concatenate(right))

    spread = min(parts, B.shuffle_parts(spark))
    posts = rows.filter("kind = 2").select("part", "postings").repartition(spread, "part").sortWithinPartitions("part")
    return posts.mapInArrow(probe, "a long, b long")


def frequent(rows: DataFrame) -> DataFrame:
    """(token, set, n, pos) of the shingles above the first level, staged, equal sets once."""

    def unpack(batches):
        for b in batches:
            for raw in b.column(0):
                v = np.frombuffer(raw.as_buffer(), dtype=POSTING)
                yield pa.RecordBatch.from_arrays([pa.array(v["token"].astype(_U).view(np.int64)), pa.array(v["set"].astype(_U).view(np.int64)), pa.array(v["n"].astype(np.int64)), pa.array(v["pos"].astype(np.int64))], ["token", "set", "n", "pos"])

    return B.stage(rows.filter("kind = 3").select("postings").mapInArrow(unpack, "token long, set long, n long, pos long").distinct(), "frequent")


def leader_pairs(often: DataFrame, t: int) -> DataFrame:
    """Each entry of a frequent shingle's list with the entry of the least name in its size class.

    Leaders are pre-aggregated before the exchange, and the join back may split
    a hot shingle's rows, so no task holds one list.
    """
    sized = often.withColumn("_class", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / t))) if t < 100 else F.col("n"))
    lead = sized.groupBy("token", "_class").agg(F.min(F.struct("set", "n", "pos")).alias("_lead"), F.count(F.lit(1)).alias("_g")).filter("_g > 1")
    lead = B.stage(lead.select(F.col("token").alias("_t"), F.col("_class").alias("_c"), F.col("_lead.set").alias("_s"), F.col("_lead.n").alias("_n"), F.col("_lead.pos").alias("_p")), "leaders")
    both = sized.join(lead, (F.col("token") == F.col("_t")) & (F.col("_class") == F.col("_c")) & (F.col("set") != F.col("_s")))
    need = F.ceil(F.lit(t) * (F.col("n") + F.col("_n")) / (100 + t))
    both = both.filter((100 * F.least("n", "_n") >= t * F.greatest("n", "_n")) & (F.least(F.col("n") - F.col("pos"), F.col("_n") - F.col("_p")) >= need))
    return both.select(F.least("set", "_s").alias("a"), F.greatest("set", "_s").alias("b"))


def verified(pairs: DataFrame, store: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b) whose whole sets reach the threshold, staged."""

    def check(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer().to_pybytes(), dtype=_U), np.frombuffer(y.as_buffer().to_pybytes(), dtype=_U)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                i = int(np.count_nonzero(y[at] == x))
                keep.append(100 * i >= t * (len(x) + len(y) - i))
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = store.select(F.col("set").alias("a"), F.col("hashes").alias("x"))
    two = store.select(F.col("set").alias("b"), F.col("hashes").alias("y"))
    return B.stage(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "links")


def overlaps(x: list[np.ndarray], probing: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, sizes of the intersections of set i with all sets) for the first ``probing`` sets.

    Each answer is derived from that of the most similar set answered before,
    if that has more than half in common: the lists of shingles that only one
    of both holds are taken away or added.
    """
    size = np.array([len(s) for s in x], dtype=np.int64)
    token, of = np.unique(np.concatenate(x), return_inverse=True)
    shared = np.bincount(of, minlength=len(token)) > 1
    owner = np.repeat(np.arange(len(x)), size)[shared[of]]
    of = of[shared[of]]
    order = np.argsort(of, kind="stable")
    start = np.searchsorted(of[order], np.arange(len(token) + 1))
    posts = owner[order]
    cut = np.searchsorted(owner, np.arange(len(x) + 1))
    had = np.diff(cut)
    done = np.zeros((probing, len(x)), dtype=np.int32)

    def met(tokens: np.ndarray) -> np.ndarray:
        if not len(tokens):
            return np.zeros(len(x), dtype=np.int64)
        return np.bincount(np.concatenate([posts[start[k] : start[k + 1]] for k in tokens]), minlength=len(x))

    for i in range(probing):
        own = of[cut[i] : cut[i + 1]]
        row = None
        if i:
            apart = had[:i] + had[i] - 2 * done[:i, i]
            p = int(np.argmin(apart))
            if apart[p] < had[i]:
                other = of[cut[p] : cut[p + 1]]
                row = done[p] - met(np.setdiff1d(other, own, True)) + met(np.setdiff1d(own, other, True))
        done[i] = met(own) if row is None else row
        out = done[i].copy()
        out[i] = size[i]
        yield i, out


def _reach(n: np.ndarray, i: int, common: np.ndarray, t: int) -> np.ndarray:
    """Whether set i is linked with each set, from sizes and intersections."""
    return 100 * common.astype(np.int64) >= t * (n[i] + n - common)


def blocks(rows: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Rows (key, i, j, side, n, ...) of pairs of blocks of sets of one key; ``i`` <= ``j``, ``side`` 0 probes.

    A key's sets are dealt into blocks of about BLOCK sets and BLOCK_BYTES of
    hashes at most. A set goes once to each pair that its block is part of, so
    only keys of many sets, or of large ones, repeat theirs.
    """
    count = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.length("hashes")) / BLOCK_BYTES)).cast("int")
    many = B.stage(rows.groupBy(key).agg(count.alias("_m")).withColumnRenamed(key, "_k"), "sizes")
    rows = rows.join(many, F.col(key) == F.col("_k")).withColumn("_b", F.pmod(F.xxhash64("set", F.lit(3)), F.col("_m")).cast("int"))
    probe = rows.withColumn("j", F.explode(F.sequence(F.col("_b"), F.col("_m") - 1))).select(key, F.col("_b").alias("i"), "j", F.lit(0).alias("side"), *keep)
    other = rows.filter("_b > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_b") - 1))).select(key, "i", F.col("_b").alias("j"), F.lit(1).alias("side"), *keep)
    both = probe.unionByName(other)
    return both.repartition(B.shuffle_parts(rows.sparkSession), key, "i", "j").sortWithinPartitions(key, "i", "j", "side", "set")


def _in_blocks(batches, keys: int, most: int, most_bytes: int) -> Iterator[list[tuple]]:
    """Rows of whole groups of equal first ``keys`` columns; small groups come together, up to ``most`` rows or ``most_bytes`` of their last column."""
    got: list[tuple] = []
    size = 0
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if got and row[:keys] != got[-1][:keys] and (len(got) >= most or size >= most_bytes or got[-1][2] > 0 or row[2] > 0):
                yield got
                got, size = [], 0
            got.append(row)
            size += len(row[-1])
    if got:
        yield got


def leftover(often: DataFrame, comp: DataFrame, store: DataFrame, t: int) -> DataFrame:
    """(a, b): components that a link joins which no leader showed, staged; at most a forest for each block.

    Lists of one least name hold much the same sets: they are compared together,
    as one unit, so a set goes once to a unit however many lists it shares.
    """
    of = comp.select(F.col("node").alias("_node"), F.col("component").alias("_comp"))
    mixed = B.stage(often.join(of, F.col("set") == F.col("_node"), "left").select("token", "set", "n", "pos", F.coalesce("_comp", "set").alias("c")), "mixed")
    # most lists lie in one component: only those that don't are gathered
    apart = mixed.groupBy("token").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.min("set").alias("lead"), F.min("n").alias("_least")).filter("_lo < _hi").select("token", "lead", "_least")
    partner = F.greatest(F.col("_least"), F.ceil(F.lit(t) * F.col("n") / 100))
    fits = F.col("n") - F.col("pos") >= F.ceil(F.lit(t) * (F.col("n") + partner) / (100 + t))
    units = B.stage(mixed.join(apart, "token").filter(fits).select("lead", "set", "c").distinct(), "units")
    B.drop(mixed)
    rows = blocks(units.join(store.select("set", "hashes"), "set"), "lead", ["set", "c", "hashes"])

    def compare(batches):
        for got in _in_blocks(batches, 3, BLOCK, BLOCK_BYTES):
            side, c = np.array([r[3] for r in got]), np.array([r[5] for r in got], dtype=np.int64)
            if c.min() == c.max():
                continue
            x = [np.frombuffer(r[6], dtype=_U) for r in got]
            n, up = np.array([len(s) for s in x], dtype=np.int64), {}

            def top(v: int, up: dict = up) -> int:
                while (w := up.get(v, v)) != v:
                    up[v] = v = up.get(w, w)
                return v

            edges = []
            for i, common in overlaps(x, int((side == 0).sum())):
                for other in np.unique(c[_reach(n, i, common, t)]).tolist():
                    a, b = top(int(c[i])), top(other)
                    if a != b:
                        up[max(a, b)] = min(a, b)
                        edges.append((min(a, b), max(a, b)))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    return B.stage(rows.mapInArrow(compare, "a long, b long").distinct(), "leftover")


def partners(comp: DataFrame, store: DataFrame, times: DataFrame, t: int) -> DataFrame:
    """(set, partners): documents of other sets that a set is linked with; every component is compared in blocks."""
    members = comp.select(F.col("node").alias("set"), F.col("component").alias("c")).join(store.select("set", "hashes"), "set").join(times, "set")
    rows = blocks(B.stage(members.select("c", "set", "times", "hashes"), "members"), "c", ["set", "times", "hashes"])

    def count(batches):
        for got in _in_blocks(batches, 3, BLOCK, BLOCK_BYTES):
            side, times = np.array([r[3] for r in got]), np.array([r[5] for r in got], dtype=np.int64)
            x = [np.frombuffer(r[6], dtype=_U) for r in got]
            n, probing = np.array([len(s) for s in x], dtype=np.int64), int((side == 0).sum())
            found = np.zeros(len(x), dtype=np.int64)
            for i, common in overlaps(x, probing):
                hit = _reach(n, i, common, t)
                if probing < len(x):
                    hit[:probing] = False  # two sets of one block meet in its own pair
                    found[hit] += times[i]
                hit[i] = False
                found[i] += int(times[hit].sum())
            yield pa.RecordBatch.from_arrays([pa.array([r[4] for r in got], pa.int64()), pa.array(found)], ["set", "partners"])

    return rows.mapInArrow(count, "set long, partners long").groupBy("set").agg(F.sum("partners").alias("partners"))


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, sets): the exact components and link counts of a similarity self-join on sets of k-word shingles.

    documents: doc_id, n_shingles, set (name of the shingle set; 0 if empty),
    component_id (smallest doc_id reachable by links, itself included), n_links
    (other documents linked directly, copies included). sets: set, n, hashes of
    the sets that share a shingle of their prefix. Links are two documents whose
    sets have a similarity of at least ``percent``; none is lost and none
    listed, as a group of n near copies has up to n(n-1)/2.

    Words are runs of characters other than space and U+0009..U+000D, A-Z
    lower-cased. A text of fewer than k words is one shingle; null and blank
    texts have none and link with nothing. Very long texts are read in slices
    and in full. Equal texts and repeated rows share a set and link with one
    another; a null doc_id links like any other but names no component unless
    the whole component is null. Other columns are ignored; an empty table
    gives empty tables.
    """
    spark = docs.sparkSession
    B.ship(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = 1 << min(16, max(0, int(max(1, B.scan_bytes(docs) // (8 << 20))) - 1).bit_length())
    bits, packed = levels(docs, "text", k, parts)
    told = spark.sparkContext.broadcast(packed)
    for seed in range(8):
        rows = index(docs, "doc_id", "text", k, percent, parts, told, bits, hash(B.new_path(spark, "levels")), seed)
        B.release(spark)
        names = rows.filter("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "set", "check")
        least = names.filter("n_shingles > 0").groupBy("set").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("times"), F.min("check").alias("_c0"), F.max("check").alias("_c1"))
        least = B.stage(least, "names")
        if not least.filter("_c0 != _c1").limit(1).count():
            break
        # two different sets of one name: other hashes
        B.drop(rows, least)
    least = least.drop("_c0", "_c1")
    store = rows.filter("kind = 1").select("set", "n", "hashes").dropDuplicates(["set"])
    often = frequent(rows)
    pairs = B.stage(rare_pairs(rows, percent, parts).unionByName(leader_pairs(often, percent)).distinct(), "pairs")
    B.release(spark)
    links = verified(pairs, store, percent)
    B.drop(pairs)
    comp = B.stage(components(links), "components")
    more = leftover(often, comp, store, percent)
    if more.limit(1).count():
        # a component is named by one of its sets
        comp = B.stage(components(more.unionByName(comp.select(F.col("node").alias("a"), F.col("component").alias("b")))), "components")
    B.drop(often, more)
    B.release(spark)
    met = B.stage(partners(comp, store, least.select("set", "times"), percent), "partners")
    of = least.join(comp, F.col("set") == F.col("node"), "left").select("set", "_least", "times", F.coalesce("component", "set").alias("_c"))
    of = B.stage(of.join(met, "set", "left").select("set", "_least", "_c", (F.coalesce("partners", F.lit(0)) + F.col("times") - 1).alias("n_links")), "sets")
    of = of.join(of.groupBy("_c").agg(F.min("_least").alias("component_id")), "_c").select(F.col("set").alias("_set"), "component_id", "n_links")
    of = B.stage(of, "named")
    out = names.filter("n_shingles > 0").join(of, F.col("set") == F.col("_set")).select("doc_id", "n_shingles", "set", "component_id", "n_links")
    none = names.filter("n_shingles = 0").select("doc_id", "n_shingles", "set", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(none), store
