"""Readings at every token: as window functions over (doc_id, tok), and over texts where they are lexed, without an exchange."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexer import KINDS, spans
from ..shipping import ship


def _w():
    return Window.partitionBy("doc_id").orderBy("tok")


def magnitude(t: DataFrame, value: str = "m") -> DataFrame:
    """m (log10 of a number, log2 of the length of other texts), gradient, energy over 16 tokens, outliers beyond 2.5 deviations."""
    n = F.expr("try_cast(text as double)")
    m = F.when((F.col("kind") == "number") & (n != 0), F.log10(F.abs(n))).otherwise(F.log2(F.octet_length("text").cast("double")))
    t = t.withColumn(value, m)
    doc = Window.partitionBy("doc_id")
    return t.withColumns({
        "gradient": F.coalesce(F.col(value) - F.lag(value).over(_w()), F.lit(0.0)),
        "energy": F.sum(F.col(value) * F.col(value)).over(_w().rowsBetween(-15, 0)),
        "outlier": F.abs(F.col(value) - F.avg(value).over(doc)) >= 2.5 * F.stddev_pop(value).over(doc),
    })


def stress(t: DataFrame) -> DataFrame:
    """Bracket depth before and after each token, and local peaks."""
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    t = t.withColumn("height", F.sum(step).over(_w()))
    return t.withColumn("peak", (F.col("height") > F.coalesce(F.lag("height").over(_w()), F.lit(0))) & (F.col("height") >= F.coalesce(F.lead("height").over(_w()), F.lit(0))))


def echo(t: DataFrame) -> DataFrame:
    """Occurrences of each token's text: count, rank forwards and backwards, gaps, novelty."""
    k = Window.partitionBy("doc_id", "text")
    o = k.orderBy("tok")
    return t.withColumns({"count": F.count("*").over(k), "nth": F.row_number().over(o), "nth_back": F.row_number().over(k.orderBy(F.desc("tok"))), "back_lag": F.col("start") - F.lag("start").over(o), "fwd_lag": F.lead("start").over(o) - F.col("start")}).withColumn("novel", F.col("nth") == 1)


def flow(t: DataFrame, signal: str) -> DataFrame:
    """Slope over four tokens, direction beyond 0.05, whether it turned since the last steep one, and the length of the run of one direction."""
    n = F.greatest(F.lit(1), F.least(F.col("tok"), F.lit(4)))
    first = F.first(signal).over(_w().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    t = t.withColumn("slope", (F.col(signal) - F.coalesce(F.lag(signal, 4).over(_w()), first)) / n)
    t = t.withColumn("direction", F.when(F.col("slope") > 0.05, 1).when(F.col("slope") < -0.05, -1).otherwise(0))
    before = F.last(F.nullif("direction", F.lit(0)), ignorenulls=True).over(_w().rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("reversal", (F.col("direction") != 0) & F.coalesce(F.col("direction") != before, F.lit(False)))
    t = t.withColumn("_run", F.sum((F.col("direction") != F.coalesce(F.lag("direction").over(_w()), F.lit(9))).cast("int")).over(_w()))
    return t.withColumn("momentum", F.row_number().over(Window.partitionBy("doc_id", "_run").orderBy("tok"))).drop("_run")


def keyed_history(t: DataFrame, by: str = "=") -> DataFrame:
    """(doc_id, tok, key, m, mean, n): each number bound to a key, with the mean magnitude and count of earlier values of that key in its document."""
    t = magnitude(t).withColumns({"_mark": F.lag("text").over(_w()), "key": F.lag("text", 2).over(_w())})
    earlier = Window.partitionBy("doc_id", "key").orderBy("tok").rowsBetween(Window.unboundedPreceding, -1)
    return t.filter((F.col("_mark") == by) & (F.col("kind") == "number")).select("doc_id", "tok", "key", "m", F.avg("m").over(earlier).alias("mean"), F.count("m").over(earlier).alias("n"))


def observation(t: DataFrame, window: int = 32) -> DataFrame:
    """Entropy of kinds before, after and around each token, and how far they disagree."""

    def entropy(frame):
        kinds = F.collect_list("kind").over(frame)
        n = F.size(kinds)
        return F.aggregate(F.array_distinct(kinds), F.lit(0.0), lambda acc, k: acc - F.size(F.filter(kinds, lambda x: x == k)) / n * F.log2(F.size(F.filter(kinds, lambda x: x == k)) / n))

    t = t.withColumns({"causal": entropy(_w().rowsBetween(-window, 0)), "anticausal": F.coalesce(entropy(_w().rowsBetween(1, window)), F.lit(0.0)), "centered": entropy(_w().rowsBetween(-window // 2, window // 2))})
    return t.withColumn("disagreement", F.abs(F.col("causal") - F.col("anticausal")))


def gravity(t: DataFrame, reach: int = 32) -> DataFrame:
    """Pairs of kinds up to ``reach`` tokens apart by gap against their expectation: (d, a, b, n, lift)."""
    ahead = t.select("doc_id", F.col("kind").alias("a"), F.array(*[F.lead("kind", d).over(_w()) for d in range(1, reach + 1)]).alias("ahead"))
    pairs = ahead.select("doc_id", "a", F.posexplode("ahead").alias("d", "b")).filter("b is not null")
    return _lifted(pairs.groupBy(F.col("d") + 1, "a", "b").agg(F.count("*").alias("n")).toDF("d", "a", "b", "n"))


def _lifted(n: DataFrame) -> DataFrame:
    d, da, db = Window.partitionBy("d"), Window.partitionBy("d", "a"), Window.partitionBy("d", "b")
    expected = F.sum("n").over(da) * F.sum("n").over(db) / F.sum("n").over(d)
    return n.select("d", "a", "b", "n", ((F.col("n") + 1) / (expected + 1)).alias("lift"))


#: Tokens that are read at once.
BLOCK = 100_000
#: Numbers that the columns of a token table read as doubles.
_DOUBLE = re.compile(r"[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?").fullmatch


class _Block:
    """Tokens of whole texts, one after another: ``of`` is each token's text, ``tok`` its place in it; readings are arrays made when first asked for."""

    def __init__(self, ids: list, sizes: list[int], kind: list[str], start: list[int], text: list[str]) -> None:
        self.size = np.array(sizes, dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.of = np.repeat(np.arange(len(sizes)), self.size)
        self.first = self.begin[self.of]
        self.at = np.arange(len(kind))
        self.made: dict = {"doc_id": pa.array(ids, pa.int64()).take(pa.array(self.of)), "tok": self.at - self.first, "kind": kind, "start": start, "text": text}

    def get(self, name: str):
        if name not in self.made:
            self.made |= getattr(self, "_" + _READ[name][1])()
        return self.made[name]

    def before(self, x: np.ndarray, n: int, other) -> np.ndarray:
        """The value ``n`` tokens before, ``other`` where the text has none."""
        out = np.roll(x, n)
        return np.where(self.made["tok"] >= n, out, other)

    def _kinds(self) -> dict:
        code = {k: i for i, k in enumerate(KINDS)}
        return {"codes": np.array([code[k] for k in self.made["kind"]], dtype=np.int64)}

    def _magnitude(self) -> dict:
        memo: dict = {}

        def read(number: bool, text: str) -> float:
            n = float(text) if number and _DOUBLE(text) else 0.0
            return math.log10(n) if n else math.log(len(text.encode())) / math.log(2.0)

        m = []
        for k, x in zip(self.made["kind"], self.made["text"], strict=True):
            key = (k == "number", x)
            if key not in memo:
                memo[key] = read(*key)
            m.append(memo[key])
        m = np.array(m, dtype=np.float64)
        return {"m": m, "gradient": np.where(self.made["tok"] > 0, m - np.roll(m, 1), 0.0)}

    def _energy(self) -> dict:
        e = self.get("m") ** 2
        total = np.zeros(len(e))
        for n in range(15, -1, -1):  # in order of tokens, as a frame is summed
            total += self.before(e, n, 0.0)
        return {"energy": total}

    def _outliers(self) -> dict:
        m = self.get("m")
        order = np.argsort(-self.size, kind="stable")
        sizes, begin = self.size[order], self.begin[order]
        total, mean, square = np.zeros(len(order)), np.zeros(len(order)), np.zeros(len(order))
        live = len(order)
        for j in range(int(sizes[0]) if len(sizes) else 0):  # Welford's way, the j-th token of every text at once
            while sizes[live - 1] <= j:
                live -= 1
            x = m[begin[:live] + j]
            total[:live] += x
            off = x - mean[:live]
            step = off / (j + 1)
            mean[:live] += step
            square[:live] += off * (off - step)
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        at = back[self.of]
        return {"outlier": np.abs(m - (total / np.maximum(sizes, 1))[at]) >= 2.5 * np.sqrt(square / np.maximum(sizes, 1))[at]}

    def _stress(self) -> dict:
        code = self.get("codes")
        step = (code == KINDS.index("open")).astype(np.int64) - (code == KINDS.index("close"))
        upto = np.cumsum(step)
        height = upto - (upto - step)[self.first]
        after = np.where(self.made["tok"] + 1 < self.size[self.of], np.roll(height, -1), 0)
        return {"height": height, "peak": (height > self.before(height, 1, 0)) & (height >= after)}

    def _echo(self) -> dict:
        said = pa.array(self.made["text"], pa.string()).dictionary_encode()
        key = self.of * max(1, len(said.dictionary)) + said.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), dtype=bool)
        new[1:] = np.diff(key[order]) != 0
        head = np.flatnonzero(new)
        n = np.diff([*head, len(key)])
        group = np.cumsum(new) - 1
        nth = np.arange(len(key)) - head[group] + 1
        start = np.array(self.made["start"], dtype=np.int64)[order]
        gap = np.zeros(len(key), dtype=np.int64)
        gap[1:] = np.diff(start)
        back = np.empty(len(key), dtype=np.int64)
        back[order] = np.arange(len(key))
        n, ahead, last = n[group], np.roll(gap, -1), nth == n[group]
        lag = lambda x, none: pa.array(x[back].astype(np.int32), mask=none[back])
        return {"count": n[back], "nth": nth[back], "nth_back": (n - nth + 1)[back], "novel": (nth == 1)[back], "back_lag": lag(gap, new), "fwd_lag": lag(ahead, last)}

    def _flow(self) -> dict:
        m, tok = self.get("m"), self.made["tok"]
        slope = (m - np.where(tok >= 4, np.roll(m, 4), m[self.first])) / np.maximum(1, np.minimum(tok, 4))
        way = np.where(slope > 0.05, 1, np.where(slope < -0.05, -1, 0))
        steep = np.maximum.accumulate(np.where(way != 0, self.at, -1))
        steep = np.concatenate([[-1], steep[:-1]])[: len(way)]
        turn = (tok == 0) | (way != np.roll(way, 1))
        run = np.maximum.accumulate(np.where(turn, self.at, 0))
        return {"slope": slope, "direction": way, "reversal": (way != 0) & (steep >= self.first) & (way[steep] != way), "momentum": self.at - run + 1}


_READ = {
    "tok": ("int", ""), "kind": ("string", ""), "start": ("int", ""), "text": ("string", ""), "codes": ("int", "kinds"), "m": ("double", "magnitude"), "gradient": ("double", "magnitude"), "energy": ("double", "energy"), "outlier": ("boolean", "outliers"), "height": ("long", "stress"), "peak": ("boolean", "stress"),
    "count": ("long", "echo"), "nth": ("int", "echo"), "nth_back": ("int", "echo"), "novel": ("boolean", "echo"), "back_lag": ("int", "echo"), "fwd_lag": ("int", "echo"), "slope": ("double", "flow"), "direction": ("int", "flow"), "reversal": ("boolean", "flow"), "momentum": ("int", "flow"),
}


def _blocks(batches):
    for b in batches:
        ids, sizes, kind, start, text = [], [], [], [], []
        for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            t = t.as_py() or ""
            found = spans(t)
            if found:
                ids.append(doc)
                sizes.append(len(found))
                kind += [x[0] for x in found]
                start += [x[1] for x in found]
                text += [t[x[1] : x[2]] for x in found]
                if len(kind) >= BLOCK:
                    yield _Block(ids, sizes, kind, start, text)
                    ids, sizes, kind, start, text = [], [], [], [], []
        if ids:
            yield _Block(ids, sizes, kind, start, text)


def read(docs: DataFrame, *names: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, names...) of every token: columns of ``scan.tokens`` and of ``magnitude``, ``stress``, ``echo`` and ``flow`` (over m), each text read where it is lexed. Rows are one text each, whatever their ids."""
    ship(docs.sparkSession)
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches):
        for b in _blocks(batches):
            cols = [b.made["doc_id"]]
            for n in names:
                x, kind = b.get(n), types[_READ[n][0]]
                cols.append(x if isinstance(x, pa.Array) else pa.array(x, kind, from_pandas=False) if isinstance(x, list) else pa.array(x).cast(kind))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *names])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, ", ".join(["doc_id long", *[f"{n} {_READ[n][0]}" for n in names]]))


def gravity_of(docs: DataFrame, reach: int = 32, text: str = "text") -> DataFrame:
    """``gravity`` of texts: pairs are counted where they are lexed, and a task hands on one row for each gap and pair of kinds."""
    ship(docs.sparkSession)

    def run(batches):
        size = len(KINDS)
        total = np.zeros((reach + 1, size * size), dtype=np.int64)
        for b in _blocks(batches):
            code = b.get("codes")
            for d in range(1, min(reach, len(code) - 1) + 1):
                pair = (code[:-d] * size + code[d:])[b.of[:-d] == b.of[d:]]
                total[d] += np.bincount(pair, minlength=size * size)
        d, pair = np.nonzero(total)
        kinds = np.array(KINDS, dtype=object)
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(kinds[pair // size], pa.string()), pa.array(kinds[pair % size], pa.string()), pa.array(total[d, pair])], ["d", "a", "b", "n"])

    return _lifted(docs.select(F.lit(0).alias("_id"), text).mapInArrow(run, "d int, a string, b string, n long").groupBy("d", "a", "b").agg(F.sum("n").alias("n")))


def history(docs: DataFrame, by: str = "=", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``keyed_history`` of texts, read where they are lexed."""
    ship(docs.sparkSession)

    def run(batches):
        for b in _blocks(batches):
            m, tok, kind, said = b.get("m"), b.made["tok"], b.made["kind"], b.made["text"]
            at, keys, mean, n = [], [], [], []
            seen: dict = {}
            for i in range(len(said)):
                if kind[i] == "number" and tok[i] > 0 and said[i - 1] == by:
                    at.append(i)
                    keys.append(said[i - 2] if tok[i] > 1 else None)
                    total, k = seen.get((b.of[i], keys[-1]), (0.0, 0))
                    mean.append(total / k if k else None)
                    n.append(k)
                    seen[b.of[i], keys[-1]] = (total + m[i], k + 1)
            ids = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.made["doc_id"].take(ids), pa.array(tok[at], pa.int32()), pa.array(keys, pa.string()), pa.array(m[at], pa.float64()), pa.array(mean, pa.float64()), pa.array(n, pa.int64())], ["doc_id", "tok", "key", "m", "mean", "n"])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "doc_id long, tok int, key string, m double, mean double, n long")


def rolling_energy(docs: DataFrame, width: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, peak): the largest sum of squared lengths of ``width`` neighbouring runs of non-blanks; no exchange. Texts without one have no row."""
    ship(docs.sparkSession)
    runs = re.compile(r"[^ \t\n]+").findall

    def run(batches):
        for b in batches:
            ids, peaks = [], []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n = np.array([len(x) for x in runs(t.as_py() or "")], dtype=np.int64)
                if len(n):
                    upto = np.concatenate([[0], np.cumsum(n * n)])
                    ids.append(doc)
                    peaks.append(int((upto[1:] - upto[np.maximum(0, np.arange(1, len(upto)) - width)]).max()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(peaks, pa.int64())], ["doc_id", "peak"])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "doc_id long, peak long")
