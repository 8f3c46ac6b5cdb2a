"""Byte-pair encoding of words: merges learned from distributed counts, applied in Arrow batches."""

from __future__ import annotations

import json
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Closes a word's symbols (fixed value).
END = "</w>"


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): white-space parted words, counted before the exchange."""
    words = F.explode(F.filter(F.split(F.col(text), r"\s+"), lambda x: x != ""))
    return docs.select(words.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def train(docs: DataFrame, merges: int, text: str = "text", words: int = 200_000) -> list[tuple[str, str]]:
    """The ``merges`` most frequent pairs in turn; of equal counts the smaller pair.

    Learned on the driver from the counts of at most ``words`` distinct words,
    the most frequent of all texts (ties by word): a bounded sample, by a
    documented parameter.
    """
    counts = word_counts(docs, text).orderBy(F.desc("n"), "word").limit(words).collect()
    held = [([*r.word, END], r.n) for r in counts]
    pairs, where = Counter(), defaultdict(set)
    for k, (w, n) in enumerate(held):
        for p in zip(w, w[1:], strict=False):
            pairs[p] += n
            where[p].add(k)
    out = []
    while len(out) < merges and pairs:
        best = min(pairs, key=lambda p: (-pairs[p], p))
        if pairs[best] < 1:
            break
        out.append(best)
        for k in list(where[best]):
            w, n = held[k]
            for p in zip(w, w[1:], strict=False):
                pairs[p] -= n
                where[p].discard(k)
                if not pairs[p]:
                    del pairs[p]
            w = held[k] = (apply(w, best), n)
            for p in zip(w[0], w[0][1:], strict=False):
                pairs[p] += n
                where[p].add(k)
    return out


def apply(symbols: list[str], pair: tuple[str, str]) -> list[str]:
    """Every occurrence of the pair joined, from the left."""
    out, k = [], 0
    while k < len(symbols):
        hit = tuple(symbols[k : k + 2]) == pair
        out.append("".join(pair) if hit else symbols[k])
        k += 1 + hit
    return out


def encode_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """A word's symbols: the pair of the lowest rank is joined until none is left."""
    now = [*word, END]
    while len(now) > 1 and (best := min(zip(now, now[1:], strict=False), key=lambda p: ranks.get(p, len(ranks)))) in ranks:
        now = apply(now, best)
    return now


def encode(docs: DataFrame, merges: list[tuple[str, str]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, symbols) of each text; each distinct word of a batch is encoded once."""
    ship(docs.sparkSession)

    def run(batches):
        ranks = {tuple(p): k for k, p in enumerate(merges)}
        for b in batches:
            memo: dict[str, list[str]] = {}
            out = []
            for t in b.column(1):
                said: list[str] = []
                for w in (t.as_py() or "").split():
                    if w not in memo:
                        memo[w] = encode_word(w, ranks)
                    said += memo[w]
                out.append(said)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["doc_id", "symbols"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, symbols array<string>")


def save(spark, merges: list[tuple[str, str]], path: str) -> None:
    spark.createDataFrame([(k, json.dumps(p)) for k, p in enumerate(merges)], "rank int, pair string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark, path: str) -> list[tuple[str, str]]:
    return [tuple(json.loads(r.pair)) for r in spark.read.parquet(path).orderBy("rank").collect()]
