"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _base as B

#: Words of a block.
BLOCK = 16
#: Documents that a shard holds on average; shards are the groups that one task sorts.
SHARD_DOCS = 4_096
#: Multipliers of the seeded block permutation (fixed values: primes below 2^31).
_PRIMES = (1000003, 15485863, 179424673, 2038074743, 2147483647)


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Add weight and target to (source, source_size, ...): shares of the total by weight, none above cap * size.

    Sources rank by code point, null last, and take ``weights`` in turn. What a
    capped source can't take is shared again among the others until none is
    above its cap; each pass is one aggregate over the sources.
    """
    spark = sources.sparkSession
    ordered = sources.withColumn("_null", F.col("source").isNull())
    ordered, _ = B.ranked(ordered, ["_null", "source"], B.shuffle_parts(spark), "sources")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    ordered = B.stage(ordered.drop("_null").withColumn("weight", w), "weights")
    most = F.col("source_size") * F.lit(float(cap))
    total = ordered.agg(F.sum("source_size")).collect()[0][0] or 0
    level, held = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) >= most
        n, fixed, free = ordered.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).collect()[0]
        if n == held or not free:
            break
        held, level = n, max(level, (share * total - fixed) / free)
    target = F.least(F.col("weight") * F.lit(level), most) if held >= 0 else most
    return ordered.withColumns({"target": target, "full": target >= most}).drop("pos")


def apportion(parties: DataFrame, weight: str, seats: int, order: list[str], tries: int = 64) -> DataFrame:
    """Add ``seats``: ``seats`` in all, given one by one to the highest quotient weight / (2 k + 1).

    A party holds floor(weight / d + 1/2) seats for the divisor d at which the
    sum is right. Each pass tries ``tries`` divisors in one aggregate, so a few
    passes find two neighbouring divisors however many parties there are; seats
    that lie between them go by quotient, ties by ``order``.
    """
    w = F.col(weight)

    def held(d):
        return F.floor(w / F.lit(float(d)) + 0.5).cast("long")

    total, n = parties.agg(F.coalesce(F.sum(weight), F.lit(0.0)), F.count(F.lit(1))).collect()[0]
    if seats <= 0 or total <= 0:
        return parties.withColumn("seats", F.lit(0).cast("long"))
    low, high = total / (seats + n + 1) / 2, total / seats * 2 * (n + 1)  # many seats, few seats
    for _ in range(12):
        step = (high / low) ** (1 / tries)
        at = [low * step**k for k in range(1, tries)]
        sums = parties.agg(*[F.sum(held(d)) for d in at]).collect()[0]
        exact = next((d for d, s in zip(at, sums, strict=True) if s == seats), None)
        if exact:
            return parties.withColumn("seats", held(exact))
        low = max([low, *[d for d, s in zip(at, sums, strict=True) if s > seats]])
        high = min([high, *[d for d, s in zip(at, sums, strict=True) if s < seats]])
        if high / low < 1 + 1e-13:
            break
    base = parties.withColumn("_have", held(high)).withColumn("_more", held(low) - F.col("_have"))
    rest = seats - (base.agg(F.sum("_have")).collect()[0][0] or 0)
    # parties on the very quotient that the last seats go to: equal weights
    tied = base.filter("_more > 0").withColumn("_r", F.row_number().over(Window.orderBy(F.desc(w / (2 * F.col("_have") + 1)), *order)))
    tied = tied.filter(F.col("_r") <= rest).select(*[F.col(c).alias(f"_w{k}") for k, c in enumerate(order)], F.lit(1).cast("long").alias("_won"))
    same = F.lit(True)
    for k, c in enumerate(order):
        same = same & F.col(c).eqNullSafe(F.col(f"_w{k}"))
    out = base.join(tied, same, "left")
    return out.select(*parties.columns, (F.col("_have") + F.coalesce("_won", F.lit(0).cast("long"))).alias("seats"))


def decide(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: bool = False) -> DataFrame:
    """Each document's part of the mix: doc_id, source, size, source_size, target, taken, and how it was cut.

    A source's documents lie end to end in a seeded order within shards of the
    source (about ``SHARD_DOCS`` documents each, so a source that holds a third
    of all rows is many shards) and are cut every ``BLOCK`` words. Blocks are
    apportioned to all shards at once; a shard's quota of q among n blocks
    takes every block q div n times and a seeded selection of q mod n once
    more. ``passes`` counts whole takings; block j of the shard is in the
    selection if (j * prime + shift) mod blocks < extra; ``at`` is the place of
    the document's first word in the shard.

    Null or empty texts have size 0 and nothing taken; null sources are one
    source, ranked last; equal rows are told apart by nothing and are
    interchangeable; an empty table gives no rows. With ``keep`` the columns of
    ``docs`` are returned under ``_row``.
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.col("_id"), F.lit(seed))
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(source).alias("source"), B.word_count(F.col(text)).alias("size"), *([F.struct("*").alias("_row")] if keep else []))
    small = B.stage(rows.select("_id", "source", "size"), "sizes")
    rows = rows if keep else small
    by = small.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    by = targets(by, weights, share, cap).withColumn("shards", F.ceil(F.col("_docs") / SHARD_DOCS).cast("long"))
    by = B.stage(by.select("source", "source_size", "target", "full", "shards"), "targets")

    def sharded(df: DataFrame) -> DataFrame:
        s = by.withColumnRenamed("source", "_s")
        return df.join(s, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumns({"_key": key, "shard": F.pmod(key, F.col("shards"))})

    shards = sharded(small).groupBy("source", "shard").agg(F.sum("size").alias("_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("full").alias("full"))
    n = F.ceil(F.col("_size") / BLOCK).cast("long")
    part = F.when(F.col("full") | (F.col("source_size") == 0), 0.0).otherwise(F.col("target") * F.col("_size") / F.col("source_size"))
    shards = B.stage(shards.withColumns({"blocks": n, "_want": part}), "shards")
    seats = round((shards.agg(F.sum("_want")).collect()[0][0] or 0) / BLOCK)
    shards = apportion(shards, "_want", seats, ["source", "shard"])
    quota = F.when(F.col("full"), 2 * F.col("blocks")).otherwise(F.least("seats", 2 * F.col("blocks")))
    pick = F.xxhash64(F.col("source"), F.col("shard"), F.lit(seed))
    shards = shards.withColumn("quota", quota).select(
        F.col("source").alias("_s"),
        F.col("shard").alias("_h"),
        "blocks",
        "quota",
        F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0).cast("long").alias("passes"),
        F.when(F.col("blocks") > 0, F.col("quota") % F.col("blocks")).otherwise(0).cast("long").alias("extra"),
        F.element_at(F.array(*[F.lit(p).cast("long") for p in _PRIMES]), (F.pmod(pick, F.lit(len(_PRIMES))) + 1).cast("int")).alias("prime"),
        F.pmod(pick, F.greatest("blocks", F.lit(1))).alias("shift"),
    )
    shards = B.stage(shards, "quotas")
    w = Window.partitionBy("source", "shard").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = sharded(rows).withColumn("at", F.coalesce(F.sum("size").over(w), F.lit(0).cast("long")))
    out = out.join(shards, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))
    end = F.col("at") + F.col("size")
    more = F.aggregate(
        F.sequence(F.floor(F.col("at") / BLOCK), F.floor((end - 1) / BLOCK)),
        F.lit(0).cast("long"),
        lambda acc, j: acc + F.when((j * F.col("prime") + F.col("shift")) % F.col("blocks") < F.col("extra"), F.least(end, (j + 1) * BLOCK) - F.greatest(F.col("at"), j * BLOCK)).otherwise(0),
    )
    more = F.when((F.col("size") > 0) & (F.col("extra") > 0), more).otherwise(0)
    out = out.withColumn("taken", F.col("passes") * F.col("size") + more)
    return out.select(F.col("_id").alias("doc_id"), "source", "size", "source_size", "target", "taken", "shard", "at", "blocks", "passes", "extra", "prime", "shift", *(["_row"] if keep else []))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for each time a document is taken.

    A whole taking repeats the row as it is; the selected blocks of a document
    make one more row, whose text joins their words by single spaces
    (``n_chars``, if there is one, is counted anew).
    """
    text = options.get("text", "text")
    d = decide(docs, keep=True, **options)
    words = F.regexp_extract_all(F.col(f"_row.{text}"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    some = F.array_join(F.filter(words, lambda x, i: (F.floor((F.col("at") + i) / BLOCK) * F.col("prime") + F.col("shift")) % F.col("blocks") < F.col("extra")), "")
    whole = F.array_repeat(F.col(f"_row.{text}"), F.col("passes").cast("int"))
    part = F.col("taken") - F.col("passes") * F.col("size")
    texts = F.when(part == F.col("size"), F.concat(whole, F.array(F.col(f"_row.{text}")))).when(part > 0, F.concat(whole, F.array(some))).otherwise(whole)
    d = d.filter(F.col("taken") > 0).select("_row", F.explode(texts).alias("_new"))
    cols = []
    for c in docs.columns:
        cols.append(F.col("_new").alias(c) if c == text else F.when(F.col("_new") == F.col(f"_row.{text}"), F.col("_row")[c]).otherwise(F.length("_new").cast(docs.schema[c].dataType)).alias(c) if c == "n_chars" else F.col("_row")[c].alias(c))
    return d.select(*cols)
