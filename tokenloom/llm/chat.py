"""Chat formatting with cumulative-snapshot collapse; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _base as B

#: Turn numbers that one window group of a conversation spans.
SPAN = 1024


def _chained(turns: DataFrame, value, name: str) -> DataFrame:
    """Exclusive running sums of ``value`` along each conversation, in two levels.

    Within a span of turn numbers by a window, then over span totals, so a
    conversation of any length is dealt over many groups.
    """
    inner = Window.partitionBy("_c", "_span").orderBy("_turn", "_role", "_text").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("_oc").orderBy("_os").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    per = turns.groupBy("_c", "_span").agg(F.sum(value).cast("decimal(38,0)").alias("_t"))
    per = per.select(F.col("_c").alias("_oc"), F.col("_span").alias("_os"), "_t").withColumn("_before", F.coalesce(F.sum("_t").over(outer).cast("decimal(38,0)"), zero)).drop("_t")
    out = turns.withColumn("_in", F.coalesce(F.sum(value).over(inner).cast("decimal(38,0)"), zero))
    out = out.join(per, F.col("_c").eqNullSafe(F.col("_oc")) & F.col("_span").eqNullSafe(F.col("_os")))
    return out.withColumn(name, (F.col("_before") + F.col("_in")).cast("decimal(38,0)")).drop("_before", "_in", "_oc", "_os")


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", opening: str = "<|{role}|>\n", closing: str = "<|end|>\n") -> DataFrame:
    """Render each maximal logged conversation; logged prefixes of longer ones and repeats go.

    Returns conv_id, part (from 0; a new part every ``SPAN`` turn numbers),
    n_turns (of the conversation), text.

    Turns run by number (null first), then role, then text (null first); their
    place in that order counts, not the number. Two conversations agree on a
    prefix if roles and texts agree turn by turn (null equals null only). Of
    equal conversations the smallest id stays (a null id only if alone). Rows
    with a null conv_id form one conversation; a null role renders as "unknown"
    and a null text as ""; an empty table gives no rows; other columns are
    ignored.

    A prefix's hash is the sum over its turns of a 64-bit hash of place, role
    and text, kept for two seeds: sums chain across groups without gathering a
    conversation anywhere. Distinct (length, hash) of proper prefixes then
    anti-join the conversations' own.
    """
    rows = turns.select(F.col(conv_id).alias("_c"), F.col(turn).cast("long").alias("_turn"), F.col(role).cast("string").alias("_role"), F.col(text).alias("_text"))
    rows = rows.withColumn("_span", F.floor(F.coalesce("_turn", F.lit(-SPAN)) / SPAN))
    one = F.lit(1).cast("decimal(20,0)")
    rows = _chained(rows, one, "_place")

    def digest(seed: int):
        # null and "" must differ, and so must the fields' borders
        return F.xxhash64(F.lit(seed), F.col("_place").cast("long"), F.col("_role").isNull(), F.length("_role"), F.col("_role"), F.col("_text").isNull(), F.col("_text")).cast("decimal(20,0)")

    rows = rows.withColumns({"_h1": digest(11), "_h2": digest(29)})
    # prefix sums before this turn: the prefix that ends just above it
    rows = B.stage(_chained(_chained(rows, F.col("_h1"), "_p1"), F.col("_h2"), "_p2"), "turns")
    ends = rows.groupBy("_c").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("_n"), F.sum("_h1").cast("decimal(38,0)").alias("_e1"), F.sum("_h2").cast("decimal(38,0)").alias("_e2"))
    best = ends.groupBy("_n", "_e1", "_e2").agg(F.min("_c").alias("_kept"))
    prefixes = rows.filter("_place > 0").select(F.col("_place").alias("_n"), F.col("_p1").alias("_e1"), F.col("_p2").alias("_e2")).distinct()
    best = B.stage(best.join(prefixes, ["_n", "_e1", "_e2"], "left_anti").select("_kept", F.col("_n").cast("long").alias("n_turns")), "maximal")
    who = F.coalesce("_role", F.lit("unknown"))
    before, after = opening.split("{role}")
    line = F.concat(F.lit(before), who, F.lit(after), F.coalesce("_text", F.lit("")), F.lit("\n" + closing))
    kept = rows.join(best, F.col("_c").eqNullSafe(F.col("_kept")))
    parts = kept.groupBy("_c", "_span", "n_turns").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", line.alias("_line")))), lambda x: x["_line"]), "").alias("text"))
    part = F.row_number().over(Window.partitionBy("_c").orderBy("_span")) - 1
    return parts.select(F.col("_c").alias("conv_id"), part.alias("part"), "n_turns", "text")
