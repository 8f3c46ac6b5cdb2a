"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _base as B


def _forest(edges: DataFrame) -> DataFrame:
    """Each task's edges (hi, lo) as stars of its own components: at most one edge a node and task."""

    def run(batches):
        up: dict[int, int] = {}

        def top(x: int) -> int:
            root = x
            while (p := up.get(root, root)) != root:
                root = p
            while up.get(x, x) != root:
                up[x], x = root, up[x]
            return root

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = top(x), top(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        flat = [(x, top(x)) for x in up]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in flat], pa.int64()), pa.array([y for _, y in flat], pa.int64())], ["hi", "lo"])

    return edges.mapInArrow(run, "hi long, lo long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on (hi, lo): every node links its larger (large) or smaller neighbours to the least it knows.

    The least neighbour is pre-aggregated and staged, so the join that follows
    has plain exchanges on both sides and a hub's rows can be split.
    """
    if large:
        near = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    else:
        near = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    least = B.stage(near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m")), "least")
    joined = near.join(least, F.col("u") == F.col("_u"))
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        out = joined.select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionByName(least.select(F.col("_u").alias("hi"), F.col("m").alias("lo")))
    return B.stage(out.filter("hi > lo").distinct(), "star")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of some edge.

    Loops and repeated edges change nothing; edges with a null end are ignored;
    no edges, no rows. Rounds grow with the logarithm of the longest path.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = B.stage(_forest(edges.select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).filter("hi > lo and lo is not null")).distinct(), "edges")
    mark = None
    while True:
        wide = _star(now, True)
        B.drop(now)
        now = _star(wide, False)
        B.drop(wide)
        got = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).collect()[0])
        if got == mark:
            break
        mark = got
    roots = now.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
