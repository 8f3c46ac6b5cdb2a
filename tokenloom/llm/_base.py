"""Shared plumbing: staged tables, global ordering, size-checked sizing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import shipping

#: Bytes of scanned input that one task of a text-heavy exchange should hold.
TASK_BYTES = 16 << 20


#: Bytes of rows that Spark hands a Python worker at once, by row counts alone it could be any number; a setting of the caller's own stays.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_SET: set[str] = set()


def ship(spark: SparkSession) -> None:
    """What each operator does first: send the sources, bound the bytes of a batch (once a session)."""
    shipping.ship(spark)
    if spark.sparkContext.applicationId not in _SET:
        _SET.add(spark.sparkContext.applicationId)
        if spark.sparkContext.getConf().get(_BATCH) is None:
            spark.conf.set(_BATCH, str(BATCH_BYTES))


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, or one made here if unset."""
    ship(spark)
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = tempfile.mkdtemp(prefix="tokenloom-")
        sc.setCheckpointDir(where)
        where = sc.getCheckpointDir()
    return where


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, sizes become known."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop(*staged: DataFrame | None) -> None:
    """Delete staged tables that nothing lazy depends on any more."""
    for df in staged:
        if df is not None and hasattr(df, "_staged_at"):
            drop_path(df.sparkSession, df._staged_at)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (exact file sizes for a bare scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def tasks_for(df: DataFrame, bytes_per_task: int = TASK_BYTES, most: int = 100_000) -> int:
    return max(1, min(most, -(-scan_bytes(df) // bytes_per_task)))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, keys: list[str], parts: int, tag: str, sums: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Stage ``df`` in global order of ``keys`` with ``pos`` (0-based) and exclusive running sums.

    One range exchange; ranks come from per-partition counts, so no row is
    ever sorted in a single task. Returns (frame, staged base for ``drop``).
    ``sums`` maps an output column to the long column that it accumulates.
    """
    sums = sums or {}
    w = Window.partitionBy("_part").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    base = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    base = base.withColumns({"_part": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    base = stage(base, tag)
    per = base.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s{k}") for k, c in enumerate(sums.values())])
    # one row for each partition of the exchange: at most ``parts``
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    per = per.select("_part", F.coalesce(F.sum("_n").over(before), zero).alias("_n0"), *[F.coalesce(F.sum(f"_s{k}").over(before), zero).alias(f"_s0{k}") for k in range(len(sums))])
    out = base.join(F.broadcast(per), "_part")
    out = out.withColumn("pos", F.col("_n0") + F.col("_i"))
    for k, (name, c) in enumerate(sums.items()):
        out = out.withColumn(name, F.col(f"_s0{k}") + F.coalesce(F.sum(c).over(w), zero))
    return out.drop("_part", "_i", "_n0", *[f"_s0{k}" for k in range(len(sums))]), base


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009..U+000D (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


_HELD: dict[tuple, object] = {}


def held(key: tuple, make):
    """What this Python worker keeps from task to task: one thing at a time, so that finished stages hold nothing."""
    if key not in _HELD:
        _HELD.clear()
        _trim()
        _HELD[key] = make()
    return _HELD[key]


def _trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def release(spark: SparkSession) -> None:
    """Let the driver notice finished exchanges, so that their shuffle files are deleted now."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
