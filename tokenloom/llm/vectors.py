"""What both vector operators share: usable vectors and exact double-precision measures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, vector: str):
    """Condition: not null, not empty, no null or non-finite component, not all zero."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def pack(column: pa.Array) -> list[bytes]:
    """Each list of doubles as bytes."""
    flat = column.values.to_numpy(zero_copy_only=False).astype("<f8")
    at = column.offsets.to_numpy()
    return [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def packed(vectors: DataFrame, ident: str, vector: str, *more: str) -> DataFrame:
    """(id, raw, *more) of the usable rows; raw: the vector's doubles as bytes."""
    rows = vectors.filter(usable(vectors, vector)).select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("_v"), *more).dropna(subset=["id"])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pack(b.column(1)), pa.binary()), *b.columns[2:]], ["id", "raw", *more])

    from pyspark.sql.types import BinaryType, LongType, StructType

    schema = StructType().add("id", LongType()).add("raw", BinaryType())
    for c in more:
        schema = schema.add(c, rows.schema[c].dataType)
    return rows.mapInArrow(run, schema)


def matrix(raws: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raws), dtype="<f8").reshape(len(raws), -1)


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, the same for equal rows wherever they are computed."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):  # one order of additions for every row, unlike blocked sums
        out += x[:, j] * y[:, j]
    return out
