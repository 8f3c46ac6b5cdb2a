"""Sending this package to the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's Python files, once an application."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    _SENT.add(app)
    top = Path(__file__).resolve().parent
    if not top.is_dir():  # the package itself came as an archive, by the same way
        return
    to = Path(tempfile.mkdtemp(prefix="tokenloom-src-")) / "tokenloom_src.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(to))
