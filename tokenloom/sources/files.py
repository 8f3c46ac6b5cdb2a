"""Inputs of files: walking, binary detection, encodings; and sinks of lines."""

from __future__ import annotations

import codecs

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte order marks and their encodings, longest first (fixed values).
MARKS = ((b"\xff\xfe\x00\x00", "UTF-32LE"), (b"\x00\x00\xfe\xff", "UTF-32BE"), (b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"))


def decoded(content: Column) -> Column:
    """Text of bytes, by their byte order mark, else UTF-8."""
    out = F.decode(content, "UTF-8")
    for mark, name in reversed(MARKS):
        body = F.substring(content, len(mark) + 1, 2147483647)
        out = F.when(F.substring(content, 1, len(mark)) == F.lit(mark), F.decode(body, name)).otherwise(out)
    return out


def read(spark: SparkSession, path: str, glob: str | None = None, hidden: bool = False, without: str | None = None, order: str = "path") -> DataFrame:
    """(path, modified, length, text) of the files below ``path``; files with a NUL byte and no mark are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        files = files.option("pathGlobFilter", glob)
    df = files.load(path)
    if not hidden:
        df = df.filter(~F.col("path").rlike(r"/\.[^/]+"))
    if without:
        df = df.filter(~F.col("path").rlike(without))
    marked = F.lit(False)
    for mark, _ in MARKS:
        marked = marked | (F.substring("content", 1, len(mark)) == F.lit(mark))
    df = df.filter(marked | (F.instr(F.hex("content"), "00") == 0) | ~F.hex("content").rlike("^(..)*00"))
    return df.select("path", F.col("modificationTime").alias("modified"), "length", decoded(F.col("content")).alias("text")).orderBy({"path": "path", "modified": "modified"}[order])


def write_lines(rows: DataFrame, column: Column, path: str) -> None:
    """One rendered line a row."""
    rows.select(column.cast("string").alias("value")).write.text(path)


class Decoder:
    """Text of bytes that come in chunks: a byte order mark decides, else ``encoding``; a character cut in two waits for the rest."""

    def __init__(self, encoding: str = "utf-8") -> None:
        self.encoding, self.head, self.decoder = encoding, b"", None

    def push(self, chunk: bytes, last: bool = False) -> str:
        if self.decoder is None:
            self.head += chunk
            if len(self.head) < 4 and not last:
                return ""
            mark, name = next(((m, n) for m, n in MARKS if self.head.startswith(m)), (b"", self.encoding))
            self.decoder, chunk = codecs.getincrementaldecoder(name)("replace"), self.head[len(mark) :]
        return self.decoder.decode(chunk, last)
