"""Tokenization, exact token-count tables and length-delimited token files.

Texts go through the ``tokenizers`` library. The library spends most of its
time on taking a text apart and on words it has not seen lately, so each Python
worker keeps a memo, bounded in bytes, from *chunks* to ids: a text is
cut before every single space that separates two non-blank characters, a
boundary that the byte-level pre-tokenizer always makes itself, and each
distinct chunk is encoded once. Chunks and ids lie in flat arrays, and a text's
ids are gathered from them. Chunks that the memo lacks go through the library's
model many at a time, joined by bytes that no text holds and no merge joins;
inside a chunk the places where the pre-tokenizer cuts are marked likewise,
unless no merge of the vocabulary could join what lies there. A text with runs
of blanks around a space, where a cut could differ, or with an added token of
the vocabulary, which no cut may split, is encoded whole.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _base as B

#: The end id that closes each document.
END_ID = 2
#: Bytes that a worker's memo of chunks holds at most.
MEMO_BYTES = 16 << 20
#: Bytes of one memo entry beside its characters and ids: where either begin, how many ids, whether met again.
ENTRY = 25
#: Chunks that go through the model at once, and that are looked up at once.
JOINED, LOOKED_UP = 192, 1 << 19

#: Blanks other than space and newline, and runs of blanks where a cut could differ.
_BLANKS = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
_ASCII_BLANKS = [c for c in _BLANKS if c.isascii()]
#: Chunks of these characters alone are cut further where a byte-level pre-tokenizer cuts; \x00 and \x01 part them.
_PLAIN = re.compile("[\x02-\x7fÀ-ÖØ-öø-ÿ]*").fullmatch
_PARTS = re.compile("\x00|'(?:[sdmt]|ll|ve|re)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\\s\x00A-Za-z0-9À-ÖØ-öø-ÿ]+|\\s+(?![^\\s\x00])|\\s+").findall
_RUNS = ["   ", "  \n", "\n  ", "\n \n"]
#: Bytes that no UTF-8 text holds: the first parts pre-tokens, the second chunks.
_PART, _CHUNK = b"\xc0", b"\xc1"

#: Classes of the bytes of simple chunks, 0 for others: letters (of U+00C0..U+00FF too), digits, newline, space, the rest of ASCII but the apostrophe.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[33:127] = 5
_KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 1
_KIND[48:58] = 2
_KIND[[10, 32, 39]] = 3, 4, 0


def default_vocabulary() -> str:
    """Path of the public byte-level vocabulary (a parameter everywhere below)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> str:
    """The letter that a byte-level vocabulary writes for each byte: printable ones as they are, the others from U+0100 on."""
    out, more = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return "".join(out)


class Encoder:
    """Exact ids of whole texts as packed little-endian integers, memoised by chunk."""

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.limit = memo_bytes
        # the memo: chunks, where their ids begin in ``ids`` and how many there are, whether they were met again
        self.words = pa.array([], pa.large_binary())
        self.first, self.count, self.met = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        self.ids = np.empty(0, self.dtype)
        # added tokens are found in the text before it is cut into words
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # only a byte-level pre-tokenizer without a normalizer cuts at every such space
        self.chunked = self.tok.normalizer is None and type(self.tok.pre_tokenizer).__name__ == "ByteLevel" and not self.tok.pre_tokenizer.add_prefix_space
        self.unmarked = False
        self.model = self._joinable(path) if self.chunked else None

    def _joinable(self, path: str):
        """The model by itself, if its two parting bytes are letters that no merge touches; else None."""
        from tokenizers import Tokenizer

        self.letters = byte_letters()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        marks = [self.letters[x[0]] for x in (_PART, _CHUNK)]
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]] if plain else []
        if not plain or any(m not in model["vocab"] for m in marks) or any(m in a or m in b for a, b in merges for m in marks):
            return None
        self.parts_id, self.chunks_id = (model["vocab"][m] for m in marks)
        self.unmarked = not any(self._crosses(a, b) for a, b in merges)
        return Tokenizer(self.tok.model)

    def _crosses(self, a: str, b: str) -> bool:
        """Whether a merge joins what lies on either side of a cut inside a simple chunk."""
        kinds = [_KIND[self.letters.index(c)] for c in a + b]
        p, q = kinds[len(a) - 1], kinds[len(a)]
        return 0 not in kinds and p != q and 4 not in (p, q)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _simple(self, chunks: pa.Array) -> np.ndarray:
        """Which chunks need no marks inside: one space at most, before the rest, and no newline after a blank."""
        at = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
        buf = np.frombuffer(chunks.buffers()[2], np.uint8)[at[0] : at[-1]]
        before = np.concatenate([buf[:1] * 0, buf[:-1]])
        bad = (_KIND[buf] == 0) | (buf == 10) & ((before == 10) | (before == 32))
        # of two bytes only U+00C0..U+00FF without the signs of multiplication and division
        bad |= (buf >= 0x80) & (buf < 0xC0) & ((before != 0xC3) | (buf == 0x97) | (buf == 0xB7))
        out = np.ones(len(chunks), bool)
        out[np.searchsorted(at - at[0], np.flatnonzero(bad), side="right") - 1] = False
        return out

    def _together(self, joined: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each chunk has) of chunks between _CHUNK bytes, cut at _PART bytes."""
        end = np.array([self.chunks_id], dtype=np.uint32) if joined else None
        got = [np.empty(0, np.uint32)]
        for e in self.model.encode_batch_fast([codecs.charmap_decode(x, "strict", self.letters)[0] for x in joined], add_special_tokens=False) if joined else ():
            got += (np.array(e.ids, dtype=np.uint32), end)
        ids = np.concatenate(got)
        if not len(ids):
            return ids.astype(self.dtype), np.empty(0, np.int64)
        ids = ids[ids != self.parts_id]
        last = ids == self.chunks_id
        return ids[~last].astype(self.dtype), np.diff(np.flatnonzero(last), prepend=-1) - 1

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each chunk's begin, how many it has) of chunks, each as if it were a text."""
        simple = self._simple(chunks) if self.unmarked and len(chunks) else np.zeros(len(chunks), bool)
        sure = chunks.filter(pa.array(simple)).to_pylist()
        text = [x.decode() for x in chunks.filter(pa.array(~simple)).to_pylist()]
        plain = np.array([bool(self.model and _PLAIN(x)) for x in text], bool)
        marked = [x for x, p in zip(text, plain, strict=True) if p]
        whole = self._whole([x for x, p in zip(text, plain, strict=True) if not p])
        done = [
            self._together([_CHUNK.join(sure[k : k + JOINED]) for k in range(0, len(sure), JOINED)]),
            self._together([_marks(marked[k : k + JOINED]) for k in range(0, len(marked), JOINED)]),
            (np.frombuffer(b"".join(whole), self.dtype), np.array([len(x) // self.dtype.itemsize for x in whole], np.int64)),
        ]
        n = np.concatenate([x for _, x in done])
        other = np.flatnonzero(~simple)
        place = np.concatenate([np.flatnonzero(simple), other[plain], other[~plain]])
        first, count = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        first[place], count[place] = np.cumsum(n) - n, n
        return np.concatenate([x for x, _ in done]), first, count

    def _forget(self) -> None:
        """Keep what was met again, the longest known first, up to half the limit."""
        size = pc.binary_length(self.words).to_numpy() + self.count * self.dtype.itemsize + ENTRY
        if size.sum() <= self.limit:
            return
        kept = np.flatnonzero(self.met)
        kept = kept[np.cumsum(size[kept]) <= self.limit // 2]
        self.words, first, self.count = self.words.take(pa.array(kept)), self.first[kept], self.count[kept]
        self.ids = self.ids[_runs(first, self.count)]
        self.first, self.met = np.cumsum(self.count) - self.count, np.zeros(len(kept), bool)

    def _look_up(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in turn, how many each has)."""
        coded = chunks.dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        new = known < 0
        self.met[known[~new]] = True
        lost = coded.dictionary.filter(pa.array(new))
        known[new] = len(self.words) + np.arange(len(lost))
        ids, first, count = self._chunks(lost)
        self.words = pa.concat_arrays([self.words, lost])
        self.first, self.count = np.concatenate([self.first, first + len(self.ids)]), np.concatenate([self.count, count])
        self.ids, self.met = np.concatenate([self.ids, ids]), np.concatenate([self.met, np.zeros(len(lost), bool)])
        at = known[coded.indices.to_numpy()]
        out = self.ids[_runs(self.first[at], self.count[at])], self.count[at]
        self._forget()
        return out

    def _cut(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of separable texts, none of them empty."""
        if not texts:
            return []
        raw = b"".join(texts)
        begin = np.cumsum([0, *map(len, texts)])
        mark = np.frombuffer(raw, np.uint8) == 32
        mark[begin[:-1]] = True
        at = np.append(np.flatnonzero(mark), len(raw))
        got = []
        for k in range(0, len(at) - 1, LOOKED_UP):
            own = np.ascontiguousarray(at[k : k + LOOKED_UP + 1], np.int64)
            got.append(self._look_up(pa.Array.from_buffers(pa.large_binary(), len(own) - 1, [None, pa.py_buffer(own), pa.py_buffer(raw)])))
        end = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in got]))])[np.searchsorted(at, begin)] * self.dtype.itemsize
        ids = np.concatenate([x for x, _ in got]).tobytes()
        return [ids[a:b] for a, b in zip(end[:-1].tolist(), end[1:].tolist(), strict=True)]

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; a null text is an empty one."""
        cut = [bool(t) and self.chunked and separable(t) and not any(a in t for a in self.added) for t in texts]
        short = iter(self._cut([t.encode() for t, c in zip(texts, cut, strict=True) if c]))
        whole = iter(self._whole([t for t, c in zip(texts, cut, strict=True) if t and not c]))
        return [next(short) if c else next(whole) if t else b"" for t, c in zip(texts, cut, strict=True)]


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run in turn."""
    end = np.cumsum(count)
    return np.repeat(first - end + count, count) + np.arange(end[-1] if len(end) else 0)


def _marks(chunks: list[str]) -> bytes:
    """Chunks between _CHUNK bytes, with a _PART byte where the pre-tokenizer cuts."""
    raw = "\x01".join(_PARTS("\x00".join(chunks))).encode()
    return raw.replace(b"\x01\x00\x01", _CHUNK).replace(b"\x01", _PART)


def separable(text: str) -> bool:
    """Whether every space of ``text`` is a cut that the byte-level pre-tokenizer makes itself."""
    if text.startswith(" ") or text.endswith(("  ", "\n ")) or any(r in text for r in _RUNS):
        return False
    return not any(c in text for c in (_ASCII_BLANKS if text.isascii() else _BLANKS))


def encoder(path: str) -> Encoder:
    """This worker's encoder; it takes the place of what other operators hold."""
    return B.held(("encoder", path), lambda: Encoder(path))


def slices(column: pa.Array, chars: int = 4_000_000) -> Iterator[tuple[int, list]]:
    """(first row, values) runs of a string column, each of about ``chars`` characters."""
    rows: list = []
    size = start = 0
    for k, v in enumerate(column):
        rows.append(v.as_py())
        size += len(rows[-1] or "")
        if size >= chars:
            yield start, rows
            rows, size, start = [], 0, k + 1
    if rows:
        yield start, rows


def token_lengths(docs: DataFrame, vocabulary: str, text: str = "text", end: bool = True) -> DataFrame:
    """(length,) of each document: ids of the whole text, and the end id if ``end``. Null text: empty."""

    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            for _, texts in slices(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([len(p) // enc.dtype.itemsize + end for p in enc.packed(texts)], pa.int64())], ["length"])

    return docs.select(text).mapInArrow(run, "length long")


def count_table(docs: DataFrame, vocabulary: str | None = None, text: str = "text", end: bool = True, block: int = 256) -> DataFrame:
    """Exact token totals for every context limit, from one histogram of encoded lengths.

    One row for each distinct length L, ascending: ``n_docs`` of that length,
    ``docs_ge`` documents of length >= L, ``docs_le`` of length <= L,
    ``total_tokens`` of all documents, ``tokens_gt`` in documents longer than L,
    ``truncated_total`` kept when every document is cut at L tokens,
    ``dropped_total`` lost by that, and ``quantile`` (share of documents of
    length <= L). Any other limit equals the row of the next smaller length plus
    (limit - L) * documents longer than L.

    Documents are pre-aggregated by length before the exchange. Suffix sums run
    in blocks of ``block`` lengths, then over block totals, so no window holds
    all lengths. Null or empty text counts as length 0 (1 with the end id); an
    empty table gives no rows; repeated rows count each time; other columns are
    ignored.
    """
    vocabulary = vocabulary or default_vocabulary()
    B.ship(docs.sparkSession)
    hist = B.stage(token_lengths(docs, vocabulary, text, end).groupBy("length").agg(F.count("*").alias("n_docs")), "lengths")
    hist = hist.withColumn("_b", F.floor(F.col("length") / block))
    inner = Window.partitionBy("_b").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outer = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mass = F.col("n_docs") * F.col("length")
    zero = F.lit(0).cast("long")
    blocks = hist.groupBy("_b").agg(F.sum("n_docs").alias("_n"), F.sum(mass).alias("_t"))
    blocks = blocks.select(
        "_b",
        F.coalesce(F.sum("_n").over(outer), zero).alias("_n0"),
        F.coalesce(F.sum("_t").over(outer), zero).alias("_t0"),
        F.sum("_n").over(everything).alias("_docs"),
        F.sum("_t").over(everything).alias("_all"),
    )
    out = hist.join(blocks, "_b").withColumns({"docs_ge": F.col("_n0") + F.sum("n_docs").over(inner), "_tge": F.col("_t0") + F.sum(mass).over(inner)})
    gt, tgt = F.col("docs_ge") - F.col("n_docs"), F.col("_tge") - mass
    kept = F.col("_all") - tgt + gt * F.col("length")
    return out.select(
        F.col("length").alias("limit"),
        "n_docs",
        "docs_ge",
        (F.col("_docs") - gt).alias("docs_le"),
        F.col("_all").alias("total_tokens"),
        tgt.alias("tokens_gt"),
        kept.alias("truncated_total"),
        (F.col("_all") - kept).alias("dropped_total"),
        ((F.col("_docs") - gt) / F.col("_docs")).alias("quantile"),
    )


def total_at(table: DataFrame, limit: int) -> int:
    """Tokens kept when every document is cut at ``limit``, from a ``count_table``."""
    row = table.filter(F.col("limit") <= limit).orderBy(F.desc("limit")).limit(1).collect()
    if row:
        return row[0].truncated_total + (limit - row[0].limit) * (row[0].docs_ge - row[0].n_docs)
    n = table.agg(F.max("docs_ge").alias("n")).collect()[0].n
    return (n or 0) * limit


# ---------------------------------------------------------------- record files

_HEAD = struct.Struct("<QI")
_META = struct.Struct("<?q")
#: Closes each record; written after a block of records by the line-oriented Spark writer.
_TAIL = b"\n"
#: Bytes of a file, and blocks of records that one is written in, at most.
FILE_BYTES, BLOCKS = 8 << 20, 32


def masked(data: bytes) -> int:
    """CRC-32 of data, rotated right by 15 bits plus a constant, so that checksums of checksums stay apart."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    """length u64 | masked crc of length u32 | payload | masked crc of payload u32, without the tail byte.

    payload: is-null flag u8 | doc_id i64 | packed ids.
    """
    payload = _META.pack(doc_id is None, doc_id or 0) + ids
    size = struct.pack("<Q", len(payload))
    return _HEAD.pack(len(payload), masked(size)) + payload + struct.pack("<I", masked(payload))


def frames(data: bytes) -> Iterator[tuple[int, int, int | None, memoryview]]:
    """(offset, size with tail, doc_id, packed ids) of each record; raises on a damaged file."""
    view, at = memoryview(data), 0
    while at < len(view):
        n, crc = _HEAD.unpack_from(view, at)
        if masked(bytes(view[at : at + 8])) != crc:
            raise ValueError(f"damaged length at byte {at}")
        body = view[at + 12 : at + 12 + n]
        if len(body) != n or struct.unpack_from("<I", view, at + 12 + n)[0] != masked(body) or bytes(view[at + 16 + n : at + 17 + n]) != _TAIL:
            raise ValueError(f"damaged record at byte {at}")
        null, doc = _META.unpack_from(body)
        yield at, n + 17, None if null else doc, body[_META.size :]
        at += n + 17


def write_records(docs: DataFrame, path: str, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> None:
    """Encode whole texts and write framed records below ``path`` in ascending doc_id order.

    Files hold consecutive ranges of ids: by task number, then by the number
    within the task. Null ids come first, rows of equal id in order of their
    text (null first). A file has about ``file_bytes`` bytes, or one record if
    that is longer, however much text a task gets. Bytes go through Spark's own
    writer and committer, so any store that Spark writes to works and a lost
    executor's files are written anew. Null text: empty; an empty table gives
    no records. Other columns are ignored.
    """
    vocabulary = vocabulary or default_vocabulary()
    block = max(1, file_bytes // BLOCKS)

    def run(batches):
        enc = encoder(vocabulary)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        held: list[bytes] = []
        size = 0
        for b in batches:
            ids = b.column(0).to_pylist()
            for start, texts in slices(b.column(1)):
                done = []
                for k, p in enumerate(enc.packed(texts)):
                    held.append(frame(ids[start + k], p + end))
                    size += len(held[-1]) + 1
                    if size >= block:
                        done.append(_TAIL.join(held))
                        held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], ["value"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_TAIL.join(held)], pa.binary())], ["value"])

    B.ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    rows = rows.repartitionByRange(B.tasks_for(rows), "_id").sortWithinPartitions("_id", "_text")
    # a row is a block of records; its last record's tail is the writer's
    blocks = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    blocks.write.option("lineSep", _TAIL.decode()).option("maxRecordsPerFile", BLOCKS).text(path)


def read_index(spark, path: str, id_bytes: int) -> DataFrame:
    """Offset index of the files below ``path``, made by reading and verifying every record.

    Columns: file, file_no (ascending with the ids), record, offset, size, doc_id, n_tokens, in_file
    (tokens before it in its file), ids_crc32 (over 32-bit ids).
    """

    def run(batches):
        kind = np.dtype(f"<u{id_bytes}")
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                cols: list[list] = [[] for _ in range(9)]
                before = 0
                task, nth = re.search(r"part-(\d+)(?:.*-c(\d+))?", name.rsplit("/", 1)[-1]).groups()
                no = int(task) << 32 | int(nth or 0)
                for k, (at, size, doc, ids) in enumerate(frames(data.as_buffer())):
                    a = np.frombuffer(ids, dtype=kind)
                    for c, v in zip(cols, (name, no, k, at, size, doc, len(a), before, zlib.crc32(a.astype("<u4"))), strict=True):
                        c.append(v)
                    before += len(a)
                kinds = (pa.string(), *[pa.int64()] * 8)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["file", "file_no", "record", "offset", "size", "doc_id", "n_tokens", "in_file", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, file_no long, record long, offset long, size long, doc_id long, n_tokens long, in_file long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, vocabulary: str | None = None, **names) -> DataFrame:
    """Write record files to ``path/data`` and their index to ``path/index``; return the index.

    The index holds ``start`` (tokens in all records before it) beside file,
    offset and size, enough for a shuffled read of any record by itself.
    """
    vocabulary = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    write_records(docs, f"{path}/data", vocabulary, **names)
    read_index(spark, f"{path}/data", encoder(vocabulary).dtype.itemsize).write.parquet(f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    per, _ = B.ranked(index.groupBy("file_no").agg(F.sum("n_tokens").alias("_n")), ["file_no"], B.shuffle_parts(spark), "files", {"_before": "_n"})
    per = B.stage(per.select(F.col("file_no").alias("_f"), "_before"), "starts")
    return index.join(per, F.col("file_no") == F.col("_f")).withColumn("start", F.col("_before") + F.col("in_file")).drop("_before", "in_file", "_f")


def read_record(path: str, offset: int, size: int) -> tuple[int | None, bytes]:
    """One record of a file on a file system that this process can open: (doc_id, packed ids)."""
    with open(path.removeprefix("file:"), "rb") as f:
        f.seek(offset)
        _, _, doc, ids = next(frames(f.read(size)))
        return doc, bytes(ids)
