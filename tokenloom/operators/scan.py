"""Token and match tables: the two relations that everything else is built on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexer import Token, count_kinds, lex, paired, spans
from ..plans.pattern import Pattern, PatternError
from ..shipping import ship

TOKENS = "doc_id long, tok int, kind string, start int, end int, text string, mate int, depth int, line int"
MATCHES = "doc_id long, m int, start int, end int, line int, text string, registers map<string,string>, kinds map<string,string>"


#: Matches or tokens that are held as Python objects at once.
SLICE = 20_000


def tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", blanks: bool = False) -> DataFrame:
    """One row a significant token; positions are characters, ``mate`` is the paired bracket's tok or null."""
    ship(docs.sparkSession)

    def given(ids, ts):
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([k for k, _ in ids], [n for _, n in ids]), pa.int64()) if None not in [k for k, _ in ids] else pa.array([k for k, n in ids for _ in range(n)], pa.int64()),
                pa.array(np.concatenate([np.arange(n, dtype=np.int32) for _, n in ids]), pa.int32()),
                pa.array([x.kind for x in ts], pa.string()),
                pa.array([x.start for x in ts], pa.int32()),
                pa.array([x.end for x in ts], pa.int32()),
                pa.array([x.text for x in ts], pa.string()),
                pa.array([x.mate if x.mate >= 0 else None for x in ts], pa.int32()),
                pa.array([x.depth for x in ts], pa.int32()),
                pa.array([x.line for x in ts], pa.int32()),
            ],
            ["doc_id", "tok", "kind", "start", "end", "text", "mate", "depth", "line"],
        )

    def run(batches):
        for b in batches:
            ids, held = [], []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if ts := lex(t.as_py(), blanks):
                    ids.append((doc, len(ts)))
                    held += ts
                    if len(held) >= SLICE:
                        yield given(ids, held)
                        ids, held = [], []
            if held:
                yield given(ids, held)

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, TOKENS)


def words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text,): the tokens of all texts, each once."""
    ship(docs.sparkSession)

    def run(batches):
        seen: set[str] = set()
        for b in batches:
            new: set[str] = set()
            for t in b.column(0):
                t = t.as_py()
                new.update([t[x:y] for _, x, y in spans(t)])
                if len(new) >= SLICE:
                    yield pa.RecordBatch.from_arrays([pa.array(list(new - seen), pa.string())], ["text"])
                    seen = seen | new if len(seen) < 10 * SLICE else new
                    new = set()
            yield pa.RecordBatch.from_arrays([pa.array(list(new - seen), pa.string())], ["text"])
            seen = seen | new if len(seen) < 10 * SLICE else new

    return docs.select(text).mapInArrow(run, "text string").distinct()


def kind_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, n) over all texts; tokens are counted where they are lexed and never leave the task."""
    ship(docs.sparkSession)

    def run(batches):
        total: dict[str, int] = {}
        for b in batches:
            for t in b.column(0):
                for k, n in count_kinds(t.as_py()).items():
                    total[k] = total.get(k, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["kind", "n"])

    return docs.select(text).mapInArrow(run, "kind string, n long").groupBy("kind").agg(F.sum("n").alias("n"))


def bracket_mates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``mates`` of texts, paired where they are lexed: only the pairs leave the task."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            ids, one, two = [], [], []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py() or ""
                found = spans(t)
                at = [k for k, x in enumerate(found) if x[0] in ("open", "close")]
                for k, x in enumerate(paired([Token(*found[i], t[found[i][1] : found[i][2]], 1) for i in at], True)):
                    if x.kind == "open" and x.mate >= 0:
                        ids.append(doc)
                        one.append(at[k])
                        two.append(at[x.mate])
                if len(ids) >= SLICE:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(one, pa.int32()), pa.array(two, pa.int32())], ["doc_id", "opened", "closed"])
                    ids, one, two = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(one, pa.int32()), pa.array(two, pa.int32())], ["doc_id", "opened", "closed"])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "doc_id long, opened int, closed int")


def mates(t: DataFrame) -> DataFrame:
    """(doc_id, opened, closed): token numbers of each bracket pair, from ``tokens``; a mate is in the row, so no join is needed."""
    return t.filter("kind = 'open' and mate is not null").select("doc_id", F.col("tok").alias("opened"), F.col("mate").alias("closed"))


def common_tokens(one: DataFrame, two: DataFrame, text: str = "text") -> DataFrame:
    """(kind, text) of the tokens that stand in both inputs, each once."""
    a, b = (tokens(d.withColumn("_id", F.lit(0)), "_id", text).select("kind", "text").distinct() for d in (one, two))
    return a.join(b, ["kind", "text"], "left_semi")


def shared(docs: DataFrame, other: DataFrame, doc_id: str = "doc_id", text: str = "text", kinds: frozenset[str] | None = None) -> DataFrame:
    """(doc_id, known): the tokens of each document (of some kinds only) that some text of ``other`` holds too; a join by token, no side is broadcast."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            ids, said = [], []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py()
                own = {t[x:y] for k, x, y in spans(t) if kinds is None or k in kinds}
                ids += [doc] * len(own)
                said += own
                if len(ids) >= SLICE:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(said, pa.string())], ["doc_id", "text"])
                    ids, said = [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(said, pa.string())], ["doc_id", "text"])

    own = docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "doc_id long, text string")
    return own.join(words(other, text), "text", "left_semi").groupBy("doc_id").agg(F.collect_set("text").alias("known"))


class _Any:
    """Stands for the tokens of an input where each test is to pass."""

    def __init__(self, want: bool) -> None:
        self.want = want

    def __contains__(self, text: str) -> bool:
        return self.want


def _mapped(keys: list[str], values: list[str], offsets: list[int]) -> pa.Array:
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))


def matches(docs: DataFrame, pattern: str | dict[str, str], doc_id: str = "doc_id", text: str = "text", need: str | None = None, limit: int | None = None, others: dict[str, DataFrame] | None = None, unless: dict[str, str] | None = None, **options) -> DataFrame:
    """One row a match: leftmost, not overlapping, in order; a dict of patterns adds ``member``.

    ``need`` is a literal that every match must hold; the scan then skips other
    rows before Python sees them. ``limit`` is the most matches of an input.
    ``others`` are the inputs (columns doc_id and text) that a pattern names
    with @; document ids must then be distinct. ``unless`` are patterns by
    member: matches on a line where such a one begins are left out.
    ``options`` are those of ``Pattern`` (lets, orbit, ignore_case, swap_greed).
    """
    ship(docs.sparkSession)
    many = isinstance(pattern, dict)
    compiled = [Pattern(p, **options) for p in [*(pattern.values() if many else [pattern]), *(unless or {}).values()]]  # refuse a bad pattern before any input is read
    named = sorted(set().union(*[p.joins for p in compiled]))
    if missing := [n for n in named if n not in (others or {})]:
        raise PatternError(f"no input is given for @{missing[0]}")
    rows = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).alias("_text"))
    if need:
        rows = rows.filter(F.col("_text").contains(need))
    # a match of one token that other inputs are asked for is found first and told by its text afterwards
    apart = compiled[0].apart if len(compiled) == 1 and limit is None else None
    passed = {n: _Any(want) for n, want in (apart or {}).items()}
    for k, n in enumerate(named if not apart else ()):
        asked = [p.asked[n] for p in compiled if n in p.asked]
        have = shared(docs, others[n], doc_id, text, None if None in asked else frozenset().union(*asked)).select(F.col("doc_id").alias("_d"), F.col("known").alias(f"_known{k}"))
        rows = rows.join(have, F.col("_doc").eqNullSafe(F.col("_d")), "left").drop("_d")

    def run(batches):
        pats = {n: Pattern(p, **options) for n, p in (pattern.items() if many else [("", pattern)])}
        bars = {n: Pattern(p, **options) for n, p in (unless or {}).items()}
        head = next(iter(pats.values()))
        full = any(p.full for p in [*pats.values(), *bars.values()])
        names = ["doc_id", "m", "start", "end", "line", "text", "registers", "kinds", "member"]

        def cleared():
            return [[] for _ in range(6)], [[], [], [], [0]], []

        def given(cols, regs, members):
            kinds = (pa.int64(), *[pa.int32()] * 4, pa.string())
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)] + [_mapped(regs[0], regs[1], regs[3]), _mapped(regs[0], regs[2], regs[3])]
            return pa.RecordBatch.from_arrays(arrays + [pa.array(members, pa.string())] * many, names if many else names[:-1])

        for b in batches:
            cols, regs, members = cleared()
            ids, ms, starts, ends, at, said = cols
            for row, doc in enumerate(b.column(0).to_pylist()):
                t = b.column(1)[row].as_py() or ""
                todo = [(name, p) for name, p in pats.items() if not p.absent(t)]
                if not todo:
                    continue
                known = passed if apart else {n: set(b.column(2 + k)[row].as_py() or ()) for k, n in enumerate(named)}
                ctx = head.input(t, known, full)
                tokens = ctx.tokens
                for name, p in todo:
                    barred = None
                    ctx.origin, n = 0, 0
                    for a, e, bound in p.spans(ctx, limit):
                        first = tokens[a]
                        if name in bars:
                            if barred is None:
                                kept, ctx.origin = ctx.origin, 0
                                barred = set() if bars[name].absent(t) else {tokens[x].line for x, _, _ in bars[name].spans(ctx, limit)}
                                ctx.origin = kept
                            if first.line in barred:
                                n += 1
                                continue
                        end = first.end if e == a + 1 else tokens[e - 1].end
                        ids.append(doc)
                        ms.append(n)
                        n += 1
                        starts.append(first.start)
                        ends.append(end)
                        at.append(first.line)
                        said.append(t[first.start : end])
                        if p.names:
                            for r, x, y, kind in p.bound(ctx, bound):
                                regs[0].append(r)
                                regs[1].append(t[x:y])
                                regs[2].append(kind)
                        regs[3].append(len(regs[0]))
                        if many:
                            members.append(name)
                if len(ids) >= SLICE:
                    yield given(cols, regs, members)
                    cols, regs, members = cleared()
                    ids, ms, starts, ends, at, said = cols
            yield given(cols, regs, members)

    out = rows.mapInArrow(run, MATCHES + (", member string" if many else ""))
    if not apart:
        return out
    for n, want in apart.items():
        out = out.join(words(others[n], text), "text", "left_semi" if want else "left_anti")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1
    return out.withColumn("m", place).select(*[x.split()[0] for x in MATCHES.split(", ")], *["member"] * many)


def counts(docs: DataFrame, pattern: str, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n) of the documents that hold a match; matches are counted where they are found."""
    ship(docs.sparkSession)
    if Pattern(pattern, **options).joins:
        return matches(docs, pattern, doc_id, text, **options).groupBy("doc_id").agg(F.count("*").alias("n"))

    def run(batches):
        p = Pattern(pattern, **options)
        for b in batches:
            n = np.array([p.count(t.as_py()) for t in b.column(1)], dtype=np.int64)
            has = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(has), pa.array(n).filter(has)], ["doc_id", "n"])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "doc_id long, n long").groupBy("doc_id").agg(F.sum("n").alias("n"))


def lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rec, text): records of one line, counted from 1."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n", -1)).alias("rec", "text")).withColumn("rec", F.col("rec") + 1)


def paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rec, text): records parted by blank lines."""
    parts = F.filter(F.split(text, r"\n[ \t]*\n\s*", -1), lambda x: F.trim(x) != "")
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(parts).alias("rec", "text")).withColumn("rec", F.col("rec") + 1)


def record_query(records: DataFrame, patterns: dict[str, str], want: str = "all", least: int = 1) -> DataFrame:
    """Records that all / any / none / at least ``least`` of the patterns match."""
    keyed = records.withColumn("_key", F.xxhash64("doc_id", "rec"))
    hit = matches(keyed, patterns, "_key").groupBy("doc_id").agg(F.count_distinct("member").alias("_n")).withColumnRenamed("doc_id", "_k")
    out = keyed.join(hit, F.col("_key") == F.col("_k"), "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    test = {"all": F.col("_n") == len(patterns), "any": F.col("_n") > 0, "none": F.col("_n") == 0, "at_least": F.col("_n") >= least}[want]
    return out.filter(test).drop("_key", "_k", "_n")
