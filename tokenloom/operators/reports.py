"""Grouped aggregates, rewriting, redaction, templates and findings over matches."""

from __future__ import annotations

import decimal
import difflib
import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StringType

from ..functions import values as V
from ..functions.lexer import KINDS, spans
from ..plans.pattern import Pattern, escape
from ..shipping import ship
from .scan import matches


#: Digits enough for any token's value beside the 10^30 that keeps signs apart.
_WIDE = decimal.Context(prec=90)


def key(template: str) -> Column:
    """A report template such as '${ip} ${mail.domain}' over a match row; an empty key prints as '-'."""
    parts = []
    for k, p in enumerate(re.split(r"\$\{(\w+(?:\.\w+)?)\}", template)):
        if k % 2 == 0:
            parts.append(F.lit(p))
        elif "." in p:
            name, member = p.split(".")
            parts.append(F.coalesce(part(F.element_at("kinds", F.lit(name)), F.element_at("registers", F.lit(name)), member), F.lit("")))
        elif p in ("start", "end", "line", "doc_id"):
            parts.append(F.col(p).cast("string"))
        else:
            parts.append(F.col("text") if p == "0" else F.coalesce(F.element_at("registers", F.lit(p)), F.lit("")))
    out = F.concat(*parts)
    return F.when(out == "", "-").otherwise(out)


def _exact(kind: pd.Series, text: pd.Series) -> pd.Series:
    """Exact numeric value of a token; null if it has none."""
    out = [V.value(k, t) if k and t else None for k, t in zip(kind, text, strict=True)]
    return pd.Series([v if v is not None and not isinstance(v, tuple) else None for v in out], dtype=object)


def count_by(found: DataFrame, template: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """Matches by rendered key, with sum, min, max and count of registers; a missing value is not zero."""
    rows = found.withColumn("key", key(template))
    for r in sums:
        rows = rows.withColumn(f"_{r}", exact(F.element_at("kinds", F.lit(r)), F.element_at("registers", F.lit(r))))
    aggs = [F.count("*").alias("count")]
    for r in sums:
        aggs += [F.sum(f"_{r}").alias(f"sum_{r}"), F.min(f"_{r}").alias(f"min_{r}"), F.max(f"_{r}").alias(f"max_{r}"), F.count(f"_{r}").alias(f"n_{r}")]
    return rows.groupBy("key").agg(*aggs)


def exact(kind: Column, text: Column) -> Column:
    """Exact numeric value of a token column, in Arrow batches."""
    return F.pandas_udf(_exact, DecimalType(38, 9))(kind, text)


def part(kind: Column, text: Column, member: str) -> Column:
    """A named part of a token (domain of an e-mail, year of an instant), as text; null if it has none."""

    def run(kind: pd.Series, text: pd.Series) -> pd.Series:
        found = [V.field(k, t, member) if k and t is not None else None for k, t in zip(kind, text, strict=True)]
        return pd.Series([None if v is None else str(v) for v in found], dtype=object)

    return F.pandas_udf(run, StringType())(kind, text)


def exact_mean(total: Column, n: Column) -> Column:
    """sum / count without rounding: a repetend in parentheses; in Arrow batches."""

    def run(total: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or not k else V.quotient(t, int(k)) for t, k in zip(total, n, strict=True)], dtype=object)

    return F.pandas_udf(run, StringType())(total, n)


def sort_key(kind: Column, text: Column) -> Column:
    """A text that sorts as the token's value does (numbers, instants, sizes, versions, addresses); null if it has none."""

    def spelt(v) -> str | None:
        if v is None:
            return None
        if isinstance(v, tuple) and isinstance(v[0], tuple):  # a version: its core, then what may precede the release
            core, pre = v
            return ".".join(f"{n:020d}" for n in core) + "-" + ".".join(f"{a}{n:020d}{w}" for a, n, w in pre)
        if isinstance(v, tuple):
            return f"{v[0]}:{v[1]:040d}"
        return f"{_WIDE.add(v, 10**30):062.25f}"

    def run(kind: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([spelt(V.value(k, t)) if k and t is not None else None for k, t in zip(kind, text, strict=True)], dtype=object)

    return F.pandas_udf(run, StringType())(kind, text)


def extremes(found: DataFrame, template: str, registers: tuple[str, ...]) -> DataFrame:
    """(key, min_r, max_r): the least and greatest token of each register by value, as written; values without one are left out."""
    rows = found.withColumn("key", key(template))
    for r in registers:
        rows = rows.withColumn(f"_{r}", sort_key(F.element_at("kinds", F.lit(r)), F.element_at("registers", F.lit(r))))
    said = {r: F.element_at("registers", F.lit(r)) for r in registers}
    return rows.groupBy("key").agg(*[x for r in registers for x in (F.min_by(said[r], f"_{r}").alias(f"min_{r}"), F.max_by(said[r], f"_{r}").alias(f"max_{r}"))])


def percentiles(found: DataFrame, template: str, register: str, shares: tuple[float, ...], how: str = "nearest") -> DataFrame:
    """(key, p50, ...): percentiles of a register's values. Equal values are counted before the exchange.

    ``nearest``: the least value with at least that share at or below it;
    ``linear``: between the two neighbouring values; ``lower``: the lower of them.
    """
    value = exact(F.element_at("kinds", F.lit(register)), F.element_at("registers", F.lit(register)))
    rows = found.select(key(template).alias("key"), value.alias("_v")).filter("_v is not null")
    named = [(q, f"p{q * 100:g}") for q in shares]
    if how == "nearest":
        return rows.groupBy("key").agg(*[F.expr(f"percentile_disc({q}) within group (order by _v)").alias(n) for q, n in named])
    if how == "linear":
        return rows.groupBy("key").agg(*[F.expr(f"percentile_cont({q}) within group (order by _v)").alias(n) for q, n in named])
    if how != "lower":
        raise ValueError(f"no such percentile: {how}")
    # the value at place floor(q (n - 1)): counts of distinct values, summed in order
    n = rows.groupBy("key", "_v").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("key").orderBy("_v")
    n = n.withColumns({"_upto": F.sum("_n").over(w), "_all": F.sum("_n").over(Window.partitionBy("key"))})
    return n.groupBy("key").agg(*[F.min(F.when(F.col("_upto") > F.floor(F.lit(q) * (F.col("_all") - 1)), F.col("_v"))).alias(name) for q, name in named])


def top(found: DataFrame, template: str, n: int = 10) -> DataFrame:
    return count_by(found, template).orderBy(F.desc("count"), "key").limit(n)


def rewrite(docs: DataFrame, pattern: str, template: str, doc_id: str = "doc_id", text: str = "text", most: int | None = None, **options) -> DataFrame:
    """(doc_id, text, n_changes): each match replaced by the rendered template (${name}, ${1}, ${0})."""
    return _edit(docs, pattern, doc_id, text, most, lambda p: lambda m, seen: re.sub(r"\$\{(\w+)\}", lambda r: _value(p, m, r[1]), template), options=options)


def _value(p: Pattern, m, name: str) -> str:
    if name == "0":
        return m.text
    name = p.names[int(name) - 1] if name.isdigit() else name
    return m.registers[name][2] if name in m.registers else ""


def mask(text: str, how: str, keep: int = 0) -> str:
    """Mask letters and digits: 'char' to *, 'shape' to a and 0; the last ``keep`` stay."""
    if how == "token":
        return "*"
    left = sum(c.isalnum() for c in text) - keep
    out = []
    for c in text:
        if c.isalnum() and left > 0:
            left -= 1
            out.append("*" if how == "char" else "0" if c.isdigit() else "a")
        else:
            out.append(c)
    return "".join(out)


def redact(docs: DataFrame, pattern: str, how: str = "char", keep: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_changes): matches masked; 'pseudonym' numbers equal texts alike over all documents (ids must be distinct)."""
    if how == "pseudonym":
        names = pseudonyms(matches(docs, pattern, doc_id, text)).select(F.col("text").alias("_t"), F.col("name").alias("_n"))
        said = matches(docs, pattern, doc_id, text).select("doc_id", "text").distinct().join(names, F.col("text") == F.col("_t"))
        own = said.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("text", "_n"))).alias("_names"))
        docs = docs.join(own.withColumnRenamed("doc_id", "_d"), F.col(doc_id).eqNullSafe(F.col("_d")), "left").drop("_d")
        return _edit(docs, pattern, doc_id, text, None, lambda p: lambda m, names: names.get(m.text, m.text), "_names")
    return _edit(docs, pattern, doc_id, text, None, lambda p: lambda m, names: mask(m.text, how, keep))


def pseudonyms(found: DataFrame) -> DataFrame:
    """(text, name): KIND_1, KIND_2, ... by first occurrence over the whole run, each kind counted by itself."""
    kind = F.upper(F.coalesce(F.element_at(F.map_values("kinds"), 1), F.lit("match")))
    first = found.groupBy("text").agg(F.min(F.struct("doc_id", "start")).alias("_first"), F.min(kind).alias("_kind"))
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # places by range: counts of each partition and kind, then a window within both
    base = first.repartitionByRange(parts, "_first", "text").sortWithinPartitions("_first", "text").withColumns({"_part": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}).persist()
    per = base.groupBy("_part", "_kind").agg(F.count(F.lit(1)).alias("_n"))
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_kind").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    nth = F.row_number().over(Window.partitionBy("_part", "_kind").orderBy("_i"))
    return base.join(per, ["_part", "_kind"]).select("text", F.concat("_kind", F.lit("_"), (F.col("_before") + nth).cast("string")).alias("name"))


def _edit(docs, pattern, doc_id, text, most, render, names: str | None = None, options: dict | None = None) -> DataFrame:
    ship(docs.sparkSession)
    Pattern(pattern, **(options or {}))

    def run(batches):
        p = Pattern(pattern, **(options or {}))
        one = render(p)
        for b in batches:
            texts, n = [], []
            for row in range(b.num_rows):
                t = b.column(1)[row].as_py()
                known = dict(b.column(2)[row].as_py() or ()) if names else {}
                out, at, found = [], 0, p.find(t, most)
                for m in found:
                    out += [t[at : m.start], one(m, known)]
                    at = m.end
                texts.append(None if t is None else "".join([*out, t[at:]]))
                n.append(len(found))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int32())], ["doc_id", "text", "n_changes"])

    columns = [F.col(doc_id).cast("long").alias("doc_id"), text, *([names] if names else [])]
    return docs.select(*columns).mapInArrow(run, "doc_id long, text string, n_changes int")


#: A character for each kind, and characters of lines that are held before they are handed on.
_CODES = {k: chr(48 + i) for i, k in enumerate(KINDS)}
HELD = 8_000_000


def templates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(shape, count, cells, template): lines grouped by their kinds; cells that never change stay literal, others become <kind>.

    Lines are grouped where they are lexed; what is exchanged is a row for each
    shape that a task holds at once (its cells as one text, its kinds as a
    character each), merged in order of shapes. A line moves once, however long.
    """
    ship(docs.sparkSession)

    def parted(cells: list[str]) -> tuple[str, str]:
        """The cells as one text, and a mark between them that none holds."""
        mark = next(c for c in map(chr, range(31, 0x110000)) if not any(c in x for x in cells))
        return mark, mark.join(cells)

    def changing(said: list[str], new: list[str], same: list[bool] | None) -> list[bool] | None:
        """Which cells were always equal; None while all were."""
        if said == new:
            return same
        return [p == q for p, q in zip(said, new, strict=True)] if same is None else [c and p == q for c, p, q in zip(same, said, new, strict=True)]

    def run(batches):
        def given(held):
            said = [parted(v[1]) for v in held.values()]
            cols = [list(held), [v[0] for v in held.values()], [x for x, _ in said], [x for _, x in said], [None if v[2] is None else "".join("01"[c] for c in v[2]) for v in held.values()]]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["shape", "n", "mark", "said", "same"])

        held: dict[str, list] = {}
        size = 0
        for b in batches:
            for t in b.column(0):
                t = t.as_py() or ""
                found = spans(t)
                cut = [0, *[k for k in range(1, len(found)) if t.find("\n", found[k - 1][1], found[k][1]) >= 0], len(found)]
                for x, y in zip(cut[:-1], cut[1:], strict=True):
                    if x < y:
                        shape, said = "".join([_CODES[k] for k, _, _ in found[x:y]]), [t[i:j] for _, i, j in found[x:y]]
                        got = held.get(shape)
                        if got is None:
                            held[shape] = [1, said, None]
                            size += 64 * (y - x)
                        else:
                            got[0] += 1
                            got[2] = changing(got[1], said, got[2])
                if size > HELD:
                    yield given(held)
                    held, size = {}, 0
        yield given(held)

    def merged(batches):
        rows, size = [], 0
        last: list | None = None  # shape, count, cells, which were equal
        kinds = list(KINDS)

        def told(shape, n, said, same):
            names = [kinds[ord(c) - 48] for c in shape]
            cells = said if same is None else [x if c else f"<{k}>" for x, c, k in zip(said, same, names, strict=True)]
            return " ".join(names), n, cells, " ".join(cells)

        def given():
            types = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x) for k, x in enumerate(types)], ["shape", "count", "cells", "template"])

        for b in batches:
            for shape, n, mark, said, same in zip(*[c.to_pylist() for c in b.columns], strict=True):
                cells = said.split(mark)
                flags = None if same is None else [c == "1" for c in same]
                if last is not None and last[0] == shape:
                    both = changing(last[2], cells, last[3])
                    last[1] += n
                    last[3] = both if flags is None else flags if both is None else [p and q for p, q in zip(both, flags, strict=True)]
                    continue
                if last is not None:
                    rows.append(told(*last))
                    size += len(rows[-1][3])
                    if size > 1_000_000:
                        yield given()
                        rows, size = [], 0
                last = [shape, n, cells, flags]
        if last is not None:
            rows.append(told(*last))
        yield given()

    part = docs.select(text).mapInArrow(run, "shape string, n long, mark string, said string, same string")
    return part.repartition("shape").sortWithinPartitions("shape").mapInArrow(merged, "shape string, count long, cells array<string>, template string")


def rare(found: DataFrame, least: int | None = None, percent: float | None = None) -> DataFrame:
    """Templates of fewer than ``least`` lines, or under ``percent`` of all lines, or under the mean count."""
    if least is not None:
        return found.filter(F.col("count") < least)
    total = found.agg(F.sum("count").alias("_all"), F.count(F.lit(1)).alias("_n"))  # one row
    test = F.col("count") * 100 < F.col("_all") * percent if percent is not None else F.col("count") * F.col("_n") < F.col("_all")
    return found.crossJoin(F.broadcast(total)).filter(test).drop("_all", "_n")


def admitted(mine: DataFrame, theirs: DataFrame, novel: bool = False) -> DataFrame:
    """Templates of ``mine`` that some template of ``theirs`` admits (``novel``: that none does): of one shape, each literal cell equal."""
    other = theirs.select(F.col("shape").alias("_s"), F.col("cells").alias("_c"))
    fits = F.forall(F.zip_with("cells", "_c", lambda a, b: (a == b) | b.rlike("^<[a-z]+>$")), lambda x: x)
    return mine.join(other, (F.col("shape") == F.col("_s")) & fits, "left_anti" if novel else "left_semi")


def as_pattern(template: str) -> str:
    """A pattern for the lines of a template."""
    return "^ " + " ".join(rf"\{{{c[1:-1]}}}" if re.fullmatch("<[a-z]+>", c) and c[1:-1] in KINDS else escape(c) for c in template.split(" ")) + " $"


def as_json(found: DataFrame) -> DataFrame:
    """(value,): each row of matches, tables or findings as one JSON object."""
    return found.select(F.to_json(F.struct("*")).alias("value"))


def diffs(before: DataFrame, after: DataFrame, lines: int = 3) -> DataFrame:
    """(doc_id, diff): unified differences of the texts that changed; ids must be distinct."""

    def run(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(difflib.unified_diff((a or "").split("\n"), (b or "").split("\n"), "before", "after", n=lines, lineterm="")) for a, b in zip(old, new, strict=True)], dtype=object)

    both = before.select("doc_id", F.col("text").alias("_old")).join(after.select(F.col("doc_id").alias("_d"), F.col("text").alias("_new")), F.col("doc_id") == F.col("_d"))
    return both.filter(~F.col("_old").eqNullSafe(F.col("_new"))).select("doc_id", F.pandas_udf(run, StringType())("_old", "_new").alias("diff"))


def rewrite_with(docs: DataFrame, pattern: str, how, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_changes): each match replaced by ``how(match)``, which gets text, line and registers."""
    return _edit(docs, pattern, doc_id, text, None, lambda p: lambda m, names: how(m))


def findings(docs: DataFrame, rules: list[dict], **options) -> DataFrame:
    """Rule findings: rules are dicts of name, pattern, message, severity and optionally unless (a pattern on the same line)."""
    barred = {r["name"]: r["unless"] for r in rules if r.get("unless")}
    found = matches(docs, {r["name"]: r["pattern"] for r in rules}, unless=barred, **options)
    meta = docs.sparkSession.createDataFrame([(r["name"], r["message"], r.get("severity", "warning")) for r in rules], "member string, message string, severity string")
    out = found.join(F.broadcast(meta), "member")  # as many rows as rules
    return out.select("doc_id", "line", "start", "end", F.col("member").alias("rule"), "severity", "message", "text")


def fixed(docs: DataFrame, rules: list[dict], **options) -> DataFrame:
    """(doc_id, text): the fixes of rules applied in turn, where a rule has one (a template in its registers)."""
    out = docs.select("doc_id", "text")
    for r in rules:
        if r.get("fix") is not None:
            out = rewrite(out, r["pattern"], r["fix"], **options).select("doc_id", "text")
    return out


def sarif(found: DataFrame) -> DataFrame:
    """One SARIF result object a finding, as JSON text."""
    place = F.struct(F.struct(F.struct(F.col("doc_id").cast("string").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    return found.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), F.col("severity").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("value"))


def sarif_document(rules: list[dict], results: list[str] = ()) -> str:
    """The run's document with its results (``sarif`` rows), which a caller collects for a report of bounded size."""
    driver = {"name": "tokenloom", "rules": [{"id": r["name"]} for r in rules]}
    return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": [json.loads(r) for r in results]}]})
