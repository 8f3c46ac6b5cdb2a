"""Queries of the engine's own operators over the driver's tables, with their SQL equivalents.

Queries of the pattern engine are in ``logs``, and at the end of this module
those over ``documents``. The others are relational readings, plain SQL shared
by Spark and the oracle, over the tables and the relations ``tok`` (doc_id, tok,
text, kind: runs of non-blanks) and ``lines`` (doc_id, rec, text), which either
side builds its own way; they show the SQL side of an operator, not the lexer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import axes, reports, scan
from ..streaming import scan as streams
from . import logs

EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}"
IPV4 = "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"
_KIND = f"CASE WHEN RX(text, '^{EMAIL}$') THEN 'email' WHEN RX(text, '^{IPV4}$') THEN 'ip' WHEN RX(text, '^[0-9]+$') THEN 'number' WHEN RX(text, '^[A-Za-zÀ-ÿ]+$') THEN 'word' WHEN RX(text, '^[A-Za-zÀ-ÿ]+[.,;:!?]+$') THEN 'closed' ELSE 'other' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tok(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(r"[^ \t\n]+"), F.lit(0))
    t = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(words).alias("tok", "text"))
    return t.withColumn("kind", F.expr(_KIND.replace("RX(", "regexp_like(")))


_TOK_SQL = f"""tok as (select doc_id, tok, text, {_KIND.replace("RX(", "regexp_matches(")} as kind from (
    select doc_id, unnest(w) as text, generate_subscripts(w, 1) - 1 as tok from (select doc_id, regexp_extract_all(text, '[^ \\t\\n]+') as w from documents)))"""
_LINES_SQL = """lines as (select doc_id, unnest(l) as text, generate_subscripts(l, 1) as rec from (select doc_id, string_split(text, chr(10)) as l from documents))"""

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def both(name: str, body: str) -> None:
    """Register one statement for both sides; {x} names a relation or a table."""
    own = {n for n in ("tok", "lines") if "{" + n + "}" in body}
    tables = {n for n in ("documents", "labels", "pages", "events", "lineitem", "orders", "customer", "part", "supplier", "nation", "benchmark", "conversations", "embeddings") if "{" + n + "}" in body}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = {n: table(spark, sf_dir, n) for n in tables}
        if "tok" in own:
            given["tok"] = tok(spark, sf_dir)
        if "lines" in own:
            given["lines"] = scan.lines(table(spark, sf_dir, "documents"))
        return spark.sql(_spark(body), **given)

    QUERIES[name] = run
    parts = [s for n, s in (("tok", _TOK_SQL), ("lines", _LINES_SQL)) if n in own]
    text = body.replace("RX(", "regexp_matches(").replace("QUANTILE(", "quantile_cont(")
    for n in own | tables:
        text = text.replace("{" + n + "}", n)
    if parts:
        text = f"with {', '.join(parts)}, " + text.strip()[5:] if text.strip().startswith("with ") else f"with {', '.join(parts)} {text}"
    ORACLE_SQL[name] = text


def _spark(body: str) -> str:
    """The statement in Spark's dialect: names of functions, and replacement of all matches by default."""
    return body.replace("RX(", "regexp_like(").replace("QUANTILE(", "percentile(").replace(", 'g')", ")")


def engine(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


# scans and projections
both("a1_inputs", "select doc_id, cast(length(text) as bigint) as chars, cast(length(text) - length(replace(text, chr(10), '')) as bigint) as newlines from {documents}")
both("a14_line_sink", "select doc_id, concat(cast(doc_id as varchar(20)), ':', lang, ':', source) as value from {documents}")
# joins
both("f3_equi_join_projection", "select lower(a.lang) as lang, cast(count(*) as bigint) as n from {documents} a join {labels} l on a.doc_id = l.doc_id group by lower(a.lang)")
both("f6_as_of", "with r as (select user_id, event_id, ts, event_type, max(case when event_type = 'purchase' then ts end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as last_purchase from {events}) select user_id, cast(count(*) as bigint) as n from r where last_purchase is not null group by user_id")
both("f11_relational_joins", "select n_name, cast(count(*) as bigint) as orders, round(sum(o_totalprice), 2) as total from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey group by n_name")
# aggregates
both("g1_count_by", "select lang, source, cast(count(*) as bigint) as n from {documents} group by lang, source")
both("g2_top", "select text, cast(count(*) as bigint) as n from {tok} where RX(text, '^[A-Za-zÀ-ÿ]+$') group by text order by n desc, text limit 20")
both("g3_uniq", "select distinct kind, length(text) > 10 as long_text from {tok}")
both("g4_key_template", "select concat(lang, ' ', source) as key, cast(count(*) as bigint) as n from {documents} group by concat(lang, ' ', source)")
both("g6_sum", "select lang, cast(sum(n_chars) as bigint) as total, cast(min(n_chars) as bigint) as least, cast(max(n_chars) as bigint) as most from {documents} group by lang")
both("g10_percentile_linear", "select lang, round(QUANTILE(cast(n_chars as double), 0.5), 6) as p50, round(QUANTILE(cast(n_chars as double), 0.9), 6) as p90 from {documents} group by lang")
both("g18_stats", "select cast(count(distinct doc_id) as bigint) as files, cast(count(*) as bigint) as tokens, cast(sum(length(text)) as bigint) as chars from {tok}")
both("g20_rollup", "select lang, source, cast(count(*) as bigint) as n from {documents} group by rollup (lang, source)")
# windows
both("h1_rank", "with r as (select doc_id, text, tok, row_number() over (partition by doc_id, text order by tok) as nth, row_number() over (partition by doc_id, text order by tok desc) as back from {tok} where kind = 'number') select doc_id, text, cast(nth as bigint) as nth, cast(back as bigint) as back from r")
both("h2_lags", "with r as (select doc_id, text, tok - lag(tok) over (partition by doc_id, text order by tok) as back from {tok} where text = 'of') select doc_id, cast(max(back) as bigint) as widest, cast(min(back) as bigint) as narrowest from r where back is not null group by doc_id")
both("h3_gradient", "with r as (select doc_id, length(text) - coalesce(lag(length(text)) over (partition by doc_id order by tok), length(text)) as g from {tok}) select doc_id, cast(max(g) as bigint) as steepest, cast(min(g) as bigint) as lowest from r group by doc_id")
both("h4_energy", "with r as (select doc_id, sum(length(text) * length(text)) over (partition by doc_id order by tok rows between 15 preceding and current row) as e from {tok}) select doc_id, cast(max(e) as bigint) as peak from r group by doc_id")
QUERIES["h4_energy"] = lambda s, d: axes.rolling_energy(table(s, d, "documents"))
both("h15_frames", "select event_id, cast(ntile(4) over w as bigint) as quarter, round(cume_dist() over w, 9) as share, round(percent_rank() over w, 9) as place, cast(sum(cast(event_id % 7 as bigint)) over (partition by user_id order by event_id range between 500 preceding and current row) as bigint) as recent from {events} window w as (partition by user_id order by value, event_id)")
# limits
both("i3_line_range", "select doc_id, cast(rec as bigint) as rec, text from {lines} where rec between 2 and 4")
# sets and records
both("j8_except", "select text from {benchmark} except select text from {documents}")
both("k1_templates", "with s as (select regexp_replace(regexp_replace(text, '[0-9]+', '<number>', 'g'), '[A-Za-zÀ-ÿ]+', 'w', 'g') as shape, text from {lines}) select shape, cast(count(*) as bigint) as n, min(text) = max(text) as literal from s group by shape having count(*) > 1")
both("n1_line_records", "select doc_id, cast(count(*) as bigint) as records from {lines} group by doc_id")
# scalars
both("l1_case_trim", "select doc_id, upper(lang) as up, trim(concat('  ', source, ' ')) as trimmed from {documents}")
both("l2_first_last", "select doc_id, left(text, 5) as head, right(text, 5) as tail from {documents}")
both("l4_url_parts", "select page_id, split_part(url, '/', 3) as host, split_part(url, ':', 1) as scheme from {pages}")
both("l7_date_parts", "select event_id, cast(extract(year from ts) as bigint) as y, cast(extract(month from ts) as bigint) as m, cast(extract(day from ts) as bigint) as d from {events}")
both("l24_edit_distance", "select doc_id, cast(levenshtein(lang, 'en') as bigint) as d from {documents}")
both("q9_tumbling", "select date_trunc('hour', ts) as window_start, event_type, cast(count(*) as bigint) as n, round(sum(value), 4) as total from {events} group by date_trunc('hour', ts), event_type")
FLAGSHIP = "x_token_kinds"

# ---- the pattern engine
_DOCS_MATCH = "select doc_id, unnest(regexp_extract_all(text, '{}')) as text from documents"
engine("x_email_matches", lambda s, d: scan.matches(table(s, d, "documents"), r"\E:e", need="@").select("doc_id", "text"), _DOCS_MATCH.format(EMAIL))
engine("x_email_domains", lambda s, d: reports.count_by(scan.matches(table(s, d, "documents"), r"\E:e", need="@"), "${e}").select("key", F.col("count").alias("n")), f"select key, count(*) as n from (select unnest(regexp_extract_all(text, '{EMAIL}')) as key from documents) group by key")
engine("x_literal_pairs", lambda s, d: scan.matches(table(s, d, "documents"), '"of" "the"').groupBy("doc_id").agg(F.count("*").alias("n")))
engine("x_number_totals", lambda s, d: reports.count_by(scan.matches(table(s, d, "documents"), r"\N:n"), "${n}", ("n",)).select("key", "count", "sum_n"))
engine("x_token_kinds", lambda s, d: scan.kind_counts(table(s, d, "documents")))
engine("x_repeated_word", lambda s, d: scan.matches(table(s, d, "documents"), r"\W:w =w").groupBy("text").agg(F.count("*").alias("n")))
engine("x_redacted", lambda s, d: reports.redact(table(s, d, "documents"), r"\E").filter("n_changes > 0"), f"select doc_id, t as text, cast(n as integer) as n_changes from (select doc_id, n, list_reduce(list_prepend(text, m), lambda a, b: replace(a, b, regexp_replace(b, '[A-Za-z0-9]', '*', 'g'))) as t from (select doc_id, text, regexp_extract_all(text, '{EMAIL}') as m, len(regexp_extract_all(text, '{EMAIL}')) as n from documents) where n > 0)")
engine("x_templates", lambda s, d: reports.templates(table(s, d, "documents")))
QUERIES |= logs.QUERIES
ORACLE_SQL |= logs.ORACLE_SQL
engine("q9_watermarked", lambda s, d: streams.windowed(table(s, d, "events")).select("window_start", "event_type", "n", F.round("total", 4).alias("total")), ORACLE_SQL["q9_tumbling"])
