"""Queries of the pattern engine over log text written from the driver's tables.

Each row of ``events`` becomes one line of typed tokens, so the lexer and the
matcher run over whole tables, while the expected answer follows from the
columns that the line was written from: the oracle never reads the line.
``logs`` has one document an event, ``sessions`` one a user (its events in
order, one a line), ``addresses`` the pages' URLs in a sentence each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from ..operators import lines as L
from ..functions import scalars
from ..operators import axes, bpe, index, records, reports, scan

#: Columns that a line is written from, and the line; MOMENT(x) is an instant in text.
_PARTS = """event_id, user_id, event_type, ts, cast(value as decimal(14,2)) as amount, user_id % 256 as a, event_id % 256 as b, event_id % 7 as c,
    event_id % 5000 as size, event_id % 101 as pct, event_id % 900 as ms, event_id % 4 as major, event_id % 10 as minor, event_id % 6 as patch"""
_LINE = """concat(MOMENT(ts), ' ', event_type, ' user=', user_id, ' from 10.', a, '.', b, '.', c, ' value=', amount, ' size=', size, 'KB cost=$', amount, ' load=', pct, '% took=', ms, 'ms v', major, '.', minor, '.', patch,
    ' mail u', user_id, '@', event_type, '.example.org said "q', event_id % 50, '" (', c, ', ', b, ') /srv/', event_type, '/f', b, '.log')"""
_LOGS = f"select event_id as doc_id, {_LINE} as text, l.* from (select {_PARTS} from EVENTS where value is not null) l"
_ORACLE = f"""with logs as ({_LOGS.replace("EVENTS", "events").replace("MOMENT(ts)", "strftime(ts, '%Y-%m-%d %H:%M:%S')")}) """

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text and the parts of the line), one row an event."""
    given = {"EVENTS": "{events}", "MOMENT(ts)": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')"}
    body = _LOGS
    for k, v in given.items():
        body = body.replace(k, v)
    return spark.sql(body, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a user's lines in order of their events."""
    said = F.array_sort(F.collect_list(F.struct("event_id", "text")))
    return logs(spark, sf_dir).groupBy(F.col("user_id").alias("doc_id")).agg(F.array_join(F.transform(said, lambda x: x["text"]), "\n").alias("text"))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").filter("url is not null").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("see "), F.col("url"), F.lit(" for more")).alias("text"))


RELATIONS = {"logs": logs, "sessions": sessions, "addresses": addresses}


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = run
    if " logs" in sql or " toks" in sql:
        sql = _ORACLE + ("," + sql.removeprefix("with ").join((" ", "")) if sql.startswith("with ") else sql)
    ORACLE_SQL[name] = sql


def find(name: str, pattern: str, sql: str, registers: tuple[str, ...] = (), rel: str = "logs", columns: tuple[str, ...] = ("doc_id", "text"), **options) -> None:
    """Matches of ``pattern`` over a relation: columns of the match and its registers."""

    def run(spark, sf_dir):
        m = scan.matches(RELATIONS[rel](spark, sf_dir), pattern, **{k: v(spark, sf_dir) if callable(v) else v for k, v in options.items()})
        return m.select(*columns, *[F.element_at("registers", F.lit(r)).alias(r) for r in registers])

    add(name, run, sql)


def count(name: str, pattern: str, sql: str, rel: str = "logs") -> None:
    """Matches a document."""
    add(name, lambda s, d: scan.counts(RELATIONS[rel](s, d), pattern), sql)


_IP = "concat('10.', a, '.', b, '.', c)"
_MAIL = "concat('u', user_id, '@', event_type, '.example.org')"
_PATH = "concat('/srv/', event_type, '/f', b, '.log')"
_VERSION = "concat('v', major, '.', minor, '.', patch)"
_MOMENT = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
_BRACKET = "concat('(', c, ', ', b, ')')"

# scans and projections
add("a7_kind_totals", lambda s, d: scan.kind_counts(logs(s, d)), """select kind, cast(sum(n) as bigint) as n from (
    select unnest(['timestamp', 'word', 'punct', 'number', 'ip', 'bytesize', 'money', 'percent', 'duration', 'version', 'email', 'quoted', 'open', 'close', 'path']) as kind,
           unnest([1, 10, 7, 4, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1]) as n from logs) x group by kind""")
find("b1_match_spans", r"\E", "select doc_id, cast(position(' mail u' in text) + 5 as int) as start, cast(position(' mail u' in text) + 5 + length(" + _MAIL + ") as int) as \"end\" from logs", columns=("doc_id", "start", "end"))
find("b2_registers", r'"user" "=" \N:who "from" \I:where', f"select doc_id, cast(user_id as varchar) as who, {_IP} as \"where\" from logs", ("who", "where"), columns=("doc_id",))
add("b3_positional", lambda s, d: reports.rewrite(logs(s, d), r'"user" "=" \N:u "from" \I:i', "${2}<${1}").select("doc_id", "text"), f"select doc_id, replace(text, concat('user=', user_id, ' from ', {_IP}), concat({_IP}, '<', user_id)) as text from logs")
find("b7_lines", r'"purchase"', "select user_id as doc_id, cast(n as int) as line from (select user_id, event_type, row_number() over (partition by user_id order by event_id) as n from logs) x where event_type = 'purchase'", rel="sessions", columns=("doc_id", "line"))
# atoms
find("c1_kind", r"\I", f"select doc_id, {_IP} as text from logs")
count("c2_any_token", ".", "select doc_id, cast(33 as bigint) as n from logs")
find("c3_literal_token", '"purchase"', "select doc_id, 'purchase' as text from logs where event_type = 'purchase'")
find("c4_literal_within_edits", '"error"~1', "select doc_id, 'error' as text from logs where event_type = 'error'")
find("c5_classes", r'"said" . "(" \d', "select doc_id, concat('said \"q', event_id % 50, '\" (', c) as text from logs")
find("c6_byte_shape", r"`p[a-z]+e`", "select doc_id, event_type as text from logs where regexp_full_match(event_type, 'p[a-z]+e')")
find("c7_class_of_tokens", r'[\W && `[a-z]{5}` -- "value" "error"]', "select doc_id, event_type as text from logs where length(event_type) = 5 and event_type <> 'error'")
find("c8_greater", r'"value" "=" \N{>50}:v', "select doc_id, cast(amount as varchar) as v from logs where amount > 50", ("v",), columns=("doc_id",))
find("c9_range_and_clauses", r'"value" "=" \N{10..20,!=15}:v', "select doc_id, cast(amount as varchar) as v from logs where amount between 10 and 20 and amount <> 15", ("v",), columns=("doc_id",))
find("c10_network", r"\I{in:10.16.0.0/12}", f"select doc_id, {_IP} as text from logs where a between 16 and 31")
find("c12_clock_fields", r"\T{hour>=22,minute<30}", f"select doc_id, {_MOMENT} as text from logs where extract(hour from ts) >= 22 and extract(minute from ts) < 30")
find("c12_instant_range", r"\T{2024-01-02..2024-01-03}", f"select doc_id, {_MOMENT} as text from logs where date_trunc('second', ts) between timestamp '2024-01-02 00:00:00' and timestamp '2024-01-03 00:00:00'")
find("c13_version_order", r"\V{>=1.5.0,<3.0.0,patch=2}", f"select doc_id, {_VERSION} as text from logs where (major > 1 or major = 1 and minor >= 5) and major < 3 and patch = 2")
find("c14_size", r"\Z{>4MB}", "select doc_id, concat(size, 'KB') as text from logs where size > 4000")
find("c14_duration", r"\R{>=0.5s}", "select doc_id, concat(ms, 'ms') as text from logs where ms >= 500")
find("c14_money", r"\${<20}", "select doc_id, concat('$', amount) as text from logs where amount < 20")
find("c14_percent", r"\%{>90}", "select doc_id, concat(pct, '%') as text from logs where pct > 90")
find("c16_url_fields", r"\U{scheme:https,host:*.example.net}", "select page_id as doc_id, url as text from pages where regexp_matches(url, '^https://[^/:?#]+[.]example[.]net([/:?#]|$)')", rel="addresses")
find("c17_mail_domain", r"\E{domain:error.*}", f"select doc_id, {_MAIL} as text from logs where event_type = 'error'")
find("c17_path_fields", r"\L{ext:log,name:f1?.log}", f"select doc_id, {_PATH} as text from logs where b between 10 and 19")
find("c19_lengths", r"\W{len>5}", "select doc_id, event_type as text from logs where length(event_type) > 5")
find("c21_set_file", r'^ . \W{in:@kinds}:k', "select doc_id, event_type as k from logs where event_type in ('purchase', 'error')", ("k",), columns=("doc_id",), others=lambda s, d: {"kinds": s.createDataFrame([(0, "purchase or error")], "doc_id long, text string")})
find("c28_same_token", r'"user" "=" \N:u .*? "(" =u', "select doc_id, cast(user_id as varchar) as u from logs where user_id = c", ("u",), columns=("doc_id",))
find("c27_since_register", r"\T:t ~([^\T]* \T{>+20m:t})", """select user_id as doc_id, cast(n as int) as line from (select user_id, row_number() over w as n, lead(date_trunc('second', ts)) over w - date_trunc('second', ts) as gap
    from logs window w as (partition by user_id order by event_id)) x where gap > interval 20 minutes""", rel="sessions", columns=("doc_id", "line"))
count("c29_same_domain", r"\E:m [^\E]* =domain m", """select doc_id, cast(sum(n // 2) as bigint) as n from (select user_id as doc_id, count(*) as n from (select user_id, event_type,
    row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, event_type order by event_id) as island from logs) x group by user_id, event_type, island) y group by doc_id having sum(n // 2) > 0""", rel="sessions")
find("c30_within_an_edit", r'"user" "=" \N:u .*? "," =edit1 u', "select doc_id, cast(user_id as varchar) as u from logs where levenshtein(cast(user_id as varchar), cast(b as varchar)) <= 1", ("u",), columns=("doc_id",))
# sequences and repetition
find("d1_run", r'"size" "=" \Z "cost"', "select doc_id, concat('size=', size, 'KB cost') as text from logs")
find("d2_first_choice", r'"error" | "purchase" | "view" "user"', "select doc_id, case when event_type = 'view' then 'view user' else event_type end as text from logs where event_type in ('error', 'purchase', 'view')")
find("d3_longest_choice", r'"view" || "view" "user" || "error"', "select doc_id, case when event_type = 'view' then 'view user' else event_type end as text from logs where event_type in ('error', 'view')")
find("d4_committed_choice", r'"view" |> "view" "user" |> "error"', "select doc_id, event_type as text from logs where event_type in ('view', 'error')")
find("d5_greedy", r'"user" .* \Q', "select doc_id, concat('user=', split_part(split_part(text, ' user=', 2), ' (', 1)) as text from logs")
find("d6_lazy", r'"user" .*? "="', "select doc_id, 'user=' as text from logs")
find("d8_counts", r'^ .{2,4}', "select doc_id, concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' ', event_type, ' user=') as text from logs")
find("d9_bound_run", r'"load" ("=" \%):p', "select doc_id, concat('=', pct, '%') as p from logs", ("p",), columns=("doc_id",))
find("d10_balanced", r"\B(\N{<3} . \N{>250})", f"select doc_id, {_BRACKET} as text from logs where c < 3 and b > 250")
count("d11_guard", r'^ ~"purchase.example" \T', "select doc_id, cast(1 as bigint) as n from logs where event_type = 'purchase'")
find("d12_ahead", r'\W ~("user")', "select doc_id, event_type as text from logs")
find("d12_not_ahead", r'"=" !~([\N \Z \% \R]) .', "select doc_id, concat('=$', amount) as text from logs")
find("d13_behind", r'~<("load" "=") \%', "select doc_id, concat(pct, '%') as text from logs")
find("d14_near", r'\T ~>4("error")', f"select doc_id, {_MOMENT} as text from logs where event_type = 'error'")
find("d15_region", r"~#{1}(\N{>200}) \B", f"select doc_id, {_BRACKET} as text from logs where b > 200")
find("d16_edit_group", r'("user" "=" "from" \I)~1', f"select doc_id, concat('user=', user_id, ' from ', {_IP}) as text from logs")
find("d17_case", r'(?orbit:case "ERROR")', "select doc_id, event_type as text from logs where event_type = 'error'")
count("d22_no_overlap", r"\W . ", "select doc_id, cast(9 as bigint) as n from logs")
# anchors
find("e1_line_start", r"^ \T .:k", "select user_id as doc_id, event_type as k from logs", ("k",), rel="sessions", columns=("doc_id",))
find("e1_line_end", r"\L $", f"select user_id as doc_id, {_PATH} as text from logs", rel="sessions")
find("e2_text_edges", r"\A . | \L \z", f"select doc_id, {_MOMENT} as text from logs union all select doc_id, {_PATH} as text from logs")
find("e3_contiguous", r"\G [\T \W]", f"select doc_id, {_MOMENT} as text from logs union all select doc_id, event_type from logs union all select doc_id, 'user' from logs")
find("e4_reset_start", r'"value" "=" \K \N', "select doc_id, cast(amount as varchar) as text from logs")
find("e8_nested", r"@nested>=1 \N", "select doc_id, cast(c as varchar) as text from logs union all select doc_id, cast(b as varchar) as text from logs")
find("e10_novel", r"@novel \W{len>5}", "select user_id as doc_id, event_type as text from logs where length(event_type) > 5 group by user_id, event_type", rel="sessions")
add("e10_echoed", lambda s, d: scan.matches(sessions(s, d), r"@echoed \W{len>5}").groupBy("doc_id", "text").agg(F.count("*").alias("n")), "select user_id as doc_id, event_type as text, count(*) as n from logs where length(event_type) > 5 group by user_id, event_type having count(*) > 1")
find("e11_last_occurrence", r"@echo:nth=-1 \W{len>5}", "select user_id as doc_id, event_type as text, cast(max(n) as int) as line from (select user_id, event_type, row_number() over (partition by user_id order by event_id) as n from logs) x where length(event_type) > 5 group by user_id, event_type", rel="sessions", columns=("doc_id", "text", "line"))
add("e12_time_order", lambda s, d: scan.matches(sessions(s, d), {"asc": r"@order:asc \T", "desc": r"@order:desc \T"}).groupBy("doc_id", "member").agg(F.count("*").alias("n")), """select user_id as doc_id, case when later then 'asc' else 'desc' end as member, count(*) as n from (
    select user_id, date_trunc('second', ts) >= lag(date_trunc('second', ts)) over (partition by user_id order by event_id) as later from logs) x where later is not null group by user_id, later""")
# joins of two inputs
_LATE = "extract(hour from ts) >= 20"
find("f1_echoed_elsewhere", r"@echoed:@late \E", f"select doc_id, {_MAIL} as text from logs where {_MAIL} in (select {_MAIL} from logs where {_LATE})", others=lambda s, d: {"late": logs(s, d).filter("hour(ts) >= 20").select("doc_id", "text")})
find("f2_novel_here", r"@novel:@late \E", f"select doc_id, {_MAIL} as text from logs where {_MAIL} not in (select {_MAIL} from logs where {_LATE})", others=lambda s, d: {"late": logs(s, d).filter("hour(ts) >= 20").select("doc_id", "text")})
add("f7_match_in_line", lambda s, d: L.touched(sessions(s, d), r'"error"').select("doc_id", "rec"), "select user_id as doc_id, cast(n as int) as rec from (select user_id, event_type, row_number() over (partition by user_id order by event_id) as n from logs) x where event_type = 'error'")
# aggregates
add("g1_by_domain", lambda s, d: reports.count_by(scan.matches(logs(s, d), r"\E:m"), "${m.domain}").select("key", F.col("count").alias("n")), "select concat(event_type, '.example.org') as key, count(*) as n from logs group by 1")
add("g6_sums", lambda s, d: reports.count_by(scan.matches(logs(s, d), r'^ . \W:k .* "value" "=" \N:v'), "${k}", ("v",)).select("key", "count", *[F.round(F.col(c).cast("double"), 2).alias(n) for c, n in (("sum_v", "total"), ("min_v", "least"), ("max_v", "most"))]), "select event_type as key, count(*) as count, round(cast(sum(amount) as double), 2) as total, round(cast(min(amount) as double), 2) as least, round(cast(max(amount) as double), 2) as most from logs group by event_type")
add("g8_extremes", lambda s, d: reports.extremes(scan.matches(logs(s, d), r"^ \T:t \W:k .* \V:v"), "${k}", ("t", "v")), f"""select event_type as key, min({_MOMENT}) as min_t, max({_MOMENT}) as max_t, arg_min({_VERSION}, major * 10000 + minor * 100 + patch) as min_v, arg_max({_VERSION}, major * 10000 + minor * 100 + patch) as max_v from logs group by event_type""")
add("g11_percentile_lower", lambda s, d: reports.percentiles(scan.matches(logs(s, d), r'^ . \W:k .* "value" "=" \N:v'), "${k}", "v", (0.5, 0.9), "lower").select("key", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("p50", "p90")]), """with r as (select event_type, amount, row_number() over (partition by event_type order by amount) as k, count(*) over (partition by event_type) as n from logs)
    select event_type as key, round(cast(max(case when k = floor(0.5 * (n - 1)) + 1 then amount end) as double), 6) as p50, round(cast(max(case when k = floor(0.9 * (n - 1)) + 1 then amount end) as double), 6) as p90 from r group by event_type""")
for _how, _fn in (("nearest", "quantile_disc"), ("linear", "quantile_cont")):
    add(f"g9_percentile_{_how}", lambda s, d, how=_how: reports.percentiles(scan.matches(logs(s, d), r'^ . \W:k .* "value" "=" \N:v'), "${k}", "v", (0.5, 0.9), how).select("key", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("p50", "p90")]), f"select event_type as key, round(cast({_fn}(cast(amount as double), 0.5) as double), 6) as p50, round(cast({_fn}(cast(amount as double), 0.9) as double), 6) as p90 from logs group by event_type")
add("g16_line_and_match_counts", lambda s, d: L.counts(sessions(s, d), r'"error" | "view"'), "select user_id as doc_id, count(*) as lines, count(*) as matches from logs where event_type in ('error', 'view') group by user_id")
add("g17_inputs_with_and_without", lambda s, d: L.with_match(sessions(s, d), r'"purchase"'), "select user_id as doc_id, bool_or(event_type = 'purchase') as found from logs group by user_id")
# lines
add("d27_inverted", lambda s, d: L.untouched(sessions(s, d), r'"error" | "view" | "click"').groupBy("doc_id").agg(F.count("*").alias("n")), "select user_id as doc_id, count(*) as n from logs where event_type not in ('error', 'view', 'click') group by user_id")
add("d28_whole_lines", lambda s, d: L.whole(sessions(s, d), r'\T "error" .*? \L').select("doc_id", "rec"), "select user_id as doc_id, cast(n as int) as rec from (select user_id, event_type, row_number() over (partition by user_id order by event_id) as n from logs) x where event_type = 'error'")
add("d29_context", lambda s, d: L.context(sessions(s, d), r'"error"', 1, 1).select("doc_id", "rec"), """with n as (select user_id, event_type, row_number() over (partition by user_id order by event_id) as n from (select user_id, event_type, event_id from events where value is not null) e)
    select distinct b.user_id as doc_id, cast(b.n as int) as rec from n a join n b on a.user_id = b.user_id and b.n between a.n - 1 and a.n + 1 where a.event_type = 'error'""")
add("d25_split", lambda s, d: L.split(logs(s, d), r'"="').select("doc_id", "part", "text").filter("part = 1"), "select doc_id, 1 as part, split_part(text, '=', 2) as text from logs")
find("i6_most_per_input", r"\E", f"select user_id as doc_id, {_MAIL} as text from (select *, row_number() over (partition by user_id order by event_id) as n from logs) x where n <= 2", rel="sessions", limit=2)
add("i1_head_lines", lambda s, d: L.window(sessions(s, d), 1, 3).select("doc_id", "rec"), "select user_id as doc_id, cast(n as int) as rec from (select user_id, row_number() over (partition by user_id order by event_id) as n from logs) x where n <= 3")
add("i2_tail_lines", lambda s, d: L.window(sessions(s, d), -2, -1).select("doc_id", "rec"), "select user_id as doc_id, cast(n as int) as rec from (select user_id, row_number() over (partition by user_id order by event_id) as n, count(*) over (partition by user_id) as m from logs) x where n > m - 2")
# sets and records
add("j1_union", lambda s, d: scan.matches(logs(s, d), {"mail": r"\E", "cost": r"\$"}).select("doc_id", "member", "text"), f"select doc_id, 'mail' as member, {_MAIL} as text from logs union all select doc_id, 'cost', concat('$', amount) from logs")
add("j4_record_quantifiers", lambda s, d: scan.record_query(scan.lines(sessions(s, d)), {"a": r'"error"', "b": r"\%{>50}"}, "all").select("doc_id", F.col("rec").cast("int").alias("rec")), "select user_id as doc_id, cast(n as int) as rec from (select user_id, event_type, pct, row_number() over (partition by user_id order by event_id) as n from logs) x where event_type = 'error' and pct > 50")
add("j6_shared_tokens", lambda s, d: scan.common_tokens(logs(s, d).filter("hour(ts) < 2"), logs(s, d).filter("hour(ts) >= 22")).filter("kind = 'email'").select("text"), f"select {_MAIL} as text from logs where extract(hour from ts) < 2 intersect select {_MAIL} from logs where extract(hour from ts) >= 22")
# rewriting
add("m1_rewritten", lambda s, d: reports.rewrite(logs(s, d), r'"load" "=" \%:p', "${p} of load").select("doc_id", "text"), "select doc_id, replace(text, concat('load=', pct, '%'), concat(pct, '% of load')) as text from logs")
add("m2_first_only", lambda s, d: reports.rewrite(logs(s, d), '"="', ":", most=1).select("doc_id", "text"), "select doc_id, replace(text, concat('user=', user_id, ' '), concat('user:', user_id, ' ')) as text from logs")
add("m4_masked", lambda s, d: reports.redact(logs(s, d), r"\I").select("doc_id", "text"), f"select doc_id, replace(text, concat('from ', {_IP}, ' '), concat('from ', regexp_replace({_IP}, '[0-9]', '*', 'g'), ' ')) as text from logs")
add("m5_token_mask", lambda s, d: reports.redact(logs(s, d), r"\Q", "token").select("doc_id", "text"), "select doc_id, replace(text, concat('\"q', event_id % 50, '\"'), '*') as text from logs")
add("m6_shape_mask", lambda s, d: reports.redact(logs(s, d), r"\Q", "shape").select("doc_id", "text"), "select doc_id, replace(text, concat('\"q', event_id % 50, '\"'), regexp_replace(concat('\"a', event_id % 50, '\"'), '[0-9]', '0', 'g')) as text from logs")
add("m7_pseudonyms", lambda s, d: reports.pseudonyms(scan.matches(logs(s, d), r"\E:e")).select("text", "name"), f"select text, concat('EMAIL_', row_number() over (order by first, text)) as name from (select {_MAIL} as text, min(event_id) as first from logs group by 1) x")
add("m8_kept_tail", lambda s, d: reports.redact(logs(s, d), r"\L", keep=3).select("doc_id", "text"), f"select doc_id, replace(text, {_PATH}, concat(regexp_replace(concat('/srv/', event_type, '/f', b), '[a-z0-9]', '*', 'g'), '.log')) as text from logs")

# readings at every token
_TOKS = f"""toks as (select doc_id, unnest(range(0, 33)) as tok,
    unnest([{_MOMENT}, event_type, 'user', '=', cast(user_id as varchar), 'from', {_IP}, 'value', '=', cast(amount as varchar), 'size', '=', concat(size, 'KB'), 'cost', '=', concat('$', amount), 'load', '=', concat(pct, '%'),
            'took', '=', concat(ms, 'ms'), {_VERSION}, 'mail', {_MAIL}, 'said', concat('"q', event_id % 50, '"'), '(', cast(c as varchar), ',', cast(b as varchar), ')', {_PATH}]) as text,
    unnest(['timestamp', 'word', 'word', 'punct', 'number', 'word', 'ip', 'word', 'punct', 'number', 'word', 'punct', 'bytesize', 'word', 'punct', 'money', 'word', 'punct', 'percent',
            'word', 'punct', 'duration', 'version', 'word', 'email', 'word', 'quoted', 'open', 'number', 'punct', 'number', 'close', 'path']) as kind from logs)"""
_M = "m as (select *, case when kind = 'number' and try_cast(text as double) <> 0 then log10(abs(try_cast(text as double))) else log2(cast(strlen(text) as double)) end as m from toks)"


def reading(name: str, run: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A reading of the log lines' tokens; the oracle's tokens are made from the columns."""
    add(name, lambda s, d: run(logs(s, d)), f"with {_TOKS}, {_M}{sql if sql.startswith(',') else ' ' + sql}")


reading("a10_tokens", lambda t: scan.tokens(t).select("doc_id", "tok", "kind", "text"), "select doc_id, cast(tok as int) as tok, kind, text from toks")
reading("p1_magnitude", lambda t: axes.read(t, "energy", "outlier", "gradient").groupBy("doc_id").agg(F.round(F.max("energy"), 6).alias("energy"), F.count_if("outlier").alias("outliers"), F.round(F.max("gradient"), 6).alias("steepest")), """, r as (select doc_id,
    m - coalesce(lag(m) over w, m) as g, sum(m * m) over (partition by doc_id order by tok rows between 15 preceding and current row) as e, abs(m - avg(m) over d) >= 2.5 * stddev_pop(m) over d as o from m window w as (partition by doc_id order by tok), d as (partition by doc_id))
    select doc_id, round(max(e), 6) as energy, count(*) filter (o) as outliers, round(max(g), 6) as steepest from r group by doc_id""")
reading("p2_stress", lambda t: axes.read(t, "height", "peak").groupBy("doc_id").agg(F.max("height").alias("deepest"), F.count_if("peak").alias("peaks")), """, h as (select doc_id, tok, sum(case kind when 'open' then 1 when 'close' then -1 else 0 end) over (partition by doc_id order by tok) as h from toks),
    r as (select doc_id, h, h > coalesce(lag(h) over w, 0) and h >= coalesce(lead(h) over w, 0) as peak from h window w as (partition by doc_id order by tok))
    select doc_id, cast(max(h) as bigint) as deepest, count(*) filter (peak) as peaks from r group by doc_id""")
reading("p3_flow", lambda t: axes.read(t, "momentum", "slope").groupBy("doc_id").agg(F.max("momentum").alias("momentum"), F.round(F.max("slope"), 6).alias("steepest")), """, s as (select doc_id, tok, (m - coalesce(lag(m, 4) over w, first_value(m) over w)) / greatest(1, least(tok, 4)) as slope from m window w as (partition by doc_id order by tok)),
    d as (select *, case when slope > 0.05 then 1 when slope < -0.05 then -1 else 0 end as dir from s),
    e as (select *, case when dir <> coalesce(lag(dir) over (partition by doc_id order by tok), 9) then 1 else 0 end as turn from d),
    f as (select *, sum(turn) over (partition by doc_id order by tok) as run from e),
    g as (select *, row_number() over (partition by doc_id, run order by tok) as momentum from f)
    select doc_id, cast(max(momentum) as int) as momentum, round(max(slope), 6) as steepest from g group by doc_id""")
reading("h7_reversals", lambda t: axes.read(t, "reversal").groupBy("doc_id").agg(F.count_if("reversal").alias("n")), """, s as (select doc_id, tok, (m - coalesce(lag(m, 4) over w, first_value(m) over w)) / greatest(1, least(tok, 4)) as slope from m window w as (partition by doc_id order by tok)),
    d as (select *, case when slope > 0.05 then 1 when slope < -0.05 then -1 else 0 end as dir from s),
    e as (select *, last_value(case when dir <> 0 then dir end ignore nulls) over (partition by doc_id order by tok rows between unbounded preceding and 1 preceding) as before from d)
    select doc_id, count(*) filter (dir <> 0 and before is not null and dir <> before) as n from e group by doc_id""")
reading("h2_lags", lambda t: axes.read(t, "text", "back_lag", "fwd_lag").filter("text = '='").groupBy("doc_id").agg(F.max("back_lag").cast("long").alias("widest"), F.min("fwd_lag").cast("long").alias("narrowest")), """, q as (select doc_id, unnest([length(concat({0}, ' ', event_type, ' user')), position(' value=' in text) + 5, position(' size=' in text) + 4, position(' cost=' in text) + 4, position(' load=' in text) + 4, position(' took=' in text) + 4]) as x, unnest(range(0, 6)) as k from logs),
    r as (select doc_id, x - lag(x) over (partition by doc_id order by k) as gap from q) select doc_id, cast(max(gap) as bigint) as widest, cast(min(gap) as bigint) as narrowest from r group by doc_id""".replace("{0}", _MOMENT))
reading("h11_keyed_history", lambda t: axes.history(t, '=').filter("key = 'value'").select("doc_id", F.round("mean", 6).alias("mean"), "n"), "select doc_id, cast(null as double) as mean, cast(0 as bigint) as n from toks where text = 'value'")
reading("p4_echo", lambda t: axes.read(t, "novel", "count", "nth_back").groupBy("doc_id").agg(F.count_if("novel").alias("novel"), F.max("count").alias("most"), F.max("nth_back").cast("long").alias("deepest")), """, r as (select doc_id, count(*) over (partition by doc_id, text) as n, row_number() over (partition by doc_id, text order by tok) as nth from toks)
    select doc_id, count(*) filter (nth = 1) as novel, max(n) as most, max(nth) as deepest from r group by doc_id""")
reading("p13_gravity", lambda t: axes.gravity_of(t).withColumn("lift", F.round("lift", 6)), """, n as (select b.tok - a.tok as d, a.kind as a, b.kind as b, count(*) as n from toks a join toks b on a.doc_id = b.doc_id and b.tok > a.tok and b.tok - a.tok <= 32 group by 1, 2, 3)
    select cast(d as int) as d, a, b, n, round((n + 1) / (cast(sum(n) over (partition by d, a) as double) * cast(sum(n) over (partition by d, b) as double) / sum(n) over (partition by d) + 1), 6) as lift from n""")
add("b5_typed_values", lambda s, d: scan.tokens(logs(s, d)).filter("kind in ('bytesize', 'duration', 'money', 'percent')").select("doc_id", "kind", F.round(reports.exact(F.col("kind"), F.col("text")).cast("double"), 4).alias("value")), """select doc_id, unnest(['bytesize', 'duration', 'money', 'percent']) as kind,
    unnest([cast(size as double) * 1000, cast(ms as double) * 1000000, cast(amount as double), cast(pct as double)]) as value from logs""")
add("f8_bracket_mates", lambda s, d: scan.bracket_mates(logs(s, d)), "select doc_id, cast(27 as int) as opened, cast(31 as int) as closed from logs")
add("k1_log_templates", lambda s, d: reports.templates(sessions(s, d)).select("count", "template"), "select count(*) as count, '<timestamp> <word> user = <number> from <ip> value = <number> size = <bytesize> cost = <money> load = <percent> took = <duration> <version> mail <email> said <quoted> ( <number> , <number> ) <path>' as template from logs")
add("o6_findings", lambda s, d: reports.findings(logs(s, d), [{"name": "slow", "pattern": r"\R{>=800ms}", "message": "slow", "unless": r'"error"'}, {"name": "full", "pattern": r"\%{>=99}", "message": "full", "severity": "error"}]).select("doc_id", "rule", "severity", "text"), """select doc_id, 'slow' as rule, 'warning' as severity, concat(ms, 'ms') as text from logs where ms >= 800 and event_type <> 'error'
    union all select doc_id, 'full', 'error', concat(pct, '%') from logs where pct >= 99""")
add("n1_paragraphs", lambda s, d: scan.paragraphs(spaced(s, d)).groupBy("doc_id").agg(F.count("*").alias("n")), "select user_id as doc_id, count(*) as n from logs group by user_id")


def spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sessions`` with an empty line between lines."""
    return sessions(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n \n")))


# units, records, sinks
_UNIT = f"""select doc_id, 'assign' as role, 0 as depth, concat(substr(text, 1, position(' (' in text) - 1)) as text from logs
    union all select doc_id, 'numeric', 1, concat(c, ', ', b) from logs union all select doc_id, 'plain', 0, {_PATH} from logs"""
add("a12_units", lambda s, d: records.units(logs(s, d)).select("doc_id", "role", "depth", "text"), _UNIT)
add("n2_blocks", lambda s, d: records.blocks(logs(s, d)).select("doc_id", "rec", "text"), f"select doc_id, 1 as rec, {_BRACKET} as text from logs")
add("n3_units_of_a_role", lambda s, d: records.units(sessions(s, d), "numeric").select("doc_id", "text"), "select user_id as doc_id, concat(c, ', ', b) as text from logs")
add("n7_started_records", lambda s, d: records.started(sessions(s, d), r"^ \T").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("rec").cast("long").alias("last")), "select user_id as doc_id, count(*) as n, count(*) as last from logs group by user_id")
add("n8_span_records", lambda s, d: records.spans(logs(s, d), r'"value" "=" \N').select("doc_id", "text"), "select doc_id, concat('value=', amount) as text from logs")
count("e15_in_numeric_unit", r"@super:numeric \N", "select doc_id, cast(2 as bigint) as n from logs")
find("d20_assignment", "@assignment", "select doc_id, unnest(['user=', 'value=', 'size=', 'cost=', 'load=', 'took=']) as text from logs")
find("d21_silhouette", '#"(N,N)"', f"select doc_id, {_BRACKET} as text from logs")
add("o3_let", lambda s, d: scan.matches(logs(s, d), r'"load" \{share}', lets={"share": r'"=" \{much}', "much": r"\%{>50}"}).select("doc_id", "text"), "select doc_id, concat('load=', pct, '%') as text from logs where pct > 50")
add("o7_rule_fixes", lambda s, d: reports.fixed(logs(s, d), [{"name": "ip", "pattern": r"\I:a", "fix": "0.0.0.0"}, {"name": "mail", "pattern": r"\E", "fix": "someone"}]), f"select doc_id, replace(replace(text, concat(' from ', {_IP}, ' '), ' from 0.0.0.0 '), {_MAIL}, 'someone') as text from logs")
add("a13_json", lambda s, d: reports.as_json(scan.matches(logs(s, d), r"\%{>90}").select("doc_id", "text")), """select concat('{"doc_id":', doc_id, ',"text":"', pct, '%"}') as value from logs where pct > 90""")
add("m3_closure", lambda s, d: reports.rewrite_with(logs(s, d), r"\V", lambda m: m.text.upper()).select("doc_id", "text"), f"select doc_id, replace(text, {_VERSION}, upper({_VERSION})) as text from logs")
add("m9_differences", lambda s, d: reports.diffs(logs(s, d), reports.rewrite(logs(s, d), '"purchase"', "sale").select("doc_id", "text")).select("doc_id", F.length("diff").cast("long").alias("n")), "select doc_id, cast(2 * length(text) + 32 as bigint) as n from logs where event_type = 'purchase'")
# summaries that leave inputs out
add("f10_candidates_lose_no_match", lambda s, d: scan.matches(index.pruned(logs(s, d), index.build(logs(s, d)), r'"purchase" .* \V{major=3}:v'), r'"purchase" .* \V{major=3}:v').select("doc_id"), "select doc_id from logs where event_type = 'purchase' and major = 3")
add("a18_candidates", lambda s, d: index.candidates(index.build(logs(s, d)), '"purchase"').join(logs(s, d).filter("event_type = 'purchase'").select("doc_id"), "doc_id", "left_semi"), "select doc_id from logs where event_type = 'purchase'")
add("a19_stale_inputs", lambda s, d: index.stale(logs(s, d), index.build(logs(s, d).filter("event_id % 3 != 0"))).select("doc_id"), "select doc_id from logs where event_id % 3 = 0")
# templates
add("k3_rare_templates", lambda s, d: reports.rare(reports.templates(logs(s, d).withColumn("text", F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("note "), F.col("event_id"))).otherwise(F.col("text"))))).select("count", "template"), "select count(*) as count, 'note <number>' as template from logs where event_id % 97 = 0")
add("k4_novel_templates", lambda s, d: reports.admitted(reports.templates(logs(s, d).withColumn("text", F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("note "), F.col("event_id"))).otherwise(F.col("text")))), reports.templates(logs(s, d)), True).select("count", "template"), "select count(*) as count, 'note <number>' as template from logs where event_id % 97 = 0")
add("j5_shared_templates", lambda s, d: reports.admitted(reports.templates(logs(s, d).filter("event_id % 2 = 0")), reports.templates(logs(s, d))).select("count"), "select count(*) as count from logs where event_id % 2 = 0")
# declarations
DECLARED = r"""# of log lines
shape place = `/srv/[a-z]+/f\d+[.]log`
kind pair = \W "=" \N
let spent = "took" "=" \R{>=800ms}:t
let entry = ^ \T:at \W:event
fields entry {at} {event}
rule slow error "slow" = \R{>=800ms}
unless slow = "error"
fix slow = 0ms
test pair accepts "a=1" rejects "a=b"
"""


def declared():
    from .declare import Declarations

    return Declarations.read(DECLARED)


add("o1_shapes", lambda s, d: scan.matches(logs(s, d), r"\{place}", **declared().options).select("doc_id", "text"), f"select doc_id, {_PATH} as text from logs")
add("o2_kinds", lambda s, d: scan.counts(logs(s, d), r"\{pair}", **declared().options), "select doc_id, cast(2 as bigint) as n from logs")
add("o5_fields", lambda s, d: declared().extract(logs(s, d), "entry").select("doc_id", "at", "event"), f"select doc_id, {_MOMENT} as \"at\", event_type as event from logs")
add("o6_declared_rules", lambda s, d: declared().findings(logs(s, d)).select("doc_id", "rule", "severity", "text"), "select doc_id, 'slow' as rule, 'error' as severity, concat(ms, 'ms') as text from logs where ms >= 800 and event_type <> 'error'")
# scalars
def _scalar(fn, kind):
    """A function of texts as a column function, in Arrow batches."""
    return F.pandas_udf(lambda x: x.map(fn), kind)


add("l3_octets", lambda s, d: scan.matches(logs(s, d), r"\I").select("doc_id", _scalar(lambda x: scalars.octets(x, 2, 3), StringType())("text").alias("part")), "select doc_id, concat(a, '.', b) as part from logs")
add("l14_plain_urls", lambda s, d: addresses(s, d).select("doc_id", _scalar(lambda x: scalars.plain_url(x[4:-9]), StringType())("text").alias("url")).filter("url not like '%\\%%'"), "select page_id as doc_id, regexp_replace(url, '^(https?://[^/?#]+)($|[?#])', '\\1/\\2') as url from pages where url not like '%!%%' escape '!' and url is not null")
add("l21_checks", lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", _scalar(lambda x: scalars.gs1(x), BooleanType())(F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("ok")), """with d as (select o_orderkey, lpad(cast(o_orderkey as varchar), 8, '0') as t from orders)
    select o_orderkey, (3 * (cast(t[1] as int) + cast(t[3] as int) + cast(t[5] as int) + cast(t[7] as int)) + cast(t[2] as int) + cast(t[4] as int) + cast(t[6] as int) + cast(t[8] as int)) % 10 = 0 as ok from d""")
add("l22_bits_per_byte", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.round(_scalar(lambda x: scalars.bits_per_byte(x.encode()), DoubleType())("p_name"), 6).alias("bits")), """with c as (select p_partkey, unnest(string_split(p_name, '')) as c from part), n as (select p_partkey, c, count(*) as n from c where c <> '' group by p_partkey, c),
    t as (select *, sum(n) over (partition by p_partkey) as t from n) select p_partkey, round(-sum(n / t * log2(n / t)), 6) as bits from t group by p_partkey""")
add("l23_base64", lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", _scalar(lambda x: (scalars.decoded(x) or b"").decode(), StringType())(F.base64(F.col("c_name").cast("binary"))).alias("name")), "select c_custkey, cast(from_base64(to_base64(encode(c_name))) as varchar) as name from customer")
add("l29_identifiers", lambda s, d: scan.matches(s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), F.concat(F.col("c_mktsegment"), F.lit(" c_custkey userName "), F.initcap("c_mktsegment")).alias("text")), r"\W").select("doc_id", "m", _scalar(scalars.identifier, StringType())("text").alias("form")), "select c_custkey as doc_id, unnest([0, 1, 2, 3]) as m, unnest(['SCREAM', 'snake', 'camel', 'Pascal']) as form from customer")
add("l9_quantities", lambda s, d: scan.matches(s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("weighs "), F.col("p_size"), F.lit("kg or "), F.col("p_size") * 1000, F.lit("g")).alias("text")), r"\{qty}{>20kg}").select("doc_id", "text"), "select p_partkey as doc_id, unnest([concat(p_size, 'kg'), concat(p_size * 1000, 'g')]) as text from part where p_size > 20")
# sub-words
add("s4_bpe_round_trip", lambda s, d: bpe.encode(logs(s, d), bpe.train(logs(s, d).select("text"), 40)).select("doc_id", F.replace(F.array_join("symbols", ""), F.lit(bpe.END), F.lit(" ")).alias("text")), "select doc_id, concat(text, ' ') as text from logs")
