"""What a query may not do twice, exchange or hold; each with its results."""

from pyspark.sql import functions as F

from tokenloom.functions import values
from tokenloom.functions.lexer import lex
from tokenloom.operators import axes, lines, reports, scan
from tokenloom.plans import pattern
from tokenloom.plans.pattern import Pattern, Program


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_templates_move_a_line_once(spark):
    long = " ".join(f"w{k}" for k in range(3000))
    d = docs(spark, long, long.replace("w7 ", "x7 "), 'a "b\\\nc" d\ne\x1f"f\x1fg" 5', 'e "f\x1fh" 6', None, "1 2\n1 3\n1 2")
    got = reports.templates(d)
    # no row for each cell that carries its line's kinds
    assert "Generate" not in plan(got) and "arrays_zip" not in plan(got)
    said = {r.template: (r["count"], r.shape.split(" ")[0], len(r.cells)) for r in got.collect()}
    assert said == {long.replace("w7 ", "<word> "): (2, "word", 3000), 'a "b\\\nc"': (1, "word", 2), "d": (1, "word", 1), "e <quoted> <number>": (2, "word", 3), "1 <number>": (3, "number", 2)}


def nodes(df, name: str) -> int:
    return plan(df).split("== Initial Plan ==")[0].count(name)


LATE = "see a@x.org\nand b@y.org"


def test_one_token_joins_read_each_text_once(spark):
    d, late = docs(spark, "a@x.org c@z.org", "b@y.org", None, ""), docs(spark, LATE, None)
    for p, want in ((r"@novel:@late \E", [(0, 0, "c@z.org")]),):
        got = scan.matches(d, p, others={"late": late})
        assert nodes(got, "MapInArrow") == 2  # this input and the other, no second reading of this one
        assert sorted((r.doc_id, r.m, r.text) for r in got.collect()) == want


def test_echoed_tokens_are_asked_for_once(spark):
    d, late = docs(spark, "a@x.org c@z.org", "b@y.org", None, ""), docs(spark, LATE, None)
    got = scan.matches(d, r"@echoed:@late \E:e", others={"late": late})
    assert nodes(got, "MapInArrow") == 2
    assert sorted((r.doc_id, r.m, r.text, r.registers["e"]) for r in got.collect()) == [(0, 0, "a@x.org", "a@x.org"), (1, 0, "b@y.org", "b@y.org")]
    # what hangs on more than the token itself is still decided in the search
    assert Pattern(r"@echoed:@late \E").apart == {"late": True} and Pattern(r"\W @echoed:@late \E").apart is None and Pattern(r"!~(@echoed:@late \E) .").apart is None


def test_unless_is_settled_in_the_same_pass(spark):
    d = docs(spark, "5ms ok\n9ms error", "9ms error", None)
    got = reports.findings(d, [{"name": "slow", "pattern": r"\R", "message": "m", "unless": '"error"'}, {"name": "all", "pattern": r"\R{>=9ms}", "message": "m"}])
    assert nodes(got, "MapInArrow") == 1
    assert sorted((r.doc_id, r.rule, r.text) for r in got.collect()) == [(0, "all", "9ms"), (0, "slow", "5ms"), (1, "all", "9ms")]


def runs(monkeypatch, pattern: str, text: str, **options) -> tuple[int, list[str]]:
    """How many starts a search tries, and what it finds."""
    n, run = [0], Program.run

    def counted(self, *a):
        n[0] += 1
        return run(self, *a)

    p = Pattern(pattern, **options)
    with monkeypatch.context() as m:
        m.setattr(Program, "run", counted)
        found = p.find(text)
    return n[0], [m.text for m in found]


TWO = "at 2024-01-01 10:00:00 a b c\nat 2024-01-01 09:00:00 purchase d e\nat 2024-01-01 09:30:00 f purchase"


def test_time_order_is_asked_of_instants_only(monkeypatch):
    assert runs(monkeypatch, r"@order:asc \T", TWO) == (3, ["2024-01-01 09:30:00"])
    assert runs(monkeypatch, r"@order:desc \T", TWO) == (3, ["2024-01-01 09:00:00"])
    assert values.instant("2024-02-30 00:00:00") is None and values.instant("2024-01-01 10:00:61") is None and values.instant("2024-01-01T00:00:01") == 1704067201


def test_line_counts_search_a_text_once(monkeypatch):
    n, find = [0], Pattern.find

    def counted(self, *a):
        n[0] += 1
        return find(self, *a)

    monkeypatch.setattr(lines, "_per_text", lambda docs, pattern, doc_id, text, schema, make: make)
    monkeypatch.setattr(Pattern, "find", counted)
    assert lines.counts(None, "x")(Pattern('"a" | "b"'), "a b\nc\na\n") == [(2, 3)] and n[0] == 1


READ = ("(a 12 = b) x = ((300 = a b 5 x = 7", "one", None, "", "1 1 1 1 1 1", "= = = a = [ ] }", " ".join(f"w{k * k % 17} = {k * 37 % 101}" for k in range(60)))


def alike(spark, read, t, names):
    """Readings made where texts are lexed against window functions over the token table."""
    assert "Window" not in plan(read) and "Exchange" not in plan(read)
    said = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select("doc_id", *names).fillna({n: -1 for n in names if n.endswith("lag")}).collect())
    assert said(read) == said(t)


def test_echo_needs_no_exchange(spark):
    d, names = docs(spark, *READ), ["tok", "kind", "text", "count", "nth", "nth_back", "novel"]
    alike(spark, axes.read(d, *names), axes.echo(scan.tokens(d)), names)


def test_matches_are_counted_where_they_are_found(spark):
    p = r"\E:m [^\E]* =domain m"
    assert any(x[0] == "many" for x in Pattern(p).program.code)  # a run of one test is one step
    d = docs(spark, "a@x.org b c@x.org d@y.org e@x.org f@y.org g@y.org", "a@x.org", None)
    assert [tuple(r) for r in scan.counts(d, p).collect()] == [(0, 2)]


def test_stress_needs_no_exchange(spark):
    d, names = docs(spark, *READ), ["tok", "height", "peak"]
    alike(spark, axes.read(d, *names), axes.stress(scan.tokens(d)), names)


def test_magnitude_needs_no_exchange(spark):
    d, names = docs(spark, *READ), ["tok", "m", "gradient", "energy", "outlier"]
    alike(spark, axes.read(d, *names), axes.magnitude(scan.tokens(d)), names)
    read = axes.history(d).withColumn("mean", F.round("mean", 9)).withColumn("m", F.round("m", 9))
    assert "Window" not in plan(read) and sorted(map(repr, read.collect())) == sorted(map(repr, axes.keyed_history(scan.tokens(d)).withColumn("mean", F.round("mean", 9)).withColumn("m", F.round("m", 9)).select(*read.columns).collect()))


def test_other_inputs_are_asked_for_one_kind(spark):
    p = r"^ . \W{in:@kinds}:k"
    assert Pattern(p).asked == {"kinds": {"word"}} and Pattern(r"@echoed:@kinds \E").asked == {"kinds": {"email"}} and Pattern(r"@echoed:@kinds{0,1} \E").asked == {"kinds": None}
    got = scan.matches(docs(spark, "1 a b\n2 c\n3 b", "4 d", None), p, others={"kinds": docs(spark, "b c or")})
    assert sorted((r.doc_id, r.registers["k"]) for r in got.collect()) == [(0, "b"), (0, "c")]


def test_flow_needs_no_exchange(spark):
    d, names = docs(spark, *READ), ["tok", "slope", "direction", "reversal", "momentum"]
    alike(spark, axes.read(d, *names), axes.flow(axes.magnitude(scan.tokens(d)), "m"), names)


def test_declared_kinds_are_counted_in_one_pass(spark, monkeypatch):
    n, o = [0], {"kinds": {"pair": r'\W "=" \N'}, "shapes": {"place": "/[a-z]+"}}
    monkeypatch.setattr(pattern, "lex", lambda *a, **k: n.__setitem__(0, n[0] + 1) or lex(*a, **k))
    p = Pattern(r"\{pair}", **o)
    n[0] = 0
    assert p.count("a=1 b=c d=2 /x") == 2 and n[0] == 1
    assert [tuple(r) for r in scan.counts(docs(spark, "a=1 b=c d=2", "x", None), r"\{pair}", **o).collect()] == [(0, 2)]


def test_edit_groups_begin_near_a_token_that_fits(monkeypatch):
    said = "a b c d e f user = g from 10.0.0.1 h i j k"
    assert runs(monkeypatch, r'("user" "=" "from" \I)~1', said) == (3, ["user = g from 10.0.0.1"])
    assert runs(monkeypatch, r'("x" "y")~1', "a b c y d")[1] == ["c y"]


def test_fields_are_sought_at_their_first_kind(monkeypatch):
    assert runs(monkeypatch, r"^ \T:at \W:event", "2024-01-01 10:00:00 view a b c 5")[0] == 1
    assert runs(monkeypatch, r"^ . \W", "a b c\nd e f") == (2, ["a b", "d e"])


def test_gravity_counts_pairs_where_they_are_lexed(spark):
    d = docs(spark, *READ)
    got = axes.gravity_of(d)
    assert "Generate" not in plan(got)
    said = lambda df: sorted((r.d, r.a, r.b, r.n, round(r.lift, 9)) for r in df.collect())
    assert said(got) == said(axes.gravity(scan.tokens(d)))


def test_bracket_pairs_without_a_token_table(spark):
    d = docs(spark, "f(a[1], {b}) )(", "x", None, "(" * 3 + ")" * 2)
    said = lambda df: sorted(map(tuple, df.collect()))
    assert said(scan.bracket_mates(d)) == said(scan.mates(scan.tokens(d)))


def test_echoed_is_asked_of_words_only(monkeypatch):
    assert runs(monkeypatch, r"@echoed \W{len>5}", "1 2 purchase 3 4 = purchase ( ) error1") == (3, ["purchase", "purchase"])


def test_any_token_is_counted_without_a_row_each(spark):
    d = docs(spark, "a b 3", None, "", "x")
    assert sorted(map(tuple, scan.counts(d, ".").collect())) == [(0, 3), (3, 1)]


def test_lags_need_no_exchange(spark):
    d, names = docs(spark, *READ), ["tok", "back_lag", "fwd_lag"]
    alike(spark, axes.read(d, *names), axes.echo(scan.tokens(d)), names)


def test_last_occurrences_are_sought_at_words(monkeypatch):
    assert runs(monkeypatch, r"@echo:nth=-1 \W{len>5}", "1 purchase 2 = purchase 3") == (2, ["purchase"])
