import pytest

from tokenloom.operators import axes, bpe, index, lines, records, reports, scan
from tokenloom.plans.declare import Declarations
from tokenloom.plans.pattern import Pattern, PatternError
from tokenloom.sources import files

LOG = "10.0.0.1 GET /a 200 5\n10.0.0.2 GET /b 404 7\n10.0.0.1 POST /a 200 9"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_count_by_with_sums(spark):
    m = scan.matches(docs(spark, LOG, None, ""), r"\I:ip \W:verb \L \N \N:n")
    got = {r.key: (r["count"], int(r.sum_n)) for r in reports.count_by(m, "${verb}", ("n",)).collect()}
    assert got == {"GET": (2, 12), "POST": (1, 9)}
    assert [r.key for r in reports.top(m, "${ip}", 1).collect()] == ["10.0.0.1"]


def test_rewrite_redact_pseudonym(spark):
    d = docs(spark, "depth : 30", "via 172.16.0.8 then 172.16.0.2 then 172.16.0.8", None, "last 172.16.0.2")
    assert reports.rewrite(d, r'\W:a ":" \N:b', "${2} as ${1}").filter("doc_id = 0").collect()[0].text == "30 as depth"
    r = {x.doc_id: x.text for x in reports.redact(d, r"\I:i", "pseudonym").collect()}
    assert r[1] == "via IP_1 then IP_2 then IP_1" and r[2] is None and r[3] == "last IP_2"
    assert reports.mask("77-abc-12", "char", 3) == "**-**c-12"


def test_aggregates_of_registers(spark):
    d = docs(spark, "\n".join(f"job {w} took {n}ms on 10.0.0.{n} v1.{n}.0" for w, n in (("a", 9), ("a", 10), ("a", 100), ("b", 3))), None)
    m = scan.matches(d, r'"job" \W:k "took" \R:t "on" \I:i \V:v')
    e = {r.key: r for r in reports.extremes(m, "${k}", ("t", "i", "v")).collect()}
    assert (e["a"].min_t, e["a"].max_t, e["a"].max_i, e["a"].max_v) == ("9ms", "100ms", "10.0.0.100", "v1.100.0")
    for how, want in (("nearest", 10_000_000), ("lower", 10_000_000), ("linear", 10_000_000)):
        assert {r.key: int(r.p50) for r in reports.percentiles(m, "${k}", "t", (0.5,), how).collect()} == {"a": want, "b": 3_000_000}
    c = reports.count_by(m, "${v.minor}", ("t",))
    assert {r.key for r in c.collect()} == {"9", "10", "100", "3"}
    mean = reports.count_by(m, "${k}", ("t",)).select("key", reports.exact_mean("sum_t", "n_t").alias("mean"))
    assert {r.key: r.mean for r in mean.collect()} == {"a": "39666666.(6)", "b": "3000000"}


def test_extremes_of_close_instants(spark):
    d = docs(spark, "\n".join(f"at 2024-01-01 00:{m:02d}:{sec:02d}" for m, sec in ((15, 27), (14, 41), (14, 40), (15, 28))))
    r = reports.extremes(scan.matches(d, r'"at" \T:t'), "all", ("t",)).collect()[0]
    assert (r.min_t, r.max_t) == ("2024-01-01 00:14:40", "2024-01-01 00:15:28")


def test_lines(spark):
    d = docs(spark, "north 1\nsouth\neast 2\nwest\n", None, "")
    two = lambda x: [(r.doc_id, r.rec) for r in x.orderBy("doc_id", "rec").collect()]
    assert two(lines.touched(d, r"\N")) == [(0, 1), (0, 3)]
    assert two(lines.untouched(d, r"\N")) == [(0, 2), (0, 4), (1, 1), (2, 1)]
    assert two(lines.whole(d, r"\W")) == [(0, 2), (0, 4)]
    assert two(lines.context(d, '"east"', 1, 0)) == [(0, 2), (0, 3)]
    assert two(lines.window(d, -2, -1).filter("doc_id = 0")) == [(0, 3), (0, 4)] and two(lines.window(d, 2, 3)) == [(0, 2), (0, 3)]
    assert [tuple(r) for r in lines.counts(d, r"\N").collect()] == [(0, 2, 2)]
    assert {r.doc_id: r.found for r in lines.with_match(d, r"\N").collect()} == {0: True, 1: False, 2: False}
    # a match over two lines touches both
    assert two(lines.touched(d, r"\N \W")) == [(0, 1), (0, 2), (0, 3), (0, 4)]


def test_joins_of_two_inputs(spark):
    d = docs(spark, "oak elm 10.0.0.1", "elm pine", None)
    other = {"trees": docs(spark, "oak 10.0.0.1", "pine")}
    said = lambda p: sorted((r.doc_id, r.text) for r in scan.matches(d, p, others=other).collect())
    assert said(r"@echoed:@trees .") == [(0, "10.0.0.1"), (0, "oak"), (1, "pine")]
    assert said(r"@novel:@trees .") == [(0, "elm"), (1, "elm")]
    assert said(r"\W{in:@trees}") == [(0, "oak"), (1, "pine")]
    with pytest.raises(PatternError):
        scan.matches(d, "@echoed:@nothing .")


def test_templates(spark):
    got = {r.template: r["count"] for r in reports.templates(docs(spark, LOG)).collect()}
    assert got == {"<ip> <word> <path> <number> <number>": 3}


def test_records_and_findings(spark):
    d = docs(spark, "a@b.org 1.2.3.4\n\nnone here\n\n5.6.7.8 only")
    p = scan.paragraphs(d)
    assert [r.rec for r in scan.record_query(p, {"i": r"\I", "e": r"\E"}, "all").collect()] == [1]
    f = reports.findings(d, [{"name": "mail", "pattern": r"\E", "message": "address", "unless": r"\W{len>40}"}])
    assert f.count() == 1 and '"ruleId":"mail"' in reports.sarif(f).collect()[0].value


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é one".encode("utf-16"))
    (tmp_path / "b.bin").write_bytes(b"x\0y")
    (tmp_path / "c.txt").write_text("two")
    assert [r.text for r in files.read(spark, str(tmp_path)).collect()] == ["é one", "two"]


def test_gravity_reaches_32_tokens(spark):
    kinds = [["word", "number", "open", "close"][k * k % 7 % 4] for k in range(50)]
    t = spark.createDataFrame([(0, k, x) for k, x in enumerate(kinds)] + [(1, 0, "word"), (1, 1, "number")], "doc_id long, tok long, kind string")
    want: dict = {}
    for seq in (kinds, ["word", "number"]):
        for d in range(1, 33):
            for a, b in zip(seq, seq[d:], strict=False):
                want[d, a, b] = want.get((d, a, b), 0) + 1
    got = {(r.d, r.a, r.b): (r.n, r.lift) for r in axes.gravity(t).collect()}
    assert {k: n for k, (n, _) in got.items()} == want
    side = lambda d, k, x: sum(n for key, n in want.items() if key[0] == d and key[k] == x)
    for (d, a, b), (n, lift) in got.items():
        expected = side(d, 1, a) * side(d, 2, b) / sum(m for key, m in want.items() if key[0] == d)
        assert abs(lift - (n + 1) / (expected + 1)) < 1e-9


def test_declarations(spark):
    d = Declarations.read("# berths\nshape berth = `[A-Z]-\\d+`\nlet load = \\N | \\Z\nkind slot = \\{berth} \":\" \\{load}\nlet row = \\W:ship \\{berth}:at \\N:t\nfields row {ship} {at} {[int]t}\nrule far error \"far berth\" = `[Q-Z]-\\d+`\nfix far = A-1\nmeta far area = east\ntest slot accepts \"B-4 : 12\" \"C-1 : 3KB\" rejects \"B-4 12\"\ntest load accepts \"x\"".replace("\\n", "\n"))
    assert d.failures() == [("load", "x", "accepts")]
    t = docs(spark, "Gull B-4 : 12 and R-7 here", "Tern C-2 30", None)
    assert [r.text for r in scan.matches(t, r"\{slot}", **d.options).collect()] == ["B-4 : 12"]
    assert [tuple(r)[2:] for r in d.extract(t, "row").collect()] == [("Tern", "C-2", 30)]
    assert [(r.rule, r.text) for r in d.findings(t).collect()] == [("far", "R-7")] and d.fixed(t).filter("doc_id = 0").collect()[0].text.endswith("and A-1 here")
    for bad in ("shape x", "let a = \\N\nlet a = \\W", "kind k = \\{none}", "fix none = 1"):
        with pytest.raises(PatternError):
            Declarations.read(bad.replace("\\n", "\n"))


def test_records_units_and_templates(spark):
    t = docs(spark, "open (a (b) c)\nrun 5 ; go(7)", None)
    assert [(r.rec, r.text) for r in records.blocks(t).collect()] == [(1, "(a (b) c)"), (2, "(b)"), (3, "(7)")]
    assert [(r.role, r.text) for r in records.units(t).filter("depth = 0").collect()] == [("call", "open"), ("numeric", "run 5"), ("call", "go")]
    assert [r.text for r in records.started(t, "^ \\W").collect()] == ["open (a (b) c)\n", "run 5 ; go(7)"]
    one, two = reports.templates(docs(spark, LOG, "x y")), reports.templates(docs(spark, LOG))
    assert [r.template for r in reports.admitted(one, two, True).collect()] == ["x y"] and [r.template for r in reports.rare(one).collect()] == ["x y"]
    p = Pattern(reports.as_pattern(two.collect()[0].template))
    assert len(p.find(LOG)) == 3


def test_index_loses_no_match(spark):
    t = docs(spark, "oak 5", "elm x@y.org", "Oak elm", None, "")
    i = index.build(t)
    for p in ('"oak"', r"\E", r"\W \N", '"oak" | "elm"', r'(?orbit:case "OAK")', r"\W* \N?"):
        hit = {r.doc_id for r in scan.matches(t, p).collect()}
        assert hit <= {r.doc_id for r in index.candidates(i, p).collect()}
        assert {r.doc_id for r in scan.matches(index.pruned(t, i, p), p).collect()} == hit
    assert {r.doc_id for r in index.candidates(i, r"\E").collect()} == {1}
    assert {r.doc_id for r in index.stale(docs(spark, "oak 5", "elm x@y.org!"), i).collect()} == {1}


def test_bpe(spark, tmp_path):
    t = docs(spark, "low lower lowest low", "new newer newest", None, "")
    merges = bpe.train(t, 12)
    words = {"low": 2, "lower": 1, "lowest": 1, "new": 1, "newer": 1, "newest": 1}
    held, want = {w: [*w, bpe.END] for w in words}, []
    for _ in range(12):
        pairs: dict = {}
        for w, sym in held.items():
            for p in zip(sym, sym[1:], strict=False):
                pairs[p] = pairs.get(p, 0) + words[w]
        best = min(pairs, key=lambda p: (-pairs[p], p))
        want.append(best)
        held = {w: bpe.apply(sym, best) for w, sym in held.items()}
    assert merges == want
    got = {r.doc_id: r.symbols for r in bpe.encode(t, merges).collect()}
    assert got[0] == held["low"] + held["lower"] + held["lowest"] + held["low"] and got[2] == []
    bpe.save(spark, merges, str(tmp_path / "m"))
    assert bpe.load(spark, str(tmp_path / "m")) == merges
