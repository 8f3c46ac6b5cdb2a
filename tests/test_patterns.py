import random
import time

import pytest

from tokenloom.functions import scalars, units
from tokenloom.functions import values as V
from tokenloom.functions.lexer import count_kinds, lex
from tokenloom.plans.infer import infer
from tokenloom.plans.pattern import Pattern, PatternError, escape
from tokenloom.sources.files import Decoder
from tokenloom.streaming.scan import Editor, Scanner, SetScanner

HARBOUR = 'boat "Sea Gull" left pier 7 at 2023-05-06 04:15:00 with 250KB cargo (7, 12) paid $31.50'

CASES = [
    # atoms and value tests
    (r"\Q", HARBOUR, ['"Sea Gull"']),
    (r"\Z{>200KB}", HARBOUR, ["250KB"]),
    (r"\${<31.51}", HARBOUR, ["$31.50"]),
    (r"\T{month=5,hour<5}", HARBOUR, ["2023-05-06 04:15:00"]),
    (r"\N{7..11}", HARBOUR, ["7", "7"]),
    (r"[\W && \l -- `.{4}`]", HARBOUR, ["at", "cargo"]),
    (r"\I{in:172.20.0.0/14}", "hosts 172.21.9.4 172.24.0.1 172.23.255.255", ["172.21.9.4", "172.23.255.255"]),
    (r"\V{<1.4.0}", "pump 1.3.9 valve 1.4.0-beta gate 1.4.0", ["1.3.9", "1.4.0-beta"]),
    (r'"granite"~2', "granit grenites gravel granite", ["granit", "grenites", "granite"]),
    (r'(?orbit:fold "müll")', "MULL Müll mull mulls", ["MULL", "Müll", "mull"]),
    # sequences, choices, repetition
    (r'"pier" \N', HARBOUR, ["pier 7"]),
    (r'"oak" | "oak" "tree" | "elm"', "oak tree elm", ["oak", "elm"]),
    (r'"oak" || "oak" "tree"', "oak tree oak", ["oak tree", "oak"]),
    (r'("oak" | "oak" "tree") "top"', "oak tree top", ["oak tree top"]),
    (r'("oak" |> "oak" "tree") "top"', "oak tree top", []),
    (r"\N+ \N", "4 5 6 tin 8", ["4 5 6"]),
    (r"(?>\N+) \N", "4 5 6", []),
    (r"\N++ \W", "4 5 tin", ["4 5 tin"]),
    (r"\N{2}", "4 5 6 7 8", ["4 5", "6 7"]),
    (r"\W .*? \N", "red 1 blue 2", ["red 1", "blue 2"]),
    (r"(\W? \N?)* \Q", 'a 1 b "q"', ['a 1 b "q"']),
    (r'("open" \W "gate" "slowly")~1', "open the wide gate slowly", ["open the wide gate slowly"]),
    (r'("open" \W "gate" "slowly")~1', "open the very gate so slowly", []),
    (r"\B(\N . \N)", HARBOUR, ["(7, 12)"]),
    (r"\B(\N)", HARBOUR, []),
    (r"\B[\B(.*)]", "[(a b)] [c]", ["[(a b)]"]),
    # looking around
    (r"\W ~(\N)", HARBOUR, ["pier"]),
    (r"~<(\W \W) \N", "one two 3 four 5", ["3"]),
    (r"~<(\W .*) \N", "9 a b 3", ["3"]),
    (r"\W ~>3{2}(\N)", "north 1 2 south 3", ["north"]),
    (r"~#{1}(\N) \B", "(1) (2 3) (x)", ["(1)"]),
    (r'\W ~"zinc"', "iron zinc lead", ["iron"]),
    # anchors
    (r"^ \W", "sun up\nmoon down", ["sun", "moon"]),
    (r"\W $", "sun up\nmoon down", ["up", "down"]),
    (r"\A \W | \W \z", "sun up moon", ["sun", "moon"]),
    (r"\G \N", "1 2 x 3", ["1", "2"]),
    (r'"pier" \K \N', HARBOUR, ["7"]),
    (r"@echo>=3 \W", "ant bee ant cow ant bee", ["ant", "ant", "ant"]),
    (r"@echo:nth=2 \W", "ant bee ant cow ant bee", ["ant", "bee"]),
    (r"@novel \W", "ant bee ant", ["ant", "bee"]),
    (r"@nested>=2 \N", "(1 (2) 3)", ["2"]),
    (r"@order:desc \T", "2020-01-02 2020-01-05 2020-01-03", ["2020-01-03"]),
    (r"@2 \W", "tin , zinc , lead", ["zinc"]),
    # registers
    (r"\N:n .* =n", "8 to 9 to 8", ["8 to 9 to 8"]),
    (r"\E:a \E =domain a", "x@p.org y@q.org z@p.org", ["x@p.org y@q.org z@p.org"]),
    (r"<\W:t> \W </=t>", "<em>word</em> <b>word</i>", ["<em>word</em>"]),
    (r"\T:t \W \T{<+2m:t}", "2020-01-01 00:00:00 to 2020-01-01 00:01:00", ["2020-01-01 00:00:00 to 2020-01-01 00:01:00"]),
]


@pytest.mark.parametrize(("pattern", "text", "want"), CASES)
def test_golden(pattern, text, want):
    assert [m.text for m in Pattern(pattern).find(text)] == want


@pytest.mark.parametrize("bad", ['"open', r"\{nothing}", "(", "a b", r"\N{>+1:k}", r"\N{>abc}", r"\I{in:nowhere}", "=later", r"(\W+)~1", r"\W{3,2}", r"\W::s", "@seam", r"(?orbit:moon \W)"])
def test_patterns_that_are_not_understood_are_refused(bad):
    with pytest.raises(PatternError):
        Pattern(bad)


def test_long_texts_take_linear_time_and_no_recursion():
    text = "w 1 " * 20_000
    start = time.time()
    assert Pattern(r'(\W \N)* "z"').find(text) == []
    assert Pattern(r'(.*)* \Q').find(text) == []
    assert len(Pattern(r"(\W | \N)+").find(text)) == 1
    assert time.time() - start < 20


def test_other_readings_of_a_pattern():
    p = Pattern(r"\N+")
    assert p.is_match("a 1") and not p.is_match("a") and not p.is_match(None)
    assert p.find_at("1 a 2 b 3", 3).text == "2" and p.shortest_match("a 1 2 3") == 3
    assert Pattern('","').split("a, b, c", 2) == ["a", " b, c"]
    assert Pattern('","').split_at_depth("f(a, b), g(c)", 0) == ["f(a, b)", " g(c)"]
    assert Pattern(escape('say "x"')).find('I say "x" so')[0].text == 'say "x"'


def test_lexer_covers_and_pairs():
    ts = lex("f(a[1], {b}) 10.0.0.1 2024-01-02 $5.20 1.2.3 30% 5s #fff")
    assert [t.kind for t in ts][-7:] == ["ip", "timestamp", "money", "version", "percent", "duration", "hexcolor"]
    assert ts[1].text == "(" and ts[ts[1].mate].text == ")"
    assert lex(None) == [] and lex("") == []


def test_kinds_are_counted_as_they_are_lexed():
    rng = random.Random(1)
    parts = ["ab", "Été", ".", ",", " ", "\n", "(", "]", "12", "x@y.org", "'", '"q"', "a" * 40, "deadbeef" * 4, "_", "-", "http://a.b/c", "Jan  3 10:00:00", "\t"]
    for _ in range(300):
        t = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 40)))
        want: dict = {}
        for x in lex(t):
            want[x.kind] = want.get(x.kind, 0) + 1
        assert count_kinds(t) == want, t


def test_values():
    assert V.quotient(V.number("7000"), 3) == "2333.(3)"
    assert V.quotient(V.number("5"), 2) == "2.5"
    assert V.version("1.0.0-rc1") < V.version("1.0.0")
    assert V.value("bytesize", "2KiB") == 2048
    assert V.number("0x3e8") == V.number("1e3") == V.number("1_000")


STREAMED = [r"\W \W", r"\W:x =x", r"\N+ \W", r"^ \W .", r"\W $", r"~<(\W \W) \N", r"\W ~(\N)", r"\G \W", r"\W .{2} \N", r'"a" | "a" "b"', r"\B(\W*)", r"@novel \W", r"@nested>=1 \N", r"\W ~>3(\N)", r"\A \W \W", r"\W .*? \N", r'("a" "b" "c")~1', r'\W ~"zz" \N', r"@echoed \W"]


@pytest.mark.parametrize("pattern", STREAMED)
def test_any_chunking_gives_the_same_matches(pattern):
    rng = random.Random(pattern)
    for _ in range(40):
        text = "".join(rng.choice(["a", "b", "c", "1", "22", "(", ")", "zz", ",", "\n"]) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(0, 40)))
        s, got, at = Scanner(pattern), [], 0
        while at < len(text):
            n = rng.randint(1, 9)
            got += s.push(text[at : at + n])
            s, at = Scanner(pattern, *s.state), at + n
        assert got + s.finish() == [(m.start, m.end, m.text) for m in Pattern(pattern).find(text)]


def test_a_stream_forgets_what_it_has_decided():
    s, text = Scanner(r"\W \W"), "alpha beta gamma delta\n" * 400
    found = s.push(text)
    assert len(found) == 800 and len(s.buffer) < 100


def test_sets_and_edits_of_a_stream():
    rng = random.Random(9)
    for _ in range(30):
        text = "".join(rng.choice(["ab ", "12 ", "x@y.org ", "\n", "( ", ") "]) for _ in range(40))
        s, e, got, new, at = SetScanner({"n": r"\N", "pair": r"\W \N"}), Editor(r"\N+", lambda t: f"<{t}>"), [], "", 0
        while at < len(text):
            n = rng.randint(1, 12)
            got += s.push(text[at : at + n])
            new += e.push(text[at : at + n])
            at += n
        got, new = got + s.finish(), new + e.finish()
        want = [(m.start, m.end, k, m.text) for k, p in (("n", r"\N"), ("pair", r"\W \N")) for m in Pattern(p).find(text)]
        assert sorted(got) == sorted(want)
        out, at = "", 0
        for m in Pattern(r"\N+").find(text):
            out, at = out + text[at : m.start] + f"<{m.text}>", m.end
        assert new == out + text[at:]


def test_units_lenses_and_names():
    said = lambda p, t, **k: [m.text for m in Pattern(p, **k).find(t)]
    assert [(u.role, u.depth) for u in units.divide(lex("run(a, b)\nkey: 5\n1,2,3\nx = (4) ; plain words [z"))] == [("call", 0), ("plain", 1), ("kv", 0), ("list", 0), ("assign", 0), ("numeric", 1), ("plain", 0)]
    assert said("@call", "sum(1, 2) and x (3)") == ["sum(1, 2)", "x (3)"] and said('#"W(N,N)"', "at pos(3, 4) or pos(3)") == ["pos(3, 4)"]
    assert said("@range", "from 3..9 to 4-5") == ["3..9", "4-5"] and said(r"@super:numeric \N", "total = 5 ; (7, 8) x") == ["7", "8"]
    assert said(r"\{pair}+", "a = 1 b = 2 c", lets={"pair": r'\W "=" \{v}', "v": r"\N"}) == ["a = 1 b = 2"]
    assert said('"OAK"', "oak Oak elm", ignore_case=True) == ["oak", "Oak"] and said(r"\N+", "1 2", swap_greed=True) == ["1", "2"]
    assert said(r"\{qty}{>5kg}", "6kg 4000g 6m2 11.1lb 7000g") == ["6kg", "11.1lb", "7000g"]
    with pytest.raises(PatternError):
        Pattern(r"\{loop}", {"loop": r"\W \{loop}"})
    p = Pattern(r'\E "at" (\N | \W) \I*')
    assert p.needs.kinds == {"email"} and p.needs.words == {"at"}


def test_scalars():
    assert scalars.mod97("GB33BUKB20201555555555") and not scalars.mod97("GB34BUKB20201555555555")
    assert scalars.gs1("4006381333931") and scalars.isbn("0-306-40615-2") and scalars.vin("1M8GDM9AXKP042788") and scalars.isin("US0378331005")
    assert not any(f("12345678901234567") for f in (scalars.isbn, scalars.vin, scalars.isin))
    assert scalars.plain_url("HTTP://Ex.org:80/%7ea%2fb?q#f") == "http://Ex.org/~a%2Fb?q#f".lower().replace("%2f", "%2F")
    assert scalars.claim("eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiJ4In0.s", "sub") == "x" and scalars.claim("a.b", "sub") is None
    assert scalars.octets("1.2.3.4", 2, 3) == "2.3" and scalars.groups("fe80::1", 1, 2) == "fe80:0000" and scalars.decoded("a") is None
    assert [scalars.identifier(x) for x in ("ab", "FOO", "foo_bar", "fooBar", "FooBar", "foo")] == ["short", "SCREAM", "snake", "camel", "Pascal", "word"]


def test_an_inferred_pattern_covers_its_examples():
    rng = random.Random(4)
    assert infer(["ship 12 left", "ship 7 left"]) == r'\A "ship" \{number} "left" \z'
    parts = ["ship", "boat", "7", "12", "x@y.org", ",", "(", ")", "10.0.0.1", "$5"]
    for _ in range(60):
        base = [rng.choice(parts) for _ in range(rng.randint(1, 8))]
        said = []
        for _ in range(rng.randint(1, 5)):
            w = [rng.choice(parts) if rng.random() < 0.2 else x for x in base if rng.random() < 0.85]
            said.append(" ".join(w + rng.choices(parts, k=rng.randint(0, 1))) or "ship")
        p = Pattern(infer(said))
        assert all(p.is_match(x) for x in said), (said, p.source)


def test_decoding_in_chunks():
    for name in ("utf-8", "utf-16", "utf-8-sig", "utf-32"):
        raw, d, out = "é ñ 漢字 text".encode(name), Decoder(), ""
        for k in range(0, len(raw), 3):
            out += d.push(raw[k : k + 3])
        assert out + d.push(b"", True) == "é ñ 漢字 text"
    assert Decoder().push(b"\xff", True) == "\ufffd"
