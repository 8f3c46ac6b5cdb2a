import numpy as np
import pytest
from brute import crc, encode, jaccard, line_dedup, near_duplicates, nearest
from pyspark.sql import functions as F

from tokenloom.llm import _base, ann, chat, graphs, lines, mixing, neardup, packing, shingles, tokens, toxicity

BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
TEXTS = [
    None,
    "",
    " \n\t ",
    "short text",
    "Short  TEXT",
    BASE,
    BASE + " more",
    BASE.upper(),
    "x " + BASE,
    "A repeated line of text\nown line number one",
    "own line number two\n  a REPEATED line of text \n\nshort",
    "a repeated line of text",
    "a   b \n c\t\td  <|endoftext|> é ",
    "word " * 5000,
    *[f"{BASE} tail{k % 40} end{k}" for k in range(60)],
    *[f"unique{k} alpha{k} beta{k} gamma{k} delta{k} " + "the common passage of many words in every such text" for k in range(40)],
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None if k % 7 == 0 else f"s{k % 3}", len(t or ""), "clash", 1) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, `set` string, `length` int").repartition(3)


@pytest.fixture(scope="module")
def plain():
    return list(enumerate(TEXTS))


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


def test_jaccard(docs, plain):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in shingles.jaccard_join(docs)[0].collect()}
    assert got == jaccard(plain)


def test_jaccard_random(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(300):
        if rows and rng.random() < 0.6:
            w = rows[rng.integers(len(rows))][1].split()
            for _ in range(rng.integers(0, 6)):
                w[rng.integers(len(w))] = f"w{rng.integers(30)}"
        else:
            w = [f"w{rng.integers(30)}" for _ in range(rng.integers(1, 120))]
        rows.append((k, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in shingles.jaccard_join(d)[0].collect()} == jaccard(rows)


def test_jaccard_of_frequent_lists_in_blocks(spark, monkeypatch):
    """Groups over several blocks, linked by chains that no leader shows, beside a passage in many texts."""
    monkeypatch.setattr(shingles, "BLOCK", 16)
    rng = np.random.default_rng(8)
    rows, passage = [], " ".join(f"p{i}" for i in range(12))
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(60):
            w = list(base)
            for at in rng.integers(0, 60, rng.integers(0, 4)):
                w[at] = f"x{rng.integers(50)}"
            rows.append(" ".join(w))
    rows += [" ".join(f"u{k}v{i}" for i in range(rng.integers(1, 12))) + " " + passage for k in range(60)]
    rows += rows[:5] + [None, ""]
    rows = list(enumerate(rows))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in shingles.jaccard_join(d)[0].collect()} == jaccard(rows)


def test_overlaps():
    rng = np.random.default_rng(9)
    x = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    for i, n in shingles.overlaps(x, 30):
        assert n.tolist() == [len(np.intersect1d(x[i], y)) for y in x]


def test_jaccard_repeated_and_null_ids(spark):
    rows = [(None, BASE), (3, BASE), (3, BASE), (5, BASE + " z"), (None, "alone here")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.n_links) for r in shingles.jaccard_join(d)[0].collect()), key=str)
    assert got == sorted([(None, 3, 3), (3, 3, 3), (3, 3, 3), (5, 3, 3), (None, None, 0)], key=str)


def test_lines(docs, plain):
    d = lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    assert {r[0]: tuple(r)[1:] for r in d.collect()} == line_dedup(plain)


def test_counts(docs, plain, tok):
    n = np.array([len(encode(tok, t)) for _, t in plain])
    table = tokens.count_table(docs, block=8)
    for r in table.collect():
        assert (r.truncated_total, r.docs_ge, r.n_docs) == (np.minimum(n, r.limit).sum(), (n >= r.limit).sum(), (n == r.limit).sum())
    assert tokens.total_at(table, 30) == np.minimum(n, 30).sum() and tokens.total_at(table, 0) == 0


def test_files_round_trip(spark, docs, plain, tok):
    index = tokens.token_files(docs, _base.new_path(spark, "t"), file_bytes=2000).orderBy("doc_id").collect()
    start = 0
    for r, (i, t) in zip(index, plain, strict=True):
        ids = encode(tok, t)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), crc(ids))
        start += len(ids)
    r = index[5]
    assert np.frombuffer(tokens.read_record(r.file, r.offset, r["size"])[1], "<u2").tolist() == encode(tok, plain[5][1])


def test_damage_is_found():
    raw = bytearray(tokens.frame(7, b"\x01\x00\x02\x00") + b"\n")
    assert next(tokens.frames(bytes(raw)))[2] == 7
    raw[20] ^= 1
    with pytest.raises(ValueError):
        list(tokens.frames(bytes(raw)))


def test_packing(docs, plain, tok):
    rows = packing.pack(docs, 64).toPandas()
    ids = {i: encode(tok, t) for i, t in plain}
    assert all(crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 for r in rows.itertuples())
    assert rows.length.sum() == sum(map(len, ids.values()))
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 64
    assert rows.sequence_id.nunique() <= 1.05 * -(-rows.length.sum() // 64) + 1


def test_mixing(docs):
    r = mixing.decide(docs).toPandas()
    assert (r.taken <= 2 * r["size"]).all() and len(r) == len(TEXTS)
    by = r.groupby(r.source.fillna("-")).agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() <= 40).all()
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(_base.word_count(F.col("text")))).collect()[0][0] == r.taken.sum()


def test_apportion(spark):
    w = [53.2, 24.1, 23.9, 1.1, 0.0, 24.1]
    have = [0] * len(w)
    for _ in range(37):
        k = max(range(len(w)), key=lambda i: (w[i] / (2 * have[i] + 1), -i))
        have[k] += 1
    df = _base.stage(spark.createDataFrame(list(enumerate(w)), "i long, w double"), "w")
    assert [r.seats for r in mixing.apportion(df, "w", 37, ["i"]).orderBy("i").collect()] == have


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", None), (3, 5, "user", "a"), (4, 0, "user", ""), (5, 0, "user", None), (None, 0, None, "z"), (6, 0, "user", ""), (7, 1, "user", "b"), (7, 0, "user", "a"), (7, 2000, "user", "c")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.part): r.text for r in chat.format_chats(d).collect()}
    assert set(got) == {(2, 0), (4, 0), (5, 0), (None, 0), (7, 0), (7, 1)}
    assert got[2, 0] == "<|user|>\na\n<|end|>\n<|assistant|>\nb\n<|end|>\n<|user|>\n\n<|end|>\n"


def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 16))
    x[50:90] = x[0] + 0.05 * rng.standard_normal((40, 16))
    x[100:130] = x[1]
    rows = [(k, [float(np.float32(c)) for c in v], k % 2 if k % 11 else None) for k, v in enumerate(x)]
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, [None] * 16, 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_search(spark):
    rows, v = vectors(spark)
    want = nearest([r[:2] for r in rows], [r[:2] for r in rows if r[0] % 20 == 0])
    got: dict = {}
    for r in ann.search(v, v.filter("vec_id % 20 = 0"), shard_rows=150).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.95 * sum(map(len, want.values()))


def test_near_duplicates(spark):
    rows, v = vectors(spark)
    out, recall = neardup.near_duplicates(v, k=8)
    assert {r.vec_id: (r.n_links, r.component_id) for r in out.collect()} == near_duplicates(rows)
    assert recall == 1.0


def test_near_duplicates_between_tight_groups(spark):
    rng = np.random.default_rng(4)
    a, b = np.eye(32)[0], np.eye(32)[1]
    second = 0.95 * a + np.sqrt(1 - 0.95**2) * b
    third = 0.955 * a - np.sqrt(1 - 0.955**2) * b
    x = np.concatenate([c + 0.004 * rng.standard_normal((40, 32)) for c in (a, second)])
    # a few equal and unsaturated nodes near the first group, and others apart
    x = np.concatenate([x, [third, third], rng.standard_normal((60, 32))])
    rows = [(k, [float(np.float32(c)) for c in v], 0) for k, v in enumerate(x)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out, recall = neardup.near_duplicates(v)
    want = near_duplicates(rows)
    assert len({want[k][1] for k in range(80)}) == 1 and want[0][0] >= 79
    assert {r.vec_id: (r.n_links, r.component_id) for r in out.collect()} == want
    assert recall == 1.0


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (5, 5), (None, 1)], "a long, b long").repartition(4)
    got = dict(map(tuple, graphs.components(e).collect()))
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit") for b in ("em", "um", "or", "et")]
    rows = [(k, " ".join(rng.choice(words, 30)) + (" you worthless thing" if k % 5 == 0 else ""), int(k % 5 == 0)) for k in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.fit(d, d.select("doc_id", "toxic"))
    assert "worthless" in m.terms
    more = spark.createDataFrame([(1, "you worthles thing"), (2, 'he said "worthless" once'), (3, None), (4, "lorem ipsum")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score(more, m).collect()}
    assert s[1] >= 0.5 > s[2] and s[3] < 0.5 and s[4] < 0.5


def test_toxicity_of_rare_quoted_and_stemmed_terms(spark):
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit") for b in ("em", "um", "or", "et")]
    plain = lambda: " ".join(rng.choice(words, 30))
    rows = [(plain() + " you worthless thing", 1) for _ in range(150)]
    rows += [(plain() + " such a numbskull today", 1) for _ in range(16)]  # a ninth of the other's rows
    rows += [(plain() + " you are disgusting now", 1) for _ in range(30)]
    rows += [(plain() + ' the man wrote "disgusting" there', 0) for _ in range(12)]  # clean rows quote it
    copied = plain() + " zanzibarium quixotry"
    rows += [(copied + f" {k} nitwitted", 1) for k in range(30)]  # one text thirty times is no evidence
    rows += [(plain(), 0) for _ in range(600)]
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, toxic int")
    m = toxicity.fit(d, d.select("doc_id", "toxic"))
    assert {"worthless", "numbskull", "disgusting"} <= set(m.terms) and "zanzibarium" not in m.terms
    said = ["a numbskul here", "you disgusting one", "you disgustin one", 'he wrote "disgusting" once', "lorem zanzibariun"]
    more = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    s = {r.doc_id: r.score >= 0.5 for r in toxicity.score(more, m).collect()}
    assert s == {0: True, 1: True, 2: True, 3: False, 4: False}


def test_toxicity_automata():
    assert toxicity.Matcher(["numbskull"]).look("umbskul") == [(0, 2)]  # two letters left out
    assert toxicity.Matcher(["worth*"]).look("wortzless") == [(0, 1)]
    assert toxicity.Matcher(["worth*"]).look("lorem") == []


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string, n_chars long")
    assert shingles.jaccard_join(d)[0].count() == 0
    assert lines.dedup_lines(d).count() == 0
    assert tokens.count_table(d).count() == 0
    assert packing.pack(d).count() == 0
    assert mixing.decide(d).count() == 0
    v = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert ann.search(v, v).count() == 0
    assert neardup.near_duplicates(v)[0].count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert toxicity.score(d, toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_encoder_cuts_like_the_library():
    import random

    from tokenloom.llm import tokens as K

    rng = random.Random(5)
    texts = ["", " a b", "a  b", "a \n", "a\n b", "a b ", "a\tb c", "x　y z", "it's a 'test of", "é è\xa0k", "don t \n", "We'LL they've 12ab³ c"]
    texts += ["".join(rng.choice("abs' \n \t.1é²") for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    e = K.Encoder(K.default_vocabulary())
    assert e.packed(texts) == e._whole(texts)
    assert e.packed([None]) == [b""]


def test_added_tokens_stay_whole(spark, tok):
    texts = ["see <|endoftext|> here", "in<|endoftext|>side a word", "<|endoftext|>", "<|endoftext|> first", "last <|endoftext|>", "é <|endoftext|><|endoftext|> é", "cut <|endof text|> <|endoftext |>"]
    e = tokens.Encoder(tokens.default_vocabulary())
    assert [np.frombuffer(p, e.dtype).tolist() for p in e.packed(texts)] == [encode(tok, t)[:-1] for t in texts]
    assert np.frombuffer(e.packed(texts)[0], e.dtype).tolist() == [3826, 220, 50256, 994]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = tokens.count_table(d)
    assert table.agg(F.sum(F.col("limit") * F.col("n_docs"))).collect()[0][0] == sum(len(encode(tok, t)) for t in texts)
