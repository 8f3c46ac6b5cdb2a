"""Nulls, repeated rows, clashing columns, ties and very long texts; the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from brute import crc, edit_distance, line_dedup, mix_targets, nearest, near_duplicates
from pyspark.sql import functions as F

from tokenloom.llm import _base, ann, chat, lines, mixing, neardup, packing, shingles, tokens, toxicity

SAID = "the same long line stands here"


def test_lines_with_clashing_columns_and_null_ids(spark):
    rows = [(5, f"{SAID}\nown five five", 50, 1, 2, [b"x"]), (3, SAID, 30, 1, 2, None), (None, f"  {SAID.upper()}\nnull id text", None, 1, 2, None), (3, SAID, 31, 1, 2, None), (None, SAID, 9, 1, 2, None), (8, None, 80, 1, 2, None), (9, "", 90, 1, 2, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _id long, _drop int, n_lines int, _suspects array<binary>").repartition(3)
    out = lines.dedup_lines(d)
    assert out.columns == ["doc_id", "text", "_id", "_drop", "_suspects", "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.text, r._id, r._drop, r.n_lines, r.n_dropped) for r in out.collect()), key=str)
    want = [(5, "own five five", 50, 1, 2, 1), (3, SAID, 30, 1, 1, 0), (None, "null id text", None, 1, 2, 1), (3, SAID, 31, 1, 1, 0), (None, "", 9, 1, 1, 1), (8, None, 80, 1, 1, 0), (9, "", 90, 1, 1, 0)]
    assert got == sorted(want, key=str)


def test_lines_with_a_full_filter_and_long_texts(spark):
    rng = random.Random(2)
    said = [f"line number {k} of the common ones" for k in range(200)]
    rows = [(k, "\n".join(rng.choice(said) if rng.random() < 0.5 else f"own {k} {j} of this text" for j in range(rng.randint(0, 30)))) for k in range(60)]
    rows.append((60, "\n".join(said * 300)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = lines.dedup_lines(d, bits=64).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in out} == line_dedup(rows)


def test_mixing_targets_by_pouring(spark):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 400))), [None, "a", "b", "ä", "Z", "c"][min(5, int(rng.exponential(1.2)))]) for k in range(500)]
    rows += rows[:3] + [(None, "w w w", "a")]
    r = mixing.decide(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = mix_targets(sizes)
    have = {None if s != s or s is None else s: g for s, g in r.groupby("source", dropna=False)}
    assert have.keys() == want.keys()
    for s, g in have.items():
        assert g.target.sub(want[s]).abs().max() < 1e-6 * max(1, want[s]) and (g.source_size == sizes[s]).all()
        assert abs(g.taken.sum() - want[s]) <= 2 * mixing.BLOCK
    assert (r.taken <= 2 * r["size"]).all() and len(r) == len(rows)


def test_a_mixture_keeps_blanks(spark):
    text = "\n".join(f"a{k}  b{k}\tc{k}" for k in range(60))
    d = spark.createDataFrame([(k, text, f"s{k % 3}") for k in range(30)], "doc_id long, text string, source string")
    for r in mixing.mixture(d).collect():
        assert r.text == text or "\n" in r.text and "  b" in r.text and set(r.text.split()) <= set(text.split())


def test_misspellings_are_those_of_brute_force():
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    terms = sorted({word(rng.randint(4, 12)) for _ in range(40)})
    root = toxicity.trie(terms)
    for _ in range(400):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "d", "x"])
        w = "".join(w)
        want = {(k, e) for k, t in enumerate(terms) if (e := edit_distance(t, w)) <= toxicity.edits_allowed(len(t))}
        assert set(toxicity.near(root, w)) == want


def test_toxicity_of_null_rows(spark):
    d = spark.createDataFrame([(None, "x"), (1, None), (1, "y"), (2, "long " * 50_000)], "doc_id long, text string")
    y = spark.createDataFrame([(1, 1), (None, 1), (2, None), (2, 0), (7, 1)], "doc_id long, toxic int")
    out = toxicity.score(d, toxicity.fit(d, y)).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)


def test_search_is_exact_on_small_shards_with_ties(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, (130, 6)).astype(float)
    x[20:60] = x[3]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(130, None)]
    d = spark.createDataFrame([*rows, rows[5], (None, [1.0] * 6)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.search(d, d.filter("vec_id % 20 = 0"), shard_rows=40).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got == nearest(rows, [r for r in rows if r[0] % 20 == 0])
    few = d.filter("vec_id < 3")
    assert ann.search(few, few).groupBy("query_id").count().filter("count > 2").count() == 0


def test_search_visits_no_more_cells_as_rows_grow(spark):
    visits = []
    for n in (1500, 6000):
        rng = np.random.default_rng(4)
        x = rng.standard_normal((n // 60, 16))[rng.integers(0, n // 60, n)] + 0.3 * rng.standard_normal((n, 16))
        x *= rng.lognormal(0, 0.1, (n, 1))
        rows = [(k, v.tolist()) for k, v in enumerate(x)]
        d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got: dict = {}
        for r in ann.search(d, d.filter("vec_id % 20 = 0"), shard_rows=50).collect():
            got.setdefault(r.query_id, set()).add((r.vec_id, r.score))
        want = nearest(rows, [r for r in rows if r[0] % 20 == 0])
        assert sum(len(set(want[q]) & got[q]) for q in want) >= 0.95 * sum(map(len, want.values()))
        assert r.audited_recall >= 0.95
        visits.append(r.visits)
    assert visits[1] <= 2 * visits[0] and visits[1] <= 0.3 * 6000 / 50


def test_search_graph_reaches_every_node_and_is_exact_when_wide():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((12, 8))[k] + 0.01 * rng.standard_normal((90, 8)) for k in range(12)]) * rng.lognormal(0, 1, (1080, 1))
    graph, start = ann.build(ann.unit(x))
    reached, front = np.zeros(len(x), bool), np.array([start])
    while len(front):
        reached[front] = True
        front = np.unique(graph[front][graph[front] >= 0])
        front = front[~reached[front]]
    assert reached.all()
    q, v, s = ann.Shard(np.arange(len(x)), x, 32, len(x)).search(np.arange(0, len(x), 20), x[::20], 20)
    got: dict = {}
    for a, b, c in zip(q.tolist(), v.tolist(), s.tolist(), strict=True):
        got.setdefault(a, []).append((b, c))
    rows = [(k, r.tolist()) for k, r in enumerate(x)]
    assert got == nearest(rows, rows[::20])


def test_near_duplicates_at_the_threshold(spark):
    rng = np.random.default_rng(12)
    base = rng.standard_normal((12, 24))
    x = np.repeat(base, 60, 0) + 0.27 * rng.standard_normal((720, 24))
    rows = [(k, v.tolist(), k % 2) for k, v in enumerate(x)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out, recall = neardup.near_duplicates(v)
    want = near_duplicates(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in out.collect()}
    links = sum(n for n, _ in want.values())
    assert links > 2000 and sum(n for n, _ in got.values()) >= 0.995 * links and recall >= 0.9
    assert all(got[k][0] <= want[k][0] for k in want)


def test_packing_repeated_and_null_ids(spark):
    d = spark.createDataFrame([(None, "a b"), (1, "c"), (1, "c"), (None, None), (2, "word " * 400)], "doc_id long, text string")
    rows = packing.pack(d, 64).toPandas()
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 64
    assert len(rows) == 4 + -(-int(rows[rows.doc_id == 2].length.sum()) // 64)


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_near_the_least(spark, seed):
    rng = np.random.default_rng(seed)
    n = np.clip(rng.exponential([9, 20, 30, 4][seed], 1500).astype(int) + 1, 1, 64)
    d = spark.createDataFrame([(k, int(x)) for k, x in enumerate(n)], "doc_id long, length long").withColumn("piece", F.lit(0))
    rows = packing.best_fit(d, 64).toPandas()
    assert sorted(rows.doc_id) == list(range(1500)) and rows.groupby("sequence_id").length.sum().max() <= 64
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]]
    # best-fit decreasing in plain Python
    gaps: list = []
    for x in sorted(n, reverse=True):
        fit = min((g for g in gaps if g >= x), default=None)
        if fit is None:
            fit = 64
        else:
            gaps.remove(fit)
        gaps.append(fit - x)
    assert rows.sequence_id.nunique() <= len(gaps) * 1.01 + 1


def test_files_of_several_blocks_and_empty_tables(spark):
    rng = random.Random(3)
    rows = [(k if k % 9 else None, " ".join(rng.choice(["alpha", "beta"]) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    index = tokens.token_files(d, _base.new_path(spark, "t"), file_bytes=4000).orderBy("start").collect()
    ids = [r.doc_id for r in index]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and len({r.file for r in index}) > 3
    at = 0
    for r in index:
        assert r.start == at and tokens.read_record(r.file, r.offset, r["size"])[0] == r.doc_id
        at += r.n_tokens
    assert tokens.token_files(d.limit(0), _base.new_path(spark, "t")).count() == 0


def test_chats_with_long_and_repeated_turns(spark):
    rows = [(1, k, "user", f"t{k}") for k in range(3000)] + [(2, k, "user", f"t{k}") for k in range(1500)] + [(3, 0, "user", "x"), (3, 0, "user", "x"), (4, None, None, None)]
    got = {(r.conv_id, r.part): (r.n_turns, len(r.text)) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k for k, _ in got} == {1, 3, 4} and got[1, 0][0] == 3000 and got[3, 0][0] == 2


def test_the_pipeline(spark, tmp_path):
    """Stages against brute force, in the order that they run in."""
    import corpus_pipeline

    rng = random.Random(5)
    word = lambda: rng.choice(["stone", "river", "cloud", "maple", "ember", "quiet", "north", "plain", "glass", "field"]) + str(rng.randrange(40))
    clean = [" ".join(word() for _ in range(40)) for _ in range(120)]
    texts = [t + (" you worthless fool" if k % 4 == 0 else "") for k, t in enumerate(clean)]
    texts += [clean[1], clean[1] + " more", clean[2], SAID + "\n" + clean[3] + "x", SAID + "\n" + clean[5] + "y z", None, ""]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k < 120 and k % 4 == 0)) for k in range(0, 127)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = _base.stage(stage(spark, docs, str(tmp_path)), name)
        kept[name] = docs.toPandas()
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(kept["toxicity"].doc_id) == {k for k in range(127) if not (k < 120 and k % 4 == 0)}
    first = {r.doc_id: r.text for r in kept["toxicity"].itertuples()}
    want = line_dedup(list(first.items()))
    got = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in kept["line_dedup"].itertuples()}
    assert got == {k: v[2] for k, v in want.items()}
    second = {r.doc_id: r.text for r in kept["line_dedup"].itertuples()}
    from brute import jaccard

    assert set(kept["ngram_jaccard_join"].doc_id) == {k for k, (n, c, _) in jaccard(list(second.items())).items() if n == 0 or c == k}
    third = kept["ngram_jaccard_join"]
    sizes = {s: sum(len((t or "").split()) for t in g.text) for s, g in third.groupby("source")}
    target = mix_targets(sizes)
    for s, g in kept["source_mixing"].groupby("source"):
        assert abs(sum(len(t.split()) for t in g.text) - target[s]) <= 2 * mixing.BLOCK
    packed, enc = kept["best_fit_packing"], tokens.encoder(tokens.default_vocabulary())
    assert packed.length.sum() == sum(len(p) // enc.dtype.itemsize + 1 for p in enc.packed(list(kept["source_mixing"].text)))


def test_words_of_a_shingle_tie(spark):
    rows = [(k, t) for k, t in enumerate(["a b c d", "A  b C d", "a b c d e", "x", "x", None])]
    got = {r.doc_id: (r.component_id, r.n_links) for r in shingles.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (2, 0), 3: (3, 1), 4: (3, 1), 5: (5, 0)}


def test_blocks_of_long_texts_are_bounded_in_bytes(spark):
    """Forty sets of 125,000 hashes were one block: 40 MB, from which a worker made half a GB."""
    rows = spark.range(40).select(F.lit(1).alias("c"), F.col("id").alias("set"), F.expr("cast(repeat('x', 1000000) as binary)").alias("hashes"))
    sides = shingles.blocks(rows, "c", ["set", "hashes"]).groupBy("i", "j", "side").agg(F.sum(F.length("hashes")).alias("size"), F.count("*").alias("n")).collect()
    assert max(r["size"] for r in sides) <= 2 * shingles.BLOCK_BYTES
    assert sum(r.n for r in sides if r.i == r.j) == 40
    import pyarrow as pa

    many = pa.RecordBatch.from_pydict({"c": list(range(100)), "i": [0] * 100, "j": [0] * 100, "hashes": [b"x" * 1000] * 100})
    got = list(shingles._in_blocks([many], 3, 1024, 10_000))
    assert [len(g) for g in got] == [10] * 10


def test_encoder_marks_only_cuts_that_a_merge_could_cross(monkeypatch):
    """Chunks of letters, digits, newlines and signs cost the model one byte each beside their own; a small memo forgets and stays exact."""
    rng = random.Random(11)
    e = tokens.Encoder(tokens.default_vocabulary(), 4096)
    assert e.packed(["one, two.\nThree 4th é."]) == e._whole(["one, two.\nThree 4th é."])
    monkeypatch.setattr(tokens, "LOOKED_UP", 40)
    for _ in range(60):
        texts = [" ".join("".join(rng.choice("aetsé×÷ÿ…12.,'\"(\n") for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 30))) for _ in range(20)]
        assert e.packed(texts) == e._whole(texts)

    sent = []

    class Counted:
        def encode_batch_fast(self, joined, add_special_tokens, model=e.model):
            sent.extend(map(len, joined))
            return model.encode_batch_fast(joined, add_special_tokens=add_special_tokens)

    e = tokens.Encoder(tokens.default_vocabulary())
    e.model = Counted()
    words = [f"({k}),x{k}\nY.{k}é" for k in range(500)]
    assert e.packed([" ".join(words)]) == e._whole([" ".join(words)])
    assert sum(sent) <= len(" ".join(words).encode()) + len(words)


def test_pieces_send_the_model_each_chunk_once_without_marks(spark, monkeypatch):
    import pyarrow as pa

    enc, sent = tokens.Encoder(tokens.default_vocabulary()), []

    class Counted:
        def encode_batch_fast(self, joined, add_special_tokens, model=enc.model):
            sent.extend(map(len, joined))
            return model.encode_batch_fast(joined, add_special_tokens=add_special_tokens)

    class Table:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return [r for b in run(iter([pa.record_batch([[0, 1, 2], [text, None, text]], ["doc_id", "text"])])) for r in b.to_pylist()]

    text = " ".join(f"word{k},and\nnext.{k}" for k in range(300))
    enc.model = Counted()
    monkeypatch.setattr(tokens, "encoder", lambda path: enc)
    rows = packing.pieces(Table(), tokens.default_vocabulary(), 64)
    ids = [np.frombuffer(enc._whole([t or ""])[0], enc.dtype).tolist() + [tokens.END_ID] for t in (text, None, text)]
    assert all(crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for r in rows)
    assert sum(r["length"] for r in rows) == sum(map(len, ids))
    assert sum(sent) <= len(text.encode()) + 300
