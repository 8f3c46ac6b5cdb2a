"""Toxicity from a learned lexicon, caught with Levenshtein automata on a trie and read in context."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _base as B

#: Labelled rows that the lexicon is learned from at most (those of the smallest id hash).
TRAIN_ROWS = 20_000
#: Lengths of stems tried beside whole words, and least lengths for one and two edits.
STEMS, ONE_EDIT, TWO_EDITS = (4, 5, 6), 5, 9
#: Words of a shingle, bands and hashes of a band by which near copies among the labelled rows are found.
SHINGLE, BANDS, BAND = 5, 8, 4
#: Words that a worker's memo holds at most.
MEMO_WORDS = 300_000
#: Words on either side of a term that are read for context.
WINDOW = 8
#: Verbs and nouns of mention rather than use (fixed values).
MENTION = frozenset("said says say wrote writes write called calls quote quoted quotes word words term terms slur slurs insult insults defined definition means meaning reported alleged testified titled".split())
_WORD = re.compile(r"[^\W_]+")
_QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’"}


@dataclass
class Node:
    next: dict[str, Node] = field(default_factory=dict)
    word: int | None = None


def trie(terms: list[str | None]) -> Node:
    """Terms as a trie; None leaves its number unused."""
    root = Node()
    for k, t in enumerate(terms):
        if t:
            n = root
            for c in t:
                n = n.next.setdefault(c, Node())
            n.word = k
    return root


def edits_allowed(length: int) -> int:
    return (length >= ONE_EDIT) + (length >= TWO_EDITS)


def near(root: Node, word: str, prefix: bool = False) -> list[tuple[int, int]]:
    """(term, distance) of all words of the trie within the edits their length allows.

    With ``prefix`` the trie's words are held against the beginnings of the
    word that are shorter than it.

    The word's Levenshtein automaton runs along the trie: bit i of level e is
    set if the path so far is i letters of the word with e edits. A branch ends
    when no bit is left.
    """
    n, most = len(word), edits_allowed(len(word) + 2)  # a term may be two letters longer
    masks: dict[str, int] = {}
    for i, c in enumerate(word):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << n + 1) - 1
    ends = (1 << n) - 2 if prefix else 1 << n
    start = [(1 << e + 1) - 1 & full for e in range(most + 1)]
    out, todo = [], [(root, start, 0)]
    while todo:
        node, level, depth = todo.pop()
        if node.word is not None:
            e = next((e for e, bits in enumerate(level) if bits & ends), None)
            if e is not None and e <= edits_allowed(depth):
                out.append((node.word, e))
        for c, child in node.next.items():
            m, moved = masks.get(c, 0), []
            for e, bits in enumerate(level):
                step = (bits & m) << 1
                if e:
                    # a letter too many on the path, another letter, a letter of the word left out
                    step |= level[e - 1] | level[e - 1] << 1 | moved[e - 1] << 1
                moved.append(step & full)
            if moved[-1]:
                todo.append((child, moved, depth + 1))
    return out


def pieces(term: str) -> list[str]:
    """One part more than the edits allowed: a word within them holds some part unchanged."""
    n = edits_allowed(len(term)) + 1
    cut = [len(term) * k // n for k in range(n + 1)]
    return [term[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]


class Matcher:
    """Finds a lexicon's terms in texts; each distinct word is looked up once a worker.

    Whole words and stems are looked up by themselves. Only words that hold an
    unchanged part of a term or stem meet the tries.
    """

    def __init__(self, terms: list[str]) -> None:
        self.words = {t: k for k, t in enumerate(terms) if not t.endswith("*")}
        self.stems = {t[:-1]: k for k, t in enumerate(terms) if t.endswith("*")}
        loose = [t if not t.endswith("*") and edits_allowed(len(t)) else None for t in terms]
        begun = [t[:-1] if t.endswith("*") and edits_allowed(len(t) - 1) else None for t in terms]
        self.root, self.begun = trie(loose), trie(begun)
        self.parts = {p for t in loose + begun if t for p in pieces(t)}
        self.sizes = sorted({len(p) for p in self.parts})
        self.known: set[str] = set()
        self.hits: dict[str, list[tuple[int, int]]] = {}

    def look(self, word: str) -> list[tuple[int, int]]:
        """(term, distance) of each term that the word is, begins with, or misspells."""
        out = [(self.words[word], 0)] if word in self.words else []
        out += [(self.stems[word[:k]], 0) for k in STEMS if len(word) > k and word[:k] in self.stems]
        if any(word[i : i + k] in self.parts for k in self.sizes for i in range(len(word) - k + 1)):
            out += [(t, e) for t, e in near(self.root, word) if e]
            out += [(t, e) for t, e in near(self.begun, word, True) if e]
        return out

    def find(self, text: str | None) -> set[tuple[int, int, int]]:
        """Distinct (term, edited, mentioned) in a whole text."""
        low = (text or "").lower()
        words = set(_WORD.findall(low))
        if len(self.known) > MEMO_WORDS:
            self.known.clear()
            self.hits.clear()
        new = words - self.known
        for w in new:
            if found := self.look(w):
                self.hits[w] = found
        self.known |= new
        hit = words & self.hits.keys()
        if not hit:
            return set()
        out = set()
        every = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(low)]
        for k, (w, a, b) in enumerate(every):
            if w in hit:
                around = every[max(0, k - WINDOW) : k + WINDOW + 1]
                said = any(x in MENTION for x, _, _ in around) or _quoted(low, a, b, around)
                out.update((t, min(e, 1), int(said)) for t, e in self.hits[w])
        return out


def _quoted(low: str, a: int, b: int, around: list) -> bool:
    left, right = low[around[0][1] : a], low[b : around[-1][2] + 1]
    for o, c in _QUOTES.items():
        if o == c:
            if left.count(o) % 2 and c in right:
                return True
        elif left.rfind(o) > left.rfind(c) and c in right:
            return True
    return False


def used(low: str) -> set[str]:
    """Words of a lower-case text that stand in it at least once without mention."""
    every = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(low)]
    said = bytearray(len(every))
    for k, (w, _, _) in enumerate(every):
        if w in MENTION:
            a, b = max(0, k - WINDOW), min(len(every), k + WINDOW + 1)
            said[a:b] = b"\1" * (b - a)
    quotes = any(q in low for q in _QUOTES)
    out: set[str] = set()
    for k, (w, a, b) in enumerate(every):
        if not said[k] and w not in out and not (quotes and _quoted(low, a, b, every[max(0, k - WINDOW) : k + WINDOW + 1])):
            out.add(w)
    return out


def bands(text: str) -> list[int]:
    """Hashes of the least shingle hashes in bands; near copies share some, texts with a passage in common hardly any."""
    words = _WORD.findall(text.lower())
    if not words:
        return []
    h = np.unique([zlib.crc32(" ".join(words[k : k + SHINGLE]).encode()) for k in range(max(1, len(words) - SHINGLE + 1))]).astype(np.uint64)
    odd = np.random.default_rng(11).integers(1 << 62, size=(BANDS * BAND, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.array([(((h + b) * a) >> np.uint64(20)).min() for a, b in odd])
    return [zlib.crc32(least[k * BAND : (k + 1) * BAND].tobytes()) << 8 | k for k in range(BANDS)]


def copies(rows: list[tuple[int, list[int]]]) -> dict[int, int]:
    """{id: least id of its group} of (id, bands) rows; rows that share a band are of one group."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    first: dict[int, int] = {}
    for i, found in rows:
        for x in found:
            a, b = top(i), top(first.setdefault(x, i))
            up[max(a, b)] = min(a, b)
    return {i: top(i) for i, _ in rows}


@dataclass
class Model:
    """terms; evidence of (term, edited, mentioned) in log odds; the base rate's log odds."""

    terms: list[str]
    evidence: dict[tuple[int, int, int], float]
    base: float

    def score(self, found: set[tuple[int, int, int]]) -> float:
        """Log odds of the base rate plus the three strongest pieces of evidence, one a term, as a probability."""
        best: dict[int, float] = {}
        for f in found:
            best[f[0]] = max(best.get(f[0], 0.0), self.evidence.get(f, 0.0))
        z = self.base + sum(sorted(best.values(), reverse=True)[:3])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of ids kept from learning; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _logit(p: float) -> float:
    p = min(1 - 1e-6, max(1e-6, p))
    return math.log(p / (1 - p))


def _lower(y: int, n: int, z: float = 2.0) -> float:
    """Lower end of the score interval of y among n."""
    return (y + z * z / 2 - z * math.sqrt(y * (n - y) / n + z * z / 4)) / (n + z * z) if n else 0.0


def choose_terms(counts: dict[str, tuple[int, int]], toxic: int, clean: int, tried: int) -> list[str]:
    """Words and stems that mark toxic rows beyond chance among ``tried`` features.

    ``counts`` are of groups of near copies, which are independent of one
    another, and of uses without mention. A feature must stand in so many toxic
    groups that the base rate would not give them by luck, and at least nine
    tenths of its groups must be toxic. A stem goes if one word makes up all its rows; a longer feature goes if a
    chosen stem covers it.
    """
    base = max(1e-3, min(0.9, toxic / max(1, toxic + clean)))
    least = max(3, math.ceil(math.log(100 * max(1, tried)) / -math.log(base)))
    good = {f: n for f, n in counts.items() if n[0] >= least and n[0] >= 0.9 * sum(n)}
    stems = {f for f in good if f.endswith("*")}
    words = set(good) - stems
    for s in list(stems):
        if any(w.startswith(s[:-1]) and good[w][0] >= 0.95 * good[s][0] for w in words):
            stems.discard(s)
    short = {s for s in stems if not any(s[:k] + "*" in stems for k in range(1, len(s) - 1))}
    kept = [w for w in words if not any(w[:k] + "*" in short for k in range(1, len(w) + 1))]
    return sorted([*kept, *short], key=lambda f: (-good[f][0], f))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn the lexicon and the weight of its terms from labelled, not held-out rows.

    At most ``rows`` labelled ids, those of the smallest id hash, a bounded
    sample; several labels of one id count as their largest. Labels that are
    null or belong to no document are ignored. Without both classes the model
    has no terms and gives the base rate.
    """
    spark = docs.sparkSession
    B.ship(docs.sparkSession)
    own = labels.select(F.col(doc_id).cast("long").alias("_l"), F.col(label).cast("int").alias("_y")).dropna().filter(~held_out(F.col("_l")))
    own = own.groupBy("_l").agg((F.max("_y") > 0).alias("_y")).orderBy(F.xxhash64("_l"), "_l").limit(rows)
    train = docs.select(F.col(doc_id).cast("long").alias("_l"), F.col(text).alias("_text")).join(F.broadcast(own), "_l").select("_y", "_text", "_l")

    def signed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bands(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["_l", "bands"])

    # at most ``rows`` ids come to the driver
    group = copies(sorted((r[0], r.bands) for r in train.select("_l", "_text").mapInArrow(signed, "_l long, bands array<long>").collect()))
    group = spark.createDataFrame(list(group.items()), "_l long, _group long")

    def features(batches):
        n: dict[bool, Counter] = {True: Counter(), False: Counter()}
        now, held = None, {True: set(), False: set()}
        for b in batches:
            for y, t, g in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != now:
                    for k in held:
                        n[k].update(held[k])
                    now, held = g, {True: set(), False: set()}
                words = used((t or "").lower())
                held[y] |= words | {w[:k] + "*" for k in STEMS for w in words if len(w) > k} | {""}
                n[y][" "] += 1
        for k in held:
            n[k].update(held[k])
        every = list(n[True].keys() | n[False].keys())
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([n[True][f] for f in every], pa.int64()), pa.array([n[False][f] for f in every], pa.int64())], ["f", "toxic", "clean"])

    dealt = train.join(F.broadcast(group), "_l").select("_y", "_text", "_group").repartition(B.shuffle_parts(spark), "_group").sortWithinPartitions("_group")
    counts = B.stage(dealt.mapInArrow(features, "f string, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "features")
    total = {r.f: r for r in counts.filter("f in ('', ' ')").collect()}
    toxic, clean = (total[" "].toxic, total[" "].clean) if total else (0, 0)
    if not toxic or not clean:
        return Model([], {}, _logit((toxic + 0.5) / (toxic + clean + 1)) if toxic + clean else _logit(0.1))
    tried = counts.count()
    few = counts.filter("f not in ('', ' ') and toxic >= 3 and toxic >= 9 * clean").collect()  # of at most ``rows`` texts
    terms = choose_terms({r.f: (r.toxic, r.clean) for r in few}, total[""].toxic, total[""].clean, tried)
    told = spark.sparkContext.broadcast(terms)

    def seen(batches):
        m, n = Matcher(told.value), Counter()
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n.update((*f, y) for f in m.find(t))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in n], pa.int32()) for k in range(3)] + [pa.array([f[3] for f in n], pa.bool_()), pa.array(list(n.values()), pa.int64())], ["term", "edited", "said", "y", "n"])

    found = train.mapInArrow(seen, "term int, edited int, said int, y boolean, n long").groupBy("term", "edited", "said", "y").agg(F.sum("n").alias("n")).collect()
    by = Counter()
    for r in found:
        by[r.term, r.edited, r.said, r.y] += r.n
    base = toxic / (toxic + clean)
    evidence = {}
    for t in range(len(terms)):
        for edited in (0, 1):
            for said in (0, 1):
                # before any row is seen: a plain term is toxic, an edited one likely so, a mention is not
                prior, weight = ((0.9, 2), (0.3, 3))[said] if not edited else ((0.75, 2), (0.2, 3))[said]
                y, n = by[t, edited, said, True], by[t, edited, said, True] + by[t, edited, said, False]
                p = (y + prior * weight) / (n + weight)
                if edited and n > y:
                    # ordinary words lie near this one
                    p = _lower(y, n)
                evidence[t, edited, said] = max(0.0, _logit(p) - _logit(base))
    return Model(terms, evidence, _logit(base))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a double column ``name`` from 0 to 1 (replaced if there is one).

    Null and empty texts hold no term and score the base rate. Whole texts are
    read; equal texts score alike; labels and other columns play no part.
    """
    B.ship(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != name]
    schema = T.StructType([docs.schema[c] for c in names]).add(name, "double", False)

    def run(batches):
        m = told.value
        matcher = Matcher(m.terms)
        for b in batches:
            s = pa.array([m.score(matcher.find(t.as_py())) for t in b.column(text)], pa.float64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], s], [*names, name])

    return docs.select(*names).mapInArrow(run, schema)
