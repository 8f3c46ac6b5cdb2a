"""Embedding near-dedup by NN-descent within labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _base as B
from . import vectors as V
from .graphs import components

#: Rows of a starting cell on average, starting partitions, and list length.
CELL, TREES, LIST = 256, 6, 16
#: Nearest list entries that a round's joins pass on.
PASS_ON = 6
#: Share of lists that must change for another round.
SETTLED = 0.002
#: Audited recall of links below which lists are doubled and refined again.
RECALL = 0.9
#: Cosines this near to the threshold are computed again in one order of additions.
BAND = 1e-9
#: Rows of one side of a counting block.
BLOCK = 2048


def _unit(raws: list[bytes]) -> np.ndarray:
    m = V.matrix(raws)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow of squares
    return m / np.sqrt((m**2).sum(1))[:, None]


def _linked(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether rows of ``x`` reach ``least`` with rows of ``y``: one answer a pair, whatever block it is met in."""
    sim = x @ y.T
    hit = sim >= least
    i, j = np.nonzero(np.abs(sim - least) < BAND)
    if len(i):
        hit[i, j] = V.dots(x[i], y[j]) >= least
    return hit


def _groups(batches, keys: int):
    """(key, columns as lists) of runs of equal first ``keys`` columns in sorted batches."""
    now, got = None, None
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for row in zip(*cols, strict=True):
            if row[:keys] != now:
                if got:
                    yield now, got
                now, got = row[:keys], [[] for _ in cols]
            for c, v in zip(got, row, strict=True):
                c.append(v)
    if got:
        yield now, got


def _tops(ids: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, sim) of each row's ``k`` largest off-diagonal similarities."""
    np.fill_diagonal(sim, -2)
    k = min(k, len(ids) - 1)
    best = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k < len(ids) - 1 else np.argsort(-sim, axis=1)[:, :k]
    return np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(sim, best, 1).ravel()


EDGE = "label long, u long, v long, sim double"


def _edges(label, u, v, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), label, np.int64)), pa.array(u), pa.array(v), pa.array(s)], ["label", "u", "v", "sim"])


def _keep(edges: DataFrame, k: int) -> DataFrame:
    """Each node's ``k`` nearest list entries, equal entries once."""
    w = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    once = edges.groupBy("u", "v").agg(F.first("label").alias("label"), F.max("sim").alias("sim"))
    return once.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def start(rows: DataFrame, dim: int, k: int, seed: int = 5) -> DataFrame:
    """First lists: exact nearest within random cells of each label, ``TREES`` different cuttings.

    Cells come from the signs of random projections, as many as leave about
    ``CELL`` rows a cell; a cell that is larger all the same is dealt into
    blocks, each compared within itself.
    """
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((TREES, 40, dim))

    def cells(batches):
        for b in batches:
            raws = b.column(2).to_pylist()
            if not raws:
                continue
            x = _unit(raws)
            depth = np.maximum(0, np.ceil(np.log2(np.maximum(1, b.column(3).to_numpy() / CELL)))).astype(np.int64)
            for t in range(TREES):
                bits = (x @ planes[t].T > 0).astype(np.int64)
                cell = (bits * (np.arange(40) < depth[:, None]) << np.arange(40)).sum(1)
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(np.full(len(raws), t, np.int32)), pa.array(cell), b.column(0), b.column(2)], ["label", "tree", "cell", "id", "raw"])

    def lists(batches):
        for (label, _, _), (_, _, _, ids, raws) in _groups(batches, 3):
            for a in range(0, len(ids), 4 * CELL):
                i = np.array(ids[a : a + 4 * CELL], np.int64)
                if len(i) > 1:
                    x = _unit(raws[a : a + 4 * CELL])
                    yield _edges(label, *_tops(i, x @ x.T, k))

    n = rows.groupBy("label").agg(F.count("*").alias("n"))
    dealt = rows.join(F.broadcast(n), "label").select("id", "label", "raw", "n").mapInArrow(cells, "label long, tree int, cell long, id long, raw binary")
    dealt = dealt.repartition(B.shuffle_parts(rows.sparkSession), "label", "tree", "cell").sortWithinPartitions("label", "tree", "cell", "id")
    return _keep(dealt.mapInArrow(lists, EDGE), k)


def descend(lists: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """One neighbours-of-neighbours round: the members of each node's list, both ways, meet one another.

    A node passes on its nearest ``PASS_ON`` entries and the nearest that name
    it; new pairs enter both lists.
    """
    near = lists.filter(F.col("place") <= PASS_ON)
    named = near.withColumn("back", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))).filter(F.col("back") <= PASS_ON)
    met = near.select(F.col("u").alias("hub"), F.col("v").alias("id")).unionByName(named.select(F.col("v").alias("hub"), F.col("u").alias("id")))
    met = met.unionByName(near.select(F.col("u").alias("hub"), F.col("u").alias("id"))).distinct()
    met = met.join(rows, "id").select("hub", "label", "id", "raw")

    def join(batches):
        for (_, label), (_, _, ids, raws) in _groups(batches, 2):
            i = np.array(ids, np.int64)
            if len(i) > 1:
                x = _unit(raws)
                yield _edges(label, *_tops(i, x @ x.T, len(i) - 1))

    new = met.repartition(B.shuffle_parts(rows.sparkSession), "hub").sortWithinPartitions("hub", "label", "id").mapInArrow(join, EDGE)
    return _keep(lists.select("label", "u", "v", "sim").unionByName(new.groupBy("u", "v").agg(F.first("label").alias("label"), F.max("sim").alias("sim")).select("label", "u", "v", "sim")), k)


def near_duplicates(vectors: DataFrame, least: float = 0.93, ident: str = "vec_id", vector: str = "embedding", label: str = "label", k: int = LIST) -> tuple[DataFrame, float]:
    """(rows: vec_id, n_links, component_id, kept; audited recall of links).

    Two rows of one non-null label link when their cosine is at least
    ``least``. Equal vectors of a label are one node with a multiplicity.
    NN-descent refines each node's ``k`` nearest until few lists change, however
    many rounds that takes. A list
    whose last entry still reaches ``least`` is saturated: its node is compared
    in blocks with its whole component and with every other node of its label
    within reach of that component by angle, so no partner is lost to the
    list's length; links found between components join them. The audit compares
    a bounded sample of nodes, saturated or not, with all nodes of their labels;
    below ``RECALL`` the lists are doubled and refined again. A pair at the
    threshold is computed in one order of additions, so that all steps agree.

    Null, empty, zero vectors, those with null or non-finite components, those
    of another dimension than the most usual one, and rows of a null label link
    with nothing; a null id links with nothing and stays its own row. Of
    repeated (id, label, vector) rows each is returned, and each is a link of
    the others. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    B.ship(vectors.sparkSession)
    all_rows = vectors.select(F.col(ident).cast("long").alias("vec_id"))
    rows = B.stage(V.packed(vectors.filter(F.col(label).isNotNull()).withColumn("_label", F.col(label).cast("long")), ident, vector, "_label").withColumnRenamed("_label", "label"), "vectors")
    usual = rows.groupBy(F.length("raw").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    alone = all_rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not usual:
        return alone, 1.0
    size = usual[0].size
    rows = rows.filter(F.length("raw") == size)
    same = B.stage(rows.groupBy("label", "raw").agg(F.min("id").alias("id"), F.count("*").alias("times")), "distinct")
    # an id repeated with other vectors may lead two nodes: nodes get numbers of their own
    nodes = B.stage(same.select("label", "raw", "times", F.col("id").alias("least_id"), F.monotonically_increasing_id().alias("id")), "nodes")
    only = nodes.select("id", "label", "raw")
    total = nodes.count()
    lists = B.stage(start(only, size // 8, k), "lists")
    while True:
        while True:
            after = B.stage(descend(lists, only, k), "lists")
            changed = after.join(lists, ["u", "v"], "left_anti").select("u").distinct().count()
            B.drop(lists)
            lists = after
            B.release(spark)
            if changed <= SETTLED * total:
                break
        counted, comp = partners(lists, nodes, only, least, k, size // 8)
        recall = audit(nodes, counted, comp, least)
        if recall >= RECALL or k >= total:
            break
        k *= 2  # lists of twice the length, begun anew from other cells
        lists = B.stage(_keep(lists.select("label", "u", "v", "sim").unionByName(start(only, size // 8, k, seed=k).select("label", "u", "v", "sim")), k), "lists")
    per = nodes.join(counted, nodes["id"] == counted["u"], "left").select("id", "label", "raw", "least_id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    per = per.join(comp, per["id"] == comp["node"], "left").select("label", "raw", "least_id", "n_links", F.coalesce("component", "id").alias("c"))
    per = B.stage(per, "counted")
    per = per.join(per.groupBy("c").agg(F.min("least_id").alias("component_id")), "c").select("label", "raw", "n_links", "component_id")
    per = B.stage(per, "named")
    linked = rows.join(per, ["label", "raw"]).select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    rest = vectors.filter(F.col(label).isNull() | F.col(ident).isNull() | ~V.usable(vectors, vector) | (F.size(vector) != size // 8))
    rest = rest.select(F.col(ident).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(ident).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(rest), recall


def partners(lists: DataFrame, nodes: DataFrame, only: DataFrame, least: float, k: int, dim: int) -> tuple[DataFrame, DataFrame]:
    """((u, n): rows linked with a node, (node, component)) from settled lists, saturated nodes compared in full; both staged."""
    links = B.stage(exact_links(lists, only, least), "links")
    comp = B.stage(components(links, "u", "v"), "components")
    full = lists.groupBy("u").agg(F.max("place").alias("n"), F.min("sim").alias("last")).filter((F.col("n") >= k) & (F.col("last") >= least - BAND)).select(F.col("u").alias("id"))
    full = B.stage(full, "saturated")
    weight = nodes.select(F.col("id").alias("v"), "times")
    counted = links.join(full, links["u"] == full["id"], "left_anti").join(weight, "v").groupBy("u").agg(F.sum("times").alias("n"))
    if full.limit(1).count():
        found = B.stage(enlarged(full, comp, nodes, least, dim), "enlarged")
        counted = counted.unionByName(found.filter("u is not null").select("u", "n")).groupBy("u").agg(F.sum("n").alias("n"))
        across = found.filter("a is not null").select("a", "b").distinct()
        if across.limit(1).count():
            # a component is named by one of its nodes, so these are links between nodes
            comp = B.stage(components(across.unionByName(comp.select(F.col("node").alias("a"), F.col("component").alias("b")))), "components")
    return B.stage(counted, "partners"), comp


def exact_links(lists: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """List entries, both ways, whose cosine in double precision reaches ``least``; those near it are computed again."""
    pairs = lists.filter(F.col("sim") >= least - BAND).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), (F.abs(F.col("sim") - least) < BAND).alias("near")).groupBy("u", "v").agg(F.max("near").alias("near"))
    pairs = B.stage(pairs, "reaching")

    def check(batches):
        for b in batches:
            if b.num_rows:
                x, y = _unit(b.column(2).to_pylist()), _unit(b.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays(b.columns[:2], ["u", "v"]).filter(pa.array(V.dots(x, y) >= least))

    near = pairs.filter("near").join(rows.select(F.col("id").alias("u"), F.col("raw").alias("x")), "u").join(rows.select(F.col("id").alias("v"), F.col("raw").alias("y")), "v")
    sure = pairs.filter("not near").select("u", "v").unionByName(near.select("u", "v", "x", "y").mapInArrow(check, "u long, v long"))
    return sure.unionByName(sure.select(F.col("v").alias("u"), F.col("u").alias("v")))


def enlarged(full: DataFrame, comp: DataFrame, nodes: DataFrame, least: float, dim: int) -> DataFrame:
    """(u, n) counts of links and (a, b) linked components, for saturated nodes.

    Saturated nodes are compared in blocks with their whole components and with
    the nodes that ``within_reach`` finds outside; a component is dealt over as
    many tasks as it has pairs of blocks. A link to an unsaturated node outside
    counts for that node too: as it leaves the component, no list holds it. A
    saturated one counts it itself, being in reach from the other side as well.
    Only counts and pairs of components leave a pair of blocks.
    """
    of = nodes.select("id", "label", "raw", "times").join(comp, F.col("id") == comp["node"], "left").select(F.coalesce("component", "id").alias("c"), "label", "id", "raw", "times")
    of = of.join(full.select(F.col("id").alias("_f")), F.col("id") == F.col("_f"), "left").withColumn("probe", F.col("_f").isNotNull()).drop("_f")
    of = B.stage(of, "members")
    probing = B.stage(of.groupBy("c").agg(F.max("probe").alias("any"), F.count_if("probe").alias("n")).filter("any").select("c", F.ceil(F.col("n") / BLOCK).cast("int").alias("rows")), "probing")
    right = of.join(probing.select("c"), "c", "left_semi").withColumn("own", F.col("c")).select("c", "own", "id", "raw", "times", "probe")
    right = B.stage(right.unionByName(within_reach(of, probing, least, dim)), "compared")
    sized = B.stage(probing.join(right.groupBy("c").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cols")), "c"), "blocks")
    right = right.join(sized, "c")
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = ["own", "id", "raw", "times", "probe"]
    left = right.filter("probe and own = c").withColumn("i", mine("rows")).select("c", "i", every("cols").alias("j"), F.lit(0).alias("side"), *rest)
    right = right.withColumn("j", mine("cols")).select("c", every("rows").alias("i"), "j", F.lit(1).alias("side"), *rest)

    def count(batches):
        for (c, _, _), (_, _, _, side, own, ids, raws, times, probe) in _groups(batches, 3):
            side, own, ids, times, probe, x = np.array(side), np.array(own, np.int64), np.array(ids, np.int64), np.array(times, np.int64), np.array(probe), _unit(raws)
            p, m = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            n, gained, across = np.zeros(len(p), np.int64), np.zeros(len(ids), np.int64), set()
            for a in range(0, len(m), BLOCK):
                some = m[a : a + BLOCK]
                hit = _linked(x[p], x[some], least) & (ids[p][:, None] != ids[some])
                n += hit @ times[some]
                outside = some[hit.any(0) & (own[some] != c)]
                across.update(own[outside].tolist())
                gained[some] = times[p] @ hit
            more = np.flatnonzero((gained > 0) & (own != c) & ~probe)
            u, n, b = [*ids[p].tolist(), *ids[more].tolist()], [*n.tolist(), *gained[more].tolist()], sorted(across)
            none, blank = [None] * len(u), [None] * len(b)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (u + blank, n + blank, none + [c] * len(b), none + b)], ["u", "n", "a", "b"])

    parts = B.shuffle_parts(full.sparkSession)
    pairs = left.unionByName(right).repartition(parts, "c", "i", "j").sortWithinPartitions("c", "i", "j", "side", "id")
    return pairs.mapInArrow(count, "u long, n long, a long, b long")


def within_reach(of: DataFrame, probing: DataFrame, least: float, dim: int) -> DataFrame:
    """(c, own, id, raw, times, probe): nodes of other components that some saturated node of component ``c`` may link with.

    Exact: a partner of a saturated node lies at most acos(least) from it, so
    from the component's centre at most that beyond its farthest saturated
    node. Nodes and centres of a label meet in pairs of blocks.
    """
    spark = of.sparkSession
    parts = B.shuffle_parts(spark)
    theta = float(np.arccos(np.clip(least, -1, 1))) + 1e-6
    own = of.filter("probe")

    def sums(batches):
        at: dict[int, list] = {}
        for b in batches:
            if b.num_rows:
                x = _unit(b.column(2).to_pylist())
                cs, which = np.unique(b.column(0).to_numpy(), return_inverse=True)
                total = np.zeros((len(cs), x.shape[1]))
                np.add.at(total, which, x)
                for c, label, v in zip(cs.tolist(), b.column(1).to_numpy()[np.unique(which, return_index=True)[1]].tolist(), total, strict=True):
                    at[c] = [label, at[c][1] + v] if c in at else [label, v]
        yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.int64()), pa.array([v[0] for v in at.values()], pa.int64()), pa.array([v[1].tobytes() for v in at.values()], pa.binary())], ["c", "label", "total"])

    def centre(batches):
        for (c, label), (_, _, totals) in _groups(batches, 2):
            v = V.matrix(totals).sum(0)
            norm = np.sqrt((v**2).sum())
            v = v / norm if norm > 1e-9 else np.eye(dim)[0]  # any point serves as a centre
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([label], pa.int64()), pa.array([v.tobytes()], pa.binary())], ["c", "label", "centre"])

    totals = own.select("c", "label", "raw").mapInArrow(sums, "c long, label long, total binary")
    centres = B.stage(totals.repartition(parts, "c", "label").sortWithinPartitions("c", "label").mapInArrow(centre, "c long, label long, centre binary"), "centres")

    def radius(batches):
        for (c, _), (_, _, _, raws) in _groups(batches, 2):
            if len(raws) > 1:
                x = _unit(raws)
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([float(np.arccos(np.clip(x[1:] @ x[0], -1, 1)).max())])], ["c", "far"])

    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = own.join(probing, "c").select("c", F.pmod(F.xxhash64("id"), F.col("rows")).cast("int").alias("i"), F.lit(1).alias("side"), "raw")
    members = members.unionByName(centres.join(probing, "c").select("c", every("rows").alias("i"), F.lit(0).alias("side"), F.col("centre").alias("raw")))
    far = members.repartition(parts, "c", "i").sortWithinPartitions("c", "i", "side").mapInArrow(radius, "c long, far double").groupBy("c").agg(F.max("far").alias("far"))
    centres = B.stage(centres.join(far, "c"), "reaches")
    sized = centres.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rows")).join(of.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cols")), "label")
    sized = F.broadcast(B.stage(sized, "labels"))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    near = centres.join(sized, "label").withColumn("i", deal("c", "rows")).select("label", "i", every("cols").alias("j"), F.lit(0).alias("side"), F.col("c").alias("id"), F.col("c").alias("own"), F.col("centre").alias("raw"), "far", F.lit(0).cast("long").alias("times"), F.lit(False).alias("probe"))
    met = of.join(sized, "label").withColumn("j", deal("id", "cols")).select("label", every("rows").alias("i"), "j", F.lit(1).alias("side"), "id", F.col("c").alias("own"), "raw", F.lit(0.0).alias("far"), "times", "probe")

    def reach(batches):
        for _, (_, _, _, side, ids, own, raws, far, times, probe) in _groups(batches, 3):
            side, own, far, x = np.array(side), np.array(own, np.int64), np.array(far), _unit(raws)
            m, p = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(m) or not len(p):
                continue
            least_cos = np.cos(np.minimum(np.pi, far[m] + theta)) - 1e-9
            for a in range(0, len(p), BLOCK):
                some = p[a : a + BLOCK]
                i, j = np.nonzero((x[m] @ x[some].T >= least_cos[:, None]) & (own[m][:, None] != own[some]))
                k = some[j].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(own[m][i]), pa.array(own[some][j]), pa.array([ids[q] for q in k], pa.int64()), pa.array([raws[q] for q in k], pa.binary()), pa.array([times[q] for q in k], pa.int64()), pa.array([probe[q] for q in k], pa.bool_())], ["c", "own", "id", "raw", "times", "probe"])

    pairs = near.unionByName(met).repartition(parts, "label", "i", "j").sortWithinPartitions("label", "i", "j", "side", "id")
    return pairs.mapInArrow(reach, "c long, own long, id long, raw binary, times long, probe boolean")


def audit(nodes: DataFrame, counted: DataFrame, comp: DataFrame, least: float, sample: int = 64) -> float:
    """Share of true links found, over ``sample`` nodes compared with all nodes of their labels.

    A node's links count as found as far as they are in its number of links
    and their ends in its component.
    """
    some = nodes.orderBy(F.xxhash64("raw"), "id").limit(sample).select("id", "label", "raw").collect()
    told = nodes.sparkSession.sparkContext.broadcast([(r.id, r.label, bytes(r.raw)) for r in some])

    def compare(batches):
        ids, labels, raws = zip(*told.value, strict=True)
        x, ids, labels = _unit(list(raws)), np.array(ids), np.array(labels)
        for b in batches:
            if b.num_rows:
                y, other, times = _unit(b.column(2).to_pylist()), b.column(0).to_numpy(), b.column(3).to_numpy()
                hit = _linked(x, y, least) & (labels[:, None] == b.column(1).to_numpy()) & (ids[:, None] != other)
                i, j = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(other[j]), pa.array(times[j])], ["u", "v", "times"])

    true = nodes.select("id", "label", "raw", "times").mapInArrow(compare, "u long, v long, times long")
    true = true.join(comp.select(F.col("node").alias("u"), F.col("component").alias("_cu")), "u", "left").join(comp.select(F.col("node").alias("v"), F.col("component").alias("_cv")), "v", "left")
    each = true.groupBy("u").agg(F.sum("times").alias("n"), F.sum(F.when(F.col("_cu") == F.col("_cv"), F.col("times")).otherwise(0)).alias("same"))
    each = each.join(counted.select("u", F.col("n").alias("got")), "u", "left")
    n, found = each.agg(F.sum("n"), F.sum(F.least("same", F.coalesce("got", F.lit(0))))).collect()[0]
    return found / n if n else 1.0
