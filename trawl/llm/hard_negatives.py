"""Hard-negative mining with a GNAT-style multiway hyperplane tree.

Vectors are made of integers (components times ``scale``, rounded down), so scores, the inner products, are exact.

1. Build, level by level.  Rows stay single rows, each with the path of its node.  Every node with more than
   ``LEAF_ROWS`` rows chooses up to ``FANOUT`` split points: of the distinct vectors with the smallest hashes the ones
   farthest apart.  Its rows, dealt over tasks, go to the nearest split point (ties to the first), and the node stores
   for each split point and each sibling subtree the range of the distances between them, and the range of the norms.
   Nodes of one distinct vector stay leaves of any number of rows.  All levels together hold about one split point for
   every ``LEAF_ROWS`` / ``FANOUT`` rows, so the tree grows with the table, in Spark, and nothing of it is held by the driver.
2. Search.  Anchors are dealt into groups of a bounded size, leaves into slices of about ``SLICE_BYTES`` (the leaves of
   one node together, in large tables).  A group and a slice are a cell, a partition of one shuffle, which also gets the nodes above its leaves.
   A task holds its group, lets it descend those nodes and reads the rows of the leaves in batches against the anchors
   that have to see them; what it holds grows neither with the table nor with the number of anchors, rows move once
   a group, anchors once a slice, and the visits of anchors at leaves are never written.
   For an anchor a and a window of scores, a row x lies in an annulus around a, since
   |a - x|^2 = |a|^2 + |x|^2 - 2 score.  A sibling is passed over when the distances that the triangle
   inequality allows for its rows, intersected over the ranges to all split points, miss the annuli of all windows
   of the anchor.  Bounds are widened by ``SLACK``, far beyond the rounding of doubles, and leaves are exact, so no row is lost.
   A first descent along the nearest split points alone gives k scores that raise the lower end of each window
   before the whole descent.
3. Positives are the best rows with the anchor's label (no window); each positive opens the window of its
   negatives, ``low`` to ``high`` percent of its score, and one more search with the other labels answers all windows
   of an anchor at once.

Where vectors lie in clusters most subtrees are passed over.  Independent random directions in many dimensions have no
annulus that misses a subtree; then every leaf is scored.

Defined results: rows whose id, label or vector is null, whose vector is empty or holds null or non-finite components
take no part; rows with equal ids are one (the smallest label, then vector); vectors of different length never
meet; ties go to the smaller id; fewer rows than asked for are all returned; a positive with a negative score has
no window; scores must fit a long; labels are integers; extra columns are ignored, whatever their names; an empty
table gives an empty result.  (There are no texts.)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import materialize

LEAF_ROWS = 2_048
FANOUT = 16
#: Split points are chosen from this many distinct vectors of a node.
CANDIDATES = 3 * FANOUT
#: Anchors that a task of the search holds, and bytes of their vectors.
ASKS = 16_384
ASK_BYTES = 8 << 20
#: Bytes of vectors in a slice of the leaves.
SLICE_BYTES = 32 << 20
#: Leaves' worth of rows of one node that a task of the build deals out.
PACKS_A_TASK = 64
#: Rows found that a task merges at a time.
HELD_ROWS = 200_000
#: Scores (anchors x rows) computed at a time.
SCORES = 1 << 20
#: Relative widening of all distance bounds.
SLACK = 1e-6
#: A node this deep stays a leaf, of any number of rows (vectors that doubles cannot tell apart).
MAX_DEPTH = 64
NO_LOW, NO_HIGH = -(1 << 62), 1 << 62

_ROWS = ["ids", "labels", "vecs"]
_ASKS = [*_ROWS, "lo", "hi"]


def _mat(col: pa.Array) -> np.ndarray:
    """The matrix of a column of lists of one length."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _runs(col: pa.Array) -> Iterator[tuple[object, int, int]]:
    """(value, begin, end) of every run of equal values."""
    if len(col):
        code = col.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(col)]
        yield from ((col[a].as_py(), a, b) for a, b in zip(cuts, cuts[1:]))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products."""
    if a.size and b.size and a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


# ---------------------------------------------------------------- build

def _candidates(batches):
    """The distinct vectors of each node with the smallest hashes, of each batch of (node, vecs)."""
    for rows in batches:
        if not rows.num_rows:
            continue
        node = rows.column(0).dictionary_encode()
        code, out = node.indices.to_numpy(zero_copy_only=False), []
        by = np.argsort(code, kind="stable")
        for own in np.split(by, np.flatnonzero(np.diff(code[by])) + 1):
            v = _mat(rows.column(1).take(pa.array(own)))
            mixer = np.random.default_rng(17).integers(1, 1 << 63, (2, v.shape[1]), dtype=np.uint64) | np.uint64(1)
            h = (v.astype(np.uint64) * mixer[0]).sum(axis=1, dtype=np.uint64)
            h = (h ^ (h >> np.uint64(31))) * mixer[1, 0]
            h, first = np.unique(h, return_index=True)
            name = node.dictionary[int(code[own[0]])].as_py()
            out += [(name, int(x) >> 1, v[i].tobytes()) for x, i in zip(h[:CANDIDATES], first)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["node", "place", "vec"])


def _choose(pdf: pd.DataFrame) -> pd.DataFrame:
    """Split points of a node: from the first on, always the candidate farthest from those chosen."""
    pdf = pdf.sort_values(["place", "vec"])
    v = np.stack([np.frombuffer(b, np.int64) for b in pdf["vec"]])
    chosen, near = [0], distances(v, v[:1])[:, 0]
    near[0] = -1
    while len(chosen) < FANOUT and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(v, v[chosen[-1:]])[:, 0])
        near[chosen] = -1
    return pd.DataFrame({"node": [pdf["node"].iloc[0]], "m": [len(chosen)], "points": [v[chosen].tobytes()]})


_SPLIT = "node string, ids bigint, labels bigint, vecs array<bigint>, parent string, child int, near array<double>, " \
         "far array<double>, short double, long double"
_SPLIT_ARROW = pa.schema([
    ("node", pa.string()), ("ids", pa.int64()), ("labels", pa.int64()), ("vecs", pa.list_(pa.int64())), ("parent", pa.string()),
    ("child", pa.int32()), ("near", pa.list_(pa.float64())), ("far", pa.list_(pa.float64())), ("short", pa.float64()),
    ("long", pa.float64())])


def _assign(batches):
    """Rows (node, points, ids, labels, vecs), the points of a node first: rows with their child, and rows that hold the
    ranges of distances of a child to all split points."""
    node, points, ranges = None, None, {}

    def told():
        if ranges:
            yield pa.RecordBatch.from_pylist([{"parent": node, "child": c, "near": n.tolist(), "far": f.tolist(), "short": s,
                                               "long": x} for c, (n, f, s, x) in ranges.items()], schema=_SPLIT_ARROW)

    for rows in batches:
        starts = np.flatnonzero(rows.column(1).is_valid().to_numpy(zero_copy_only=False)).tolist()
        for a, b in zip([0, *starts], [*starts, rows.num_rows]):
            if a in starts and a < b:
                yield from told()
                node, ranges = rows.column(0)[a].as_py(), {}
                dim = int(node.split(".")[0])
                points = np.frombuffer(rows.column(1)[a].as_py(), np.int64).reshape(-1, dim)
                a += 1
            if a >= b:
                continue
            own = rows.slice(a, b - a)
            v = _mat(own.column(4))
            d = distances(v, points)
            child, norm = d.argmin(axis=1), np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
            for c in np.unique(child).tolist():
                at = child == c
                new = d[at].min(axis=0), d[at].max(axis=0), float(norm[at].min()), float(norm[at].max())
                old = ranges.get(c, new)
                ranges[c] = (np.minimum(old[0], new[0]), np.maximum(old[1], new[1]), min(old[2], new[2]), max(old[3], new[3]))
            names = pa.array([f"{node}.{c}" for c in range(len(points))]).take(pa.array(child))
            cols = [names, own.column(2), own.column(3), own.column(4)]
            cols += [pa.nulls(len(own), f.type) for f in list(_SPLIT_ARROW)[4:]]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, _SPLIT_ARROW)], schema=_SPLIT_ARROW)
    yield from told()


@dataclass
class Tree:
    """``levels``: for each level, the split nodes (node, m, points, ranges); ``leaves``: the rows (node, ids, labels, vecs,
    ``n``, always 1, and ``deal``, which parts a leaf of many rows); the number of rows and their bytes."""
    levels: list[DataFrame]
    leaves: DataFrame
    rows: int
    bytes: int


def _parent(node: str) -> Column:
    return F.regexp_replace(node, "[.][0-9]+$", "")


def build(rows: DataFrame) -> Tree:
    """The tree over ``rows`` (ids, labels, vecs)."""
    rows = rows.select(F.size("vecs").cast("string").alias("node"), *_ROWS)
    total = rows.agg(F.count("*"), F.sum(F.size("vecs") * 8 + 24)).first()
    levels, leaves = [], []
    while True:
        sizes = rows.groupBy("node").agg(F.count("*").alias("size"))
        sizes = sizes.filter((F.col("size") > LEAF_ROWS) & (F.size(F.split("node", "[.]")) <= MAX_DEPTH))
        sizes = materialize(sizes, "gnat-sizes")
        if sizes.isEmpty():
            break
        big = rows.join(sizes, "node", "left_semi")
        found = big.select("node", "vecs").mapInArrow(_candidates, "node string, place long, vec binary") \
            .groupBy("node", "place").agg(F.min("vec").alias("vec"))
        first = Window.partitionBy("node").orderBy("place")
        found = found.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= CANDIDATES).drop("r")
        points = found.groupBy("node").applyInPandas(_choose, "node string, m int, points binary").filter("m > 1")
        deals = F.ceil(F.col("size") / F.lit(LEAF_ROWS * PACKS_A_TASK)).cast("long").alias("deals")
        points = materialize(points.join(sizes, "node").select("node", "m", "points", deals), "gnat-points")
        if points.isEmpty():
            break
        # points and sizes are written, small tables: Spark broadcasts them under its own threshold
        leaves.append(rows.join(points.select("node"), "node", "left_anti"))
        told = points.select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"), "points",
                             *[F.lit(None).cast(t).alias(c) for c, t in zip(_ROWS, ("long", "long", "array<long>"))])
        dealt = rows.join(points.select("node", "deals"), "node").select(
            "node", F.pmod(F.xxhash64("ids"), "deals").alias("deal"), F.lit(None).cast("binary").alias("points"), *_ROWS)
        dealt = told.unionByName(dealt).repartition("node", "deal") \
            .sortWithinPartitions("node", "deal", F.col("points").desc_nulls_last())
        split = materialize(dealt.select("node", "points", *_ROWS).mapInArrow(_assign, _SPLIT), "gnat-split")
        ranges = split.filter("parent is not null") \
            .select("parent", "child", "short", "long", F.posexplode(F.arrays_zip("near", "far")).alias("point", "d")) \
            .groupBy("parent", "child", "point").agg(F.min("d.near").alias("near"), F.max("d.far").alias("far"),
                                                     F.min("short").alias("short"), F.max("long").alias("long")) \
            .groupBy(F.col("parent").alias("node")).agg(F.collect_list(F.struct(
                F.col("child").cast("double"), F.col("point").cast("double"), "near", "far", "short", "long")).alias("ranges"))
        levels.append(materialize(points.drop("deals").join(ranges, "node"), "gnat-level"))
        rows = split.filter("parent is null").select("node", *_ROWS)
    leaves.append(rows)
    out = leaves[0]
    for p in leaves[1:]:
        out = out.unionByName(p)
    # a leaf of one distinct vector can have any number of rows, which are dealt over the slices
    wide = materialize(out.groupBy("node").agg(F.count("*").alias("size")).filter(F.col("size") > LEAF_ROWS), "gnat-wide")
    deal = F.coalesce(F.pmod(F.xxhash64("ids"), F.ceil(F.col("size") / LEAF_ROWS).cast("long")), F.lit(0).cast("long"))
    out = out.join(wide, "node", "left").select("node", F.lit(1).alias("n"), *_ROWS, deal.alias("deal"))
    return Tree(levels, out, total[0], total[1] or 0)


# ---------------------------------------------------------------- search

def alive(vecs: np.ndarray, lo: np.ndarray, hi: np.ndarray, points: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """(anchors x children): False where no row of the child can score within any window of the anchor.

    ``ranges`` holds (child, point, near, far, short, long) rows."""
    m = len(points)
    child, point = ranges[:, 0].astype(int), ranges[:, 1].astype(int)
    near, far, short, long = np.full((m, m), np.inf), np.full((m, m), -np.inf), np.zeros(m), np.zeros(m)
    near[child, point], far[child, point] = ranges[:, 2], ranges[:, 3]
    short[child], long[child] = ranges[:, 4], ranges[:, 5]
    norm = np.sqrt((vecs.astype(np.float64) ** 2).sum(axis=1))[:, None]
    d = distances(vecs, points)[:, None, :]
    slack = SLACK * (norm + long.max() + np.sqrt((points.astype(np.float64) ** 2).sum(axis=1)).max() + 1)
    least = np.maximum(np.maximum(d - far, near - d).max(axis=2) - slack, 0)
    most = (d + far).min(axis=2) + slack
    best = (norm ** 2 + long ** 2 - least ** 2) / 2 + slack * (norm + long + 1)
    worst = (norm ** 2 + short ** 2 - most ** 2) / 2 - slack * (norm + long + 1)
    lo, hi = lo.astype(np.float64)[:, None, :], hi.astype(np.float64)[:, None, :]
    return ((lo <= hi) & (best[:, :, None] >= lo) & (worst[:, :, None] <= hi)).any(axis=2)


def _merged(found: list[np.ndarray], k: int) -> np.ndarray:
    """The k best rows (anchor, window, id, score) of each window of each anchor."""
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], -rows[:, 3], rows[:, 1], rows[:, 0]))]
    new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
    place = np.arange(len(rows)) - np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    return rows[place < k]


class _Asked:
    """Anchors of one vector length that descend the nodes of a cell and meet the rows of its leaves."""

    def __init__(self, rows: pa.Table, nearest_only: bool, same: bool, k: int):
        self.ids, self.labels = (rows.column(c).to_numpy() for c in ("ids", "labels"))
        self.vecs, self.lo, self.hi = (_mat(rows.column(c).combine_chunks()) for c in ("vecs", "lo", "hi"))
        self.lo = self.lo.copy()
        self.nearest_only, self.same, self.k = nearest_only, same, k
        self.at = {str(self.vecs.shape[1]): np.arange(len(self.ids))}       # the anchors that have to see a node
        self.held, self.n, self.settled = [], 0, 0

    def descend(self, node: str, points: np.ndarray, ranges: np.ndarray) -> None:
        who, step, go = self.at.pop(node, ()), max(1, SCORES // 4 // len(points) ** 2), []
        for a in range(0, len(who), step):
            own = who[a:a + step]
            if self.nearest_only:
                go.append(distances(self.vecs[own], points).argmin(axis=1)[:, None] == np.arange(len(points)))
            else:
                go.append(alive(self.vecs[own], self.lo[own], self.hi[own], points, ranges))
        if go:
            go = np.concatenate(go)
            self.at.update((f"{node}.{c}", who[go[:, c]]) for c in np.flatnonzero(go.any(axis=0)).tolist())

    def meet(self, who: np.ndarray, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray) -> None:
        step = max(1, SCORES // len(ids))
        for a in range(0, len(who), step):
            own = who[a:a + step]
            s, lo, hi = scores(self.vecs[own], vecs), self.lo[own], self.hi[own]
            q, c = np.nonzero((s >= lo.min(axis=1)[:, None]) & (s <= hi.max(axis=1)[:, None]))
            like = labels[c] == self.labels[own[q]]
            fit = like & (ids[c] != self.ids[own[q]]) if self.same else ~like
            q, c = q[fit], c[fit]
            s = s[q, c]
            for w in range(lo.shape[1]):
                at = np.flatnonzero((s >= lo[q, w]) & (s <= hi[q, w]))
                if len(at):
                    self.held.append(np.column_stack([own[q[at]], np.full(len(at), w), ids[c[at]], s[at]]))
                    self.n += len(at)
            if self.n > 2 * self.settled + HELD_ROWS:
                self.settle()

    def settle(self) -> None:
        """Keep the k best of each window; nothing below the last of k can be among the best."""
        rows = _merged(self.held, self.k)
        self.held, self.n, self.settled = [rows], len(rows), len(rows)
        last = np.flatnonzero(np.r_[(rows[1:, :2] != rows[:-1, :2]).any(axis=1), True])
        full = last[np.diff(np.r_[-1, last]) == self.k]
        at = rows[full, 0], rows[full, 1]
        self.lo[at] = np.maximum(self.lo[at], rows[full, 3])

    def found(self):
        if self.held:
            rows = _merged(self.held, self.k)
            for a in range(0, len(rows), HELD_ROWS):
                own = rows[a:a + HELD_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[own[:, 0]]), *[pa.array(own[:, i]) for i in (1, 2, 3)]],
                                                 names=["anchor", "win", "id", "score"])


def _walk(nearest_only: bool, same: bool = True, k: int = 0):
    """Rows of a cell (see ``_cells``): what its anchors find in its leaves; with no ``k``, the number of them at each leaf."""
    def run(batches):
        asked, groups, last = [], None, None
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            a, b = np.searchsorted(kind, [1, 2]).tolist()
            if a:
                asked.append(batch.slice(0, a).select(_ASKS))
            if a == batch.num_rows:
                continue
            if groups is None:
                if not asked:
                    return
                asked = pa.Table.from_batches(asked)
                dims = pc.list_value_length(asked.column("vecs")).to_numpy()
                groups = {str(d): _Asked(asked.take(pa.array(np.flatnonzero(dims == d))), nearest_only, same, k)
                          for d in np.unique(dims).tolist()}
                asked = None
            for i in range(a, b):
                node = batch.column("node")[i].as_py()
                dim = node.split(".")[0]
                if dim in groups:
                    ranges = batch.column("ranges")[i].values.flatten()
                    groups[dim].descend(node, np.frombuffer(batch.column("points")[i].as_py(), np.int64).reshape(-1, int(dim)),
                                        np.column_stack([x.to_numpy(zero_copy_only=False) for x in ranges]))
            rows = batch.slice(b)
            for node, x, y in _runs(rows.column("node")):
                g = groups.get(node.split(".")[0])
                who = () if g is None else g.at.get(node, ())
                if not len(who):
                    continue
                if k:
                    own = rows.slice(x, y - x)
                    g.meet(who, own.column("ids").to_numpy(), own.column("labels").to_numpy(), _mat(own.column("vecs")))
                elif node != last:
                    yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([len(who)])], names=["node", "n"])
                last = node
        for g in (groups or {}).values():
            yield from g.found()
    return run


def _cells(tree: Tree, asks: DataFrame, k: int) -> DataFrame:
    """Cells of a group of anchors and a slice of the leaves, one in a partition: the anchors (kind 0), the nodes above
    the leaves (1), parents first, and the rows of the leaves (2), by node."""
    stats = asks.agg(F.count("*"), F.max(F.size("vecs")), F.max(F.size("lo"))).first()
    dim, windows = max(1, stats[1] or 1), max(1, stats[2] or 1)
    most = max(1, min(ASKS, ASK_BYTES // (8 * dim), max(256, 4 * HELD_ROWS // (windows * max(1, k)))))
    groups = max(1, -(-stats[0] // most))
    tasks = 2 * asks.sparkSession.sparkContext.defaultParallelism
    slices = max(1, -(-tree.bytes // SLICE_BYTES), min(-(-tasks // groups), -(-tree.rows // LEAF_ROWS)))
    kinds = {"node": "string", "ids": "long", "labels": "long", "vecs": "array<long>", "lo": "array<long>", "hi": "array<long>",
             "points": "binary", "ranges": "array<struct<child:double,point:double,near:double,far:double,short:double,long:double>>"}

    def dealt(df: DataFrame, kind: int, group: Column, part: Column) -> DataFrame:
        df = df.withColumn("_group", group).withColumn("_slice", part)
        return df.select((F.col("_group") * slices + F.col("_slice")).cast("int").alias("_cell"), F.lit(kind).alias("kind"),
                         *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # the leaves below one node are kept together, but not where these would be much of a slice
    split = max(1, min(FANOUT, FANOUT * LEAF_ROWS * slices // max(1, tree.rows)))
    part = F.pmod(F.xxhash64(_parent("node"), F.pmod(F.xxhash64("node"), F.lit(split)), "deal"), F.lit(slices))
    cells = dealt(asks, 0, F.pmod(F.xxhash64("ids"), F.lit(groups)), each(slices))
    cells = cells.unionByName(dealt(tree.leaves, 2, each(groups), part))
    if tree.levels:
        inner = tree.levels[0]
        for level in tree.levels[1:]:
            inner = inner.unionByName(level)
        steps = F.split("above", "[.]")
        at = tree.leaves.select(part.alias("part"), _parent("node").alias("above")).distinct() \
            .select("part", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(
                F.slice(steps, F.lit(1), i), "."))).alias("node")).distinct()
        cells = cells.unionByName(dealt(inner.join(at, "node"), 1, each(groups), F.col("part")))
    return cells.repartitionById(groups * slices, "_cell").sortWithinPartitions("kind", "node").drop("_cell")


def visits(tree: Tree, asks: DataFrame, nearest_only: bool = False) -> DataFrame:
    """(node, n): the numbers of anchors at the leaves that they have to see, of each group."""
    return _cells(tree, asks, 0).mapInArrow(_walk(nearest_only), "node string, n long")


def _ranked(tree: Tree, asks: DataFrame, same: bool, k: int, nearest_only: bool) -> DataFrame:
    found = _cells(tree, asks, k).mapInArrow(_walk(nearest_only, same, k), "anchor long, win long, id long, score long")
    best = Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _asks(queries: DataFrame) -> DataFrame:
    """The anchors (ids, labels, vecs, lo, hi), written."""
    return materialize(queries.select(*_ASKS), "gnat-anchors")


def search(tree: Tree, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor, win, id, score, rank): the k best rows in each window of each query (ids, labels, vecs, lo[], hi[])."""
    queries = _asks(queries)
    if tree.levels:
        first = _ranked(tree, queries, same, k, nearest_only=True)
        # k rows found in a window: nothing below the last of them can be among the best
        raised = first.filter(F.col("rank") == k).groupBy(F.col("anchor").alias("ids")) \
            .agg(F.map_from_entries(F.collect_list(F.struct("win", "score"))).alias("raised"))
        queries = _asks(queries.join(raised, "ids", "left").withColumn("lo", F.transform("lo", lambda x, w: F.greatest(
            x, F.element_at("raised", w.cast("long"))))))
    return _ranked(tree, queries, same, k, nearest_only=False)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30,
                   high: int = 90, scale: float = 256.0, id_col: str = "vec_id", label: Column | None = None,
                   vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every row for which
    ``anchors`` (over ``ids``) holds and each of its ``positives`` best rows with the same ``label``, the ``negatives``
    best rows with other labels that score ``low`` to ``high`` percent of the positive."""
    v = F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = rows.select(F.col(f"`{id_col}`").cast("long").alias("ids"),
                        (F.col("label") if label is None else label).cast("long").alias("labels"),
                        F.when((F.size(v) > 0) & finite, F.transform(v, lambda x: F.floor(x.cast("double") * scale)))
                        .alias("vecs")).dropna()
    clean = clean.groupBy("ids").agg(F.min(F.struct("labels", "vecs")).alias("x")).select("ids", "x.labels", "x.vecs")
    clean = materialize(clean, "gnat-input")
    tree = build(clean)
    asked = clean.filter(anchors)
    free = asked.withColumn("lo", F.array(F.lit(NO_LOW))).withColumn("hi", F.array(F.lit(NO_HIGH)))
    best = materialize(search(tree, free, same=True, k=positives)
                       .select("anchor", F.col("id").alias("positive"), F.col("score").alias("p"),
                               (F.col("rank") - 1).cast("long").alias("win")), "gnat-positives")
    # integer arithmetic: ceil(low * p / 100) and floor(high * p / 100); no window for p < 0
    p = F.col("p")
    edges = best.withColumn("lo", F.when(p >= 0, F.expr(f"({low} * p + 99) div 100")).otherwise(NO_HIGH)) \
        .withColumn("hi", F.when(p >= 0, F.expr(f"{high} * p div 100")).otherwise(NO_LOW))
    edges = edges.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("win", "lo", "hi"))).alias("e"))
    slots = F.sequence(F.lit(0), F.lit(positives - 1))   # every anchor has as many windows, the missing ones empty

    def edge(field: str, missing: int) -> Column:
        return F.transform(slots, lambda i: F.coalesce(F.get(F.col("e"), i)[field], F.lit(missing))).alias(field)

    queries = asked.join(edges, asked["ids"] == edges["anchor"]) \
        .select("ids", "labels", "vecs", edge("lo", NO_HIGH), edge("hi", NO_LOW))
    found = search(tree, queries, same=False, k=negatives)
    return found.join(best, ["anchor", "win"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), F.col("p").alias("positive_score"), F.col("score").alias("negative_score"))
