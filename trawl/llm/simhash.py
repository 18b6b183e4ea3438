"""SimHash near-duplicates through vantage-point trees.

1. One pass over the texts gives each document a 64-bit SimHash fingerprint (Arrow batches, numpy bit counts).
2. Equal fingerprints collapse: from here on the work is on *distinct* fingerprints, so groups of copies cost one row.
3. The 64 bits are cut into ``parts`` halves.  Fingerprints that differ in at most ``k`` bits differ in at most
   ``k // parts`` bits of some half (pigeonhole), so each half is searched with that small radius.
4. Each half has a vantage-point tree: a node has a vantage point and a split distance; points at most that far go
   left, the others right.  A point's *home* shard is the leaf it falls into.  As a query it visits every leaf that
   the triangle inequality cannot rule out (left if ``d - r <= split``, right if ``d + r > split``), so points near a
   boundary also visit the shard beyond it.  The tree is only a routing structure, fitted on a bounded sample; any
   tree gives the exact pairs.
5. Inside a shard the home points are sorted by distance to a local vantage point, each query is compared with the
   band ``d - k .. d + k`` alone, and matching pairs are reduced to a spanning forest at once, so a dense shard
   gives as many links as it has points, never all its pairs.  A shard over ``SHARD`` points is dealt out as blocks
   of home points times blocks of queries: exact, and no task gets more than a block of each.
6. Connected components of the links (alternating large and small stars) give each document the smallest document
   id of its group.

Defined results: null and word-less texts have fingerprint zero and link like any other; a null id never becomes a
component id unless no document of the group has an id (then the component id is null); repeated rows are kept,
one result row each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import bounded_sample, fresh, materialize, text_or_empty

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
#: Most distinct fingerprints that the routing trees are fitted on.
TREE_SAMPLE = 20_000
#: Home points (and queries) that one task compares at a time.
SHARD = 2_048
#: Depth at which a tree stops; larger leaves are dealt out in blocks.
MAX_DEPTH = 14
#: A split that sends more than this share of the sample to both sides saves nothing.
MAX_OVERLAP = 0.55


# --- fingerprints -----------------------------------------------------------------------------------------------

def shingle_hashes(text: str | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every run of ``n`` words (all words, if fewer); A-Z lowered, words split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= n:
        return np.array([h(join(words), SEED)], np.uint64)
    runs = zip(*(words[k:] for k in range(n)))
    return np.fromiter((h(join(r), SEED) for r in runs), np.uint64, len(words) - n + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if more than half of the hashes have it; returned as a signed 64-bit number."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def row_key(id_col: str, text_col: str) -> Column:
    """Equal for rows with the same id and text, for no others."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col(f"`{id_col}`").cast("long").cast("string"), F.lit("null")),
                             F.md5(text_or_empty(f"`{text_col}`"))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 n: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, row_key, fp) for every row."""
    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "row_key": pdf["row_key"], "fp": np.array(
                [fingerprint(shingle_hashes(t, n)) for t in pdf["text"]], np.int64)})

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row_key"),
                      text_or_empty(f"`{text_col}`").alias("text"))
    return src.mapInPandas(batches, "doc_id long, row_key string, fp long")


# --- vantage-point trees ----------------------------------------------------------------------------------------

class Tree:
    """A vantage-point tree as two heap-ordered arrays; node 1 is the root, split -1 marks a leaf."""

    def __init__(self, mask: int, radius: int, vantage: np.ndarray, split: np.ndarray):
        self.mask, self.radius, self.vantage, self.split = np.uint64(mask), radius, vantage, split

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        node = np.ones(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.split[node] >= 0)
            if not len(inner):
                return node
            at = node[inner]
            d = np.bitwise_count((x[inner] ^ self.vantage[at]) & self.mask)
            node[inner] = 2 * at + (d > self.split[at])

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, leaf) of every leaf that can hold a point within the radius of each query."""
        idx, node = np.arange(len(x)), np.ones(len(x), np.int64)
        done_i, done_n = [], []
        while len(idx):
            leaf = self.split[node] < 0
            done_i.append(idx[leaf])
            done_n.append(node[leaf])
            idx, node = idx[~leaf], node[~leaf]
            d = np.bitwise_count((x[idx] ^ self.vantage[node]) & self.mask).astype(np.int64)
            s = self.split[node]
            left, right = d - self.radius <= s, d + self.radius > s
            idx = np.concatenate([idx[left], idx[right]])
            node = np.concatenate([2 * node[left], 2 * node[right] + 1])
        return np.concatenate(done_i), np.concatenate(done_n)


def fit_tree(sample: np.ndarray, mask: int, radius: int, depth: int) -> Tree:
    """Fit a tree to a sample: at each node the best of a few vantage points by the share of points near the split."""
    size = 1 << (min(depth, MAX_DEPTH) + 1)
    vantage, split = np.zeros(size, np.uint64), np.full(size, -1, np.int64)
    parts = {1: sample}
    m = np.uint64(mask)
    for node in range(1, size // 2):
        pts = parts.pop(node, np.empty(0, np.uint64))
        if len(pts) < 8:
            continue
        best = None
        for c in range(0, len(pts), max(1, len(pts) // 8)):
            d = np.bitwise_count((pts ^ pts[c]) & m).astype(np.int64)
            mid = int(np.median(d))
            for s in (mid - 1, mid):
                left = int((d <= s).sum())
                if s < 0 or not 0.2 <= left / len(pts) <= 0.8:
                    continue
                both = float(((d - radius <= s) & (d + radius > s)).mean())
                if best is None or both < best[0]:
                    best = (both, pts[c], s, d)
        if best is None or best[0] > MAX_OVERLAP:
            continue
        _, vantage[node], split[node], d = best
        parts[2 * node], parts[2 * node + 1] = pts[d <= split[node]], pts[d > split[node]]
    return Tree(mask, radius, vantage, split)


def fit_forest(distinct: DataFrame, n: int, max_bits: int, parts: int = 2) -> list[Tree]:
    """One tree for each part of the 64 bits, fitted on at most ``TREE_SAMPLE`` fingerprints (smallest hash first)."""
    rows = bounded_sample(distinct.select("fp"), F.col("fp"), n, TREE_SAMPLE).collect()
    sample = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    depth = max(0, int(np.ceil(np.log2(max(1, n) / SHARD))))
    width = 64 // parts
    masks = [((1 << (64 - width * p if p == parts - 1 else width)) - 1) << (width * p) for p in range(parts)]
    return [fit_tree(sample, mask, max_bits // parts, depth) for mask in masks]


# --- pairs within shards ----------------------------------------------------------------------------------------

def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make ``label`` equal (to the smallest) along the links a-b; labels are indices that point to a root."""
    while len(a):
        ra, rb = label[a], label[b]
        hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
        np.minimum.at(label, hi, lo)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]


def spanning_links(home: np.ndarray, query: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all pairs (home, query) within ``max_bits``; triangle bounds skip most comparisons."""
    pts, inv = np.unique(np.concatenate([home, query]), return_inverse=True)
    if not len(home) or len(pts) < 2:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    hi, qi = np.unique(inv[:len(home)]), np.unique(inv[len(home):])
    vantage = pts[hi[0]]
    dh, dq = np.bitwise_count(pts[hi] ^ vantage), np.bitwise_count(pts[qi] ^ vantage)
    order = np.argsort(dh, kind="stable")
    hi, dh = hi[order], dh[order].astype(np.int64)
    label = np.arange(len(pts))
    for d in np.unique(dq):
        a = np.searchsorted(dh, int(d) - max_bits, "left")
        b = np.searchsorted(dh, int(d) + max_bits, "right")
        band, qs = hi[a:b], qi[dq == d]
        step = max(1, (1 << 20) // max(1, len(band)))
        for at in range(0, len(qs) if len(band) else 0, step):
            q = qs[at:at + step]
            r, c = np.nonzero(np.bitwise_count(pts[q][:, None] ^ pts[band][None, :]) <= max_bits)
            if len(r):
                x, y = q[r], band[c]
                keep = x != y
                _union(label, x[keep], y[keep])
    moved = np.flatnonzero(label != np.arange(len(pts)))
    return pts[moved], pts[label[moved]]


def links(distinct: DataFrame, n: int, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) whose connected components are those of all pairs of fingerprints within ``max_bits``."""
    spark = distinct.sparkSession
    forest = fit_forest(distinct, n, max_bits)

    def routed(x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for t, tree in enumerate(forest):
            i, leaf = tree.visits(x)
            yield t, i, leaf, tree.home(x)[i] == leaf

    def counted(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        homes = [np.zeros(len(tree.split), np.int64) for tree in forest]
        visits = [np.zeros(len(tree.split), np.int64) for tree in forest]
        for pdf in it:
            for t, _, leaf, home in routed(pdf["fp"].to_numpy(np.int64).view(np.uint64)):
                homes[t] += np.bincount(leaf[home], minlength=len(homes[t]))
                visits[t] += np.bincount(leaf, minlength=len(visits[t]))
        for t, seen in enumerate(visits):
            leaf = np.flatnonzero(seen)
            yield pd.DataFrame({"t": t, "leaf": leaf, "homes": homes[t][leaf], "visits": seen[leaf]})

    # one row per leaf: bounded by the depth of the trees, whatever the input
    sizes = distinct.select("fp").mapInPandas(counted, "t int, leaf long, homes long, visits long") \
        .groupBy("t", "leaf").agg(F.sum("homes"), F.sum("visits")).collect()
    blocks = {(t, leaf): (-(-max(1, homes) // SHARD), -(-visits // (2 * SHARD)))
              for t, leaf, homes, visits in sizes}
    blocks_b = spark.sparkContext.broadcast(blocks)

    def dealt(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            fp = pdf["fp"].to_numpy(np.int64)
            x = fp.view(np.uint64)
            mix = (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for t, i, leaf, home in routed(x):
                hb = np.array([blocks_b.value[t, int(v)][0] for v in leaf], np.int64)
                qb = np.array([blocks_b.value[t, int(v)][1] for v in leaf], np.int64)
                m = mix[i].astype(np.int64)
                own_h, own_q = m % hb, (m // 7) % qb
                # queries go to every block of home points, home points to every block of queries
                for block in range(int(hb.max(initial=1))):
                    s = hb > block
                    yield pd.DataFrame({"t": t, "leaf": leaf[s], "hb": block, "qb": own_q[s], "fp": fp[i][s],
                                        "home": False})
                for block in range(int(qb.max(initial=1))):
                    s = home & (qb > block)
                    yield pd.DataFrame({"t": t, "leaf": leaf[s], "hb": own_h[s], "qb": block, "fp": fp[i][s],
                                        "home": True})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        home = pdf["home"].to_numpy(bool)
        a, b = spanning_links(fp[home], fp[~home], max_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return distinct.select("fp").mapInPandas(dealt, "t int, leaf long, hb int, qb int, fp long, home boolean") \
        .groupBy("t", "leaf", "hb", "qb").applyInPandas(joined, "a long, b long").distinct()


# --- components -------------------------------------------------------------------------------------------------

def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node of its component.

    Alternating large and small stars; each half round is written to the shared folder.  A hot node's minimum is
    pre-aggregated, and joining it back to its edges is a join that adaptive execution can split.
    """
    def min_join(directed: DataFrame) -> DataFrame:
        mins = directed.groupBy("u").agg(F.min("v").alias("m")) \
            .select("u", F.least("u", "m").alias("m"))
        return directed.join(mins, "u")

    def large(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        return min_join(both).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        j = min_join(down)
        return j.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")) \
            .union(j.select(F.col("u").alias("a"), F.col("m").alias("b")))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialize(edges.select("a", "b").filter("a <> b").distinct(), "links")
    before = state(now)
    for _ in range(max_rounds):
        now = materialize(small(large(now).distinct()).distinct(), "stars")
        after = state(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    raise RuntimeError("components did not settle")


def grouped(docs: DataFrame, id_col: str, text_col: str, n: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprint of every row, and (fp, root, first) of every fingerprint.

    ``first`` is the smallest (id is null, id, row key) of the whole group.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, n), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")), "distinct-fp")
    comp = components(links(nodes.select("fp"), nodes.count(), max_bits))
    rooted = nodes.join(comp, nodes["fp"] == comp["node"], "left") \
        .select("fp", F.col("first").alias("own"), F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("own").alias("first"))
    return marked, materialize(rooted.join(least, "root").select("fp", "root", "first"), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    n: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    marked, named = grouped(docs, id_col, text_col, n, max_bits)
    return marked.join(named, "fp").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def fingerprint_hex(fp: str = "fp") -> Column:
    """Sixteen lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         n: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group, with all columns: that with the smallest id, then the smallest row key.

    A row without an id stays only where no row of its group has one; of rows equal in id and text one stays.
    """
    key = fresh(docs.columns, "row_key__")
    _, named = grouped(docs, id_col, text_col, n, max_bits)
    stays = named.select(F.col("first.row_key").alias(key)).distinct()
    return docs.withColumn(key, row_key(id_col, text_col)).join(stays, key, "left_semi") \
        .dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])
