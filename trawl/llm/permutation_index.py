"""Approximate nearest neighbours by a permutation index.

1. Vectors are dealt into shards of about ``SHARD_ROWS`` by a hash of their id.  A shard's pivots are the
   ``PIVOTS`` of its vectors with the smallest id hash.
2. Every vector of a shard is represented by its ``PREFIX`` nearest pivots in order, and posted, with the rank, in
   the inverted file of each of these pivots.
3. A query orders the same pivots, reads only the postings of its own ``PREFIX`` pivots, and adds up the footrule
   distance to every posted vector (a pivot missing from a prefix counts as rank ``PREFIX``).
4. The ``CANDIDATES`` share of the shard with the smallest footrule is ranked anew by the exact cosine, in double
   precision, and the shard's ``k`` best go on; a window over the few survivors gives the answer.

Queries travel in blocks to every shard, so no task holds more than one shard and one block.  Every vector is
indexed.  Shards have a fixed size, so the share of true neighbours found does not fall as the table grows.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows without an id,
take no part; equal ids are one vector (the smallest); vectors of different length are never compared; a query with
fewer than ``k`` candidates returns all of them; ties go to the smaller id; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import materialize

SHARD_ROWS = 1_024
QUERY_BLOCK = 4_096
PIVOTS = 256
PREFIX = 32
#: Share of a shard that is ranked by cosine, and the least number.
CANDIDATES = 0.25
MIN_CANDIDATES = 64


def usable(v: Column) -> Column:
    """True for vectors with a direction."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


class Shard:
    """The inverted files of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: int = PIVOTS, prefix: int = PREFIX):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.norm = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        mix = (self.ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x2545F4914F6CDD1D)
        chosen = np.argsort(mix, kind="stable")[:pivots]
        self.pivots = self.vectors[chosen] / self.norm[chosen, None]
        self.prefix = min(prefix, len(chosen))
        near = self.ordered(self.vectors)
        rows = np.repeat(np.arange(len(self.ids)), self.prefix)
        ranks = np.tile(np.arange(self.prefix), len(self.ids))
        by_pivot = np.argsort(near.ravel(), kind="stable")
        ends = np.searchsorted(near.ravel()[by_pivot], np.arange(len(chosen) + 1))
        self.rows = [rows[by_pivot[a:b]] for a, b in zip(ends, ends[1:])]
        self.ranks = [ranks[by_pivot[a:b]] for a, b in zip(ends, ends[1:])]
        self.size = np.diff(ends)

    def ordered(self, vectors: np.ndarray) -> np.ndarray:
        """The nearest pivots of each vector, in order."""
        return np.argsort(-(vectors @ self.pivots.T), axis=1, kind="stable")[:, :self.prefix]

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """The k best of the shard for each query, exact cosines on the candidates."""
        out = []
        size = max(MIN_CANDIDATES, int(CANDIDATES * len(self.ids)), k + 1)
        for q, qid, near in zip(queries, query_ids, self.ordered(queries)):
            # footrule = prefix * (prefix + 1) - sum over shared pivots of 2 * (prefix - later rank)
            rows = np.concatenate([self.rows[p] for p in near])
            later = np.maximum(np.concatenate([self.ranks[p] for p in near]),
                               np.repeat(np.arange(self.prefix), self.size[near]))
            shared = np.bincount(rows, 2.0 * (self.prefix - later), len(self.ids))
            footrule = self.prefix * (self.prefix + 1) - shared
            if size < len(footrule):
                # all below the cut, and the smallest ids of those on it
                cut = np.partition(footrule, size - 1)[size - 1]
                below = np.flatnonzero(footrule < cut)
                rows = np.concatenate([below, np.flatnonzero(footrule == cut)[:size - len(below)]])
            else:
                rows = np.arange(len(footrule))
            rows = rows[self.ids[rows] != qid]
            score = (self.vectors[rows] * q).sum(axis=1) / (self.norm[rows] * np.sqrt((q * q).sum()))
            best = np.lexsort((self.ids[rows], -score))[:k]
            out += [(int(qid), int(self.ids[rows[b]]), float(score[b])) for b in best]
        return out


def nearest(embeddings: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which ``queries`` (over ``vec_id``) holds."""
    v = F.col(f"`{vector_col}`")
    clean = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")) \
        .filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = materialize(clean.groupBy("vec_id").agg(F.min("v").alias("v"))
                       .select("vec_id", F.transform("v", lambda x: x.cast("double")).alias("v"),
                               F.size("v").alias("dim"), queries.alias("asked")), "vectors")
    total, asked = rows.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    shards, blocks = max(1, -(-total // SHARD_ROWS)), max(1, -(-asked // QUERY_BLOCK))
    shard_of = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    block_of = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    data = rows.select("dim", shard_of.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                       "vec_id", "v")
    asks = rows.filter("asked").select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
                                       block_of.alias("block"), "vec_id", "v")

    def searched(own: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        if own.empty or questions.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        shard = Shard(own["vec_id"].to_numpy(np.int64), np.stack(own["v"].to_numpy()))
        found = shard.search(np.stack(questions["v"].to_numpy()), questions["vec_id"].to_numpy(np.int64), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    key = ["dim", "shard", "block"]
    found = data.groupBy(*key).cogroup(asks.groupBy(*key)) \
        .applyInPandas(searched, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
