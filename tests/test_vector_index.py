"""The index returns the rows of the full scan, and scores few pairs where vectors lie in clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.operators import vector_index as V
from trawl.operators.retrieve import TILE_ROWS, _unit_rows, similar_chunks_batch

SCHEMA = "source_id string, chunk_number int, vector array<float>, chunk_text string"
Q_SCHEMA = "q_id long, qvec array<float>"


def chunk_frame(spark, vectors):
    return spark.createDataFrame([(f"d{k // 5}", k % 5, None if v is None else [float(x) for x in v], f"text {k}")
                                  for k, v in enumerate(vectors)], SCHEMA)


def question_frame(spark, vectors):
    return spark.createDataFrame([(k, None if v is None else [float(x) for x in v]) for k, v in enumerate(vectors)], Q_SCHEMA)


def clustered(n, dim=16, centres=40, spread=0.1, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return (c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)


def adversarial():
    """Equal vectors, opposite ones, two directions a hair apart, axes, other lengths, and vectors without a direction."""
    rng = np.random.default_rng(4)
    one = rng.normal(size=8)
    near = [one + 1e-6 * rng.normal(size=8) for _ in range(60)]
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1.0, 2.0], [2.0, 1.0], [-1.0, -2.0]]
    return [one] * 150 + [-one] * 70 + near + list(np.eye(8)) * 3 + list(-np.eye(8)) + odd + list(rng.normal(size=(80, 8)))


def rows(df):
    return sorted((r.q_id, r.rank, r.source_id, r.chunk_number, r.chunk_text, round(r.similarity, 9)) for r in df.collect())


@pytest.mark.parametrize("k, threshold", [(3, None), (7, 0.5), (None, 0.9)])
@pytest.mark.parametrize("kind", ["clustered", "random", "adversarial"])
def test_equals_the_full_scan(spark, kind, k, threshold):
    vectors = {"clustered": lambda: list(clustered(900)), "adversarial": adversarial,
               "random": lambda: list(np.random.default_rng(2).normal(size=(500, 12)))}[kind]()
    chunks = chunk_frame(spark, vectors).repartition(4)
    asked = question_frame(spark, vectors[::17] + [None, [0.0] * 8, [1.0]])
    index = V.build_index(chunks, payload_cols=("chunk_text",), tile_rows=16)
    got = V.search_index(index, asked, k, threshold, payload_cols=("chunk_text",), chunks=chunks, slice_bytes=2_000)
    want = similar_chunks_batch(chunks, asked, k, threshold, payload_cols=("chunk_text",))
    assert got.columns == want.columns and rows(got) == rows(want)


def local_scan(index, vectors, k):
    """The scan over all tiles in one process, floors found first as in the search."""
    unit = _unit_rows(np.asarray(vectors, np.float32))
    tiles = list(index.toPandas().itertuples(index=False))
    first = V.Scan(np.arange(len(unit)), unit, np.full(len(unit), V.NONE), k)
    b = np.concatenate([V.bounds(unit, np.frombuffer(t.centre, np.float64)[None, :], np.array([t.radius])) for t in tiles], axis=1)
    for t, tile in enumerate(tiles):
        who = np.flatnonzero((np.argsort(-b, axis=1, kind="stable")[:, :V.FIRST] == t).any(axis=1))
        list(first.tile(tile, who))
    scan = V.Scan(np.arange(len(unit)), unit, first.best.min(axis=1), k)
    for tile in tiles:
        list(scan.tile(tile))
    return scan, b, tiles, unit


def test_few_pairs_are_scored_on_clusters(spark):
    vectors = clustered(6_000)
    index = V.build_index(chunk_frame(spark, vectors), tile_rows=64)
    scan, _, tiles, unit = local_scan(index, vectors[::60], 3)
    assert scan.met == len(tiles) * 100 and scan.scored < 0.2 * scan.met, (scan.scored, scan.met)
    sims = np.rint((unit @ _unit_rows(vectors).T) * 1e9).astype(np.int64)
    assert (np.sort(scan.best, axis=1) == np.sort(sims, axis=1)[:, -3:]).all()


def test_bounds_hold(spark):
    """No chunk scores above the bound of its tile, whatever the vectors."""
    for vectors in (adversarial(), list(np.random.default_rng(3).normal(size=(300, 3)))):
        index = V.build_index(chunk_frame(spark, vectors), tile_rows=8)
        dim = max(len(v) for v in vectors if v is not None)
        asked = [v for v in vectors if v is not None and len(v) == dim and np.isfinite(v).all() and np.any(v)]
        unit = _unit_rows(np.asarray(asked, np.float32))
        for t in index.where(F.col("dim") == dim).toPandas().itertuples(index=False):
            s = unit @ _unit_rows(np.frombuffer(t.vecs, np.float32).reshape(t.n, t.dim)).T
            b = V.bounds(unit, np.frombuffer(t.centre, np.float64)[None, :], np.array([t.radius]))[:, 0]
            assert (s.max(axis=1) <= b).all()


def test_index_holds_every_usable_vector_once(spark):
    vectors = adversarial()
    index = V.build_index(chunk_frame(spark, vectors), tile_rows=16)
    usable = sum(v is not None and len(v) > 0 and np.isfinite(v).all() and bool(np.any(v)) for v in vectors)
    got = index.agg(F.sum("n"), F.max("n")).first()
    assert got[0] == usable and got[1] <= 16 < TILE_ROWS
    assert index.select("tile").distinct().count() == index.count()


def test_empty(spark):
    chunks = chunk_frame(spark, [[1.0, 0.0]])
    index = V.build_index(chunks.limit(0))
    assert index.count() == 0
    asked = question_frame(spark, [[1.0, 0.0]])
    assert V.search_index(index, asked, chunks=chunks).count() == 0
    assert V.search_index(V.build_index(chunks), asked.limit(0), chunks=chunks).count() == 0


def test_plan_has_no_cross_join(spark):
    chunks = chunk_frame(spark, clustered(400))
    index = V.build_index(chunks, tile_rows=32)
    plan = V.search_index(index, question_frame(spark, clustered(9)), 3, chunks=chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and "cross" not in plan.lower()
