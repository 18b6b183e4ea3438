import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, duck
from trawl.llm import hard_negatives as H
from trawl.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, label int, embedding array<double>, ids string, node string, score string"


def brute(rows, step, positives=5, negatives=10):
    """(anchor, positive, rank, negative, scores) by comparing everything with everything."""
    out = set()
    v = {i: np.floor(256 * np.asarray(x, np.float64)).astype(np.int64) for i, _, x in rows}
    label = {i: c for i, c, _ in rows}
    for a in sorted(i for i in v if i % step == 0):
        s = {i: int(v[a] @ v[i]) for i in v if i != a and len(v[i]) == len(v[a])}
        order = sorted(s, key=lambda i: (-s[i], i))
        for p in [i for i in order if label[i] == label[a]][:positives]:
            fit = [i for i in order if label[i] != label[a] and 30 * s[p] <= 100 * s[i] <= 90 * s[p]]
            out |= {(a, p, r + 1, i, s[p], s[i]) for r, i in enumerate(fit[:negatives])}
    return out


def mined(spark, rows, step, **kw):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = [tuple(r) for r in H.hard_negatives(df, F.col("ids") % step == 0, **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def clustered(n, dim=16, centres=30, spread=0.15, seed=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    x = c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(int(k), int(rng.integers(0, 4)), x[k].tolist()) for k in range(n)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(H, "LEAF_ROWS", 32)
    monkeypatch.setattr(H, "FANOUT", 4)
    monkeypatch.setattr(H, "CANDIDATES", 12)
    monkeypatch.setattr(H, "ASKS", 8)
    monkeypatch.setattr(H, "PACKS_A_TASK", 2)


def test_equals_brute_force_in_a_deep_tree(spark, small):
    rows = clustered(1_200)
    got = mined(spark, rows, 20)
    assert got == brute(rows, 20) and len(got) > 500


def test_random_directions(spark, small):
    rng = np.random.default_rng(5)
    rows = [(k, k % 3, rng.normal(size=12).tolist()) for k in range(400)]
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_copies_and_ties(spark, small):
    """A third of the rows is one vector, others come in groups of equal vectors."""
    rng = np.random.default_rng(8)
    few = rng.normal(size=(9, 6))
    rows = [(k, int(rng.integers(0, 3)), (few[0] if k % 3 == 0 else few[k % 9]).tolist()) for k in range(600)]
    got = mined(spark, rows, 50)
    assert got == brute(rows, 50)


def test_subtrees_are_passed_over(spark, small):
    """On clustered vectors the windows of positives meet a small part of the leaves, and none that matters is missed."""
    rows = clustered(3_000, dim=8, centres=40, spread=0.03)
    df = spark.createDataFrame([(i, c, [int(np.floor(256 * y)) for y in x]) for i, c, x in rows],
                               "ids long, labels long, vecs array<long>")
    tree = H.build(df)
    assert len(tree.levels) > 2 and tree.leaves.agg(F.sum("n")).first()[0] == 3_000
    asks = df.filter("ids % 100 = 0").withColumn("lo", F.array(F.lit(55_000))).withColumn("hi", F.array(F.lit(62_000)))
    seen = H.visits(tree, H._asks(asks)).agg(F.sum("n")).first()[0]
    leaves = tree.leaves.select("node").distinct().count()
    assert seen < 0.35 * leaves * 30, (seen, leaves)
    got = {(r.anchor, r.id) for r in H.search(tree, asks, same=False, k=10 ** 6).collect()}
    v = {i: np.floor(256 * np.array(x)).astype(int) for i, _, x in rows}
    label = {i: c for i, c, _ in rows}
    assert got == {(a, i) for a in v if a % 100 == 0 for i in v if label[i] != label[a] and 55_000 <= v[a] @ v[i] <= 62_000}


def test_bounds_hold_for_random_trees():
    """No child is passed over that holds a row within a window."""
    rng = np.random.default_rng(11)
    for _ in range(200):
        dim, m = int(rng.integers(1, 9)), int(rng.integers(2, 6))
        x = (rng.normal(size=(60, dim)) * 300).astype(np.int64)
        points = x[:m]
        d = H.distances(x, points)
        child = d.argmin(axis=1)
        norm = np.linalg.norm(x.astype(float), axis=1)
        ranges = np.array([(c, p, d[child == c, p].min(), d[child == c, p].max(), norm[child == c].min(), norm[child == c].max())
                           for c in np.unique(child) for p in range(m)])
        a = (rng.normal(size=(20, dim)) * 300).astype(np.int64)
        lo = rng.integers(-50_000, 200_000, (20, 2))
        hi = lo + rng.integers(0, 60_000, (20, 2))
        ok = H.alive(a, lo, hi, points, ranges)
        s = a @ x.T
        for c in np.unique(child):
            hit = ((s[:, None, child == c] >= lo[:, :, None]) & (s[:, None, child == c] <= hi[:, :, None])).any(axis=(1, 2))
            assert not (hit & ~ok[:, c]).any()


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.5, 0.5]), (3, 2, [0.9, 0.0]), (4, None, [1.0, 1.0]),
            (5, 1, None), (6, 1, []), (7, 1, [nan, 1.0]), (8, 1, [inf, 1.0]), (9, 2, [None, 1.0]), (None, 1, [1.0, 1.0]),
            (10, 2, [0.5, 0.5, 0.5]), (100, 3, [0.0, 0.0]), (11, 3, [-0.0, 0.0]), (12, 2, [-1.0, 0.0])]
    clean = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.5, 0.5]), (3, 2, [0.9, 0.0]), (10, 2, [0.5, 0.5, 0.5]),
             (100, 3, [0.0, 0.0]), (11, 3, [0.0, 0.0]), (12, 2, [-1.0, 0.0])]
    got = mined(spark, rows, 100)
    assert got == brute(clean, 100) and len(got) > 2
    df = spark.createDataFrame([], SCHEMA)
    assert H.hard_negatives(df, F.col("ids") % 100 == 0).count() == 0


def test_scores_beyond_doubles_are_exact():
    a = np.array([[3_000_000_001, 7]], np.int64)
    assert H.scores(a, a)[0, 0] == 3_000_000_001 ** 2 + 49


def test_query_equals_sql(spark, sf):
    for d in (sf, "/root/testdata/sf0.1"):
        problems, n = compare(QUERIES["op13_gnat_hard_negatives"](spark, d), duck(d), ORACLES["op13_gnat_hard_negatives"])
        assert not problems and n > 0


def test_many_cells_equal_brute_force(spark, small, monkeypatch):
    """Groups of a few anchors and slices of a few leaves, also of a leaf of one vector, lose and repeat nothing."""
    monkeypatch.setattr(H, "SLICE_BYTES", 8_000)
    rows = clustered(500, dim=6, centres=12)
    rows += [(k, k % 3, [0.5] * 6) for k in range(500, 700)] + [(k, k % 2, [0.25 * k, 1.0]) for k in range(700, 760)]
    got = mined(spark, rows, 20)
    assert got == brute(rows, 20)


def test_no_row_grows_with_the_table(spark, monkeypatch):
    """tables hold single vectors and the split points of one node, no packs of rows and no visits of anchors."""
    monkeypatch.setattr(H, "LEAF_ROWS", 256)
    written, real = {}, H.materialize

    def spy(df, name):
        out = real(df, name)
        written.setdefault(name, []).append(out)
        return out
    monkeypatch.setattr(H, "materialize", spy)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in clustered(3_000)], SCHEMA)
    assert H.hard_negatives(df, F.col("ids") % 20 == 0).count() > 0
    widest, rows = 0, {}
    for name, frames in written.items():
        for out in frames:
            size = [F.coalesce(F.length(c) if t == "binary" else F.size(c) * 8, F.lit(0)) for c, t in out.dtypes
                    if t == "binary" or t.startswith("array")]
            got = out.agg(F.count("*"), F.max(sum(size, F.lit(0)))).first()
            widest, rows[name] = max(widest, got[1] or 0), max(rows.get(name, 0), got[0])
    assert widest <= H.FANOUT * 16 * 8 + H.FANOUT * H.FANOUT * 48, widest
    assert max(rows.values()) <= 3_000 * 1.5 and rows["gnat-anchors"] == 150, rows


def test_slices_are_even(spark):
    """No task of the search reads much more rows than others, also where all leaves are below the root."""
    df = spark.createDataFrame([(i, c, [int(np.floor(256 * y)) for y in x]) for i, c, x in clustered(6_000, centres=400)],
                               "ids long, labels long, vecs array<long>")
    tree = H.build(df)
    asks = df.filter("ids % 100 = 0").withColumn("lo", F.array(F.lit(0))).withColumn("hi", F.array(F.lit(9)))
    sizes = [r[1] for r in H._cells(tree, H._asks(asks), 5).filter("kind = 2").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 6_000 and len(sizes) > 1 and max(sizes) < 4_500, sizes


def test_running_best_raises_the_windows(monkeypatch):
    monkeypatch.setattr(H, "HELD_ROWS", 10)
    rng = np.random.default_rng(2)
    v = rng.integers(-50, 50, (400, 5))
    label = rng.integers(0, 2, 400)
    rows = H.pa.table({"ids": H.pa.array(range(20)), "labels": H.pa.array(label[:20]), "vecs": H.pa.array(v[:20].tolist()),
                       "lo": H.pa.array([[-3_000, 0]] * 20), "hi": H.pa.array([[2_000, H.NO_HIGH]] * 20)})
    g = H._Asked(rows, False, False, 3)
    for a in range(0, 400, 40):
        g.meet(np.arange(20), np.arange(a, a + 40), label[a:a + 40], v[a:a + 40])
    got = {tuple(r.values()) for b in g.found() for r in b.to_pylist()}
    want = set()
    for a in range(20):
        for w, (lo, hi) in enumerate([(-3_000, 2_000), (0, H.NO_HIGH)]):
            fit = [i for i in range(400) if label[i] != label[a] and lo <= v[a] @ v[i] <= hi]
            want |= {(a, w, i, int(v[a] @ v[i])) for i in sorted(fit, key=lambda i: (-(v[a] @ v[i]), i))[:3]}
    assert got == want and (g.lo[:, 1] > 0).all()
