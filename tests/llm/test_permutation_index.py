import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SMALL
from trawl.llm import permutation_index as P

SCHEMA = "vec_id long, embedding array<float>, v string, shard string"


def asked():
    return F.col("vec_id") % 50 == 0



def brute(rows, k=5):
    """(query, neighbours) by exact cosine in double precision."""
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    ids = np.array([i for i, _ in rows])
    n = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = (x * x[q]).sum(axis=1) / (n * n[q])
        order = [b for b in np.lexsort((ids, -s)) if ids[b] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[b]), float(s[b])) for b in order]
    return out


def found(df, k=5):
    out = {}
    for r in P.nearest(df, asked(), k).orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / max(1, len(w)) for q, w in want.items()])


def test_recall_on_the_table(spark, sf):
    for d in (SMALL, sf):
        df = spark.read.parquet(f"{d}/embeddings.parquet")
        want = brute([(r.vec_id, r.embedding) for r in df.collect()])
        got = found(df)
        assert got.keys() == want.keys() and recall(got, want) >= 0.9
        truth = {(q, i): s for q, w in brute([(r.vec_id, r.embedding) for r in df.collect()], 10 ** 6).items() for i, s in w}
        assert all(abs(s - truth[q, i]) < 1e-12 for q, w in got.items() for i, s in w)


def test_recall_over_several_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ROWS", 400)
    monkeypatch.setattr(P, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 32))
    rows = [(k, [float(np.float32(x)) for x in centres[k % 20] + rng.normal(size=32)]) for k in range(2_000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    want = brute(rows)
    got = found(df)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9 and all(len(w) == 5 for w in got.values())


def test_ties_go_to_the_smaller_id(spark):
    same = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(k, same, "x", "y") for k in range(0, 3_000)], SCHEMA)
    got = found(df)
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[50]] == [0, 1, 2, 3, 4]


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([
        (0, [1.0, 0.0], "x", "y"), (0, [1.0, 0.0], "x", "y"), (1, [1.0, 1.0], "x", "y"), (2, None, "x", "y"), (3, [], "x", "y"),
        (4, [0.0, 0.0], "x", "y"), (5, [inf, 1.0], "x", "y"), (6, [nan, 1.0], "x", "y"), (7, [None, 1.0], "x", "y"),
        (None, [1.0, 0.0], "x", "y"), (50, [1.0, 0.0, 0.0], "x", "y"), (8, [-1.0, 0.0], "x", "y"), (100, None, "x", "y")], SCHEMA)
    got = found(df)
    assert got.keys() == {0} and [i for i, _ in got[0]] == [1, 8] and abs(got[0][1][1] + 1) < 1e-15
    assert P.nearest(df.limit(0), asked()).count() == 0
