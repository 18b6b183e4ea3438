import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.odd import ROWS, no_docs, odd_docs
from trawl.llm import quality_net as Q
from trawl.llm import toxicity as T
from trawl.llm.common import as_bool_learn


def held_out(spark, sf, scores, label):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = scores(spark.read.parquet(f"{sf}/documents.parquet"), labels).toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]).all()
    assert rows.score.between(0, 1).all()
    both = rows.merge(labels.toPandas(), on="doc_id")
    both = both[both.held_out]
    return both.score, both.predicted, both[label]


def test_quality_on_held_out_rows(spark, sf):
    score, predicted, y = held_out(spark, sf, Q.quality_scores, "quality")
    assert (predicted == y).mean() >= 0.97 and ((score - y) ** 2).mean() < 0.03


def test_toxicity_on_held_out_rows(spark, sf):
    score, predicted, y = held_out(spark, sf, T.toxicity_scores, "toxic")
    assert (predicted == y).mean() >= 0.93
    assert score[y == 1].mean() - score[y == 0].mean() > 0.4


@pytest.mark.parametrize("scores,label", [(Q.quality_scores, "quality"), (T.toxicity_scores, "toxic")])
def test_odd_rows(spark, scores, label):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 1), (3, 1), (2, 0), (99, 0)], f"doc_id long, {label} int")
    for labels in (none, odd):
        rows = scores(docs, labels).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (2, 3, 5)}) == 1 and len({r.score for r in rows if r.doc_id == 1}) == 1
        assert scores(no_docs(spark), labels).count() == 0


def test_temperature_calibrates():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3_000, 6))
    y = (rng.random(3_000) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)  # noisy labels
    net = Q.Net.fit(x[:2_000], y[:2_000], np.arange(2_000) % 5 == 0)
    p, z = net.scores(x[2_000:]), y[2_000:]
    raw = 1 / (1 + np.exp(-net.logits(x[2_000:])))

    def loss(s):
        return -np.mean(np.log(np.where(z > 0, s, 1 - s).clip(1e-9)))
    assert net.temperature > 1 and loss(p) < loss(raw) and abs(p.mean() - z.mean()) < 0.06


def test_context_table_equals_brute_force(spark):
    texts = ["the cat sat on the mat", "A cat!! the the mat", "", None, "cat"]
    got = Q.context_table(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want, index, types = np.zeros((Q.BUCKETS, Q.DIM)), Q.index_vectors().astype(float), Q._Types()
    for t in texts:
        k = Q.token_types(t or "", types)
        for a, b in zip(k, k[1:]):
            want[a // Q.SHAPES] += index[b]
            want[b // Q.SHAPES] += index[a]
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got, want / np.where(norm > 0, norm, 1), atol=1e-6)


def test_counterfactual_penalty_frees_neutral_mentions():
    fill = ["we met at the market today", "the weather was fine again", "a long walk by the river", "they cooked dinner at home"]
    toxic = [f"{f} you are a stupid muslim" for f in fill] * 6 + [f"{f} stupid fool" for f in fill] * 3
    clean = [f"{f} my christian neighbour came" for f in fill] * 6 + fill * 6
    texts, y = toxic + clean, np.array([1.0] * len(toxic) + [0.0] * len(clean))
    plain, fair = (T.fit_texts(texts, y, penalty=p) for p in (0.0, 5.0))
    a, b = "a muslim cooked dinner", "a christian cooked dinner"
    assert plain.score(a) - plain.score(b) > 0.1
    assert abs(fair.score(a) - fair.score(b)) < 0.3 * (plain.score(a) - plain.score(b))
    assert fair.score(a) < T.THRESHOLD <= fair.score("you stupid fool") and fair.score("a stupid christian, stupid") >= 0.5


def test_sparse_and_repeated_labels_fill_the_sample(spark):
    from trawl.llm.labelled import learn_sample

    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    ids = [r.doc_id for r in docs.filter(as_bool_learn(F.col("doc_id"))).orderBy("doc_id").limit(3_000).collect()]
    labels = docs.select("doc_id", F.when(F.col("doc_id") <= ids[-1], 1).alias("toxic"))
    assert learn_sample(docs, labels, "toxic", 1_000).count() == 1_000  # most labels are null
    twice = labels.filter("toxic = 1").unionByName(labels.filter("toxic = 1")).unionByName(labels.filter("toxic = 1"))
    assert learn_sample(docs, twice, "toxic", 2_000).count() == 2_000
    assert learn_sample(docs, labels, "toxic", 9_000).count() == 3_000
