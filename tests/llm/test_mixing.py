import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.odd import ROWS, no_docs, odd_docs
from trawl.llm import mixing as M


@pytest.fixture(scope="module")
def tokens(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{s}", lang, topic, int(rng.integers(50, 500) * (40 if s == 0 else 1)))
            for s in range(6) for lang in ("en", "fr", "de") for topic in ("x", "y") if rng.random() < 0.9 or s == 0]
    return spark.createDataFrame(rows, "source string, lang string, topic string, n_tokens long")


def test_marginals_meet_targets_like_plain_raking(spark, tokens):
    lang = {"en": 0.5, "fr": 0.3, "de": 0.2}
    fit = M.rake(tokens, lang_targets=lang, keep=0.01)
    a = {r.source: r.a for r in fit.sources.collect()}
    w = dict(zip(fit.pairs, fit.weights))
    cells = [(r.source, r.lang, r.topic, r.n_tokens) for r in tokens.collect()]
    mass = {(s, lg, t): n * a[s] * w[lg, t] for s, lg, t, n in cells}
    # numpy-free raking of the same table
    plain = {(s, lg, t): float(n) for s, lg, t, n in cells}
    totals = [{}, {}, {}]
    for k, n in plain.items():
        for at in range(3):
            totals[at][k[at]] = totals[at].get(k[at], 0.0) + n
    want = [M._targets(t, lang if at == 1 else None, M.ALPHA) for at, t in enumerate(totals)]
    for _ in range(300):
        for at in range(3):
            now = {}
            for k, v in plain.items():
                now[k[at]] = now.get(k[at], 0.0) + v
            plain = {k: v * want[at][k[at]] / now[k[at]] for k, v in plain.items()}
    assert mass.keys() == plain.keys() and max(abs(mass[k] - plain[k]) for k in mass) < 1e-7
    expected = sum(n * min(1, fit.scale * a[s] * w[lg, t]) for s, lg, t, n in cells)
    assert abs(expected - 0.01 * sum(n for *_, n in cells)) < 1e-6 * expected


def leaky(spark, share, langs=4):
    """20 sources with ``share`` of their tokens outside their main language."""
    rng = np.random.default_rng(0)
    rows = []
    for s in range(20):
        total, topics = int(rng.integers(10 ** 6, 10 ** 8)), rng.dirichlet(np.ones(2))
        for lang in range(langs):
            part = 1 - share if lang == s % langs else share / (langs - 1)
            rows += [(f"s{s}", f"l{lang}", f"t{t}", int(total * part * q)) for t, q in enumerate(topics)]
    return spark.createDataFrame(rows, "source string, lang string, topic string, n_tokens long")


def test_slow_tables_meet_their_targets(spark):
    assert M.rake(leaky(spark, 1e-3)).error <= M.TOLERANCE


def test_targets_that_cannot_be_met_are_reported(spark, caplog):
    fit = M.rake(leaky(spark, 0.0))
    assert fit.error > 1e-3 and fit.cycles < M.MAX_CYCLES and "cannot meet" in caplog.text


def test_sample_follows_the_probabilities(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
        F.when(F.col("id") % 5 == 0, "fr").otherwise("en").alias("lang"), F.lit("one two three four").alias("text"))
    got = M.with_probability(docs, keep=0.2, seed=3).agg(
        F.sum("probability"), F.count_if("sampled"), F.sum(F.when(F.col("lang") == "fr", F.col("probability")))).first()
    assert abs(got[0] - 4_000) < 1 and abs(got[1] - 4_000) < 200
    fr = 4_000 ** 0.5 / (4_000 ** 0.5 + 16_000 ** 0.5)
    assert abs(got[2] / got[0] - fr) < 1e-6


def test_plan_is_native(spark):
    plan = M.with_probability(odd_docs(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval"))


def test_odd_rows(spark):
    docs = odd_docs(spark)
    names = ("m_topic", "m_tokens", "m_p", "m_in")
    rows = M.with_probability(docs, names=names).collect()
    assert len(rows) == len(ROWS)
    assert {r.doc_id for r in rows if r.m_tokens == 0} == {2, 3, 5} and all(r.m_p == 0 for r in rows if not r.m_tokens)
    assert len({r.m_in for r in rows if r.doc_id == 1}) == 1
    assert M.sample_mixture(docs).columns == docs.columns
    assert M.sample_mixture(no_docs(spark)).count() == 0
    assert all(r.m_p > 0.999999 for r in M.with_probability(docs, names=names, keep=1.0).collect() if r.m_tokens)


def test_many_languages_and_topics(spark):
    """5,000 languages, 20,000 pairs, of plain raking in numpy."""
    rng = np.random.default_rng(7)
    s, lg, tp = np.meshgrid(np.arange(7), np.arange(5_000), np.arange(4), indexing="ij")
    keep = rng.random(s.shape) < 0.8
    s, lg, tp = s[keep], lg[keep], tp[keep]
    n = rng.integers(1, 10_000, len(s)) * np.where(s == 0, 50, 1)
    pdf = pd.DataFrame({"source": [f"s{x}" for x in s], "lang": [f"l{x}" for x in lg], "topic": [f"t{x}" for x in tp], "n_tokens": n})
    fit = M.rake(spark.createDataFrame(pdf), keep=0.001)
    assert fit.error <= M.TOLERANCE and len(fit.pairs) > 19_000
    a = {r.source: r.a for r in fit.sources.collect()}
    got = n * np.array([a[f"s{x}"] * fit.lang_weights[f"l{y}"] * fit.topic_weights[f"t{z}"] for x, y, z in zip(s, lg, tp)])
    plain = n.astype(float)
    totals = [np.bincount(k, n) for k in (s, lg, tp)]
    want = [t ** M.ALPHA / (t ** M.ALPHA).sum() for t in totals]
    for _ in range(100):
        for k, w in zip((s, lg, tp), want):
            plain *= (w / np.bincount(k, plain))[k]
    assert np.abs(got - plain).max() < 1e-9
    langs = {r.lang: r.b for r in fit.langs.collect()}
    assert langs == fit.lang_weights


def test_a_document_of_each_of_many_languages(spark):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"),
                                     F.concat(F.lit("l"), F.col("id") % 1_500).alias("lang"), F.lit("one two three").alias("text"))
    got = M.with_probability(docs, keep=0.25).agg(F.sum("probability"), F.min("probability"), F.max("probability")).first()
    assert abs(got[0] - 750) < 1e-3 and got[2] - got[1] < 1e-6
