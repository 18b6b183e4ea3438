"""Chunks follow the texts of their pages."""

import pytest
from pyspark.sql import functions as F

from trawl.operators import chunks as CH
from trawl.operators import embed as E
from trawl.operators.chunk_versions import ChunkStore
from trawl.session import scratch_path

LOG = "url string, markdown string, ts int, file_name string"


def texts(n, tag=""):
    return {f"u{k}": f"{tag}{k} " + "word " * (k % 40) for k in range(n)}


def log(spark, *crawls):
    return spark.createDataFrame([(u, t, ts, "f") for ts, c in enumerate(crawls) for u, t in c.items()], LOG)


@pytest.fixture
def store(spark):
    seen = []

    def chunker(docs):
        seen.append(sorted(r.source_id for r in docs.select("source_id").collect()))
        return CH.chunk_fixed(docs, 40, 10, key="source_id")
    s = ChunkStore(spark, scratch_path(spark, "chunks"), chunker, dim=16)
    s.cut = seen
    return s


def want(spark, crawl):
    docs = spark.createDataFrame([(u, t) for u, t in crawl.items() if t is not None], "source_id string, text string")
    out = E.embed(CH.chunk_fixed(docs, 40, 10, key="source_id"), "chunk_text", dim=16)
    return rows(out)


def rows(df):
    return sorted((r.source_id, r.chunk_number, r.chunk_text, tuple(r.vector)) for r in df.collect())


def test_changed_gone_and_returned_pages(spark, store):
    a = texts(30)
    assert store.latest() is None and store.chunks().count() == 0
    assert store.sync(log(spark, a)) == 0 and rows(store.chunks()) == want(spark, a)
    b = {**a, "u3": "another text", "u4": None, "new": "a new page"}
    assert store.sync(log(spark, a, b)) == 1 and rows(store.chunks()) == want(spark, b)
    assert store.cut[-1] == ["new", "u3"]                                    # nothing else was cut again
    assert store.sync(log(spark, a, b)) == 1 == store.latest()               # nothing changed, no version
    assert store.sync(log(spark, a, b, a)) == 2 and rows(store.chunks()) == want(spark, {**a, "new": "a new page"})
    assert store.cut[-1] == []                                               # old texts: old chunks
    assert store.sync(log(spark, {"u1": "only this"})) == 3
    assert rows(store.chunks()) == want(spark, {**a, "new": "a new page", "u1": "only this"})
    assert store.sync(log(spark, {"u1": "only this"}), drop_missing=True) == 4
    assert rows(store.chunks()) == want(spark, {"u1": "only this"})
    assert store.compact() == 5 and rows(store.chunks()) == want(spark, {"u1": "only this"})
    assert store._stored().select("digest").distinct().count() == 1 and len(store.manifest()) == 2
    assert store.sync(log(spark, {"u1": None})) == 6 and store.chunks().count() == 0


def test_crash_before_the_commit(spark, store, monkeypatch):
    a = texts(5)
    store.sync(log(spark, a))
    with monkeypatch.context() as m:
        m.setattr(ChunkStore, "commit", lambda *x: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.sync(log(spark, a, {"u1": "changed"}))
    assert rows(store.chunks()) == want(spark, a)
    store.sync(log(spark, a, {"u1": "changed"}))
    assert rows(store.chunks()) == want(spark, {**a, "u1": "changed"})


def test_odd_logs(spark, store):
    assert store.sync(log(spark)) is None and store.compact() is None
    df = spark.createDataFrame([(None, "no url", 0, "f"), ("e", "", 0, "f"), ("d", "same", 0, "f"), ("d", "same", 0, "f")], LOG)
    store.sync(df)
    assert sorted(r.source_id for r in store.chunks().collect()) == ["d", "e"]
    assert store.sets().where(F.col("source_id").isNull()).count() == 0
