"""ST1 with a bounded memory, ST2 with atomic publishing."""

import os
import re
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.operators.newest import located
from trawl.session import scratch_path
from trawl.sources import versions as V
from trawl.streaming import seen as S

SCHEMA = "url string, body string, extra map<string,int>"


def batch(spark, urls, tag):
    path = scratch_path(spark, f"batch-{tag}")
    spark.createDataFrame([(u, f"{tag} {k}", {"k": k}) for k, u in enumerate(urls)], SCHEMA).repartition(3).write.parquet(path)
    return located(spark.read.parquet(path))


def test_filters_forget_nothing():
    rng = np.random.default_rng(1)
    h = rng.integers(-2 ** 63, 2 ** 63 - 1, (2, 5_000))
    f = S.make_filter(*h)
    assert S.may_hold([f], *h).all() and len(f) <= 5_000 * S.BITS // 8 + 8
    other = rng.integers(-2 ** 63, 2 ** 63 - 1, (2, 20_000))
    assert S.may_hold([f], *other).mean() < 0.03
    assert not S.may_hold([], *h).any() and not S.may_hold([S.make_filter(*h[:, :0])], *h).any()
    half = [S.make_filter(*h[:, :2_500]), S.make_filter(*h[:, 2_500:])]
    assert S.may_hold(half, *h).all()


def test_each_url_once_over_batches_replays_and_compaction(spark):
    t = S.SeenIngest(spark, scratch_path(spark, "seen"), buckets=4)
    one = batch(spark, [f"u{k % 60}" for k in range(200)] + [None], "a")
    two = batch(spark, [f"u{k}" for k in range(40, 100)] * 2, "b")
    assert t.ingest(one, 0) and t.read().count() == 60
    assert not t.ingest(one, 0) and t.read().count() == 60             # the epoch is repeated
    assert t.ingest(two, 1)
    rows = t.read().collect()
    assert sorted(r.url for r in rows) == sorted(f"u{k}" for k in range(100))
    assert all(r.body.startswith("a" if int(r.url[1:]) < 60 else "b") and r.extra == {"k": int(r.body.split()[1])} for r in rows)
    t.compact()
    assert len([p for p in t.manifest() if p.startswith(("seen", "bloom"))]) == 2 and t.seen().count() == 100
    assert not t.ingest(two, 1)
    assert t.ingest(two, 2) and t.read().count() == 100
    assert t.ingest(batch(spark, ["new", "u5"], "c"), 3) and t.read().count() == 101


def test_only_urls_that_may_be_known_read_the_memory(spark, monkeypatch):
    t = S.SeenIngest(spark, scratch_path(spark, "seen"), buckets=16)
    t.ingest(batch(spark, [f"u{k}" for k in range(300)], "a"), 0)
    asked = []
    plain = S.SeenIngest.seen
    monkeypatch.setattr(S.SeenIngest, "seen", lambda self, buckets=None: asked.append(buckets) or plain(self, buckets))
    t.ingest(batch(spark, [f"v{k}" for k in range(40)], "b"), 1)
    t.ingest(batch(spark, ["u7"], "c"), 2)
    assert len(asked[0]) < 8 and len(asked[1]) == 1 and t.read().count() == 340


def test_page_bodies_are_not_shuffled(spark, monkeypatch):
    t = S.SeenIngest(spark, scratch_path(spark, "seen"), buckets=4)
    plans = []
    plain = S.rows_at

    def spy(rows, places):
        out = plain(rows, places)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out
    monkeypatch.setattr(S, "rows_at", spy)
    t.ingest(batch(spark, [f"u{k}" for k in range(50)], "a"), 0)
    assert len(plans) == 1 and "BroadcastHashJoin" in plans[0] and not re.search("Sort|hashpartitioning", plans[0])


def test_crash_before_the_commit(spark, monkeypatch):
    t = S.SeenIngest(spark, scratch_path(spark, "seen"), buckets=4)
    one = batch(spark, ["a", "b"], "a")
    with monkeypatch.context() as m:
        m.setattr(S.SeenIngest, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            t.ingest(one, 0)
    assert t.latest() is None and t.ingest(one, 0) and t.read().count() == 2


def test_stream_over_many_batches(spark):
    src, sink, ck = (scratch_path(spark, n) for n in ("s-src", "s-sink", "s-ck"))
    rows = [(f"https://A.example.com/{k % 30}", f"b{k}", None) for k in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.repartition(3).write.parquet(src)
    for _ in range(2):
        S.stream_ingest_seen(spark, src, sink, ck, df.schema, buckets=4, max_files_per_trigger=1, compact_every=2)
        out = S.SeenIngest(spark, sink).read()
        assert out.count() == 30 == out.select("url").distinct().count()
        df.repartition(1).write.mode("append").parquet(src)


def test_published_epochs(spark):
    t = V.PublishedTable(spark, scratch_path(spark, "pub"))
    df = spark.range(3)
    assert t.publish(df, 0) and not t.publish(spark.range(9), 0) and t.read().count() == 3
    assert t.publish(df.limit(0), 1) and t.read().count() == 0 and t.read().columns == df.columns
    assert t.publish(spark.range(5), 2) and not t.publish(df, 1) and t.read().count() == 5 and t.read(0).count() == 3


def test_a_reader_in_a_loop_never_sees_half_a_table(spark):
    t = V.PublishedTable(spark, scratch_path(spark, "pub"))
    t.publish(spark.range(0, 1_000, 1, 8).withColumn("epoch", F.lit(0)), 0)
    stop, seen, errors = threading.Event(), [], []

    def reader():
        while not stop.is_set():
            try:
                r = V.PublishedTable(spark, t.path).read().agg(F.count("*"), F.min("epoch"), F.max("epoch")).first()
                seen.append(tuple(r))
            except Exception as e:      # noqa: BLE001 - any error is a failure of the test
                errors.append(e)
    th = threading.Thread(target=reader)
    th.start()
    for e in range(1, 5):
        t.publish(spark.range(0, 1_000, 1, 8).withColumn("epoch", F.lit(e)), e)
    stop.set()
    th.join()
    assert not errors and seen and all(n == 1_000 and a == b for n, a, b in seen)
    assert os.path.isdir(t.path)
