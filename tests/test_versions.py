"""Versioned tables: atomic publishing, upserts that rewrite only the buckets they hit, crashes, resumable walks."""

import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from trawl.operators import crawl_log as C
from trawl.session import checkpoint_dir, scratch_path
from trawl.sources import versions as V

LOG = "url string, success boolean, file_name string, file_type string, content_type string, size long, metadata string, ts timestamp_ntz"
UPD = "url string, file_name string, file_type string, content_type string, size long, metadata string"


def log(spark, n=400):
    return spark.createDataFrame([(f"u{k % 150}" if k % 3 else "hot", True, f"f{k}", "md", None, k, None, None) for k in range(n)], LOG)


def files(table):
    out = {}
    for piece, (folder, _) in table.manifest().items():
        if piece:
            out[piece] = {(f, os.stat(os.path.join(table.at(folder), f)).st_mtime_ns)
                          for f in os.listdir(table.at(folder)) if f.endswith(".parquet")}
    return out


@pytest.fixture
def table(spark):
    t = V.BucketedTable(spark, scratch_path(spark, "buckets"))
    t.create(log(spark), "url", 32)
    return t


def test_create_and_read(spark, table):
    assert table.latest() == 0
    assert table.read().exceptAll(log(spark)).count() == 0 and table.read().count() == 400
    assert table.lookup("hot").count() == log(spark).where("url = 'hot'").count() > 100
    assert table.lookup("nobody").count() == 0
    one = table.lookup("u1")
    assert len({os.path.dirname(f) for f in one.inputFiles()}) == 1


def test_upsert_rewrites_only_the_buckets_it_hits(spark, table):
    before = files(table)
    updates = spark.createDataFrame([("u1", "new", "pdf", "x", 1, "{}"), ("u2", "new", "pdf", "x", 2, "{}"), ("fresh", "new", "pdf", "x", 3, "{}")], UPD)
    want = C.merge_file_metadata(table.read(), updates, "2024-02-01 00:00:00")
    hit = {str(b) for b in table.buckets_of(updates)}
    assert C.upsert_file_metadata(table, updates, "2024-02-01 00:00:00") == 1
    after = files(table)
    assert 0 < len(hit) <= 3
    for b in set(before) | set(after):
        assert (before.get(b) == after.get(b)) == (b not in hit), b
    got = table.read()
    assert got.count() == 401 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert table.read(version=0).exceptAll(log(spark)).count() == 0         # the old version is still there


def test_no_update_makes_no_version(spark, table):
    assert C.upsert_file_metadata(table, spark.createDataFrame([], UPD), "2024-02-01 00:00:00") == 0 == table.latest()


def test_crash_before_the_commit_leaves_the_old_table(spark, table, monkeypatch):
    updates = spark.createDataFrame([("u1", "new", "pdf", "x", 1, "{}")], UPD)

    def crash(self, version, pieces):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(V.BucketedTable, "commit", crash)
        with pytest.raises(RuntimeError):
            C.upsert_file_metadata(table, updates, "2024-02-01 00:00:00")
    assert table.latest() == 0 and table.read().exceptAll(log(spark)).count() == 0
    assert C.upsert_file_metadata(table, updates, "2024-02-01 00:00:00") == 1
    assert table.read().where("file_name = 'new'").count() > 0


def test_half_written_manifest_is_not_seen(spark, table):
    os.makedirs(os.path.join(table.path, "versions", "v=7", "_temporary", "0"))
    assert table.latest() == 0 and table.read().count() == 400


def test_two_writers_of_one_version(spark, table):
    table.commit(1, table.manifest())
    with pytest.raises(AnalysisException):
        table.commit(1, table.manifest())


def test_two_updates_for_a_url_are_an_error(spark, table):
    updates = spark.createDataFrame([("u1", "a", "pdf", "x", 1, "{}"), ("u1", "b", "pdf", "x", 1, "{}")], UPD)
    with pytest.raises(ValueError):
        C.upsert_file_metadata(table, updates, "2024-02-01 00:00:00")
    assert table.latest() == 0


def test_hot_bucket_is_written_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(V, "ROWS_A_TASK", 20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # the rows are few
    t = V.BucketedTable(spark, scratch_path(spark, "buckets"))
    t.create(log(spark), "url", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert t.read().count() == 400 and t.read().exceptAll(log(spark)).count() == 0
    hot = t.buckets_of(spark.createDataFrame([("hot",)], "url string"))[0]
    assert len(files(t)[str(hot)]) > 1


def test_empty_table(spark):
    t = V.BucketedTable(spark, scratch_path(spark, "buckets"))
    assert t.latest() is None
    with pytest.raises(ValueError):
        t.read()
    t.create(log(spark).limit(0), "url", 4)
    assert t.read().count() == 0 and t.read().schema == log(spark).schema
    updates = spark.createDataFrame([("u1", "new", "pdf", "x", 1, "{}")], UPD)
    C.upsert_file_metadata(t, updates, "2024-02-01 00:00:00")
    assert [r.url for r in t.read().collect()] == ["u1"]


# ---------------------------------------------------------------- walks

DOMAIN = "g.example.com"


def graph(spark, n=600):
    """A chain of small stars: the frontier of each round is a few URLs of many."""
    u = "https://g.example.com/{}".format
    e = [(u(k), u(k + 1)) for k in range(0, n, 10)] + [(u(k), u(k + d)) for k in range(0, n, 10) for d in (2, 3, 10)]
    return spark.createDataFrame(e + e[:50] + [(u(0), "https://other.org/x"), (u(0), None)], "src string, dst string")


def start(spark):
    return spark.createDataFrame([("https://g.example.com/0",)], "url string")


def rows(df):
    return sorted((r.url, r.depth, r.processed, r.error) for r in df.collect())


@pytest.mark.parametrize("with_pages", [False, True])
def test_resumed_walk_equals_one_run(spark, with_pages):
    from trawl.operators import frontier as FR
    g = graph(spark)
    pages = g.select(F.col("src").alias("url")).where(~F.col("url").endswith("/20")) if with_pages else None
    want = rows(FR.discover(g, start(spark), DOMAIN, 4, pages=pages))
    edges = FR.bucketed_edges(g, scratch_path(spark, "edges"), 16)
    for stops in ([4], [1, 3], [1, 1, 1, 1]):
        path = scratch_path(spark, "walk")
        FR.Walk(edges, path, DOMAIN, pages).add(start(spark))
        for n in stops:
            FR.Walk(edges, path, DOMAIN, pages).run(n)
        assert rows(FR.Walk(edges, path, DOMAIN, pages).result()) == want
    assert len(want) > 5


def test_a_round_reads_the_buckets_of_its_frontier(spark, monkeypatch):
    from trawl.operators import frontier as FR
    edges = FR.bucketed_edges(graph(spark), scratch_path(spark, "edges"), 64)
    read = []
    plain = V.BucketedTable.read

    def spy(self, buckets=None, version=None):
        read.append(None if buckets is None else len(buckets))
        return plain(self, buckets, version)
    monkeypatch.setattr(V.BucketedTable, "read", spy)
    w = FR.Walk(edges, scratch_path(spark, "walk"), DOMAIN)
    w.add(start(spark))
    w.run(2)
    assert read == [1, 4] and len(edges.manifest()) > 30


def test_crash_in_a_round_changes_nothing(spark, monkeypatch):
    from trawl.operators import frontier as FR
    edges = FR.bucketed_edges(graph(spark), scratch_path(spark, "edges"), 8)
    path = scratch_path(spark, "walk")
    w = FR.Walk(edges, path, DOMAIN)
    w.add(start(spark))
    w.run(1)
    before = rows(w.result())
    with monkeypatch.context() as m:
        m.setattr(V.Versions, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            w.step()
    assert rows(FR.Walk(edges, path, DOMAIN).result()) == before
    FR.Walk(edges, path, DOMAIN).run(2)
    assert rows(FR.Walk(edges, path, DOMAIN).result()) == rows(FR.discover(graph(spark), start(spark), DOMAIN, 3))


def test_what_is_processed_is_not_followed_again(spark):
    from trawl.operators import frontier as FR
    edges = FR.bucketed_edges(graph(spark, 60), scratch_path(spark, "edges"), 8)
    w = FR.Walk(edges, scratch_path(spark, "walk"), DOMAIN)
    w.add(start(spark))
    assert w.run() == 6 and w.frontier().count() == 0
    n = w.discovered().count()
    assert not w.add(start(spark)) and w.run() == 0 and w.discovered().count() == n
    assert w.add(spark.createDataFrame([("https://g.example.com/new",)], "url string"))
    assert [r.url for r in w.frontier().collect()] == ["https://g.example.com/new"]
    w.run()
    assert w.discovered().count() == n + 1


def test_walk_without_seeds(spark):
    from trawl.operators import frontier as FR
    edges = FR.bucketed_edges(graph(spark), scratch_path(spark, "edges"), 8)
    w = FR.Walk(edges, scratch_path(spark, "walk"), DOMAIN)
    assert w.run() == 0 and w.result().count() == 0
