"""What a task holds or reads does not grow with the tables."""

import pandas as pd
from pyspark.sql import functions as F

from tests.conftest import SMALL
from trawl.operators import chunk_versions as CV
from trawl.operators import chunks as CH
from trawl.operators import util
from trawl.plans import web
from trawl.session import scratch_path


def test_spread_follows_the_size_of_the_files(spark, monkeypatch):
    path = scratch_path(spark, "spread [a] {b},c")
    spark.range(5_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path.replace("[", "\\[").replace("]", "\\]").replace("{", "\\{").replace("}", "\\}").replace(",", "\\,"))
    size = util.file_bytes(spark, rows.inputFiles())
    assert 5_000 * 32 < size < 5_000 * 100
    assert util.spread(rows, 3).rdd.getNumPartitions() == 3
    monkeypatch.setattr(util, "SPREAD_BYTES", size // 20)
    assert 20 <= util.spread(rows, 3).rdd.getNumPartitions() <= 21
    assert util.spread(rows.repartition(2), 1).rdd.getNumPartitions() == 2      # enough files: as it came
    assert util.spread(spark.createDataFrame([(1,)], "a int"), 4).rdd.getNumPartitions() == 4


def test_chunk_texts_passes_pieces_on(spark, monkeypatch):
    """A batch of texts is not held as chunks as a whole."""
    from trawl.functions import sql as SQL
    texts = pd.Series(["word " * 30, None, "", "another text " * 20] * 10)
    n, o = pd.Series([40] * 40), pd.Series([5] * 40)
    monkeypatch.setattr(SQL, "PIECE_CHARS", 500)
    pieces = list(SQL.chunk_texts.func(iter([(texts, n, o), (texts[:0], n[:0], o[:0])])))
    assert max(map(len, pieces)) <= 8 and sum(map(len, pieces)) == 40
    got = [[c["chunk_text"] for c in cs] for p in pieces for cs in p]
    assert got == [CH.split_text(t, 40, 5) for t in texts]


def test_the_walk_reads_its_edges_with_all_cores(spark):
    g, _, _ = web._graph(spark, SMALL)
    assert g.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_the_walk_tests_each_target_once(spark, monkeypatch):
    """The domain is tested above the grouping of the targets, not on every edge."""
    from trawl.operators import frontier
    plans = []
    real = frontier.materialize

    def spy(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return real(df, name)
    monkeypatch.setattr(frontier, "materialize", spy)
    edges = spark.createDataFrame([("https://a.b/1", "https://a.b/2")] * 5 + [("https://a.b/1", "https://c.d/3")], "src string, dst string")
    seeds = spark.createDataFrame([("https://a.b/1",)], "url string")
    assert {r.url: r.depth for r in frontier.discover(edges, seeds, "a.b", 1).collect()} == {"https://a.b/1": 0, "https://a.b/2": 1}
    plan = dict(plans)["bfs-depth1"]
    assert "regexp_extract" in plan and plan.rindex("regexp_extract") < plan.index("Aggregate [")


def test_a_sync_moves_no_vector_and_writes_no_text_twice(spark, monkeypatch):
    embedded, written = [], []
    embed, materialize = CV.E.embed, CV.materialize
    monkeypatch.setattr(CV.E, "embed", lambda df, *a: embedded.append(df.columns) or embed(df, *a))
    monkeypatch.setattr(CV, "materialize", lambda df, name: written.append((name, "text" in df.columns)) or materialize(df, name))
    store = CV.ChunkStore(spark, scratch_path(spark, "chunks"), lambda d: CH.chunk_fixed(d, 40, 10, key="source_id"), dim=8)
    for ts, text in ((1, "one"), (2, "two")):
        log = spark.createDataFrame([(f"u{i}", text if i else "kept", ts, "f") for i in range(5)],
                                    "url string, markdown string, ts int, file_name string")
        store.sync(log)
    assert [n for n, text in written if text] == ["chunk-texts"] * 2
    assert len(embedded) == 2 and all("digest" in c for c in embedded)          # digests have joined before vectors are made
    assert sorted((r.source_id, r.chunk_text) for r in store.chunks().collect()) == \
        [("u0", "kept")] + [(f"u{i}", "two") for i in range(1, 5)]
