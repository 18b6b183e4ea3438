"""The newest row of each key, fetched by locator."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from trawl.operators import crawl_log as C
from trawl.operators import newest as N
from trawl.session import scratch_path
from trawl.sources.tables import crawl_log_from_events, read_table

SCHEMA = "url string, ts long, file_name string, body string, extra map<string,int>"


def log_rows(n=3_000):
    rnd = random.Random(1)
    return [(rnd.choice(["hot", None, *[f"u{k}" for k in range(200)]]) if rnd.random() < 0.7 else "hot",
             rnd.choice([None, *range(40)]), rnd.choice([None, "a", "b", "c"]), f"body {k}", {"k": k}) for k in range(n)]


@pytest.fixture(scope="module")
def path(spark):
    p = scratch_path(spark, "newest log")          # a blank in the path
    spark.createDataFrame(log_rows(), SCHEMA).repartition(7).write.option("parquet.block.size", 4096).parquet(p)
    return p


def order(r):
    return (r.ts is not None, r.ts or 0, r.file_name is not None, r.file_name or "")


@pytest.mark.parametrize("most", [1 << 20, 5, 1])
def test_newest_rows_of_a_table_of_files(spark, path, monkeypatch, most):
    """One slice, several slices of whole files, and files with more masks than a slice should hold."""
    monkeypatch.setattr(N, "MASKS", most)
    scan = spark.read.parquet(path)
    best = {}
    for r in scan.collect():
        if r.url not in best or order(r) > order(best[r.url]):
            best[r.url] = r
    got = C.latest_per_url(N.located(scan))
    assert got.columns == scan.columns
    rows = got.collect()
    assert len(rows) == len(best) and {r.url for r in rows} == set(best)
    assert all(order(r) == order(best[r.url]) and r.extra == {"k": int(r.body.split()[1])} for r in rows)


def test_ties_are_decided_by_the_locator(spark):
    p = scratch_path(spark, "newest-ties")
    spark.createDataFrame([("u", 1, "f", str(k), None) for k in range(500)], SCHEMA).repartition(3).write.parquet(p)
    loc = N.located(spark.read.parquet(p))
    want = loc.orderBy(F.desc(N.FILE), F.desc(N.ROW)).first().body
    for _ in range(2):
        assert [r.body for r in C.latest_per_url(loc).collect()] == [want]


def test_no_payload_is_sorted_or_shuffled(spark, path):
    plan = C.latest_per_url(N.located(spark.read.parquet(path)))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert not re.search(r"Sort|Aggregate|Window|hashpartitioning", plan)


def test_a_slice_reads_its_files_alone(spark, path, monkeypatch):
    monkeypatch.setattr(N, "MASKS", 5)
    loc = N.located(spark.read.parquet(path))
    one = loc.where(F.pmod(F.xxhash64(N.FILE), F.lit(4)) == 1)
    df = one.select("body")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "_metadata.file_path" in plan or "file_path" in plan
    files = {r[0] for r in loc.select(N.FILE).distinct().collect()}
    assert 0 < len({r[0] for r in one.select(N.FILE).distinct().collect()}) < len(files) == len(
        [f for f in os.listdir(path) if f.endswith(".parquet")])


def test_equals_the_aggregate_on_the_crawl_log(spark, sf):
    events = read_table(spark, sf, "events")
    a = C.latest_per_url(crawl_log_from_events(N.located(events)))
    b = C.latest_per_url(crawl_log_from_events(events))
    assert a.columns == b.columns and a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_empty(spark):
    p = scratch_path(spark, "newest-empty")
    spark.createDataFrame([], SCHEMA).write.parquet(p)
    assert C.latest_per_url(N.located(spark.read.schema(SCHEMA).parquet(p))).count() == 0
