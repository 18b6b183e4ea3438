"""The physical plans have the shape the design relies on at scale."""

import contextlib
import io

from pyspark.sql import functions as F

from tests.conftest import SMALL
from trawl.operators import crawl_log as C
from trawl.operators import retrieve
from trawl.sources.tables import crawl_log_from_events, read_table


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_retrieval_plan_keeps_chunks_in_place(spark):
    emb = read_table(spark, SMALL, "embeddings")
    qs = emb.where(F.col("vec_id") < 10).select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("qvec"))
    p = _plan(retrieve.similar_chunks_batch(emb, qs, 3, key_cols=("vec_id",), vector_col="embedding"))
    assert "BroadcastNestedLoopJoin" in p
    assert "WindowGroupLimit" in p and "Partial" in p          # top-k cut before the shuffle
    assert p.count("hashpartitioning") == 1                    # the only hash shuffle: candidates by question


def test_latest_per_url_combines_map_side(spark):
    log = crawl_log_from_events(read_table(spark, SMALL, "events"))
    p = _plan(C.latest_per_url(log))
    assert "partial_max_by" in p and "Window" not in p


def test_walk_does_not_shuffle_the_edges_first(spark):
    from trawl.sources.tables import link_graph_from_lineitem
    assert "Exchange" not in _plan(link_graph_from_lineitem(read_table(spark, SMALL, "lineitem")))


def test_filters_and_columns_reach_the_scan(spark):
    from trawl.plans.rag import _questions
    p = _plan(_questions(spark, SMALL))
    assert "EqualTo(role,user)" in p                           # predicate pushed into parquet
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in p


def test_upsert_broadcasts_the_small_side(spark):
    log = crawl_log_from_events(read_table(spark, SMALL, "events")).drop("event_id")
    upd = C.latest_per_url(log.where(F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz"))) \
        .select("url", "file_name", "file_type", "content_type", "size", "metadata")
    p = _plan(C.merge_file_metadata(log, upd, "2024-02-01 00:00:00"))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
