"""Registered streaming queries: the input files are written from whole
driver tables into a fresh folder under ``spark.checkpoint.dir``, the stream
runs to completion (``availableNow``), and the sink is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.plans import sqltext as S
from trawl.plans.registry import query
from trawl.session import scratch_path
from trawl.sources.tables import crawl_log_from_events, crawl_log_sql, read_table
from trawl.sources.versions import PublishedTable
from trawl.streaming.ingest import stream_ingest, stream_metrics
from trawl.streaming.seen import SeenIngest, stream_ingest_seen


_ONCE = f"""
select distinct {S.normalize_url('url')} as url from pages where {S.normalize_url('url')} is not null"""


@query("stream_ingest", oracle=_ONCE)
def q_stream_ingest(spark, sf_dir):
    """ST1: pages arrive in two rounds of files (the second repeats every URL);
    the sink holds each normalised URL once, and a rerun adds nothing."""
    pages = read_table(spark, sf_dir, "pages")
    src, sink, ckpt = scratch_path(spark, "st1-src"), scratch_path(spark, "st1-sink"), scratch_path(spark, "st1-ckpt")
    pages.repartition(3).write.parquet(src)
    stream_ingest(spark, src, sink, ckpt, pages.schema)
    pages.repartition(2).write.mode("append").parquet(src)
    stream_ingest(spark, src, sink, ckpt, pages.schema)     # picks up the new files only
    return spark.read.parquet(sink).select("url")


@query("stream_ingest_seen", oracle=_ONCE)
def q_stream_ingest_seen(spark, sf_dir):
    """ST1: the same with the seen URLs in a bucketed table and Bloom filters in front of it."""
    pages = read_table(spark, sf_dir, "pages")
    src, sink, ckpt = scratch_path(spark, "st1-src"), scratch_path(spark, "st1-sink"), scratch_path(spark, "st1-ckpt")
    for parts in (3, 2):
        pages.repartition(parts).write.mode("append").parquet(src)
        stream_ingest_seen(spark, src, sink, ckpt, pages.schema, buckets=8)
    return SeenIngest(spark, sink).read().select("url")


@query("stream_metrics", oracle=f"""
with log as ({crawl_log_sql()})
select case when success then 'success' when not success then 'failed' else 'unknown' end as status,
       count(*) as count
from log group by all""")
def q_stream_metrics(spark, sf_dir):
    """ST2: running success/failure counts over the crawl log delivered in files."""
    log = crawl_log_from_events(read_table(spark, sf_dir, "events"))
    src, sink, ckpt = scratch_path(spark, "st2-src"), scratch_path(spark, "st2-sink"), scratch_path(spark, "st2-ckpt")
    log.repartition(4).write.parquet(src)
    stream_metrics(spark, src, sink, ckpt, log.schema)
    return PublishedTable(spark, sink).read().select("status", F.col("count").cast("long").alias("count"))
