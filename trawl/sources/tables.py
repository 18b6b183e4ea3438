"""Table sources (A1, A7) and the views that stand for the reference's datasets.

The driver tables are parquet files ``<dir>/<name>.parquet``.  The crawl
log and the link graph the reference keeps in its warehouse are derived
from them here with plain projections over the *whole* tables, so their
size grows with the input.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl import schemas
from trawl.operators.newest import FILE, ROW

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A1: crawled pages ``(page_id, url, html)`` with a fixed schema."""
    return spark.read.schema(schemas.PAGES).parquet(path)


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """Fetched robots/sitemap documents ``(url, content, is_xml, status)``."""
    return spark.read.schema(schemas.SITEMAPS).parquet(path)


def crawl_log_from_events(events: DataFrame) -> DataFrame:
    """The crawl log (CRAWL_METADATA) as a view over ``events``.

    Several rows per URL, NULL ``success`` for signups (rows written by the
    file upsert carry no success flag), JSON metadata from ``props``.  Row
    locators of ``events`` stay.
    """
    et = F.col("event_type")
    return events.select(
        F.concat(F.lit("https://s"), (F.col("user_id") % 7).cast("string"),
                 F.lit(".example.com/u/"), F.col("user_id").cast("string")).alias("url"),
        F.when(et == "error", F.lit(False)).when(et == "signup", F.lit(None).cast("boolean"))
         .otherwise(F.lit(True)).alias("success"),
        F.when(et == "error", F.lit("HTTP 500")).alias("error_message"),
        F.col("props").alias("metadata"),
        F.col("ts"),
        F.lit(None).cast("string").alias("markdown"),
        F.concat(F.lit("f"), F.col("event_id").cast("string"), F.lit("."), et).alias("file_name"),
        F.when(et == "signup", F.lit(None).cast("string")).otherwise(et).alias("file_type"),
        F.lit(None).cast("string").alias("content_type"),
        F.floor(F.col("value")).cast("long").alias("size"),
        F.col("event_id"),
        *[F.col(c) for c in (FILE, ROW) if c in events.columns],
    )


def crawl_log_sql(events: str = "events") -> str:
    """The same view as SQL text (runs on Spark and DuckDB alike)."""
    return f"""
select concat('https://s', cast(user_id % 7 as varchar), '.example.com/u/', cast(user_id as varchar)) as url,
       case when event_type = 'error' then false when event_type = 'signup' then null else true end as success,
       case when event_type = 'error' then 'HTTP 500' end as error_message,
       props as metadata, ts, cast(null as varchar) as markdown,
       concat('f', cast(event_id as varchar), '.', event_type) as file_name,
       case when event_type = 'signup' then null else event_type end as file_type,
       cast(null as varchar) as content_type,
       cast(floor(value) as bigint) as size,
       event_id
from {events}"""


def link_graph_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """A page graph (src, dst) from ``lineitem``: every line links its part
    page to its supplier page and back.  All rows; repeated edges stay (the
    walk de-duplicates each round's targets)."""
    li = lineitem.select("l_partkey", "l_suppkey")
    p = F.concat(F.lit("https://g.example.com/p/"), F.col("l_partkey").cast("string"))
    s = F.concat(F.lit("https://g.example.com/s/"), F.col("l_suppkey").cast("string"))
    fwd = li.select(p.alias("src"), s.alias("dst"))
    back = li.select(s.alias("src"), p.alias("dst"))
    return fwd.unionByName(back)


def link_graph_sql(lineitem: str = "lineitem") -> str:
    return f"""
select distinct a as src, b as dst from (
  select concat('https://g.example.com/p/', cast(l_partkey as varchar)) a,
         concat('https://g.example.com/s/', cast(l_suppkey as varchar)) b from {lineitem}
  union all
  select concat('https://g.example.com/s/', cast(l_suppkey as varchar)),
         concat('https://g.example.com/p/', cast(l_partkey as varchar)) from {lineitem}) t"""
