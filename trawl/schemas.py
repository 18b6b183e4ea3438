"""Table schemas of the five datasets (pages, crawl log, links, chunks, vectors)."""

from pyspark.sql import types as T

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

# One row per crawl attempt or saved file.  Append-only; several rows per URL.
CRAWL_LOG = T.StructType([
    T.StructField("url", T.StringType(), False),
    T.StructField("success", T.BooleanType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("metadata", T.StringType()),        # JSON text
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("markdown", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("size", T.LongType()),
])

LINKS = T.StructType([
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
    T.StructField("kind", T.StringType()),            # same_domain | external
])

DOCS = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("contents", T.StringType()),
])

CHUNKS = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("chunk_number", T.IntegerType()),
    T.StructField("chunk_text", T.StringType()),
    T.StructField("vector", T.ArrayType(T.FloatType(), False)),
])

ASSETS = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("domain", T.StringType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
])

SITEMAPS = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("is_xml", T.BooleanType()),
    T.StructField("status", T.IntegerType()),
])

CONVERSATIONS = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])

MEDIA_ITEM = T.StructType([
    T.StructField("src", T.StringType()),
    T.StructField("data", T.StringType()),
    T.StructField("alt", T.StringType()),
    T.StructField("score", T.DoubleType()),
])

# A crawl result as handed over by a fetcher (the reference's result object).
CRAWL_RESULT = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("markdown", T.StringType()),
    T.StructField("raw_markdown", T.StringType()),
    T.StructField("pdf", T.BinaryType()),
    T.StructField("screenshot", T.StringType()),
    T.StructField("media", T.ArrayType(MEDIA_ITEM)),
    T.StructField("links", T.ArrayType(T.StringType())),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
