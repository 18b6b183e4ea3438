"""The append-only crawl log and its queries (A2-A4, B1-B4, B12-B15, C4, C9,
C10, D1-D8, E2, E3, F1, H16, H17, H20, H21, T5).

The log may hold many rows per URL (appends are never de-duplicated).
"Latest row per URL" is found by row locators (``newest``), or is a
``max_by(row, (ts, tie))`` aggregate: both are combined map-side before the
shuffle, so a URL that holds a third of all rows still costs one partial row
per task, not one giant sort group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl import schemas
from trawl.functions.urls import authority
from trawl.operators.filters import is_excluded
from trawl.operators.newest import is_located, newest_rows
from trawl.session import checkpoint_dir, materialize
from trawl.sources.versions import BucketedTable

# Result labels, default error text and content types.
STATUS_OK = "✅ Success"
STATUS_FAILED = "❌ Failed"
UNKNOWN_ERROR = "Unknown error"
SAVED_CONTENT_TYPES = ["markdown", "images", "pdf", "screenshot"]


# ---------------------------------------------------------------- writing

def crawl_log_rows(results: DataFrame, ingested_at) -> DataFrame:
    """A2 + T5 + H16: crawl results -> log rows.  Media, links and page
    metadata are packed into one JSON object; the raw markdown wins over the
    rendered one when present."""
    r = results
    meta = F.to_json(F.struct(
        F.coalesce(F.col("media"), F.array().cast(r.schema["media"].dataType)).alias("MEDIA"),
        F.coalesce(F.col("links"), F.array().cast("array<string>")).alias("LINKS"),
        F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")).alias("METADATA")))
    return r.select(
        F.col("url"), F.col("success"), F.col("error_message"), meta.alias("metadata"),
        F.lit(ingested_at).cast("timestamp_ntz").alias("ts"),
        F.coalesce(F.col("raw_markdown"), F.col("markdown")).alias("markdown"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.CRAWL_LOG.fields
          if f.name in ("file_name", "file_type", "content_type", "size")])


def append_crawl_log(results: DataFrame, path: str, ingested_at) -> DataFrame:
    """A2: append crawl results to the log at ``path`` (bulk, not per row)."""
    rows = crawl_log_rows(results, ingested_at)
    rows.write.mode("append").parquet(path)
    return rows


def append_documents(docs: DataFrame, path: str) -> None:
    """A4: append ``(source_id, contents)`` documents."""
    docs.select("source_id", "contents").write.mode("append").parquet(path)


def _unused(base: str, *taken) -> str:
    """A column name that none of the given frames or names has."""
    low = {c.lower() for t in taken for c in (t.columns if isinstance(t, DataFrame) else [t])}
    while base.lower() in low:
        base += "_"
    return base


def merge_file_metadata(target: DataFrame, updates: DataFrame, as_of) -> DataFrame:
    """A3 / C4: upsert file metadata by URL.

    Matched target rows (every row of that URL) get file_name, file_type,
    content_type, size, metadata and ``ts = as_of``; other columns stay.
    Unmatched updates are inserted with those six columns, the rest NULL.
    Two updates for one URL are an error (which of them should win is not
    known).  The result is a new table; write it to a new path and swap
    (parquet has no in-place MERGE), or keep the log by buckets and use
    :func:`upsert_file_metadata`, which rewrites only the buckets it hits.

    The updates are written once, so Spark knows their size: it broadcasts them
    when they are small and shuffles both sides otherwise.  The insert test
    needs only the log's URLs that occur in the updates.
    """
    cols = ["file_name", "file_type", "content_type", "size", "metadata"]
    checkpoint_dir(target.sparkSession)
    updates = materialize(updates.select("url", *cols), "upsert-source")   # computed once
    if not updates.groupBy("url").count().where("count > 1").isEmpty():
        raise ValueError("merge_file_metadata: more than one update for a URL")
    hit = _unused("upsert_hit", target)
    new = {c: _unused("upsert_" + c, target, hit) for c in cols}
    u = updates.select("url", *[F.col(c).alias(new[c]) for c in cols], F.lit(True).alias(hit))
    ts = F.lit(as_of).cast("timestamp_ntz")
    is_hit = F.col(hit).isNotNull()
    kept = target.join(u, "url", "left").select(
        *[(F.when(is_hit, F.col(new[c])).otherwise(F.col(c)) if c in cols
           else F.when(is_hit, ts).otherwise(F.col("ts")) if c == "ts" else F.col(c)).alias(c)
          for c in target.columns])
    seen = target.select("url").join(updates.select("url"), "url", "left_semi").distinct()
    inserted = updates.join(seen, "url", "left_anti").select(*[
        (F.col(f.name) if f.name in cols or f.name == "url" else
         ts if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in target.schema.fields])
    return kept.unionByName(inserted)


def upsert_file_metadata(table: BucketedTable, updates: DataFrame, as_of) -> int:
    """A3 / C4 on a log kept by buckets of its URLs: only the buckets that hold a URL of ``updates`` are read and
    rewritten, and the new version appears at once.  Returns its number; no update makes no version."""
    checkpoint_dir(updates.sparkSession)
    updates = materialize(updates, "upsert-updates")
    hit = table.buckets_of(updates)
    return table.rewrite(hit, lambda rows: merge_file_metadata(rows, updates, as_of)) if hit else table.latest()


# ---------------------------------------------------------------- reading

def latest_per_url(log: DataFrame, ts: str = "ts", tie=("file_name",)) -> DataFrame:
    """Newest row per URL (ties broken by ``tie`` descending).

    A log with row locators (``newest.located``) is read twice, first without its payload, and the
    newest rows are taken by their place in the files: nothing wide is sorted or shuffled.  For any other
    log ``max_by`` compares (ts, tie) alone and carries the other columns, which may be of any type (maps too).
    """
    if is_located(log):
        return newest_rows(log, "url", [ts, *tie])
    rest = [c for c in log.columns if c != "url"]
    order = F.struct(F.col(ts).alias("t"), *[F.col(c).alias(f"t{k}") for k, c in enumerate(tie)])
    best = log.groupBy("url").agg(F.max_by(F.struct(*rest), order).alias("newest"))
    return best.select("url", *[F.col("newest").getField(c).alias(c) for c in rest]).select(*log.columns)


def json_field(metadata, key: str, default: str = "{}") -> Column:
    """A top-level JSON field as JSON text, ``default`` when absent."""
    m = F.col(metadata) if isinstance(metadata, str) else metadata
    return F.coalesce(F.get_json_object(m, f"$.{key}"), F.lit(default))


def write_clustered(log: DataFrame, path: str, group_bytes: int = 8 << 20) -> DataFrame:
    """Write a log for look-ups by URL (B2, B3) and read it back.

    Rows are range partitioned and sorted by (url, ts), so a hot URL is spread over files; row groups are small
    and carry the range and a Bloom filter of their URLs.  ``where(url = ...)`` then skips files and row groups."""
    (log.repartitionByRange("url", "ts").sortWithinPartitions("url", "ts").write
     .option("parquet.block.size", str(group_bytes)).option("parquet.bloom.filter.enabled#url", "true").parquet(path))
    return log.sparkSession.read.parquet(path)


def crawl_result(log: DataFrame, url: str) -> DataFrame:
    """B2: the (latest) row of one URL with its JSON parts split out (see :func:`write_clustered`)."""
    one = latest_per_url(log.where(F.col("url") == url))
    return one.select("url", F.coalesce(F.col("success"), F.lit(False)).alias("success"),
                      "error_message",
                      json_field("metadata", "MEDIA").alias("media"),
                      json_field("metadata", "LINKS").alias("links"),
                      json_field("metadata", "METADATA").alias("page_metadata"))


def saved_files(log: DataFrame, url: str | None = None, file_type: str | None = None,
                *, stage_prefix: str) -> DataFrame:
    """B1 + B3 + B15 + F1: file rows, optional filters, newest first (ties by
    URL and file name), with ``file_path`` = prefix + the stage path that the metadata names."""
    df = log
    if url:
        df = df.where(F.col("url") == url)
    if file_type:
        df = df.where(F.col("file_type") == file_type)
    sp = F.get_json_object("metadata", "$.STAGE_PATH")
    return df.orderBy(F.col("ts").desc(), "url", "file_name").select(
        "url", "file_name", "file_type", "content_type", "size", "metadata",
        F.when(sp.isNotNull(), F.concat(F.lit(stage_prefix), sp)).alias("file_path"))


def cached_urls(log: DataFrame) -> DataFrame:
    """Distinct URLs of the log."""
    return log.select("url").distinct()


def result_files(results: DataFrame, log: DataFrame) -> DataFrame:
    """The saved files of every successful result, one ``(url, file_name)`` row each, every file once."""
    ok = results.where(F.coalesce(F.col("success"), F.lit(False))).select("url").distinct()
    files = log.where(F.col("file_name").isNotNull()).select("url", "file_name")
    return files.join(ok, "url", "left_semi").distinct()


def results_with_files(results: DataFrame, log: DataFrame) -> DataFrame:
    """Each crawl result with ``files``, the number of its saved files (by
    distinct name); 0 when the crawl failed.  The files themselves are the
    rows of :func:`result_files`: no URL's files are gathered into one value."""
    names = log.where(F.col("file_name").isNotNull()).select("url", "file_name").distinct()
    n = names.groupBy("url").agg(F.count("*").alias("files"))
    ok = F.coalesce(F.col("success"), F.lit(False))
    return (results.join(n, "url", "left")
            .withColumn("files", F.when(ok, F.coalesce(F.col("files"), F.lit(0))).otherwise(F.lit(0)).cast("long")))


def result_rows(results: DataFrame) -> DataFrame:
    """Display rows: status label, file count (0 when failed), error
    text of failed rows."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    return results.select(
        "url",
        F.when(ok, F.lit(STATUS_OK)).otherwise(F.lit(STATUS_FAILED)).alias("status"),
        F.when(ok, F.col("files")).otherwise(F.lit(0)).cast("long").alias("files"),
        F.when(~ok, F.coalesce(F.col("error_message"), F.lit(UNKNOWN_ERROR))).alias("error"))


def crawl_errors(results: DataFrame) -> DataFrame:
    """Failed rows with their message."""
    return results.where(~F.coalesce(F.col("success"), F.lit(False))).select(
        "url", F.coalesce(F.col("error_message"), F.lit(UNKNOWN_ERROR)).alias("error"))


def crawl_summary(results: DataFrame) -> DataFrame:
    """D8 + H23: total, success rate in percent (0 when empty, one decimal),
    number of files of successful results."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    n = F.count("*")
    return results.agg(
        n.alias("total"),
        F.when(n > 0, F.round(F.count_if(ok) * 100.0 / n, 1)).otherwise(F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.sum(F.when(ok, F.col("files"))), F.lit(0)).cast("long").alias("saved_files"))


def upper_columns(df: DataFrame) -> DataFrame:
    """Upper-case all column names."""
    return df.toDF(*[c.upper() for c in df.columns])


# ---------------------------------------------------------------- statistics

def crawl_stats(log: DataFrame) -> DataFrame:
    """Total rows, successes, failures (NULL success counts in neither)."""
    return log.agg(F.count("*").alias("total_urls"),
                   F.count_if(F.col("success")).alias("successful_urls"),
                   F.count_if(~F.col("success")).alias("failed_urls"))


def file_stats(log: DataFrame) -> DataFrame:
    """D2 + B4: per non-NULL file type, row count and total size."""
    return (log.where(F.col("file_type").isNotNull()).groupBy("file_type")
            .agg(F.count("*").alias("count"), F.sum("size").alias("total_size")))


def stats_report(log: DataFrame, as_of) -> DataFrame:
    """D3 + A6 + H20: one row ``{crawl_stats, file_stats, last_update}`` as JSON.

    One pass: aggregate per file type (combined map-side), then fold the
    few per-type rows into the document - no join between the two parts.
    """
    per_type = log.groupBy("file_type").agg(
        F.count("*").alias("n"), F.sum("size").alias("total_size"),
        F.count_if(F.col("success")).alias("ok"), F.count_if(~F.col("success")).alias("bad"))
    typed = F.when(F.col("file_type").isNotNull(), F.struct(
        F.col("file_type"), F.struct(F.col("n").alias("count"), F.col("total_size"))))
    one = per_type.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_urls"),
        F.coalesce(F.sum("ok"), F.lit(0)).cast("long").alias("successful_urls"),
        F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("failed_urls"),
        F.map_from_entries(F.array_sort(F.collect_list(typed))).alias("file_stats"))
    stamp = F.date_format(F.lit(as_of).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    return one.select(
        F.to_json(F.struct("total_urls", "successful_urls", "failed_urls")).alias("crawl_stats"),
        F.to_json("file_stats").alias("file_stats"),
        stamp.alias("last_update"))


def saved_content_counts(assets: DataFrame, type_col: str = "file_type") -> DataFrame:
    """Saved files per content type, the four fixed types always present
    (asset type ``image`` counts as ``images``)."""
    spark = assets.sparkSession
    fixed = spark.createDataFrame([(t,) for t in SAVED_CONTENT_TYPES], "content string")
    name = F.when(F.col(type_col) == "image", F.lit("images")).otherwise(F.col(type_col))
    counts = assets.groupBy(name.alias("content")).agg(F.count("*").alias("saved"))
    return fixed.join(counts, "content", "left") \
        .select("content", F.coalesce("saved", F.lit(0)).cast("long").alias("saved"))


def crawl_metrics(log: DataFrame, batch_size: int = 10, patterns=None) -> DataFrame:
    """D6 + H21: successful, failed, skipped, total batches ``(n-1)//size+1``,
    duration in seconds (last minus first time stamp), URLs per second =
    (ok + failed) / duration, 0 when the duration is not positive.

    ``skipped`` counts the rows whose URL an exclusion pattern (B8) matches;
    they are left out of all other figures."""
    out = F.coalesce(is_excluded(patterns), F.lit(False)) if patterns else F.lit(False)
    # as a grouping key the patterns are tested once a row, not once in every figure
    per = log.select("success", F.col("ts").cast("timestamp").alias("ts"), out.alias("out")).groupBy("out").agg(
        F.count("*").alias("n"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("bad"),
        F.min("ts").alias("first"), F.max("ts").alias("last"))

    def total(col: str, keep: Column) -> Column:
        return F.coalesce(F.sum(F.when(keep, F.col(col))), F.lit(0))
    kept = ~F.col("out")
    n = total("n", kept)
    agg = per.agg(total("ok", kept).alias("successful"), total("bad", kept).alias("failed"), total("n", F.col("out")).alias("skipped"),
                  F.when(n > 0, F.floor((n - 1) / batch_size) + 1).otherwise(F.lit(0)).cast("long").alias("total_batches"),
                  ((F.unix_micros(F.max(F.when(kept, F.col("last")))) - F.unix_micros(F.min(F.when(kept, F.col("first"))))) / 1e6)
                  .alias("duration"))
    return agg.withColumn("urls_per_second", F.when(F.col("duration") > 0,
                                                    (F.col("successful") + F.col("failed")) / F.col("duration"))
                          .otherwise(F.lit(0.0)))


# ---------------------------------------------------------------- numbering

def with_index(df: DataFrame, order_cols) -> DataFrame:
    """0-based global position (column ``_idx``) in ``order_cols`` order,
    without a single-partition window.

    The sorted frame is computed once: it is written with the id of its
    partition and the position in it, and both the partition sizes and the
    rows are read from there (sorting twice would sample other range bounds).
    """
    mid = F.col("_mid")
    srt = materialize(df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id()), "sorted")
    srt = srt.withColumn("_pid", F.shiftright(mid, 33)).withColumn("_pos", mid.bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = srt.groupBy("_pid").agg(F.count("*").alias("_n"))
    # one row per partition
    offs = sizes.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    return srt.join(F.broadcast(offs), "_pid").withColumn("_idx", F.col("_off") + F.col("_pos")) \
        .drop("_mid", "_pid", "_pos", "_off")


def with_batches(df: DataFrame, key: str = "url", size: int = 10, per: str | None = "domain",
                 ties: tuple[str, ...] = ()) -> DataFrame:
    """``batch = position // size + 1`` in ``key`` order (then ``ties``),
    numbered per domain (``per='domain'``), per another column, or over the
    whole list (``per=None``, the reference's numbering).  Hot domains are split
    over many tasks by the global sort; nothing is collected per group."""
    if per is None:
        ix = with_index(df, [F.col(c) for c in (key, *ties)])
        return ix.withColumn("batch", F.floor(F.col("_idx") / size).cast("long") + 1).drop("_idx")
    grp = authority(key) if per == "domain" else F.col(per)
    ix = with_index(df.withColumn("_grp", grp), [F.col(c) for c in ("_grp", key, *ties)])
    start = ix.groupBy("_grp").agg(F.min("_idx").alias("_start"))
    return (ix.join(start.withColumnRenamed("_grp", "_grp2"), F.col("_grp").eqNullSafe(F.col("_grp2")))
            .withColumn("batch", F.floor((F.col("_idx") - F.col("_start")) / size).cast("long") + 1)
            .drop("_grp", "_grp2", "_idx", "_start"))


def orphan_chunks(chunks: DataFrame, log: DataFrame, key: str = "source_id") -> DataFrame:
    """Chunks whose source URL is not in the log (the declared,
    unenforced foreign key)."""
    return chunks.join(log.select(F.col("url").alias(key)).distinct(), key, "left_anti")
