"""Registered crawl-log queries; the log is the view over the whole ``events`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.operators import crawl_log as C
from trawl.operators.newest import located
from trawl.plans import sqltext as S
from trawl.plans.registry import query
from trawl.session import scratch_path
from trawl.sources.tables import crawl_log_from_events, crawl_log_sql, read_table
from trawl.sources.versions import BucketedTable

# Fixed values of the registered queries
AS_OF = "2024-02-01 00:00:00"
SPLIT_TS = "2024-01-16 00:00:00"       # upsert: earlier rows are the table, later ones the updates
LOOKUP_URL = "https://s1.example.com/u/8"
FILE_TYPE = "purchase"
SKIP_PATTERN = "^u/[0-9]*3[0-9]$"
SKIPPED = "regexp_matches(url, '^https?://[^/]*/u/[0-9]*3[0-9]$')"

LOG = f"log as ({crawl_log_sql()})"
LATEST = """latest as (
  select * exclude (rn) from (
    select *, row_number() over (partition by url order by ts desc, file_name desc) as rn from log) t
  where rn = 1)"""
FILES = """files as (
  select url, count(distinct file_name) as n_files from log where file_name is not null group by url)"""


def _log(spark, sf_dir):
    return crawl_log_from_events(read_table(spark, sf_dir, "events"))


# Metadata with the fields that page results carry, made from every log row
META = """(case event_id % 4 when 0 then '{"STAGE_PATH":"d' || event_id || '/f.md"}'
  when 1 then '{"MEDIA":[' || event_id || '],"LINKS":["l' || event_id || '"]}'
  when 2 then '{"METADATA":{"title":"t' || event_id || '"},"STAGE_PATH":"s' || event_id || '"}'
  else metadata end)"""
META_LOG = f"mlog as (select * replace ({META} as metadata) from log)"
META_LATEST = LATEST.replace("latest as", "mlatest as").replace("from log)", "from mlog)")
STAGE_PREFIX = "@stage/"


def _meta_log(spark, sf_dir):
    log = _log(spark, sf_dir)
    return log.withColumn("metadata", F.expr(META))


def _results(spark, sf_dir):
    log = _log(spark, sf_dir)
    latest = C.latest_per_url(log).select("url", "success", "error_message")
    return C.results_with_files(latest, log)


@query("crawl_stats", headline=True, oracle=f"""
with {LOG}
select count(*) as total_urls, cast(count_if(success) as bigint) as successful_urls, cast(count_if(not success) as bigint) as failed_urls from log""")
def q_crawl_stats(spark, sf_dir):
    """Total / successful / failed rows."""
    return C.crawl_stats(_log(spark, sf_dir))


@query("upper_columns", oracle=f"""
with {LOG}
select count(*) as TOTAL_URLS, cast(count_if(success) as bigint) as SUCCESSFUL_URLS, cast(count_if(not success) as bigint) as FAILED_URLS from log""")
def q_upper_columns(spark, sf_dir):
    """Crawl statistics with upper-case column names."""
    return C.upper_columns(C.crawl_stats(_log(spark, sf_dir)))


@query("file_stats", oracle=f"""
with {LOG}
select file_type, count(*) as count, cast(sum(size) as bigint) as total_size
from log where file_type is not null group by file_type""")
def q_file_stats(spark, sf_dir):
    """D2 + B4: count and total size per file type."""
    return C.file_stats(_log(spark, sf_dir))


@query("stats_report", oracle=f"""
with {LOG},
c as (select count(*) as total_urls, cast(count_if(success) as bigint) as successful_urls, cast(count_if(not success) as bigint) as failed_urls from log),
f as (select file_type, count(*) as count, cast(sum(size) as bigint) as total_size
      from log where file_type is not null group by file_type),
fj as (select '{{' || coalesce(string_agg('"' || file_type || '":{{"count":' || count || ',"total_size":' || total_size || '}}', ',' order by file_type), '') || '}}' as file_stats from f)
select '{{"total_urls":' || total_urls || ',"successful_urls":' || successful_urls || ',"failed_urls":' || failed_urls || '}}' as crawl_stats,
       file_stats, '{AS_OF.replace(' ', 'T')}' as last_update
from c, fj""")
def q_stats_report(spark, sf_dir):
    """D3 + A6 + H20: combined statistics document as JSON text."""
    return C.stats_report(_log(spark, sf_dir), AS_OF)


@query("cached_urls", oracle=f"with {LOG} select distinct url from log")
def q_cached_urls(spark, sf_dir):
    """Distinct URLs in the log."""
    return C.cached_urls(_log(spark, sf_dir))


@query("latest_per_url", headline=True, oracle=f"with {LOG}, {LATEST} select * from latest")
def q_latest_per_url(spark, sf_dir):
    """Newest row per URL, taken by its place in the files."""
    return C.latest_per_url(crawl_log_from_events(located(read_table(spark, sf_dir, "events"))))


_RESULT = f"""
with {LOG}, {META_LOG}, {META_LATEST}
select url, coalesce(success, false) as success, error_message,
       coalesce(json_extract(metadata, '$.MEDIA')::varchar, '{{}}') as media,
       coalesce(json_extract(metadata, '$.LINKS')::varchar, '{{}}') as links,
       coalesce(json_extract(metadata, '$.METADATA')::varchar, '{{}}') as page_metadata
from mlatest where url = '{LOOKUP_URL}'"""


@query("crawl_result", oracle=_RESULT)
def q_crawl_result(spark, sf_dir):
    """B2 + H17: point lookup of one URL's latest result."""
    return C.crawl_result(_meta_log(spark, sf_dir), LOOKUP_URL)


@query("crawl_result_clustered", oracle=_RESULT)
def q_crawl_result_clustered(spark, sf_dir):
    """B2: the same look-up in a log written by ranges of its URLs."""
    log = C.write_clustered(_meta_log(spark, sf_dir), scratch_path(spark, "clustered-log"))
    return C.crawl_result(log, LOOKUP_URL)


@query("saved_files", oracle=f"""
with {LOG}, {META_LOG}
select url, file_name, file_type, content_type, size, metadata,
       case when json_extract_string(metadata, '$.STAGE_PATH') is not null
            then '{STAGE_PREFIX}' || json_extract_string(metadata, '$.STAGE_PATH') end as file_path
from mlog where file_type = '{FILE_TYPE}'""")
def q_saved_files(spark, sf_dir):
    """B1 + B3 + B15 + F1: saved files of one type, newest first."""
    return C.saved_files(_meta_log(spark, sf_dir), file_type=FILE_TYPE, stage_prefix=STAGE_PREFIX)


@query("json_fields", oracle=f"""
with {LOG}, {META_LOG}
select event_id, cast(json_extract_string(metadata, '$.k') as bigint) as k,
       coalesce(json_extract(metadata, '$.MEDIA')::varchar, '{{}}') as media,
       coalesce(json_extract(metadata, '$.LINKS')::varchar, '{{}}') as links,
       coalesce(json_extract(metadata, '$.METADATA')::varchar, '{{}}') as page_metadata from mlog""")
def q_json_fields(spark, sf_dir):
    """H16 + H17: fields of the JSON metadata column."""
    log = _meta_log(spark, sf_dir)
    return log.select("event_id", F.get_json_object("metadata", "$.k").cast("long").alias("k"),
                      C.json_field("metadata", "MEDIA").alias("media"),
                      C.json_field("metadata", "LINKS").alias("links"),
                      C.json_field("metadata", "METADATA").alias("page_metadata"))


@query("result_rows", oracle=f"""
with {LOG}, {LATEST}, {FILES}
select l.url,
       case when coalesce(success, false) then '{C.STATUS_OK}' else '{C.STATUS_FAILED}' end as status,
       case when coalesce(success, false) then coalesce(n_files, 0) else 0 end as files,
       case when not coalesce(success, false) then coalesce(error_message, '{C.UNKNOWN_ERROR}') end as error
from latest l left join files f on l.url = f.url""")
def q_result_rows(spark, sf_dir):
    """C9 + B12: latest result per URL joined with its files, as display rows."""
    return C.result_rows(_results(spark, sf_dir))


@query("crawl_errors", oracle=f"""
with {LOG}, {LATEST}
select url, coalesce(error_message, '{C.UNKNOWN_ERROR}') as error from latest where not coalesce(success, false)""")
def q_crawl_errors(spark, sf_dir):
    """Failed results with message."""
    return C.crawl_errors(C.latest_per_url(_log(spark, sf_dir)))


@query("result_files", oracle=f"""
with {LOG}, {LATEST}
select distinct url, file_name from log
where file_name is not null and url in (select url from latest where coalesce(success, false))""")
def q_result_files(spark, sf_dir):
    """Every saved file of every successful latest result."""
    log = _log(spark, sf_dir)
    return C.result_files(C.latest_per_url(log).select("url", "success"), log)


@query("crawl_summary", oracle=f"""
with {LOG}, {LATEST}, {FILES}
select count(*) as total,
       case when count(*) > 0 then round(count_if(coalesce(success, false)) * 100.0 / count(*), 1) else 0.0 end as success_rate,
       coalesce(sum(case when coalesce(success, false) then coalesce(n_files, 0) end), 0) :: bigint as saved_files
from latest l left join files f on l.url = f.url""")
def q_crawl_summary(spark, sf_dir):
    """Total, success rate, saved files."""
    return C.crawl_summary(_results(spark, sf_dir))


@query("crawl_metrics", oracle=f"""
with {LOG}, x as (select * from log where not ({SKIPPED}))
select cast(count_if(success) as bigint) as successful, cast(count_if(not success) as bigint) as failed,
       (select count(*) from log where {SKIPPED}) as skipped,
       cast(case when count(*) > 0 then (count(*) - 1) // 10 + 1 else 0 end as bigint) as total_batches,
       (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as duration,
       case when (epoch_us(max(ts)) - epoch_us(min(ts))) > 0
            then (count_if(success) + count_if(not success)) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6)
            else 0.0 end as urls_per_second
from x""")
def q_crawl_metrics(spark, sf_dir):
    """D6 + H21: batch metrics over the whole log, URLs of users 30-39, 130-139 ... excluded."""
    return C.crawl_metrics(_log(spark, sf_dir), batch_size=10, patterns=[SKIP_PATTERN])


def _halves(spark, sf_dir):
    """The log before ``SPLIT_TS``, and the newest file row of each URL since."""
    log = _log(spark, sf_dir)
    target = log.where(F.col("ts") < F.lit(SPLIT_TS).cast("timestamp_ntz")).drop("event_id")
    upd = C.latest_per_url(log.where(F.col("ts") >= F.lit(SPLIT_TS).cast("timestamp_ntz"))) \
        .select("url", "file_name", "file_type", "content_type", "size", "metadata")
    return target, upd


_MERGED = f"""
with {LOG},
t as (select * exclude (event_id) from log where ts < TIMESTAMP '{SPLIT_TS}'),
u as (select url, file_name, file_type, content_type, size, metadata from (
        select *, row_number() over (partition by url order by ts desc, file_name desc) rn
        from log where ts >= TIMESTAMP '{SPLIT_TS}') x where rn = 1)
select t.url, t.success, t.error_message,
       case when u.url is not null then u.metadata else t.metadata end as metadata,
       case when u.url is not null then TIMESTAMP '{AS_OF}' else t.ts end as ts,
       t.markdown,
       case when u.url is not null then u.file_name else t.file_name end as file_name,
       case when u.url is not null then u.file_type else t.file_type end as file_type,
       case when u.url is not null then u.content_type else t.content_type end as content_type,
       case when u.url is not null then u.size else t.size end as size
from t left join u on t.url = u.url
union all
select url, null, null, metadata, TIMESTAMP '{AS_OF}', null, file_name, file_type, content_type, size
from u where url not in (select url from t)"""


@query("merge_file_metadata", oracle=_MERGED)
def q_merge_file_metadata(spark, sf_dir):
    """A3 / C4: upsert the later half's latest file rows into the earlier half."""
    return C.merge_file_metadata(*_halves(spark, sf_dir), AS_OF)


@query("upsert_buckets", oracle=_MERGED)
def q_upsert_buckets(spark, sf_dir):
    """A3 / C4: the same upsert on a log kept by buckets, in three versions: the updates arrive in two parts."""
    target, upd = _halves(spark, sf_dir)
    table = BucketedTable(spark, scratch_path(spark, "log-buckets"))
    table.create(target, "url", 16)
    for part in (0, 1):
        C.upsert_file_metadata(table, upd.where(F.pmod(F.xxhash64("url"), F.lit(2)) == part), AS_OF)
    return table.read()


@query("with_batches", oracle=f"""
with {LOG}, u as (select distinct url from log)
select url, cast((row_number() over (partition by {S.authority('url')} order by url) - 1) // 10 + 1 as bigint) as batch
from u""")
def q_with_batches(spark, sf_dir):
    """Batches of 10 URLs, numbered per domain."""
    return C.with_batches(C.cached_urls(_log(spark, sf_dir)), "url", 10, per="domain")


@query("batched_log", oracle=f"""
with {LOG}
select event_id, url, metadata, file_name, size,
       cast((row_number() over (partition by {S.authority('url')} order by url, event_id) - 1) // 10 + 1 as bigint) as batch
from log""")
def q_batched_log(spark, sf_dir):
    """Every log row, with its payload, in batches of 10 per domain."""
    b = C.with_batches(_log(spark, sf_dir), "url", 10, per="domain", ties=("event_id",))
    return b.select("event_id", "url", "metadata", "file_name", "size", "batch")


FETCH = """fetches as (select concat('https://s', cast(user_id % 7 as varchar), '.example.com/u/', cast(user_id as varchar)) as url,
       value / 100.0 as duration,
       case event_type when 'error' then 'error' when 'signup' then 'timeout' else 'ok' end as outcome from events)"""


def _fetch_log(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.lit("https://s"), (F.col("user_id") % 7).cast("string"), F.lit(".example.com/u/"),
                 F.col("user_id").cast("string")).alias("url"),
        (F.col("value") / 100.0).alias("duration"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "timeout")
         .otherwise("ok").alias("outcome"))


@query("fetch_stats", oracle=f"""
with {FETCH}
select count(*) as total_requests, round(coalesce(avg(duration), 0.0), 6) as avg_fetch_time,
       cast(count_if(outcome = 'error') as bigint) as errors, cast(count_if(outcome = 'timeout') as bigint) as timeouts from fetches""")
def q_fetch_stats(spark, sf_dir):
    """Requests, average fetch time, errors, timeouts of a fetch log (from events)."""
    from trawl.operators.frontier import fetch_stats
    st = fetch_stats(_fetch_log(spark, sf_dir))
    return st.withColumn("avg_fetch_time", F.round("avg_fetch_time", 6))   # summation order differs by engine


@query("urls_in_list", oracle=f"""
with {LOG}, {LATEST}
select event_id, url from log where url in (select url from latest where not coalesce(success, false))""")
def q_urls_in_list(spark, sf_dir):
    """C1 + B5: log rows whose URL is in a URL table (URLs whose latest crawl failed)."""
    log = _log(spark, sf_dir)
    failed = C.crawl_errors(C.latest_per_url(log)).select("url")
    return log.join(failed, "url", "left_semi").select("event_id", "url")
