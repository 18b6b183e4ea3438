"""Registered page-text and saved-file queries.

Crawl results are derived from the whole ``documents`` table: the text is
the markdown (raw markdown for English documents), German documents also
carry it as a PDF, French ones a screenshot, and every document has three
media items (a data-URL image, an item without ``src`` and one whose data
is not base64).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl import schemas
from trawl.operators import assets as A
from trawl.operators import pages as P
from trawl.operators.crawl_log import saved_content_counts
from trawl.plans.registry import query
from trawl.session import scratch_path
from trawl.sources.tables import read_table

DOC_URL = "https://docs.example.com/d/"
DOMAIN = "docs.example.com"


def _results(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    b64 = F.base64(F.encode("text", "UTF-8"))
    ext = (F.when(F.col("lang") == "en", ".png").when(F.col("lang") == "de", ".jpg")
           .when(F.col("lang") == "fr", ".GIF").otherwise(""))
    media = F.array(
        F.struct(F.concat(F.lit("img/"), F.col("source"), ext).alias("src"),
                 F.concat(F.lit("data:image/png;base64,"), b64).alias("data"),
                 F.col("source").alias("alt"), (F.col("n_chars") / 1000.0).alias("score")),
        F.struct(F.lit("").alias("src"), b64.alias("data"), F.lit(None).cast("string").alias("alt"),
                 F.lit(None).cast("double").alias("score")),
        F.struct(F.lit("broken.gif").alias("src"), F.lit("@@ not base64 @@").alias("data"),
                 F.lit(None).cast("string").alias("alt"), F.lit(None).cast("double").alias("score")))
    return d.select(
        F.concat(F.lit(DOC_URL), F.col("doc_id").cast("string")).alias("url"),
        F.lit(True).alias("success"), F.lit(None).cast("string").alias("error_message"),
        F.concat(F.lit("# "), F.col("text")).alias("markdown"),
        F.when(F.col("lang") == "en", F.col("text")).alias("raw_markdown"),
        F.when(F.col("lang") == "de", F.encode("text", "UTF-8")).alias("pdf"),
        F.when(F.col("lang") == "fr", F.base64(F.encode(F.col("text"), "UTF-8"))).alias("screenshot"),
        media.cast(schemas.CRAWL_RESULT["media"].dataType).alias("media"),
        F.array().cast("array<string>").alias("links"),
        F.create_map().cast("map<string,string>").alias("metadata"))


SQL_ASSETS = f"""d as (select '{DOC_URL}' || cast(doc_id as varchar) as url, * from documents),
a as (
  select url, sha256(url) || '.md' as file_name, 'markdown' as file_type, 'text/markdown' as content_type,
         cast(octet_length(encode(case when lang = 'en' then text else '# ' || text end)) as bigint) as size
  from d
  union all
  select url, sha256(url) || '.pdf', 'pdf', 'application/pdf', cast(octet_length(encode(text)) as bigint)
  from d where lang = 'de'
  union all
  select url, sha256(src) || ext, 'image',
         case lower(ext) when '.png' then 'image/png' when '.jpg' then 'image/jpeg' when '.gif' then 'image/gif' else 'image/unknown' end,
         cast(octet_length(encode(text)) as bigint)
  from (select url, text, 'img/' || source || case lang when 'en' then '.png' when 'de' then '.jpg' when 'fr' then '.GIF' else '' end as src,
               case lang when 'en' then '.png' when 'de' then '.jpg' when 'fr' then '.GIF' else '.png' end as ext from d) i
  union all
  select url, sha256(url) || '.png', 'screenshot', 'image/png', cast(octet_length(encode(text)) as bigint)
  from d where lang = 'fr')"""


_PAGE_TEXT_SQL = r"""
with a as (select page_id, url, html, regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g') h from pages),
b as (select page_id, url, html, regexp_replace(h, '(?is)<(script|style|noscript|template|form|header|footer|nav)\b[^>]*>.*?</(script|style|noscript|template|form|header|footer|nav)\s*>', ' ', 'g') h from a),
c as (select page_id, url, html, regexp_replace(h, '(?s)<[^>]*>', ' ', 'g') h from b),
d as (select page_id, url, html,
             replace(replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
                     '&#39;', chr(39)), '&amp;', '&'), '&amp', '&') h from c)
select page_id, url, case when html is not null then trim(regexp_replace(h, '\s+', ' ', 'g')) end as text,
       case when html is null then 'no content' end as error
from d"""


# SQL twin: regex removal of comments, dropped elements and tags, then the
# entities that occur in the data; equal to the parser's text on the driver tables
@query("page_text", headline=True, oracle=_PAGE_TEXT_SQL)
def q_page_text(spark, sf_dir):
    """T4: main text of every page without form/header/footer/nav/script/style."""
    return P.page_text(read_table(spark, sf_dir, "pages"))


@query("extract_assets", oracle=f"""
with {SQL_ASSETS}
select url, file_name, file_type, content_type, size,
       '{DOMAIN}/' || case file_type when 'image' then 'images' when 'pdf' then 'pdfs' when 'screenshot' then 'screenshots' else 'markdown' end || '/' || file_name as stage_path
from a""")
def q_extract_assets(spark, sf_dir):
    """T6 + T5 + H8-H11: saved files of every crawl result."""
    a = A.extract_assets(_results(spark, sf_dir))
    return a.select("url", "file_name", "file_type", "content_type", "size", "stage_path")


@query("asset_meta", oracle=f"""
with {SQL_ASSETS}
select url, file_name, file_type, case file_type when 'markdown' then 'markdown_v2' end as type,
       case when file_type = 'markdown' then case when lang = 'en' then text else '# ' || text end end as markdown_content,
       case when file_type = 'image' then 'img/' || source || case lang when 'en' then '.png' when 'de' then '.jpg' when 'fr' then '.GIF' else '' end end as src
from a join d using (url)""")
def q_asset_meta(spark, sf_dir):
    """The metadata of saved files: kind and whole text of markdown, source of images."""
    a = A.extract_assets(_results(spark, sf_dir))
    return a.select("url", "file_name", "file_type", *[F.col("meta")[k].alias(k) for k in ("type", "markdown_content", "src")])


@query("saved_content_counts", oracle=f"""
with {SQL_ASSETS},
c as (select case file_type when 'image' then 'images' else file_type end as content, count(*) as saved from a group by all),
f as (select unnest(['markdown', 'images', 'pdf', 'screenshot']) as content)
select f.content, coalesce(c.saved, 0) as saved from f left join c using (content)""")
def q_saved_content_counts(spark, sf_dir):
    """Saved files per content type, the four types always listed."""
    return saved_content_counts(A.extract_assets(_results(spark, sf_dir)))


@query("write_assets", oracle=f"""
with {SQL_ASSETS}
select '{DOMAIN}' as domain, file_type, count(*) as files, cast(sum(size) as bigint) as bytes from a group by all""")
def q_write_assets(spark, sf_dir):
    """A5: files written partitioned by domain and type, read back and summed."""
    path = scratch_path(spark, "assets")
    A.write_assets(A.extract_assets(_results(spark, sf_dir)), path, mode="overwrite")
    back = spark.read.parquet(path)
    return back.groupBy("domain", "file_type").agg(
        F.count("*").alias("files"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"))


@query("append_crawl_log", oracle=f"""
select '{DOC_URL}' || cast(doc_id as varchar) as url, true as success,
       case when lang = 'en' then text else '# ' || text end as markdown,
       cast(3 as integer) as n_media, cast(0 as integer) as n_links
from documents""")
def q_append_crawl_log(spark, sf_dir):
    """A2 + T5 + H16: crawl results appended to a log table in two appends, read back."""
    from trawl.operators.crawl_log import append_crawl_log
    path = scratch_path(spark, "crawl-log")
    res = _results(spark, sf_dir)
    append_crawl_log(res.where(F.col("raw_markdown").isNotNull()), path, "2024-02-01 00:00:00")
    append_crawl_log(res.where(F.col("raw_markdown").isNull()), path, "2024-02-01 00:00:00")
    log = spark.read.parquet(path)
    return log.select("url", "success", "markdown",
                      F.json_array_length(F.get_json_object("metadata", "$.MEDIA")).alias("n_media"),
                      F.json_array_length(F.get_json_object("metadata", "$.LINKS")).alias("n_links"))


@query("append_documents", oracle=f"""
select '{DOC_URL}' || cast(doc_id as varchar) as source_id, text as contents from documents
union all
select '{DOC_URL}' || cast(doc_id as varchar), text from documents where lang = 'en'""")
def q_append_documents(spark, sf_dir):
    """A4: documents appended in bulk (all, then the English ones again), read back."""
    from trawl.operators.crawl_log import append_documents
    path = scratch_path(spark, "documents")
    d = read_table(spark, sf_dir, "documents").select(
        F.concat(F.lit(DOC_URL), F.col("doc_id").cast("string")).alias("source_id"),
        F.col("text").alias("contents"), "lang")
    append_documents(d, path)
    append_documents(d.where(F.col("lang") == "en"), path)
    return spark.read.parquet(path)
