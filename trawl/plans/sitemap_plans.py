"""Registered sitemap queries.

The fetched sitemap documents are derived from the whole ``pages`` table,
per host: a robots.txt naming the sitemap index (lower-case ``sitemap:``),
a sitemap index, and url sets of at most 50,000 URLs each (the protocol's
limit; a host's pages are spread over ``ceil(n / 50000)`` files by page id,
so no file - and no ``collect_list`` group - grows past that).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.functions.urls import authority, normalize_url
from trawl.operators import sitemaps as SM
from trawl.plans import sqltext as S
from trawl.plans.registry import query
from trawl.session import scratch_path
from trawl.sources.tables import read_sitemaps, read_table

URLS_PER_FILE = 50_000
FOREIGN = "https://elsewhere.example.org/page"
NS = SM.SITEMAP_NS


def _xml_escape(c):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def sitemap_docs(pages):
    """SITEMAPS rows ``(url, content, is_xml, status)`` for every host of ``pages``."""
    p = pages.select("page_id", "url", F.lower(authority("url")).alias("host")).where(F.col("host") != "")
    per_host = p.groupBy("host").agg(F.count("*").alias("n"))
    parts = per_host.select("host", F.ceil(F.col("n") / URLS_PER_FILE).cast("int").alias("parts"))
    site = F.concat(F.lit("https://"), F.col("host"))
    tagged = p.join(parts, "host").withColumn("part", F.pmod("page_id", F.col("parts")))
    urlsets = tagged.groupBy("host", "part").agg(F.array_join(F.array_sort(F.collect_list(
        F.concat(F.lit("<url><loc>"), _xml_escape(F.col("url")), F.lit("</loc></url>")))), "").alias("body"))
    urlset_docs = urlsets.select(
        F.concat(site, F.lit("/sitemap-"), F.col("part").cast("string"), F.lit(".xml")).alias("url"),
        F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="{NS}">'), F.col("body"),
                 F.lit("</urlset>")).alias("content"))
    index_docs = parts.select(
        F.concat(site, F.lit("/sitemap_index.xml")).alias("url"),
        F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><sitemapindex xmlns="{NS}">'),
                 F.array_join(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.concat(
                     F.lit("<sitemap><loc>"), site, F.lit("/sitemap-"), i.cast("string"), F.lit(".xml</loc></sitemap>"))), ""),
                 F.lit("</sitemapindex>")).alias("content"))
    # nested indexes that only robots.txt names; white space and a foreign host in the last one
    def listing(tag, *locs):
        return F.concat(F.lit(f'<{tag} xmlns="{NS}">'), *[x for loc in locs for x in (
            F.lit("<url><loc>\n "), loc, F.lit(" </loc></url>"))], F.lit(f"</{tag}>"))
    nested = parts.select(F.explode(F.array(
        F.struct(F.concat(site, F.lit("/maps/extra.xml")).alias("url"),
                 listing("sitemapindex", F.concat(site, F.lit("/maps/l1.xml"))).alias("content")),
        F.struct(F.concat(site, F.lit("/maps/l1.xml")).alias("url"),
                 listing("sitemapindex", F.concat(site, F.lit("/maps/l2.xml"))).alias("content")),
        F.struct(F.concat(site, F.lit("/maps/l2.xml")).alias("url"),
                 listing("urlset", F.concat(site, F.lit("/deep")), F.lit(FOREIGN)).alias("content"))
    )).alias("d")).select("d.*")
    xml = urlset_docs.unionByName(index_docs).unionByName(nested).withColumn("content_type", F.lit("application/xml; charset=utf-8"))
    robots = parts.select(F.concat(site, F.lit("/robots.txt")).alias("url"),
                          F.concat(F.lit("User-agent: *\nDisallow: /private\nsitemap: "), site,
                                   F.lit("/sitemap_index.xml\nSitemap: /maps/extra.xml\nSITEMAP: news.xml\n")).alias("content"),
                          F.lit("text/plain").alias("content_type"))
    docs = xml.unionByName(robots)
    return docs.select("url", "content", SM.is_xml_content("content_type").alias("is_xml"),
                       F.lit(200).alias("status"))


def _docs(spark, sf_dir):
    return sitemap_docs(read_table(spark, sf_dir, "pages"))


def _sites(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    return p.select(F.concat(F.lit("https://"), F.lower(authority("url"))).alias("site")) \
        .where(F.col("site") != "https://").distinct()


_HOSTS = f"""hosts as (select lower({S.authority('url')}) as host, count(*) as n from pages
           where {S.authority('url')} <> '' group by all),
parts as (select host, unnest(range(0, cast(ceil(n / {URLS_PER_FILE}) as integer))) as part from hosts)"""


_NESTED = f"""(values ('/maps/extra.xml', '/maps/l1.xml'), ('/maps/l1.xml', '/maps/l2.xml'),
  ('/maps/l2.xml', '/deep'), ('/maps/l2.xml', '{FOREIGN}')) as nested(a, b)"""


@query("sitemap_candidates", oracle=f"""
with {_HOSTS}
select distinct 'https://' || host as site, 'https://' || host || p as sitemap_url
from hosts, (select unnest({[*SM.WELL_KNOWN, '/maps/extra.xml', '/news.xml']!r}) as p) w""")
def q_sitemap_candidates(spark, sf_dir):
    """T9 + H7: well-known sitemap paths and robots.txt sitemap lines per site."""
    return SM.sitemap_candidates(_sites(spark, sf_dir), _docs(spark, sf_dir))


@query("sitemap_locs", oracle=f"""
with {_HOSTS}
select 'https://' || host || '/sitemap_index.xml' as url, 'https://' || host || '/sitemap-' || cast(part as varchar) || '.xml' as loc
from parts
union all
select 'https://' || lower({S.authority('url')}) || '/sitemap-' || cast(page_id % cast(ceil(n / {URLS_PER_FILE}) as integer) as varchar) || '.xml', url
from pages join hosts on lower({S.authority('url')}) = host
union all
select 'https://' || host || a, case when b like 'https:%' then b else 'https://' || host || b end
from hosts, {_NESTED}""")
def q_sitemap_locs(spark, sf_dir):
    """T10 + A7: sitemap documents stored as a table, read back with the
    fixed schema, every <loc> of every sitemap index and url set."""
    path = scratch_path(spark, "sitemaps")
    _docs(spark, sf_dir).write.parquet(path)
    return SM.sitemap_locs(read_sitemaps(spark, path)).select("url", "loc")


@query("expand_sitemaps", headline=True, oracle=f"""
with {_HOSTS}
select distinct {S.normalize_url('u')} as url from (
  select 'https://' || host || '/sitemap-' || cast(part as varchar) || '.xml' as u from parts
  union all select url from pages
  union all select case when b like 'https:%' then b else 'https://' || host || b end from hosts, {_NESTED}) t
where {S.normalize_url('u')} is not null""")
def q_expand_sitemaps(spark, sf_dir):
    """T11 + G1: URLs found from each site's candidate sitemaps, nested sitemaps followed."""
    path = scratch_path(spark, "sitemaps")
    _docs(spark, sf_dir).write.parquet(path)
    docs = read_sitemaps(spark, path)
    roots = SM.sitemap_candidates(_sites(spark, sf_dir), docs).select(F.col("sitemap_url").alias("url"))
    return SM.expand_sitemaps(docs, roots)


@query("html_sitemap_domain", oracle=f"""
with h as (select url, unnest(list_append(list_append(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1),
                  'https://elsewhere.example.net/p/' || page_id), 'https://sub.' || regexp_extract(url, '^https?://([^/?#]+)', 1) || '/more')) as href
           from pages where html is not null),
r as (select url, case when href like 'http%' then href else concat(regexp_extract(url, '^https?://[^/?#]+'), href) end as loc
      from h where href <> '')
select distinct url, {S.normalize_url('loc')} as loc from r
where {S.normalize_url('loc')} is not null and {S.is_same_domain('loc', S.authority('url'))}""")
def q_html_sitemap_domain(spark, sf_dir):
    """Every page has a link to another site and one to a sub-domain; the same-domain test keeps the second alone."""
    p = read_table(spark, sf_dir, "pages").where(F.col("html").isNotNull())
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    html = F.concat("html", F.lit('<a href="https://elsewhere.example.net/p/'), F.col("page_id").cast("string"), F.lit('">x</a><a href="https://sub.'),
                    host, F.lit('/more">y</a>'))
    docs = p.select("url", html.alias("content"), F.lit(False).alias("is_xml"), F.lit(200).alias("status"))
    locs = SM.sitemap_locs(docs).where(F.col("error").isNull())
    return locs.select("url", normalize_url("loc").alias("loc")).where(F.col("loc").isNotNull()).distinct()


@query("html_sitemap_links", oracle=f"""
with h as (select url, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)) as href from pages),
r as (select url, concat(regexp_extract(url, '^https?://[^/?#]+'), href) as loc from h where href <> '')
select distinct url, {S.normalize_url('loc')} as loc from r where {S.normalize_url('loc')} is not null""")
def q_html_sitemap_links(spark, sf_dir):
    """Pages read as HTML sitemaps: same-domain links, resolved, normalised."""
    p = read_table(spark, sf_dir, "pages")
    docs = p.select("url", F.col("html").alias("content"), F.lit(False).alias("is_xml"), F.lit(200).alias("status"))
    locs = SM.sitemap_locs(docs).where(F.col("error").isNull())
    return locs.select("url", normalize_url("loc").alias("loc")).where(F.col("loc").isNotNull()).distinct()
