"""Registered URL, filter, link and discovery queries over ``pages`` / ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.functions import urls as U
from trawl.operators import filters, frontier, links
from trawl.operators.util import spread
from trawl.plans import sqltext as S
from trawl.plans.registry import query
from trawl.session import materialize, scratch_path
from trawl.sources.tables import link_graph_from_lineitem, link_graph_sql, read_table

# Fixed values of the registered queries (parameters, not data subsets)
EXCLUDE = ["^fr/", "7$", "["]               # "[" is invalid: logged and ignored
SELECT_TEXT = "PAGE=2\n\n  utm_source  \n"
BASE_DOMAIN = "example.com"
GRAPH_SEED = "https://g.example.com/p/1"
GRAPH_DOMAIN = "g.example.com"
HREF_RX = r'<a\s[^>]*?href="([^"]*)"'


def _pages(spark, sf_dir):
    return read_table(spark, sf_dir, "pages")


def _bare(x):
    return f"regexp_replace({x}, '^https?://', '')"


@query("normalize_url", oracle=f"""
select page_id, url, {S.normalize_url('url')} as norm_url,
       {S.normalize_url(_bare('url'))} as norm_bare
from pages""")
def q_normalize_url(spark, sf_dir):
    """H1 on every page URL, as given and with its scheme removed."""
    p = _pages(spark, sf_dir)
    return p.select("page_id", "url", U.normalize_url("url").alias("norm_url"),
                    U.normalize_url(F.regexp_replace("url", "^https?://", "")).alias("norm_bare"))


@query("clean_url", oracle=f"""
select page_id, {S.clean_url('url')} as cleaned, {S.clean_url(_bare('url'))} as cleaned_bare from pages""")
def q_clean_url(spark, sf_dir):
    """H2: scheme, authority and path only."""
    p = _pages(spark, sf_dir)
    return p.select("page_id", U.clean_url("url").alias("cleaned"),
                    U.clean_url(F.regexp_replace("url", "^https?://", "")).alias("cleaned_bare"))


@query("url_parts", oracle=f"""
select page_id, {S.authority('url')} as authority, {S.stripped_path('url')} as path,
       {S.is_same_domain('url', "'" + BASE_DOMAIN + "'")} as same_domain,
       ends_with(url, '.html') as is_html, starts_with(url, 'https://') as is_https
from pages""")
def q_url_parts(spark, sf_dir):
    """H3, H4, B7, H6 on every page URL."""
    p = _pages(spark, sf_dir)
    return p.select("page_id", U.authority("url").alias("authority"),
                    U.stripped_path("url").alias("path"),
                    U.is_same_domain("url", F.lit(BASE_DOMAIN)).alias("same_domain"),
                    F.col("url").endswith(".html").alias("is_html"),
                    F.col("url").startswith("https://").alias("is_https"))


@query("filter_urls", oracle=f"""
select distinct cleaned as url from (select {S.clean_url('url')} as cleaned from pages) t
where not (regexp_matches({S.stripped_path('cleaned')}, '^fr/')
           or regexp_matches({S.stripped_path('cleaned')}, '7$'))""")
def q_filter_urls(spark, sf_dir):
    """B10 + B8 + G5: clean, exclude by path patterns, distinct."""
    return filters.filter_urls(_pages(spark, sf_dir), EXCLUDE)


@query("select_urls", oracle="""
select url, not (regexp_matches(url, '(?i)PAGE=2') or regexp_matches(url, '(?i)utm_source')) as selected
from pages""")
def q_select_urls(spark, sf_dir):
    """UI selection flag, patterns one per line, whole URL, any case."""
    return filters.select_urls(_pages(spark, sf_dir).select("url"), SELECT_TEXT)


@query("selection_counts", oracle="""
select count(*) filter (where not (regexp_matches(url, '(?i)PAGE=2') or regexp_matches(url, '(?i)utm_source'))) as selected,
       count(*) as total
from pages""")
def q_selection_counts(spark, sf_dir):
    """D13: "k out of n" URLs selected."""
    return filters.selection_counts(filters.select_urls(_pages(spark, sf_dir).select("url"), SELECT_TEXT))


@query("validate_urls", oracle=f"""
with c as (select {_bare('url')} as input from pages),
n as (select input, {S.normalize_url('input')} as url from c),
k as (select distinct {S.normalize_url('url')} as url from pages)
select input, url from n where url is not null and url in (select url from k where url is not null)""")
def q_validate_urls(spark, sf_dir):
    """Scheme-less page URLs, normalised (https), kept when a page has that URL."""
    p = _pages(spark, sf_dir)
    cand = p.select(F.regexp_replace("url", "^https?://", "").alias("url"))
    return filters.validate_urls(cand, p)


def _links_sql():
    return f"""
with h as (select page_id, url, unnest(regexp_extract_all(html, '{HREF_RX}', 1)) as href from pages),
r as (select page_id, concat(regexp_extract(url, '^https?://[^/?#]+'), href) as dst_raw from h
      where trim(href) <> '' and not (starts_with(href, 'javascript:') or starts_with(href, 'mailto:') or starts_with(href, 'tel:'))),
l as (select distinct page_id, {S.normalize_url('dst_raw')} as dst from r)
select * from l where dst is not null"""


@query("extract_links", headline=True, oracle=f"""
{_links_sql()}""")
def q_extract_links(spark, sf_dir):
    """T1 (+ B11, H5, H1, D11): distinct normalised link targets per page."""
    return links.extract_links(_pages(spark, sf_dir)).select("page_id", "dst")


@query("classify_links", oracle=f"""
{_links_sql().replace('select * from l where dst is not null', '')}
select page_id, dst, case when {S.is_same_domain('dst', "'" + BASE_DOMAIN + "'")} then 'same_domain' else 'external' end as kind
from l where dst is not null""")
def q_classify_links(spark, sf_dir):
    """Links classified against the base domain."""
    return links.classify_links(links.extract_links(_pages(spark, sf_dir)), BASE_DOMAIN) \
        .select("page_id", "dst", "kind")


@query("link_lists", oracle=f"""
{_links_sql().replace('select * from l where dst is not null', '')},
k as (select page_id, dst, {S.is_same_domain('dst', "'" + BASE_DOMAIN + "'")} as same from l where dst is not null)
select page_id,
       coalesce(string_agg(dst, ' ' order by dst) filter (where same), '') as same_domain,
       coalesce(string_agg(dst, ' ' order by dst) filter (where not same), '') as external,
       count(*) filter (where same) as n_same, count(*) filter (where not same) as n_external
from k group by page_id""")
def q_link_lists(spark, sf_dir):
    """Sorted distinct same-domain / external targets per page."""
    lk = links.classify_links(links.extract_links(_pages(spark, sf_dir)), BASE_DOMAIN)
    ll = links.link_lists(lk, key="page_id")
    return ll.select("page_id", F.array_join("same_domain", " ").alias("same_domain"),
                     F.array_join("external", " ").alias("external"),
                     F.size("same_domain").cast("long").alias("n_same"),
                     F.size("external").cast("long").alias("n_external"))


@query("link_graph", oracle=f"""
{_links_sql().replace('select * from l where dst is not null', '')},
k as (select page_id, dst, {S.is_same_domain('dst', S.authority('url'))} as same from l join pages using (page_id) where dst is not null),
c as (select page_id, string_agg(dst, ' ' order by dst) filter (where same) as same_domain,
             string_agg(dst, ' ' order by dst) filter (where not same) as external from k group by page_id)
select p.page_id, p.url, coalesce(same_domain, '') as same_domain, coalesce(external, '') as external,
       case when p.html is null then 'no content' end as error
from pages p left join c on p.page_id = c.page_id""")
def q_link_graph(spark, sf_dir):
    """One node per page with its out-degree and read error."""
    g = links.link_graph(_pages(spark, sf_dir))
    return g.select("page_id", "url", F.array_join(F.array_sort("same_domain"), " ").alias("same_domain"),
                    F.array_join(F.array_sort("external"), " ").alias("external"), "error")


_HAS_PAGE = ("(regexp_extract({u}, '/p/([0-9]+)$', 1) = '' "
             "or coalesce(try_cast(regexp_extract({u}, '/p/([0-9]+)$', 1) as bigint), 0) % 7 <> 0)")


def _bfs_sql():
    return f"""
with recursive graph as (select * from ({link_graph_sql()}) g where {_HAS_PAGE.format(u='src')}),
r(url, depth) as (
  select '{GRAPH_SEED}', 0
  union
  select g.dst, r.depth + 1 from r join graph g on g.src = r.url
  where r.depth < 3 and {S.is_same_domain('g.dst', "'" + GRAPH_DOMAIN + "'")}),
d as (select url, cast(min(depth) as integer) as depth from r group by url)"""


_WALKS: dict[tuple[str, str], str] = {}


def _graph(spark, sf_dir):
    """The lineitem page graph, its seed and its pages: every seventh part has no page, so there are error nodes."""
    # the walk reads the edges once a round: a table of few pieces would leave that to few tasks, so the two keys are spread
    g = link_graph_from_lineitem(spread(read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")))
    part = F.regexp_extract("src", "/p/([0-9]+)$", 1)
    # each source is tested once; with the count in it, the test stays behind the grouping
    has_page = ((part == "") | (F.expr("try_cast(regexp_extract(src, '/p/([0-9]+)$', 1) as bigint)") % 7 != 0))
    pages = g.groupBy("src").agg(F.count("*").alias("_n")).where(F.when(F.col("_n") > 0, has_page)).select(F.col("src").alias("url"))
    return g, spark.createDataFrame([(GRAPH_SEED,)], "url string"), pages


def _discovered(spark, sf_dir):
    """The walk over the lineitem page graph, written once per application and shared by its queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WALKS:
        g, seeds, pages = _graph(spark, sf_dir)
        path = scratch_path(spark, "discovered")
        frontier.discover(g, seeds, GRAPH_DOMAIN, 3, pages=pages).write.parquet(path)
        _WALKS[key] = path
    return spark.read.parquet(_WALKS[key])


_DISCOVERED = f"""
{_bfs_sql()}
select url, depth, depth < 3 and {_HAS_PAGE.format(u='url')} as processed,
       case when depth < 3 and not ({_HAS_PAGE.format(u='url')}) then 'not fetchable' end as error from d"""


@query("discover", headline=True, oracle=_DISCOVERED)
def q_discover(spark, sf_dir):
    """G6 (+ C3, C8, B7): 3-round breadth-first discovery on the lineitem page graph."""
    return _discovered(spark, sf_dir).select("url", "depth", "processed", "error")


@query("resumed_walk", oracle=_DISCOVERED)
def q_resumed_walk(spark, sf_dir):
    """G6 + C8: the same walk over bucketed edges, stopped after each round and taken up again from its written state."""
    g, seeds, pages = _graph(spark, sf_dir)
    edges = frontier.bucketed_edges(g, scratch_path(spark, "edges"))
    state = scratch_path(spark, "walk")
    pages = materialize(frontier.url_set(pages), "walk-pages")
    frontier.Walk(edges, state, GRAPH_DOMAIN, pages).add(seeds)
    for _ in range(3):
        frontier.Walk(edges, state, GRAPH_DOMAIN, pages).run(1)
    return frontier.Walk(edges, state, GRAPH_DOMAIN, pages).result()


@query("pending_urls", oracle=f"""
{_bfs_sql()}
select url from d where depth >= 3 or not {_HAS_PAGE.format(u='url')}""")
def q_pending_urls(spark, sf_dir):
    """Discovered minus processed after discovery."""
    d = _discovered(spark, sf_dir)
    return frontier.pending_urls(d.select("url"), d.where("processed").select("url"))


@query("url_stats", oracle=f"""
{_bfs_sql()}
select count(*) as total_discovered, count(*) filter (where depth < 3 and {_HAS_PAGE.format(u='url')}) as total_processed,
       count(*) filter (where depth >= 3 or not {_HAS_PAGE.format(u='url')}) as pending,
       count(distinct {S.authority('url')}) as domains,
       90.0 as elapsed_seconds, count(*) / 90.0 as urls_per_second
from d""")
def q_url_stats(spark, sf_dir):
    """Discovery statistics."""
    d = _discovered(spark, sf_dir)
    return frontier.url_stats(d, start="2024-02-01 00:00:00", end="2024-02-01 00:01:30").select(
        "total_discovered", "total_processed", "pending", "domains", "elapsed_seconds", "urls_per_second")


@query("external_links", oracle=f"""
{_links_sql().replace('select * from l where dst is not null', '')}
select page_id, dst from l where dst is not null and not {S.is_same_domain('dst', "'" + BASE_DOMAIN + "'")}""")
def q_external_links(spark, sf_dir):
    """Extracted links minus same-domain ones."""
    return links.external_links(links.extract_links(_pages(spark, sf_dir)), BASE_DOMAIN).select("page_id", "dst")


@query("mark_processed", oracle=f"""
{_bfs_sql()}
select url from d where depth <= 1 and {_HAS_PAGE.format(u='url')} or depth >= 3""")
def q_mark_processed(spark, sf_dir):
    """The pages of the first two levels, and then the URLs of the last one marked as processed."""
    d = _discovered(spark, sf_dir)
    return frontier.mark_processed(d.where("processed and depth <= 1").select("url"),
                                   d.where("depth >= 3").select("url"))
