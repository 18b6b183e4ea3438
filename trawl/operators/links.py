"""Link extraction and the page graph.

HTML is parsed with the standard-library ``html.parser`` inside a narrow
``mapInPandas`` (one pass per page, no shuffle); relative links are resolved
there with ``urljoin``.  Everything after that - the href filter,
normalisation, classification, de-duplication and adjacency lists - is
built-in Spark.
"""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions.urls import authority, is_same_domain, normalize_url, usable_href
from trawl.operators.util import spread

RAW_LINKS = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("src", T.StringType()),
    T.StructField("href", T.StringType()),
    T.StructField("dst_raw", T.StringType()),
    T.StructField("error", T.StringType()),
])


class _AnchorParser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hrefs: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            for name, value in attrs:
                if name == "href" and value is not None:
                    self.hrefs.append(value)
                    break


def anchors(html: str) -> list[str]:
    """All ``<a href>`` values of a page, in document order."""
    p = _AnchorParser()
    p.feed(html)
    p.close()
    return p.hrefs


def _resolve(base: str, href: str) -> str | None:
    try:
        return urljoin(base, href)
    except ValueError:
        return None


def _extract(batches):
    skip = ("javascript:", "mailto:", "tel:")
    for pdf in batches:
        rows = []
        for pid, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
            if html is None or url is None:
                rows.append((pid, url, None, None, "no content"))
                continue
            try:
                hrefs = anchors(html)
            except Exception as e:  # a page that does not parse gives no links
                rows.append((pid, url, None, None, f"parse error: {e}"))
                continue
            for h in hrefs:
                # B11 here as well, so that unusable hrefs are not resolved
                if h and h.strip() and not h.startswith(skip):
                    rows.append((pid, url, h, _resolve(url, h), None))
        yield pd.DataFrame(rows, columns=RAW_LINKS.fieldNames())


def raw_links(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """One row per usable ``<a href>``: page, href, resolved target, and one
    row with ``error`` set for a page without content or that fails to parse."""
    src = pages.select(F.col(id_col).cast("long").alias("page_id"),
                       F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return spread(src).mapInPandas(_extract, RAW_LINKS)


def links_from_raw(raw: DataFrame) -> DataFrame:
    ok = raw.where(F.col("error").isNull() & usable_href("href"))
    return (ok.select("page_id", "src", normalize_url("dst_raw").alias("dst"))
            .where(F.col("dst").isNotNull())
            .dropDuplicates(["page_id", "dst"]))


def extract_links(pages: DataFrame, **kw) -> DataFrame:
    """Distinct ``(page_id, src, dst)``; dst is the normalised target."""
    return links_from_raw(raw_links(pages, **kw))


def classify_links(links: DataFrame, base=None, normalized: bool = True) -> DataFrame:
    """``kind`` = same_domain | external.  ``base`` is a domain string,
    a column, or None for each source page's own authority.  ``normalized``:
    the targets come from :func:`extract_links` (normalised, so their
    authority needs no further check)."""
    if base is None:
        b = F.lower(authority("src"))
    elif isinstance(base, str):
        b = F.lit(base)
    else:
        b = base
    return links.withColumn(
        "kind", F.when(is_same_domain("dst", b, validate=not normalized), F.lit("same_domain"))
        .otherwise(F.lit("external")))


def link_lists(links: DataFrame, key="src") -> DataFrame:
    """Per page, sorted distinct same-domain and external targets.

    The per-page lists are bounded by what one page links to.  Partial
    aggregation (map-side ``collect_set``) runs before the shuffle.
    """
    return links.groupBy(key).agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "same_domain", F.col("dst")))).alias("same_domain"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "external", F.col("dst")))).alias("external"))


def link_graph(pages: DataFrame, base=None, **kw) -> DataFrame:
    """One node per page: sorted distinct same-domain and external
    targets, and ``error`` for pages that could not be read (no content /
    parse failure).  The HTML is parsed once: lists and errors come from one
    aggregation over the parsed rows; the join back to the page nodes reads
    only their id and URL."""
    raw = raw_links(pages, **kw)
    if base is None:
        b = F.lower(authority("src"))
    else:
        b = F.lit(base) if isinstance(base, str) else base
    ok = F.col("error").isNull() & usable_href("href")
    # targets and their class in a projection first (computed once per row)
    staged = raw.select("page_id", "error", F.when(ok, normalize_url("dst_raw")).alias("dst"), b.alias("_b")) \
        .withColumn("_same", is_same_domain("dst", F.col("_b"), validate=False))
    agg = staged.groupBy("page_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("_same"), F.col("dst")))).alias("same_domain"),
        F.array_sort(F.collect_set(F.when(~F.col("_same"), F.col("dst")))).alias("external"),
        F.max("error").alias("error"))
    nodes = pages.select(F.col(kw.get("id_col", "page_id")).cast("long").alias("page_id"),
                         F.col(kw.get("url_col", "url")).alias("url"))
    empty = F.array().cast("array<string>")
    return (nodes.join(agg, "page_id", "left")
            .select("page_id", "url",
                    F.coalesce("same_domain", empty).alias("same_domain"),
                    F.coalesce("external", empty).alias("external"),
                    "error"))


def external_links(links: DataFrame, base) -> DataFrame:
    """Extracted minus same-domain = external targets."""
    return classify_links(links, base).where(F.col("kind") == "external")
