"""Sitemaps (A7, T9-T12): candidates, parsing and the nested-sitemap walk.

Fetched robots/sitemap documents are a table ``(url, content, is_xml,
status)``.  XML documents are parsed with the standard library's
ElementTree inside a narrow ``mapInPandas`` (SQL ``xpath`` aborts the whole
job on one bad document, the reference only counts an error).  The walk
over nested sitemaps is the breadth-first operator of ``frontier`` on the
(sitemap -> loc) edges, with a visited set, so cycles end.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions.urls import authority, is_same_domain, normalize_url
from trawl.operators import frontier
from trawl.operators.links import anchors
from trawl.operators.util import spread
from trawl.session import checkpoint_dir, materialize

# Well-known sitemap paths, robots.txt rule, sitemap namespace.
WELL_KNOWN = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml",
              "/sitemaps/sitemap.xml", "/sitemap/sitemap.xml"]
ROBOTS_RX = r"(?i)Sitemap:\s*(\S+)"
SITEMAP_NS = "http://www.sitemaps.org/schemas/sitemap/0.9"


def is_xml_content(content_type) -> F.Column:
    """A response is treated as XML when its content type mentions xml."""
    c = F.col(content_type) if isinstance(content_type, str) else content_type
    return F.coalesce(F.lower(c).contains("xml"), F.lit(False))


def sitemap_candidates(sites: DataFrame, docs: DataFrame | None = None, site_col: str = "site") -> DataFrame:
    """Per site root ``scheme://authority``: the five well-known paths,
    plus every ``Sitemap:`` line of its robots.txt (relative ones joined to
    the root).  Returns distinct ``(site, sitemap_url)``."""
    s = sites.select(F.col(site_col).alias("site")).distinct()
    fixed = s.select("site", F.explode(F.array(*[F.lit(p) for p in WELL_KNOWN])).alias("p")) \
        .select("site", F.concat("site", "p").alias("sitemap_url"))
    if docs is None:
        return fixed
    robots = docs.where(F.col("status") == 200).select(
        F.col("url").alias("robots_url"), "content")
    hits = s.join(robots, F.concat(s["site"], F.lit("/robots.txt")) == robots["robots_url"])
    lines = hits.select("site", F.explode(F.regexp_extract_all("content", F.lit(ROBOTS_RX), F.lit(1))).alias("p"))
    absolute = F.when(F.col("p").startswith("http"), F.col("p")) \
        .when(F.col("p").startswith("/"), F.concat("site", "p")) \
        .otherwise(F.concat("site", F.lit("/"), "p"))
    return fixed.unionByName(lines.select("site", absolute.alias("sitemap_url"))).distinct()


_LOCS = T.StructType([T.StructField("url", T.StringType()), T.StructField("loc", T.StringType()),
                      T.StructField("kind", T.StringType()), T.StructField("error", T.StringType())])


def _xml_locs(content: str) -> list[str]:
    root = ET.fromstring(content)
    # white space around the URL is layout, not part of it (the reference keeps it)
    return [t for e in root.iter(f"{{{SITEMAP_NS}}}loc") if (t := (e.text or "").strip())]


def _parse(batches):
    for pdf in batches:
        rows = []
        for url, content, is_xml in zip(pdf["url"], pdf["content"], pdf["is_xml"]):
            if content is None:
                continue
            try:
                if is_xml:
                    rows.extend((url, loc, "xml", None) for loc in _xml_locs(content))
                else:
                    for h in anchors(content):
                        if h:
                            rows.append((url, urljoin(url, h), "html", None))
            except ET.ParseError as e:
                rows.append((url, None, "xml", f"xml parse error: {e}"))
            except Exception as e:
                rows.append((url, None, "html" if not is_xml else "xml", f"processing error: {e}"))
        yield pd.DataFrame(rows, columns=_LOCS.fieldNames())


def sitemap_locs(docs: DataFrame, base=None) -> DataFrame:
    """T10 + T12: ``(url, loc, kind, error)`` for every fetched (status 200)
    document.  XML: every ``<loc>`` of the sitemap namespace (sitemap
    indexes and url sets alike).  HTML: every ``<a href>``, resolved, kept
    when in the base domain (default: the sitemap's own authority).  A
    document that does not parse gives one row with ``error`` set."""
    ok = docs.where(F.col("status") == 200).select("url", "content", "is_xml")
    parsed = spread(ok).mapInPandas(_parse, _LOCS)
    b = F.lower(authority("url")) if base is None else (F.lit(base) if isinstance(base, str) else base)
    keep = F.col("error").isNotNull() | (F.col("kind") == "xml") | is_same_domain("loc", b)
    return parsed.where(keep)


def expand_sitemaps(docs: DataFrame, roots: DataFrame, max_rounds: int | None = None, base=None) -> DataFrame:
    """T11 + G1: URLs found by following sitemaps from ``roots`` (column
    ``url``); every found loc that is itself a fetched document is followed
    again until no new one is found (or ``max_rounds`` deep), each sitemap once.  Returns the
    distinct normalised URLs (NULL ones dropped)."""
    checkpoint_dir(docs.sparkSession)
    edges = materialize(sitemap_locs(docs, base).where(F.col("error").isNull())
                        .select(F.col("url").alias("src"), F.col("loc").alias("dst")), "sitemap-edges")
    fetched = docs.where(F.col("status") == 200).select("url")
    walk = frontier.discover(edges, roots.select("url"), None, max_rounds, pages=fetched)
    reached = walk.where("processed").select(F.col("url").alias("src"))
    found = edges.join(reached, "src", "left_semi").select(normalize_url("dst").alias("url"))
    return found.where(F.col("url").isNotNull()).distinct()
