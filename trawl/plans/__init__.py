"""Named queries over the driver tables (see ``registry``)."""

from trawl.plans import crawl, files, rag, retrieval, sitemap_plans, streams, web  # noqa: F401  (registers queries)
from trawl.plans.registry import HEADLINE, ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES", "HEADLINE"]
