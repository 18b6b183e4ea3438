"""Main text of crawled pages (T4).

The reference configures its browser to drop ``form, header, footer, nav``
elements; here a standard-library ``html.parser`` helper does the same per
page inside a narrow ``mapInPandas`` (script and style content is dropped
too).  Whitespace is collapsed to single spaces.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.operators.util import spread

# Tags whose content is not page text.
EXCLUDED_TAGS = ["form", "header", "footer", "nav"]
ALWAYS_DROPPED = ["script", "style", "noscript", "template"]
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
             "source", "track", "wbr"}


class _TextParser(HTMLParser):
    def __init__(self, drop):
        super().__init__(convert_charrefs=True)
        self.drop = drop
        self.stack: list[str] = []
        self.skip = 0
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID_TAGS:
            return
        self.stack.append(tag)
        if tag in self.drop:
            self.skip += 1

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack:
            t = self.stack.pop()
            if t in self.drop:
                self.skip -= 1
            if t == tag:
                break

    def handle_data(self, data):
        if self.skip == 0:
            self.parts.append(data)


def html_text(html: str, excluded=EXCLUDED_TAGS) -> str:
    p = _TextParser(set(excluded) | set(ALWAYS_DROPPED))
    p.feed(html)
    p.close()
    return " ".join(" ".join(p.parts).split())


_OUT = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                     T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


def page_text(pages: DataFrame, excluded_tags=None) -> DataFrame:
    """T4: ``(page_id, url, text, error)``; a page that does not parse gets
    NULL text and the error."""
    excl = list(EXCLUDED_TAGS if excluded_tags is None else excluded_tags)

    def run(batches):
        for pdf in batches:
            texts, errs = [], []
            for h in pdf["html"]:
                if h is None:
                    texts.append(None)
                    errs.append("no content")
                    continue
                try:
                    texts.append(html_text(h, excl))
                    errs.append(None)
                except Exception as e:
                    texts.append(None)
                    errs.append(f"parse error: {e}")
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "error": errs})

    src = pages.select(F.col("page_id").cast("long"), "url", "html")
    return spread(src).mapInPandas(run, _OUT)
