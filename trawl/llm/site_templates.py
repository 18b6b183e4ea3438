"""Main text of web pages: site templates are found by counting element subtrees per host.

1. One pass parses every page (a streaming tokenizer, no tree is kept).  Each element's subtree is hashed bottom-up
   over its tags and its text; text is cut into blocks at block elements, with white space folded.  Elements that
   are never main text by their meaning (navigation, footers, asides, forms, scripts, adverts, notices, reader
   comments ...) are left out at once, since the first page of a host must come out clean too; inside the marked
   article or main part their tag and role decide, and class or id words only where the subtree recurs (2.).  If a
   page marks its main part, only blocks inside it count, and only those of its articles if they hold ``ROOT_SHARE``
   of that text.
2. Spark counts the pages of each (host, subtree); a subtree on ``MIN_PAGES`` pages or more is a template, whatever
   its share of the text.  Pages are told apart by the digest of their kept text, so copies of one page count once.
3. Blocks inside a template subtree are deleted.  Inside a marked article only containers can be templates, never
   the paragraphs themselves: a passage that many articles quote is main text.

Only blocks inside candidate containers take part in the join with the templates; the text of all other pages is
final after the first pass, whose result is written to the shared folder.  A hot host costs partial counts, and the
join key is (host, subtree), whose hot values adaptive execution splits.

Defined results: null html counts as empty and gives the empty text; a null or odd url gives the empty host;
repeated rows are extracted one by one and count as one page; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import materialize

#: Pages of one host, of different text, on which a subtree must recur to be a template.
MIN_PAGES = 10

#: Articles that hold this share of the text of the main part (of the page, if none is marked) are the main text.
ROOT_SHARE = 0.5

# --- fixed values: HTML element kinds --------------------------------------------------------------------------------
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
             "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
             "pre search section select summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = set("aside details dialog div dl fieldset figure footer form header hgroup menu nav ol section table ul"
                 .split())
NOT_TEXT = set("aside button canvas dialog footer form head iframe input math menu nav noframes noscript object option "
               "script search select style svg template textarea title video audio noembed".split())
#: An open p, li ... ends where one of these starts.
ENDS_P = BLOCKS - set("body head html legend option optgroup tbody td tfoot th thead title tr summary".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"},
        "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: Class or id words, and roles, of parts that are no main text.
NOT_TEXT_WORDS = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
                     "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
                     "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header "
                     "masthead comment comments disqus reply replies share sharing social related recommended widget "
                     "login search toolbar skip".split())
NOT_TEXT_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar "
                     "toolbar".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>"""
                  r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_ROOT = {"article", "main"}
#: Class or id that names reader comments, also inside an article: they recur on no other page.
COMMENTS = "comments"
# zones: text outside the main part, in it, in an article outside it, in an article in it
OUTSIDE, MAIN, ARTICLE, BOTH = range(4)


def _zone(tag: str, zone: int) -> int:
    """The zone inside an element that stands in ``zone``."""
    if tag == "main":
        return MAIN if zone < ARTICLE else BOTH
    if tag == "article":
        return BOTH if zone in (MAIN, BOTH) else ARTICLE
    return zone


def _not_text(tag: str, attrs: str, zone: int) -> bool | None:
    """Is this element, by its meaning, no main text?  None: by its class or id words alone, inside the main text."""
    if tag in NOT_TEXT or tag == "header" and zone < ARTICLE:
        return True
    if not attrs:
        return False
    out: bool | None = False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in NOT_TEXT_ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main") \
                and not NOT_TEXT_WORDS.isdisjoint(_WORD.findall(value)):
            if zone == OUTSIDE or COMMENTS in value.split():
                return True
            out = None
    return out


class _Frame:
    """An open element."""

    __slots__ = ("tag", "dropped", "marked", "zone", "parts", "parent", "digest")

    def __init__(self, tag: str, dropped: bool, marked: bool, zone: int, parent: _Frame | None):
        self.tag, self.dropped, self.marked, self.zone, self.parent = tag, dropped, marked, zone, parent
        self.parts: list[bytes] = []
        self.digest = 0


def parse(page: str | None) -> tuple[list[tuple[str, list[int]]], set[int]]:
    """The kept blocks in order, each with the hashes of the containers that may be templates, and all subtree hashes
    of the page."""
    root = _Frame("", False, False, OUTSIDE, None)
    top, subtrees = root, set()
    blocks: list[tuple[int, str, _Frame]] = []
    buffer: list[str] = []
    page = page or ""

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            blocks.append((top.zone, text, top))

    def words(raw: str) -> None:
        if raw:
            text = html_lib.unescape(raw) if "&" in raw else raw
            top.parts.append(" ".join(text.split()).encode("utf-8", "surrogatepass"))
            if not top.dropped:
                buffer.append(text)

    def close() -> None:
        nonlocal top
        done = top
        body = b"\0".join([done.tag.encode("utf-8", "surrogatepass"), *done.parts])
        digest = xxhash.xxh64(body).digest()
        top = done.parent
        top.parts.append(digest)
        if any(done.parts):
            done.digest = int.from_bytes(digest, "big", signed=True)
            if done.tag in BLOCKS and done.tag not in ("html", "body", "article", "main", "head"):
                subtrees.add(done.digest)

    def close_to(tags: set[str], stop: set[str]) -> None:
        """Close up to the nearest open element of ``tags``, if none of ``stop`` is nearer."""
        f = top
        while f.parent is not None and f.tag not in tags:
            if f.tag in stop:
                return
            f = f.parent
        if f.parent is None:
            return
        end = f.parent
        flush()
        while top is not end:
            close()

    at = 0
    while True:
        m = _TAG.search(page, at)
        words(page[at:m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        attrs = m[3] or m[6] or ""
        if m[1] or m[4]:
            if tag == "br":
                words(" ")
            elif tag == "p" or tag in BLOCKS:
                close_to({tag}, set() if tag != "p" else BLOCKS - {"p"})
            else:
                close_to_inline = top
                while close_to_inline.parent is not None and close_to_inline.tag not in BLOCKS \
                        and close_to_inline.tag != tag:
                    close_to_inline = close_to_inline.parent
                if close_to_inline.tag == tag:
                    end = close_to_inline.parent
                    while top is not end:
                        close()
            continue
        if tag in ENDS_P:
            close_to({"p"}, {"table", "td", "th", "button", "object", "div", "section", "article", "li"})
        if tag in SAME:
            close_to(SAME[tag], {"ul", "ol", "dl", "table", "select"} if tag != "tbody" else {"table"})
        if tag in BLOCKS:
            flush()
        if tag in VOID:
            if tag in ("br", "wbr") and not top.dropped:
                buffer.append(" " if tag == "br" else "")
            continue
        zone = _zone(tag, top.zone)
        no_text = _not_text(tag, attrs, top.zone)
        dropped = top.dropped or bool(no_text)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else len(page)
            top.parts.append(xxhash.xxh64(tag.encode() + page[at:stop].encode("utf-8", "surrogatepass")).digest())
            close_at = page.find(">", stop) if end else -1
            at = close_at + 1 if close_at >= 0 else len(page)
            continue
        if attrs.rstrip().endswith("/") and tag in ("path", "use", "circle", "rect"):
            continue
        top = _Frame(tag, dropped, no_text is None, zone, top)
    flush()
    while top.parent is not None:
        flush()
        close()

    chars = [0] * 4
    for z, text, _ in blocks:
        chars[z] += len(text)
    around = MAIN if chars[MAIN] + chars[BOTH] else OUTSIDE
    articles = chars[ARTICLE] + chars[BOTH]
    zones = {ARTICLE, BOTH} if articles and articles >= ROOT_SHARE * (articles + chars[around]) \
        else {ARTICLE, BOTH, around}
    out = []
    for z, text, f in blocks:
        if z not in zones:
            continue
        hashes = []
        while f is not None and f.tag not in _ROOT:
            allowed = f.tag in CONTAINERS or f.marked if z else f.tag in BLOCKS and f.tag not in ("html", "body", "h1")
            if allowed and f.digest in subtrees:
                hashes.append(f.digest)
            f = f.parent
        out.append((text, hashes))
    return out, subtrees


PARSED = "page_id long, url string, host string, text string, " \
    "blocks array<struct<text: string, hashes: array<long>>>, digest long, subtrees array<long>"


def parsed_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """Every page with its host, subtrees and digest of the kept text, and either its final text or its blocks."""
    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts, blocks, digests, trees = [], [], [], []
            for page in pdf["html"]:
                found, subtrees = parse(page)
                open_ = any(h for _, h in found)
                text = "\n".join(t for t, _ in found)
                digest = xxhash.xxh64(text.encode("utf-8", "surrogatepass")).digest()
                digests.append(int.from_bytes(digest, "big", signed=True))
                texts.append(None if open_ else text)
                blocks.append([{"text": t, "hashes": h} for t, h in found] if open_ else None)
                trees.append(sorted(subtrees))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "host": pdf["host"], "text": texts,
                                "blocks": blocks, "digest": digests, "subtrees": trees})

    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`"), F.lit("")),
                                    r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    src = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                       host.alias("host"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    return src.mapInPandas(batches, PARSED)


def site_templates(parsed: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, hash) of the subtrees that recur on at least ``min_pages`` pages of a host; copies count once."""
    return parsed.select("host", "digest", F.explode("subtrees").alias("hash")).groupBy("host", "hash") \
        .agg(F.count_distinct("digest").alias("pages")).filter(F.col("pages") >= min_pages).select("host", "hash", "pages")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    parsed = materialize(parsed_pages(pages, id_col, url_col, html_col)
                         .withColumn("row_id", F.monotonically_increasing_id()), "parsed-pages")
    templates = materialize(site_templates(parsed, min_pages), "site-templates").select("host", "hash")
    ready = parsed.filter("text is not null").select("page_id", "url", "text")
    blocks = parsed.filter("text is null") \
        .select("row_id", "host", F.posexplode("blocks").alias("pos", "block"))
    hits = blocks.select("row_id", "host", "pos", F.explode("block.hashes").alias("hash")) \
        .join(templates, ["host", "hash"], "left_semi").select("row_id", "pos").distinct()
    # a page's own blocks: bounded by the page
    texts = blocks.select("row_id", "pos", F.col("block.text").alias("t")) \
        .join(hits, ["row_id", "pos"], "left_anti").groupBy("row_id") \
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda b: b["t"]), "\n")
             .alias("joined"))
    rest = parsed.filter("text is null").select("row_id", "page_id", "url").join(texts, "row_id", "left") \
        .select("page_id", "url", F.coalesce("joined", F.lit("")).alias("text"))
    return ready.unionByName(rest).withColumn("n_chars", F.length("text").cast("long"))
