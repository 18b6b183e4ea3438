"""URL functions and filters against a plain-Python statement of the rules."""

from urllib.parse import urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from trawl.functions import urls as U
from trawl.operators import filters
from trawl.sources.tables import read_table


def py_normalize(url):
    """The normalisation rule, written directly with the standard library."""
    if not url:
        return None
    if not url.startswith(("http://", "https://")):
        url = "https://" + url
    try:
        p = urlparse(url)
    except ValueError:
        return None
    if not p.netloc:
        return None
    path = p.path or "/"
    if path != "/" and path.endswith("/"):
        path = path[:-1]
    out = f"{p.scheme}://{p.netloc}{path}"
    return out + (f"?{p.query}" if p.query else "")


def py_clean(url):
    try:
        p = urlparse(url)
    except ValueError:          # the reference returns the input unchanged
        return url
    return urlunparse((p.scheme, p.netloc, p.path, "", "", ""))


EDGE = ["example.com/path/", "https://example.com/path?q=1", "https://a.b//", "HTTP://A.b/C/",
        "ftp://x/y", "https://a.b/p;x=1/q;y=2?k", "", "https://", "http://h/a/b/#frag",
        "https://h?x", "https://h/?", "https://user:pw@h:8080/x/;p", "https://h/a\tb\n/",
        "https://[::1]/x", "https://[bad/x", "mailto:someone@x.org", "localhost:8080/x",
        "https://quickstarts.example.com/guide/data/index.html?index=..%2F..index#0"]


def _col(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "u string")
    return [r[0] for r in df.select(fn("u")).collect()]


def test_normalize_edge_cases(spark):
    got = _col(spark, EDGE + [None], U.normalize_url)
    assert got == [py_normalize(u) for u in EDGE] + [None]


def test_normalize_pins(spark):
    # pins of the survey: multi-slash, upper-case scheme, other scheme, params
    got = dict(zip(EDGE, _col(spark, EDGE, U.normalize_url)))
    assert got["https://a.b//"] == "https://a.b/"
    assert got["HTTP://A.b/C/"] == "https://HTTP://A.b/C"
    assert got["ftp://x/y"] == "https://ftp://x/y"
    assert got["https://a.b/p;x=1/q;y=2?k"] == "https://a.b/p;x=1/q?k"
    assert got["example.com/path/"] == "https://example.com/path"
    assert got[""] is None


def test_normalize_page_urls(spark):
    urls = [r.url for r in read_table(spark, SMALL, "pages").select("url").collect()]
    assert _col(spark, urls, U.normalize_url) == [py_normalize(u) for u in urls]


def test_normalize_idempotent(spark):
    once = [u for u in _col(spark, EDGE, U.normalize_url) if u and "//" not in u.split("://", 1)[1]]
    assert _col(spark, once, U.normalize_url) == once


def test_clean_url(spark):
    vals = [u for u in EDGE if u]
    assert _col(spark, vals, U.clean_url) == [py_clean(u) for u in vals]
    deep = "https://quickstarts.example.com/guide/data/index.html?index=..%2F..index#0"
    assert _col(spark, [deep], U.clean_url) == ["https://quickstarts.example.com/guide/data/index.html"]


def test_same_domain(spark):
    df = spark.createDataFrame([("https://sub.example.com", True), ("https://otherdomain.com", False),
                                ("https://notexample.com/x", False), ("https://Example.COM/a", True),
                                ("https://example.com:8080/", False), ("example.com/x", False)],
                               "u string, want boolean")
    rows = df.select(U.is_same_domain("u", F.lit("example.com")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)


def test_exclusion_sees_path_without_slashes(spark):
    df = spark.createDataFrame([("https://example.com/admin/users",), ("https://example.com/public/page",)], "url string")
    # "^/admin/" never matches: the leading slash is stripped first (kept as in the reference)
    assert filters.exclude_urls(df, ["^/admin/"]).count() == 2
    assert [r.url for r in filters.exclude_urls(df, ["^admin", "["]).collect()] == ["https://example.com/public/page"]


def test_select_urls_case_insensitive_whole_url(spark):
    df = spark.createDataFrame([("https://A.com/Private/x",), ("https://b.com/y",)], "url string")
    out = filters.select_urls(df, "  private \n\n").orderBy("url").collect()
    assert [r.selected for r in out] == [False, True]
    assert filters.selection_counts(filters.select_urls(df, "private")).first().asDict() == {"selected": 1, "total": 2}


def test_filter_urls_distinct_clean(spark):
    df = spark.createDataFrame([("https://h/a?x=1",), ("https://h/a#f",), ("https://h/fr/x",)], "url string")
    assert sorted(r.url for r in filters.filter_urls(df, ["^fr/"]).collect()) == ["https://h/a"]


@pytest.mark.parametrize("href,ok", [("/page", True), ("  ", False), ("", False), ("javascript:void(0)", False),
                                     ("mailto:a@b", False), ("tel:1", False), (" javascript:x", True)])
def test_usable_href(spark, href, ok):
    assert _col(spark, [href], U.usable_href) == [ok]


# random URL-like text: the column functions must agree with the standard-library rule
_URL_ALPHABET = list("htpsfHTP:/?#;.@[]ab0-%=&\t ") + ["http://", "https://", "//", ":8"]


def test_url_functions_match_stdlib_on_random_text(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    cases = []

    @settings(max_examples=400, deadline=None, database=None)
    @given(st.lists(st.sampled_from(_URL_ALPHABET), max_size=14).map("".join))
    def collect(u):
        cases.append(u)

    collect()
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    got = df.select("u", U.normalize_url("u").alias("n"), U.clean_url("u").alias("c"),
                    U.authority("u").alias("a")).collect()
    for r in got:
        try:
            netloc = urlparse(r.u).netloc
        except ValueError:
            netloc = None
        assert r.n == py_normalize(r.u), r.u
        assert r.c == py_clean(r.u), r.u
        if netloc is not None:
            assert r.a == netloc, r.u
