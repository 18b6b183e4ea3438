"""URL column functions, all built-in Spark expressions (no Python per row).

The split of a URL into parts follows the standard-library ``urlsplit``
rules the crawler relies on: an optional scheme (a letter, then letters,
digits, ``+ - .``) before the first ``:``, an authority after ``//`` up to
the first of ``/ ? #``, a path up to ``?`` or ``#``, a query up to ``#``.
Tabs and line breaks anywhere, and leading control characters or spaces,
are removed before the split.  ``;params`` of the last path segment are
dropped for the schemes that carry them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.functions.util import as_col

# URL grammar pieces and scheme lists of the standard library.
URL_RX = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
PARAMS_RX = r";[^/]*$"
# schemes for which ``;params`` are split off the last path segment
USES_PARAMS = ["", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp",
               "rtsp", "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel"]
# schemes for which an empty authority is still written as ``//``
USES_NETLOC = ["ftp", "http", "gopher", "nntp", "telnet", "imap", "wais",
               "file", "mms", "https", "shttp", "snews", "prospero", "rtsp",
               "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs",
               "git", "git+ssh", "ws", "wss", "itms-services"]
# hrefs that are not followed (prefix test, case-sensitive, before trimming)
SKIP_HREF_PREFIXES = ["javascript:", "mailto:", "tel:"]
# text that ``str.strip()`` reduces to nothing
BLANK_RX = r"(?U)^[\s\x1c-\x1f]*$"


def _ipv6_rx() -> str:
    """IPv6 address text as the standard library accepts it: up to eight
    1-4 digit hex groups, one optional ``::`` standing for at least one
    group, an optional dotted IPv4 tail worth two groups, an optional
    ``%scope``.  Built from that rule (all splits around ``::``)."""
    h = "[0-9A-Fa-f]{1,4}"
    v4 = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}"

    def groups(n):
        return "" if n == 0 else h + f"(?::{h}){{{n - 1}}}" if n > 1 else h

    alts = [f"{groups(8)}", f"{groups(6)}:{v4}"]
    for tail, width in (("", 0), (v4, 2)):
        for left in range(0, 8):
            for right in range(0, 8 - left - width):
                if left + right + width > 7:
                    continue
                r = groups(right)
                if tail:
                    r = f"{r}:{tail}" if right else tail
                alts.append(f"{groups(left)}::{r}")
    return "(?:" + "|".join(alts) + ")"


_IPV6_BODY = _ipv6_rx()
IPV6_RX = "^" + _IPV6_BODY + "(?:%[^%]+)?$"
IPVFUTURE_RX = r"^v[A-Fa-f0-9]+\.[^\]]+$"
# a host urlparse accepts between the first "[" and the next "]" (or the end)
_HOST_IN_BRACKETS = ("^[^\\[]*\\[(?:v[A-Fa-f0-9]+\\.[^\\]]+|" + _IPV6_BODY + "(?:%[^%\\]]+)?)(?:\\]|$)")
_ANY_BRACKET = r"[\[\]]"
_BOTH_BRACKETS = r"\[[\s\S]*\]|\][\s\S]*\["


def bad_authority(netloc: Column) -> Column:
    """True where ``urlparse`` would reject the authority: unbalanced
    brackets, or a bracketed host that is not an IPv6/IPvFuture address.
    Three regex tests on the authority (few references keep generated code
    small where Catalyst inlines it into filters)."""
    return netloc.rlike(_ANY_BRACKET) & ~(netloc.rlike(_BOTH_BRACKETS) & netloc.rlike(_HOST_IN_BRACKETS))


def _clean_input(c: Column) -> Column:
    """Drop leading C0 controls or spaces, and tab/CR/LF anywhere (one pass:
    a tab that would become leading after removal is in the leading run)."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\t\r\n]", "")


def url_part(url, part: str) -> Column:
    """One raw part of a URL: scheme (lower-cased), authority, path, query, fragment."""
    idx = {"scheme": 1, "authority": 2, "path": 3, "query": 4, "fragment": 5}[part]
    u = _clean_input(as_col(url))
    v = F.regexp_extract(u, URL_RX, idx)
    return F.lower(v) if part == "scheme" else v


def _strip_params(path: Column, scheme: Column) -> Column:
    return F.when(scheme.isin(USES_PARAMS), F.regexp_replace(path, PARAMS_RX, "")).otherwise(path)


def authority(url) -> Column:
    """``urlparse(url).netloc``."""
    return url_part(url, "authority")


def url_path(url) -> Column:
    """``urlparse(url).path`` (``;params`` of the last segment removed)."""
    return _strip_params(url_part(url, "path"), url_part(url, "scheme"))


def stripped_path(url) -> Column:
    """``urlparse(url).path.strip('/')`` – what exclusion patterns are tested on."""
    return F.btrim(url_path(url), F.lit("/"))


def normalize_url(url) -> Column:
    """Canonical form of a URL, NULL when it has no authority.

    Empty → NULL; ``https://`` is put in front unless the text starts with
    ``http://`` or ``https://`` (case-sensitive); empty path becomes ``/``;
    one trailing slash goes (unless the path is ``/``); fragment and
    ``;params`` go; the query stays.  For a struct input (the reference also
    takes ``{"url": ...}`` dicts) pass its field: ``normalize_url("x.url")``.
    """
    c = as_col(url)
    prefixed = F.when(c.startswith("http://") | c.startswith("https://"), c) \
        .otherwise(F.concat(F.lit("https://"), c))
    u = _clean_input(prefixed)
    scheme = F.regexp_extract(u, URL_RX, 1)
    netloc = F.regexp_extract(u, URL_RX, 2)
    path = F.regexp_replace(F.regexp_extract(u, URL_RX, 3), PARAMS_RX, "")
    query = F.regexp_extract(u, URL_RX, 4)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    path = F.when((path != "/") & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    bad_brackets = bad_authority(netloc)
    out = F.concat(F.lower(scheme), F.lit("://"), netloc, path,
                   F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(c.isNull() | (c == "") | (netloc == "") | bad_brackets, F.lit(None).cast("string")) \
        .otherwise(out)


def clean_url(url) -> Column:
    """Scheme, authority and path only (``urlunparse`` of the three)."""
    c = as_col(url)
    u = _clean_input(c)
    scheme = F.lower(F.regexp_extract(u, URL_RX, 1))
    netloc = F.regexp_extract(u, URL_RX, 2)
    path = _strip_params(F.regexp_extract(u, URL_RX, 3), scheme)
    body = (F.when(netloc != "", F.concat(F.lit("//"), netloc,
                                          F.when((path != "") & ~path.startswith("/"), F.lit("/")).otherwise(F.lit("")),
                                          path))
            .when(path.startswith("//"), F.concat(F.lit("//"), path))
            .when(scheme.isin(USES_NETLOC) & ((path == "") | path.startswith("/")), F.concat(F.lit("//"), path))
            .otherwise(path))
    # urlparse rejects an authority with unbalanced brackets; the input is then returned as it is
    return F.when(c.isNull(), F.lit(None).cast("string")) \
        .when(bad_authority(netloc), c) \
        .otherwise(F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")), body))



def is_same_domain(url, base, validate: bool = True) -> Column:
    """Lower-cased authority equals the base, or is a sub-domain of it.
    ``validate=False`` skips the authority check for URLs that come out of
    :func:`normalize_url` (which never yields a rejected authority)."""
    raw = authority(url)
    b = F.lower(as_col(base))
    # a == b or a ends with "." + b, written with one reference to a;
    # an authority urlparse rejects is "not same domain" (the reference catches the error)
    same = F.concat(F.lit("."), F.lower(raw)).endswith(F.concat(F.lit("."), b))
    return (~bad_authority(raw) & same) if validate else same


def usable_href(href) -> Column:
    """href is non-blank and not a javascript:/mailto:/tel: link."""
    h = as_col(href)
    starts = None
    for p in SKIP_HREF_PREFIXES:
        s = h.startswith(p)
        starts = s if starts is None else (starts | s)
    return h.isNotNull() & ~h.rlike(BLANK_RX) & ~starts


def site_root(url) -> Column:
    """``scheme://authority`` of an absolute URL."""
    u = as_col(url)
    return F.concat(url_part(u, "scheme"), F.lit("://"), authority(u))
