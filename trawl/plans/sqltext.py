"""SQL text (DuckDB dialect) for the column functions, used by the oracles.

Each builder returns an expression over a column expression ``x`` that
computes the same value as the Spark function of the same name.
"""

from __future__ import annotations

from trawl.functions.urls import (_ANY_BRACKET, _BOTH_BRACKETS, _HOST_IN_BRACKETS, PARAMS_RX, URL_RX,
                                 USES_NETLOC, USES_PARAMS)


def _lst(xs):
    return ", ".join("'" + x + "'" for x in xs)


def _clean(x):
    return rf"regexp_replace({x}, '^[\x00-\x20]+|[\t\r\n]', '', 'g')"


def part(x, idx):
    return f"regexp_extract({_clean(x)}, '{URL_RX}', {idx})"


def scheme(x):
    return f"lower({part(x, 1)})"


def authority(x):
    return part(x, 2)


def url_path(x):
    return (f"(case when {scheme(x)} in ({_lst(USES_PARAMS)}) "
            f"then regexp_replace({part(x, 3)}, '{PARAMS_RX}', '') else {part(x, 3)} end)")


def stripped_path(x):
    return f"trim({url_path(x)}, '/')"


def bad_authority(n):
    return (f"(regexp_matches({n}, '{_ANY_BRACKET}') and not (regexp_matches({n}, '{_BOTH_BRACKETS}') "
            f"and regexp_matches({n}, '{_HOST_IN_BRACKETS}')))")


def normalize_url(x):
    pre = f"(case when starts_with({x}, 'http://') or starts_with({x}, 'https://') then {x} else concat('https://', {x}) end)"
    net = part(pre, 2)
    p0 = f"regexp_replace({part(pre, 3)}, '{PARAMS_RX}', '')"
    p1 = f"(case when {p0} = '' then '/' else {p0} end)"
    p2 = f"(case when {p1} <> '/' and ends_with({p1}, '/') then left({p1}, length({p1}) - 1) else {p1} end)"
    q = part(pre, 4)
    bad = bad_authority(net)
    out = f"concat(lower({part(pre, 1)}), '://', {net}, {p2}, case when {q} <> '' then concat('?', {q}) else '' end)"
    return f"(case when {x} is null or {x} = '' or {net} = '' or {bad} then null else {out} end)"


def clean_url(x):
    s, n, p = scheme(x), authority(x), url_path(x)
    body = (f"(case when {n} <> '' then concat('//', {n}, case when {p} <> '' and not starts_with({p}, '/') then '/' else '' end, {p}) "
            f"when starts_with({p}, '//') then concat('//', {p}) "
            f"when {s} in ({_lst(USES_NETLOC)}) and ({p} = '' or starts_with({p}, '/')) then concat('//', {p}) "
            f"else {p} end)")
    bad = bad_authority(n)
    return (f"(case when {x} is null then null when {bad} then {x} "
            f"else concat(case when {s} <> '' then concat({s}, ':') else '' end, {body}) end)")


def is_same_domain(x, base):
    a = f"lower({authority(x)})"
    b = f"lower({base})"
    return f"(not {bad_authority(authority(x))} and ({a} = {b} or ends_with({a}, concat('.', {b}))))"
