"""URL filters.

Patterns are checked on the driver before they reach a plan: the
reference logs and ignores a pattern that does not compile, while an
invalid pattern inside ``rlike`` would fail the whole job.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions.urls import authority, bad_authority, clean_url, normalize_url, stripped_path

log = logging.getLogger(__name__)

#: Up to this many patterns are tested one by one.
CHAIN = 32
#: Escapes after which more characters belong to the escape, or that change what follows.
_NUMBERED = "xuUNkgpPQEco"


def valid_patterns(patterns) -> list[str]:
    """Patterns that compile; the others are logged and dropped."""
    out = []
    for p in patterns or []:
        try:
            re.compile(p)
            out.append(p)
        except re.error as e:
            log.error("Invalid regex pattern %r: %s", p, e)
    return out


def pattern_lines(text: str | None) -> list[str]:
    """One pattern per line, stripped, blank lines dropped."""
    return [p.strip() for p in (text or "").split("\n") if p.strip()]


def _any_match(c: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    """True where a pattern is found.  Few patterns are one chain of ``rlike``; many go through :func:`_candidates`:
    one pass of an automaton over all their literals, and ``rlike`` for the patterns whose literal occurs."""
    flagged = [f"(?i){p}" for p in patterns] if ignore_case else list(patterns)
    literals = [required_literal(p) for p in patterns]
    if ignore_case:
        literals = [x.lower() if x.isascii() else "" for x in literals]
    many = len(patterns) > CHAIN
    m = F.lit(False)
    for p, literal in zip(flagged, literals):
        if not (many and literal):
            m = m | F.coalesce(c.rlike(p), F.lit(False))
    if many and any(literals):
        held = F.lit([p for p, x in zip(flagged, literals) if x])
        found = F.exists(_candidates([x for x in literals if x], ignore_case)(c), lambda i: F.rlike(c, F.element_at(held, i)))
        m = m | F.coalesce(found, F.lit(False))
    return m


def required_literal(pattern: str) -> str:
    """The longest text found that every match of ``pattern`` holds; "" where none is certain."""
    runs, cur, i, depth = [], "", 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            nxt = pattern[i + 1:i + 2]
            if not nxt or nxt in _NUMBERED or nxt.isdigit():     # escapes that take more characters
                return ""
            literal = "" if nxt.isalpha() else nxt
            i += 2
        elif ch == "[":
            end = i + 1 + (pattern[i + 1:i + 2] == "^")
            end = pattern.find("]", end + 1)
            if end < 0 or "[" in pattern[i + 1:end] or "\\" in pattern[i + 1:end] or "&&" in pattern[i + 1:end]:
                return ""
            literal, i = "", end + 1
        elif ch == "{":
            end = pattern.find("}", i)
            if end < 0:
                return ""
            literal, i = "", end + 1
        elif ch in "()":
            if ch == "(" and pattern[i + 1:i + 2] == "?" and pattern[i + 2:i + 3] not in (":", "=", "!"):
                return ""                                       # flags and names
            depth += 1 if ch == "(" else -1
            literal, i = "", i + 1
        elif ch == "|" and depth == 0:
            return ""
        else:
            literal, i = ("" if ch in ".^$|*?+}" or ch.isspace() or ch == "#" else ch), i + 1
        if not literal or depth:
            runs, cur = [*runs, cur], ""
            continue
        if pattern[i:i + 1] and pattern[i] in "*?{":            # the character may be absent
            runs, cur = [*runs, cur], ""
        elif pattern[i:i + 1] == "+":
            runs, cur = [*runs, cur + literal], ""
        else:
            cur += literal
    return max([*runs, cur], key=len)


def _candidates(literals: list[str], ignore_case: bool):
    """Text -> the numbers (from 1) of the literals that occur in it."""
    numbers: dict[str, list[int]] = {}
    for k, x in enumerate(literals):
        numbers.setdefault(x, []).append(k + 1)

    @F.pandas_udf(T.ArrayType(T.IntegerType(), False))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick                   # built once a task
        automaton = ahocorasick.Automaton()
        for x, ks in numbers.items():
            automaton.add_word(x, ks)
        automaton.make_automaton()
        for texts in batches:
            yield pd.Series([None if t is None else sorted({k for _, ks in automaton.iter(t.lower() if ignore_case else t) for k in ks})
                             for t in texts], dtype=object)
    return run


def is_excluded(patterns, url_col: str = "url") -> Column:
    """B8 as a condition.  A URL urlparse rejects is not excluded (the reference catches the error)."""
    return ~bad_authority(authority(url_col)) & _any_match(stripped_path(url_col), valid_patterns(patterns))


def exclude_urls(df: DataFrame, patterns, url_col: str = "url") -> DataFrame:
    """Drop rows whose URL path, with slashes stripped from both ends,
    contains a match of any pattern (case-sensitive)."""
    pats = valid_patterns(patterns)
    return df.where(~is_excluded(pats, url_col)) if pats else df


def select_urls(df: DataFrame, pattern_text: str | None, url_col: str = "url") -> DataFrame:
    """Flag ``selected`` = no pattern (one per line) is found anywhere in
    the whole URL, ignoring case."""
    pats = valid_patterns(pattern_lines(pattern_text))
    return df.withColumn("selected", ~_any_match(F.col(url_col), pats, ignore_case=True))


def selection_counts(flagged: DataFrame) -> DataFrame:
    """D13: "k out of n" selected."""
    return flagged.agg(F.count_if("selected").alias("selected"), F.count("*").alias("total"))


def filter_urls(df: DataFrame, patterns=None, url_col: str = "url") -> DataFrame:
    """B10 + G5: clean every URL (H2), drop excluded ones (B8), distinct.

    The reference keeps duplicates when patterns are given; here the result
    is always a set.
    """
    # The parsed path and authority of clean_url(u) are those of u (only the
    # params, query and fragment go, and the path is tested without params),
    # so the exclusion test runs on the raw column: no nesting of the two.
    kept = exclude_urls(df.select(F.col(url_col).alias("_raw")), patterns, "_raw")
    return kept.select(clean_url("_raw").alias("url")).distinct()


def validate_urls(df: DataFrame, pages: DataFrame, url_col: str = "url",
                  page_url_col: str = "url") -> DataFrame:
    """Normalise; keep URLs with an authority that are reachable, i.e.
    present (normalised) in the page table."""
    cand = df.select(F.col(url_col).alias("input"), normalize_url(url_col).alias("url")) \
        .where(F.col("url").isNotNull())
    known = pages.select(normalize_url(page_url_col).alias("url")).where(F.col("url").isNotNull()).distinct()
    return cand.join(known, "url", "left_semi")
