"""The SQL twin of the splitter sees separators, merging and overlap."""

import random

import duckdb
import pytest

from trawl.operators.chunks import split_text
from trawl.plans.splitsql import split_sql

PARTS = ["# head ", "\n# H ", "\n\n", "\n", "```\n", "\n***\n", "\n----\n", "\n___\n", " ", "word", "a", "longer text here", "x" * 30, " \n ", "é"]


def chunks(texts, size, overlap):
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", texts)
    return {(k, i): c for k, i, c in con.sql(split_sql(size, overlap)).fetchall()}


@pytest.mark.parametrize("size, overlap", [(40, 10), (20, 5), (25, 0), (100, 30)])
def test_twin_equals_the_splitter_on_markdown(size, overlap):
    rnd = random.Random(size)
    texts = [(k, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 60)))) for k in range(300)] + [(900, None), (901, "")]
    want = {(k, i): c for k, t in texts for i, c in enumerate(split_text(t, size, overlap))}
    assert chunks(texts, size, overlap) == want and len(want) > 300


def test_twin_is_not_plain_windows():
    text = "\n# One\n" + "word " * 30 + "\n## Two\n\n" + "other " * 30
    got = [c for _, c in sorted(chunks([(1, text)], 60, 12).items())]
    assert got[0] == "# One" and any(c.startswith("## Two") for c in got)
    assert any(a.split()[-2:] == b.split()[:2] for a, b in zip(got, got[1:]))       # the overlap
    assert got != [text[k:k + 60] for k in range(0, len(text), 48)]
