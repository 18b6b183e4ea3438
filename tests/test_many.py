"""Many patterns in one pass, long conversations in two levels, look-ups that read few row groups."""

import random
import re

import pytest
from pyspark.sql import functions as F

from trawl.operators import crawl_log as C
from trawl.operators import filters as FL
from trawl.operators import rag
from trawl.session import scratch_path
from trawl.sources.tables import crawl_log_from_events, read_table


@pytest.mark.parametrize("pattern, literal", [
    ("^/admin/", "/admin/"), ("a|b", ""), ("blog/[0-9]+$", "blog/"), ("colou?r", "colo"), ("ab+cd", "ab"), ("x{0,20000}yz", "yz"), ("(?i)abc", ""),
    (r"\.pdf$", ".pdf"), (r"\d+abc", "abc"), (r"\x41bc", ""), ("(foo|bar)baz", "baz"), ("(foo)?bar", "bar"), ("[a-z]*", ""), ("", ""),
    (r"\Qa.b\E", ""), ("a*", ""), ("(a(b)c)d", "d"), ("[]x]yy", "yy"), ("[^]x]yy", "yy")])
def test_required_literal(pattern, literal):
    assert FL.required_literal(pattern) == literal


def test_a_match_holds_the_literal():
    rnd = random.Random(3)
    parts = ["a", "b", "ab", "c?", "a*", "b+", "[ab]", "(a|b)", "(ab)?", ".", r"\d", "^", "$", "|", "a{0,1}", "b{2}", "(?:ba)", r"\.", "1"]
    for _ in range(20_000):
        p = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5)))
        try:
            rx = re.compile(p)
        except re.error:
            continue
        text = "".join(rnd.choice("ab1.") for _ in range(rnd.randint(0, 6)))
        for m in rx.finditer(text):
            assert FL.required_literal(p) in m.group(), (p, text)


def urls(spark, n=2_000):
    rnd = random.Random(5)
    words = ["admin", "blog", "user", "Item", "page", "é", "x"]
    return spark.createDataFrame([(None if k % 97 == 0 else f"https://h{k % 7}.org/{rnd.choice(words)}{rnd.randint(0, 3000)}/{rnd.choice(words)}",)
                                  for k in range(n)], "url string")


def test_many_patterns_equal_the_chain(spark, monkeypatch):
    """5,000 patterns, some without a literal, and the chain as the other way."""
    pats = [f"^{w}{k}/" for w in ("admin", "blog", "user", "Item", "page") for k in range(0, 3000, 3)] + [f"zz{k}" for k in range(10)] + [r"/x$", "[ab]dmin1[0-9]/", "(é|q)7"]
    df = urls(spark)
    some = pats[:40] + pats[-3:]
    got = FL.exclude_urls(df, pats)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and len(pats) > 5_000 and "Exchange" not in plan
    kept = {r.url for r in got.collect()}
    rx = [re.compile(p) for p in pats]
    assert kept == {r.url for r in df.collect() if r.url is None or not any(x.search(re.sub("^https://[^/]*/", "", r.url).strip("/")) for x in rx)}
    a = sorted(map(str, FL.exclude_urls(df, some).collect()))
    b = sorted(map(str, FL.select_urls(df, "\n".join(some)).where("selected").collect()))
    monkeypatch.setattr(FL, "CHAIN", 10 ** 6)
    assert a == sorted(map(str, FL.exclude_urls(df, some).collect()))
    assert b == sorted(map(str, FL.select_urls(df, "\n".join(some)).where("selected").collect()))


def test_long_conversations_in_two_levels(spark):
    rnd = random.Random(2)
    rows = [(0, t, rnd.choice(["user", "assistant"]), f"line {t}") for t in range(1_000)]
    rows += [(c, t, "user", None if t % 3 == 0 else f"{c}-{t}") for c in range(1, 40) for t in range(c)]
    rows += [(None, t, "user", "x") for t in range(60)] + [(99, t, None, "x") for t in range(50)] + [(0, 3, "user", "same turn")] * 3
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(6)
    want = {r.conv_id: (r.transcript, r.turns) for r in rag.transcripts(df, segment=10 ** 6).collect()}
    for segment in (7, 30):
        out = rag.transcripts(df, segment=segment)
        assert {r.conv_id: (r.transcript, r.turns) for r in out.collect()} == want and out.count() == len(want)
    assert want[0][0].count("\n") == 1_002 and want[99] == ("", 50)


def scanned(df):
    """Rows that the scans of a finished query gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName().startswith("Adaptive") else plan
    leaves, out = plan.collectLeaves(), 0
    for k in range(leaves.size()):
        node = leaves.apply(k)
        if node.nodeName().endswith("QueryStage"):
            sub = node.plan().collectLeaves()
            nodes = [sub.apply(i) for i in range(sub.size())]
        else:
            nodes = [node]
        out += sum(n.metrics().apply("numOutputRows").value() for n in nodes if n.nodeName().startswith("Scan"))
    return out


def test_a_lookup_reads_few_row_groups(spark, sf):
    log = crawl_log_from_events(read_table(spark, sf, "events"))
    clustered = C.write_clustered(log, scratch_path(spark, "clustered"), group_bytes=64 << 10)
    assert clustered.count() == log.count()
    url = log.select("url").first().url
    one = clustered.where(F.col("url") == url)
    n = scanned(one.select("url", "size"))
    assert n < 0.25 * log.count(), (n, log.count())
    assert C.crawl_result(clustered, url).collect() == C.crawl_result(log, url).collect()
    assert scanned(clustered.where("url = 'https://nowhere'").select("url")) < 0.25 * log.count()
