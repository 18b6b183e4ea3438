import re

import pytest
from pyspark.sql import functions as F

from tests.llm.odd import CLASHING, no_docs, odd_docs
from tests.oracle import compare, duck
from trawl.llm import decontaminate as D
from trawl.llm.queries import ORACLES, QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEN = "alpha beta gamma delta epsilon zeta eta theta iota kappa"

ITEMS = [(1, f"{TEN} lambda mu"), (2, "short item"), (10, "SHORT, item!"), (3, None), (4, ""), (5, "...  !"), (None, "nameless one"),
         (7, "Überraschung 日本 \U0001F600x"), (1, f"{TEN} lambda mu")]
TEXTS = [None, "", f"before {TEN} after", f"{TEN} lambda mu, {TEN}", "a Short  Item and short-item", TEN.rsplit(" ", 1)[0],
         "x nameless One y", "überraschung 日本 \U0001F600x", "Überraschung!日本\n\U0001F600x z", "clean words only", f"{TEN} " * 3,
         f"{TEN.upper()} Lambda. Mu", "short short item item"]


def brute(texts, items, n=10):
    words = [WORD.findall((t or "").translate(LOWER)) for _, t in items]
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        hit, ids = set(), set()
        for (item, _), g in zip(items, words):
            size = min(n, len(g))
            grams = {tuple(g[i:i + size]) for i in range(len(g) - size + 1)} if g else set()
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in grams:
                    hit |= set(range(i, i + size))
                    ids |= {str(item)} if item is not None else set()
        out.append((len(w), sorted(hit), sorted(ids)))
    return out


def frames(spark, texts=TEXTS, items=ITEMS):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    return docs, spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, gram string")


@pytest.mark.parametrize("most", [2_000_000, 2])
def test_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(D, "MAX_SET", most)        # 2: many slices
    got = {r.doc_id: r for r in D.contamination(*frames(spark)).collect()}
    want = brute(TEXTS, ITEMS)
    for k, (n, hit, ids) in enumerate(want):
        r = got[k]
        assert (r.n_words, r.n_hit, r.item_ids) == (n, len(hit), ids), TEXTS[k]
        assert [p for s in r.spans for p in range(s.first, s.past)] == hit
        assert all(a.past < b.first for a, b in zip(r.spans, r.spans[1:]))
    assert len(got) == len(TEXTS)


def test_hashes_alone_do_not_decide(spark, monkeypatch):
    """With one hash for everything, every window is a candidate, and the words alone decide."""
    monkeypatch.setattr(D.F, "xxhash64", lambda *cols: F.lit(7).cast("long"))
    got = {r.doc_id: (r.n_hit, r.item_ids) for r in D.contamination(*frames(spark)).collect()}
    assert got == {k: (len(hit), ids) for k, (_, hit, ids) in enumerate(brute(TEXTS, ITEMS))}


def test_spans_are_removed(spark):
    docs, items = frames(spark)
    out = D.remove_spans(docs, items)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[2] == "before after" and got[3] == "" and got[4] == "a and" and got[9] == "clean words only" and got[0] is None
    assert got[8] == " z" and got[11] == ""
    for k, (n, hit, _) in enumerate(brute(TEXTS, ITEMS)):
        left = [w for i, w in enumerate(WORD.findall((TEXTS[k] or "").translate(LOWER))) if i not in set(hit)]
        assert WORD.findall((got[k] or "").translate(LOWER)) == left


def test_documents_are_dropped_by_share(spark):
    docs, items = frames(spark)
    want = brute(TEXTS, ITEMS)
    for share in (0.0, 0.5):
        kept = {r.doc_id for r in D.drop_contaminated(docs, items, max_share=share).collect()}
        assert kept == {k for k, (n, hit, _) in enumerate(want) if len(hit) <= share * n}


def test_odd_rows(spark):
    docs, items = odd_docs(spark), frames(spark)[1]
    out = D.contamination(docs, items)
    assert out.count() == docs.count() and set(CLASHING) <= set(out.columns) and out.filter("n_hit > 0").count() == 0
    lazy = spark.createDataFrame([(9, "lazy dog sat")], "item_id long, text string")
    hits = {(r.doc_id, r.n_hit) for r in D.contamination(docs, lazy).filter("n_hit > 0").collect()}
    assert hits == {(1, 12)}
    assert D.contamination(no_docs(spark), items).count() == 0
    assert D.contamination(docs, items.limit(0)).filter("n_hit = 0").count() == docs.count()
    assert D.remove_spans(docs, items.limit(0)).columns == docs.columns


def test_long_text(spark):
    text = " ".join(f"w{k}" for k in range(60_000)) + f" {TEN}"
    r = D.contamination(*frames(spark, [text])).first()
    assert (r.n_words, r.n_hit, r.item_ids) == (60_010, 10, ["1"])


def test_query_equals_sql(spark, sf):
    problems, n = compare(QUERIES["op12_ngram_decontamination"](spark, sf), duck(sf), ORACLES["op12_ngram_decontamination"])
    assert not problems and n > 0


def test_sql_sees_short_items(spark):
    docs, items = frames(spark)
    con = duck("/root/testdata/sf0.001")
    con.register("d", docs.toPandas())
    con.register("i", items.toPandas().astype({"item_id": "Int64"}))
    sql = ORACLES["op12_ngram_decontamination"].replace("FROM documents", "FROM d").replace("FROM benchmark", "FROM i")
    out = D.contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
    problems, _ = compare(out, con, sql)
    assert not problems


def test_plan_is_native(spark, sf):
    df = QUERIES["op12_ngram_decontamination"](spark, sf)
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|RDD", plan)
