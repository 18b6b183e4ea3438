import re

from tests.conftest import SMALL
from tests.llm.odd import ROWS, no_docs, odd_docs
from tests.oracle import compare, duck
from trawl.llm import queries
from trawl.llm.quality_rules import Rule, keep_good, quality_rules


def brute(text):
    words = re.findall(r"[^ \x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^ \x09-\x0d]", x)]
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1 if len(grams) < 2_000 else grams.index(g) != i:
            hit |= set(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(hit))


def counts(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)


def test_counts_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_rules(docs).collect():
        assert counts(r) == brute(texts[r.doc_id])


def test_overlapping_windows(spark):
    text = "a b c d e f g h i " * 3 + "x y a b c d e f g h i z"
    r = quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert counts(r) == brute(text) and r.n_repeat_words > 0


def test_odd_rows(spark):
    got = quality_rules(odd_docs(spark)).collect()
    assert len(got) == len(ROWS)
    by_id = {r.doc_id: r for r in got}
    assert counts(by_id[2]) == (0, 0, 0, 0, 0) and by_id[2].base_failed and not by_id[3].kept
    assert by_id[4].n_words == 120_000 and by_id[1].n_words == 60
    kept = keep_good(odd_docs(spark), rules=[Rule("n_words", 1, None)])
    assert kept.columns == odd_docs(spark).columns
    assert quality_rules(no_docs(spark)).count() == 0 and keep_good(no_docs(spark)).count() == 0


def test_clean_texts_of_other_languages_stay(spark):
    clean = {
        "ru": "Вчера вечером мы долго гуляли по старому парку и говорили о книгах которые читали летом а потом вернулись домой пить чай с мёдом и вареньем",
        "el": "Χθες το βράδυ περπατήσαμε στο παλιό πάρκο και μιλήσαμε για τα βιβλία που διαβάσαμε το καλοκαίρι και μετά γυρίσαμε στο σπίτι για να πιούμε τσάι",
        "ar": "في مساء أمس مشينا طويلا في الحديقة القديمة وتحدثنا عن الكتب التي قرأناها في الصيف ثم عدنا إلى البيت لنشرب الشاي مع العسل",
        "pl": "Wczoraj wieczorem długo spacerowaliśmy po starym parku i rozmawialiśmy o książkach które czytaliśmy latem potem zaś wróciliśmy pić herbatę z miodem oraz ciastem",
        "id": "Kemarin malam kami berjalan lama di taman tua dan kami bicara soal buku yang kami baca pada musim panas dan lalu pulang ke rumah",
    }
    junk = " ".join(f"{w} " * 3 for w in ("inerst", "ble", "reou", "erhe", "thatan", "onre", "stea", "ghor"))
    rows = [(k, t, lang) for lang, t in clean.items() for k in (lang, None)] + [(None, junk, "x1"), ("en", junk, "x2")]
    docs = spark.createDataFrame(rows, "lang string, text string, doc_id string")
    want = [(t, lang) for lang, t in clean.items()] * 2
    assert sorted((r.text, r.doc_id) for r in keep_good(docs).collect()) == sorted(want)
    assert keep_good(docs.drop("lang")).count() == len(want)
    assert {r.doc_id for r in quality_rules(docs).collect() if r.kept} == set(clean)


SPAM = "cheap pills buy now cheap watches buy now big sale buy now cheap pills low cost buy now best deal buy now win cash buy now"


def language_rows():
    clean = "Kemarin malam kami berjalan lama di taman tua dan kami bicara soal buku yang kami baca pada musim panas dan lalu pulang ke rumah"
    russian = "Вчера вечером мы долго гуляли по старому парку и говорили о книгах которые читали летом а потом вернулись домой пить чай с мёдом"
    langs = ["en", "EN-us", " fr", "de", "spa", "id", "ru", "", None, "x", "en_GB", "english"]
    return [(10 * k + j, t, lang) for k, lang in enumerate(langs) for j, t in enumerate((SPAM, clean, russian, "", None))]


def test_a_covered_language_is_never_exempt(spark):
    docs = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality_rules(docs).collect() if r.kept}
    assert not kept & {k for k, _, lang in language_rows() if lang in ("en", "EN-us", " fr", "de", "spa", "en_GB")}
    assert {51, 62, 71, 72, 81, 82} <= kept             # Indonesian and Russian, by their code or without one


def test_sql_twin_holds_the_language_rule(spark):
    docs = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string")
    con = duck(SMALL)
    con.register("d", docs.toPandas())
    sql = queries.ORACLES["op5_quality_rules"].replace("FROM documents", "FROM d")
    problems, n = compare(quality_rules(docs), con, sql)
    assert not problems and n == len(language_rows())


def test_no_user_function_and_no_shuffle(spark):
    plan = quality_rules(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_sql_twins(spark, sf):
    con = duck(sf)
    for name, sql in queries.ORACLES.items():
        problems, _ = compare(queries.QUERIES[name](spark, sf), con, sql)
        assert not problems, (name, problems)
