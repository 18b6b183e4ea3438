from trawl.llm import site_templates as T


def texts(page):
    return [t for t, _ in T.parse(page)[0]]


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div><main><article><h1>T &amp; x</h1>
<p>One <b>two</b>
 three&nbsp;four<br>five<p>Six<ul><li>a<li>b</ul><div><p>x</p>inner</div><section id="comments"><p>c1</p></section>
<script>if(a<b){"</p>"}</script><aside>no</aside><form><input>no</form><!-- <p>no</p> --><pre> k
 l</pre><table><tr><td>1<td>2</table></article></main><div class="ad">Buy</div><footer>&copy; f</footer>"""


def test_article_without_the_rest():
    assert texts(PAGE) == ["T & x", "One two three four five", "Six", "a", "b", "x", "inner", "k l", "1", "2"]


def test_odd_html():
    assert texts("") == [] and texts(None) == [] and texts("a < b &lt; c") == ["a < b < c"]
    assert texts('<p title="a>b">q</p><p>w') == ["q", "w"] and texts("<!-- open <p>x</p>") == []
    assert texts("<p>a<script>never ends <p>b") == ["a"] and texts("</p></div>x<p>") == ["x"]
    assert texts("<div>" * 3_000 + "deep") == ["deep"]


def site(spark, n):
    rows = [(k, "https://a.org/%d" % k, f"<body><div><p>Join the club today</p></div><div><p>Story {k} is its own long text with words</p>"
             f"<p>and a second part {k} of the same story</p></div></body>") for k in range(n)]
    rows += [(100 + k, "https://b.org/%d" % k, "<body><div><p>Join the club today</p></div><p>Rare host text that is longer</p></body>")
             for k in range(2)]
    quoted = "<article><p>Intro %d of the page</p><p>A quoted passage</p><div><p>Share this page now</p></div><p>The end is here %d</p></article>"
    rows += [(200 + k, "https://a.org/q%d" % k, quoted % (k, k)) for k in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_templates_are_counted_per_host(spark):
    n = T.MIN_PAGES
    got = {r.page_id: r for r in T.main_text(site(spark, n)).collect()}
    assert got[3].text == "Story 3 is its own long text with words\nand a second part 3 of the same story"
    assert got[100].text == "Join the club today\nRare host text that is longer"  # too few pages of that host
    # containers go, a quoted paragraph of an article stays
    assert got[203].text == "Intro 3 of the page\nA quoted passage\nThe end is here 3"
    assert all(r.n_chars == len(r.text) for r in got.values()) and len(got) == 2 * n + 2


def test_copies_of_one_page_survive(spark):
    page = "<body><div><p>The only text of this page</p></div></body>"
    df = spark.createDataFrame([(k, "https://a.org/", page) for k in range(30)], "page_id long, url string, html string")
    assert {r.text for r in T.main_text(df).collect()} == {"The only text of this page"}


def test_copies_of_a_long_page_survive(spark):
    parts = "".join(f"<section><h2>Part {k}</h2><p>Text of part {k}</p><ul><li>item {k}</li></ul></section>" for k in range(4))
    pages = {"https://a.org/": f"<article><h1>T</h1>{parts}</article>", "https://b.org/": f"<body><div>{parts}</div></body>"}
    df = spark.createDataFrame([(k, u, page) for u, page in pages.items() for k in range(30)], "page_id long, url string, html string")
    text = "\n".join(f"Part {k}\nText of part {k}\nitem {k}" for k in range(4))
    assert {(r.url, r.text) for r in T.main_text(df).collect()} == {("https://a.org/", "T\n" + text), ("https://b.org/", text)}


def test_class_words_inside_an_article_need_recurrence(spark):
    page = """<body><article><div class="entry-header"><h1>Head %d</h1></div><h2 id="related-work">Related work</h2><p>Text %d</p>
<section id="search-results"><p>Found %d</p></section><p class="notice">Note %d</p><p class="newsletter">Subscribe</p></article></body>"""
    n = T.MIN_PAGES
    df = spark.createDataFrame([(k, "https://a.org/%d" % k, page % (k, k, k, k)) for k in range(n)]
                               + [(n, "https://b.org/", page % (n, n, n, n))], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in T.main_text(df).collect()}
    assert got[n] == f"Head {n}\nRelated work\nText {n}\nFound {n}\nNote {n}\nSubscribe"
    # on many pages of a host: a notice that recurs goes, the rest stays
    assert got[3] == "Head 3\nText 3\nFound 3\nNote 3"


def test_a_teaser_card_is_not_the_article():
    card = "<article><p>Teaser</p></article>"
    text = "<p>A long main text that stands outside of the card</p>"
    want = ["A long main text that stands outside of the card", "Teaser"]
    assert texts(f"<body><p>around</p><main>{text}{card}</main></body>") == want
    assert texts(f"<body><div>{text}</div>{card}</body>") == want
    assert texts(f"<body><p>around</p><main><article>{text}</article><p>More</p></main></body>") == want[:1]


def test_a_menu_longer_than_the_article_goes(spark):
    menu = "<div>" + "".join(f"<p>Long entry {k} of the site</p>" for k in range(20)) + "</div>"
    df = spark.createDataFrame([(k, "https://a.org/%d" % k, f"<body>{menu}<p>Short text {k}</p></body>")
                                for k in range(T.MIN_PAGES)], "page_id long, url string, html string")
    assert {r.text for r in T.main_text(df).collect()} == {f"Short text {k}" for k in range(T.MIN_PAGES)}


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (None, "no url", "<p>t</p>", "x"), (2, "https://A.org:80/p", "", "x"),
                                (2, "https://A.org:80/p", "", "x"), (3, "https://a.org", "<p>" + "word " * 50_000, "x")],
                               "page_id long, url string, html string, host string")
    got = sorted(T.main_text(df).collect(), key=lambda r: (r.page_id or 0, r.n_chars))
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [
        (None, "no url", 1), (1, None, 0), (2, "https://A.org:80/p", 0), (2, "https://A.org:80/p", 0), (3, "https://a.org", 249_999)]
    assert T.main_text(df.limit(0)).count() == 0
