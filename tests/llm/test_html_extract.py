import pytest

from tallyloom.llm.html_extract import Page, host_of, main_texts

CASES = {
    "": "",
    "<p>a<p>b": "a b",
    '<div class="ad">x</div>text &amp; more<nav>n</nav> <b>bo</b>ld': "text & more bold",
    "<article><h1>T</h1><div class=comments><article class=comment><p>c</p></article></div><p>x<br>y</article><p>out": "T x y",
    "a < b and <3 c <p": "a < b and <3 c",
    "<p>x &am": "x &am",
    "<ul><li>a<li>b</ul><form><p>f</p></form>z": "a b z",
    '<body class="has-sidebar"><main><p>M</p><aside>s</aside></main><p>out</p>': "M",
    '<div hidden>h</div><div id="cookie-notice">c</div><p title="a>b">q</p>': "q",
    "<table><tr><td>1<td>2<tr><td>3</table>": "1 2 3",
    '<script>var a="</p>"': "",
    "<p>a<!-- x --> b</p><!-- open": "a b",
    '<a href="x>y</a><p>t</p>': "y t",
    "<title>t</title><style>p{}</style><p>a&nbsp;&#233;&#x41;  \n b</p>": "a éA b",
    "<header>h</header><article><p><b>one<br><p>two</b></article><footer>f</footer>": "one two",
    "<p>x</p><div style='display: none'>no</div><span class=advert>no</span>yes": "x yes",
    "<div>" * 3000 + "deep" + "</div>" * 10: "deep",
    "<" * 5000 + "a": "<" * 4999,
}


@pytest.mark.parametrize("html", CASES, ids=range(len(CASES)))
def test_cases(html):
    assert Page(html).main_text(set()) == CASES[html]


def site(host, count, first=0):
    """Pages without an article element: only recurrence tells the template."""
    return [
        (first + i, f"http://{host}/{i}", f"<body><div><div>All about {host} since 1999</div><div><a href='/'>Home</a> <a>Shop</a></div><div><p>Own text {i} of {host} number {i * i}.</p><p>More {i}.</p></div><div>Made by us</div></div>")
        for i in range(count)
    ]


def test_site_templates_go(spark):
    rows = [*site("one.example", 12), *site("two.example", 3, 100), *[(200 + i, f"http://copy.example/{i}", "<body><div><div>Same</div><div><p>Copied page that is the same everywhere.</p></div></div>") for i in range(20)]]
    got = {r.page_id: r for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got[3].text == "Own text 3 of one.example number 9. More 3."
    assert got[101].text.startswith("All about two.example")  # three pages are not many
    assert got[205].text == "Same Copied page that is the same everywhere."  # copies count as one page
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_template_inside_an_article(spark):
    share = "<div><b>Share this</b></div>"
    rows = [(i, f"http://h.example/{i}", f"<article><h1>Title {i}</h1><p>The same opening everywhere.</p><p>Text {i} that is longer than the rest.</p>{share}</article>") for i in range(20)]
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[4] == "Title 4 The same opening everywhere. Text 4 that is longer than the rest."


def test_odd_tables(odd_pages):
    rows = main_texts(odd_pages).collect()
    assert len(rows) == 13 and {r.text for r in rows if r.page_id == 4} == {""} and {r.text for r in rows if r.page_id == 5} == {""}
    assert {r.n_chars for r in rows if r.page_id == 11} == {300_000 - 1}
    assert main_texts(odd_pages.limit(0)).collect() == []


def test_hosts():
    assert [host_of(u) for u in ("http://A.example:80/x", "//b/c", "nothing", "https://u@c.d#x")] == ["a.example", "b", "", "c.d"]


@pytest.mark.parametrize("story", ["main", "div"])
def test_a_teaser_article_is_not_the_page(spark, story):
    teaser = "<article class=card><h1>Read this next</h1><p>Our best tips for you, today and every day of the year.</p></article>"
    rows = [(i, f"http://h.example/{i}", f"<{story}><p>Story {i} is told here.</p><p>End {i}, with a few words more.</p></{story}>{teaser}") for i in range(20)]
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[4].startswith("Story 4 is told here. End 4, with a few words more.")
    long = [(i, url, html.replace("told here.", "told here. " + f"Much more of story {i}. " * 9)) for i, url, html in rows]
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(long, "page_id long, url string, html string")).collect()}
    assert "Read this next" not in got[4] and "Our best tips" not in got[4] and got[4].endswith("End 4, with a few words more.")
    assert Page(long[3][2]).main_text(set()).startswith("Story 3")
