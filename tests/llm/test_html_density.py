import re
from html import unescape

import pytest

from docloom.llm import html_density, queries

PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><nav>Home | About</nav><div class="cookie-notice">We use cookies &amp; more.</div>
<div id="wrap"><div class="content"><h2>Title &eacute;</h2><p>One&nbsp;two <a href=x>link</a> three.<p>Second para, <i>very</i>long &lt;tag&gt;.</div><div class="sidebar">side text that is fairly long for a side bar indeed</div>
<section id="comments"><p>Reader comment text very long long long</p></section></div><form>Subscribe <input></form><footer>foot</footer></body></html>"""
CASES = {
    PAGE: "Title é One two link three. Second para, verylong <tag>.",
    "<article><h1>A</h1><p><b>B.<br><p>C</p><script>x</script><style>y</style></article><div class=ad>Buy</div>": "A B. C",
    "plain text only": "plain text only",
    "<p>a<p>b<!-- x": "a b",
    "<div": "",
    "": "",
    "<body><main><article><p>one</p><aside>no</aside><p>two</p></article><div class='comments'><p>long comment text here that is long</p></div></main></body>": "one two",
    "<ul><li>one<li>two</ul>": "one two",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a b c",
    "<p hidden>no</p><p style='display: none'>no</p><p>yes &#233;&#x41; &notanentity;</p>": "yes éA ¬anentity;",
    "<article><header><h1>Head</h1></header>Body<footer>f</footer></article>": "Head Body",
    "<nav><a>x</a></nav>": "",
    "<body><h1>Title</h1><div id=c><p>A long enough paragraph of text.</p><p>And one more paragraph here.</p></div><div class='right-rail'><p>Rail text</p></div></body>": "Title A long enough paragraph of text. And one more paragraph here.",
    "<main><h1>T</h1><article class=post>Body text<article class='comment'>No, it is not</article></article></main>": "T Body text",
}


@pytest.mark.parametrize("html", list(CASES))
def test_cases(html):
    assert html_density.extract(html) == CASES[html]


def test_links_lower_a_density():
    assert html_density.density(100, 5, 0, 0, 0.1) > html_density.density(100, 5, 60, 4, 0.1) > html_density.density(100, 5, 100, 5, 0.1)


def test_dense_part_wins_without_names():
    side = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(12))
    body = "".join(f"<p>Sentence number {i} of a text that goes on for a good while, with few tags.</p>" for i in range(8))
    got = html_density.extract(f"<body><div><ul>{side}</ul></div><div><div>{body}</div></div></body>")
    assert got.startswith("Sentence number 0") and got.endswith("few tags.") and "Link" not in got


def paragraphs(n, start=0):
    return "".join(f"<p>Sentence number {i} of a text that goes on for a good while, with few tags.</p>" for i in range(start, start + n))


def test_short_promotions_beside_an_article_without_names():
    promos = "".join(f"<p>Read <a href=/{i}>our other story {i}</a> now</p>" for i in range(5))
    for page in (f"<div id=wrap><div>{paragraphs(8)}</div><div>{promos}</div></div>", f"<div id=wrap><div>{promos}</div><div class=x7><h2>Head</h2>{paragraphs(8)}<p>Short.</p></div></div>"):
        got = html_density.extract(f"<body>{page}</body>")
        assert "our other story" not in got and all(f"number {i} of" in got for i in range(8)) and ("Short." in got) == ("Short." in page)


def test_densities_choose_between_an_article_element_and_the_text():
    teasers = "".join(f"<article><a href=/{i}>Teaser {i}</a></article>" for i in range(6))
    got = html_density.extract(f"<body><div>{teasers}</div><div class=text>{paragraphs(9)}</div></body>")
    assert "Teaser" not in got and got.count("Sentence") == 9


def test_nothing_else_is_dropped_within_an_article():
    references = "<ul>" + "".join(f"<li><a href=/{i}>Reference {i}</a></li>" for i in range(6)) + "</ul>"
    inside = f"<h2 id='search'>Search</h2>{paragraphs(4)}<section class='search-algorithms'>{paragraphs(2, 4)}</section><p class='notice'>A notice period applies.</p><div class='share-price-table'><table><tr><td>1</td></tr></table></div>"
    got = html_density.extract(f"<body><nav>menu</nav><article>{inside}<h2 id=references>References</h2>{references}<div class='ad-slot'>Buy</div><div class='comment-list'>Reader</div></article></body>")
    assert got.count("Sentence") == 6 and all(x in got for x in ("Search", "A notice period applies.", " 1 ", "Reference 5")) and "Buy" not in got and "Reader" not in got
    plain = html_density.extract(f"<body><div class='search-box'>find</div><div>{inside}</div><div class='site-notice'>Note</div></body>")
    assert plain.count("Sentence") == 6 and "find" not in plain and "Note" not in plain and "notice period" in plain


NAMED = "sidebar article-sidebar notice site-notice breadcrumbs cookie-banner pagination menu mobile-nav banner footer login toc reader-discussion".split()


def test_what_surrounds_an_article_goes_also_within_main_and_article():
    for name in NAMED:
        beside = f"<div class={name}><p>Beside the text {name}.</p></div>"
        for page in (f"<main><div class=content>{paragraphs(5)}</div>{beside}</main>", f"<article>{paragraphs(3)}{beside}{paragraphs(2, 3)}</article>", f"<main><article>{paragraphs(5)}</article>{beside}</main>"):
            got = html_density.extract(f"<body>{page}</body>")
            assert got.count("Sentence") == 5 and "Beside" not in got, (name, page[:20])
    for tag in ("article", "main", "div"):
        got = html_density.extract(f"<body><{tag}>{paragraphs(4)}<p class=comment>Reader says.</p><p class='reader-comment'>Another.</p><p class=notice-period>Kept.</p></{tag}></body>")
        assert got.count("Sentence") == 4 and "Reader says" not in got and "Another" not in got and "Kept." in got


def test_densities_decide_within_articles_and_main(monkeypatch):
    links = "<div>" + "".join(f"<div><a href=/{i}>More of our stories {i}</a></div>" for i in range(8)) + "</div>"
    references = "<h2>References</h2><ul>" + "".join(f"<li><a href=/{i}>Reference {i}</a></li>" for i in range(6)) + "</ul>"
    section = "<section><h2>Sources</h2>" + "".join(f"<div><a href=/{i}>Source {i}</a></div>" for i in range(3)) + "</section>"
    pages = [f"<body><article>{paragraphs(6)}{links}{references}{section}</article></body>", f"<body><main><div>{paragraphs(6)}</div>{links}</main></body>", f"<body><main><h1>Title</h1><div>{links}</div><div>{paragraphs(6)}</div></main></body>"]
    got = [html_density.extract(p) for p in pages]
    assert all(g.count("Sentence") == 6 and "More of" not in g for g in got)
    assert "Reference 5" in got[0] and "Source 2" in got[0] and "Title" in got[2]
    monkeypatch.setattr(html_density, "density", lambda *_: 1.0)
    assert [html_density.extract(p) for p in pages] != got and "More of" in html_density.extract(pages[0])


def test_deep_and_long_pages():
    assert html_density.extract("<div>" * 3000 + "x" + "</div>" * 3000) == "x"
    assert len(html_density.extract("<article><p>" + "word " * 200_000 + "</article>")) == 200_000 * 5 - 1


def test_query_and_edges(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in queries.op5_html_density(spark, small).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.DOTALL)[1]
        want = " ".join(unescape(re.sub(r"<[^>]+>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)).split())
        assert (r.text, r.n_chars) == (want, len(want))
    edge = spark.createDataFrame([(1, "u", None, "old"), (1, "u", None, "old"), (None, None, "<p>😀", "old")], "page_id long, url string, html string, TEXT string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html_density.extract_pages(edge, keep=("page_id", "url", "TEXT")).collect()) == [("1", "", 0), ("1", "", 0), ("None", "😀", 1)]
    assert html_density.extract_pages(edge.limit(0)).count() == 0
