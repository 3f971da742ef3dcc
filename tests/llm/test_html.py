import re
import time
from html import unescape

import pytest

from ashlar.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="home"><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div>
<ul class="menu"><li><a href=x>Home</a></ul><div class="wrap"><div id="p{n}" class="post post-{n}"><header><h2>Title &amp; more</h2><span>By me</span></header><p>First <b>bold</b>
text &lt;here&gt;<p>Second para &nbsp; number {n} with a somewhat longer text.<table><tr><td>c1<td>c2</table><div class="ad-slot">Buy</div><script>if(a<b){{"</p>"}}</script>
<form>Name <input></form><section id="comments"><p>A reader writes a rather long remark here, longer than anything else on the page, and then some more.</section></div></div><aside>Side</aside><footer>F</footer>"""
TEXT = "Title & more\nFirst bold text <here>\nSecond para number {n} with a somewhat longer text.\nc1\nc2"


def test_extraction_of_a_page():
    assert html.extract(PAGE.format(n=3), None) == TEXT.format(n=3)
    assert html.extract(None, None) == html.extract("", ["html"]) == html.extract("<p></p>", None) == ""
    assert html.extract("just text", None) == "just text"
    assert html.extract("<article><p>a<br>b<!-- <p>no</p> --></article><footer>f", None) == "a b"


def test_names_of_states_and_of_article_headers():
    page = '<body><div class="wrap has-sidebar"><div class="entry"><div class="entry-header"><h1>Head</h1><i>by me</i></div><p>Body text of it.</p></div><div class="sidebar">no</div></div>'
    assert html.extract(page, None) == "Head\nBody text of it."


def test_consensus_beats_a_misleading_page(spark):
    odd = PAGE.format(n=9).replace("<aside>Side</aside>", "<div class='box'><p>" + "A strange but very long box of words. " * 30 + "</p></div>")
    rows = [(i, f"http://U@Host.example:80/{i}", PAGE.format(n=i), 1) for i in range(12)] + [(50, "http://host.example/odd", odd, 1), (51, None, PAGE.format(n=51), 2), (52, "http://host.example/", None, 3), (3, "http://host.example/3", PAGE.format(n=3), 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = html.main_texts(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[50].text == TEXT.format(n=9) and html.extract(odd, None) != TEXT.format(n=9)
    assert by[51].text == TEXT.format(n=51) and by[52].text == ""
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.main_texts(pages.limit(0)).count() == 0


@pytest.mark.parametrize("url, host", [("http://a.B/c", "a.b"), ("//x.y?q", "x.y"), ("https://u:p@h.i:8/z", "h.i"), ("mailto:x", ""), (None, ""), ("", "")])
def test_hosts(url, host):
    assert html.host_of(url) == host


def plain_article(page):
    """Blocks of the one article element, by cutting at block tags."""
    inner = re.search("<article>(.*?)</article>", page or "", re.S)[1].replace("<br>", " ")
    parts = re.split(r"</?(?:p|h1|h2|ul|ol|li|div|table|tr|td)(?:\s[^>]*)?>", inner)
    return "\n".join(t for t in (" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in parts) if t)


def test_registered_query_matches_a_plain_form_on_whole_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html.main_texts(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == (plain_article(r.html) if "<article>" in (r.html or "") else got[r.page_id].text)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


@pytest.mark.parametrize("page, text", [
    # title and lead beside three sections that hold most of the text
    ("<body><article><h1>Head</h1><p>The lead.</p>" + "<section><p>Part of it all.</p></section>" * 9 + "</article><p>Stray</p>", "Head\nThe lead." + "\nPart of it all." * 9),
    ("<body><div class=c><h1>Head</h1><p>The lead.</p><div class=b>" + "<p>Some long part of the text.</p>" * 6 + "</div></div><div class=x><a href=a>one</a> <a href=b>two</a></div>", "Head\nThe lead." + "\nSome long part of the text." * 6),
    # ids that headings make, and names that wrap the article
    ('<article><section id="related-work"><h2>Related work</h2><p>Body.</p></section><section id="advertising"><h2>Advertising</h2><p>Text.</p></section></article>', "Related work\nBody.\nAdvertising\nText."),
    ('<article><h2 id="comments" class="comments">Comments on it</h2><p class="notice">Kept.</p></article><div id="comments"><p>A reader writes more and more and more and more.</p></div>', "Comments on it\nKept."),
    ('<body><div class="content-sidebar-wrap"><main><h1>T</h1><p>Body text.</p></main><div class="sidebar">No</div></div>', "T\nBody text."),
    ("<body><form id=aspnet><div><h1>T</h1><p>Body text of a page in one form.</p></div></form>", "T\nBody text of a page in one form."),
    ("<article><p>Text.</p><form><p>Your name and your mail, please, and much more.</p></form><p class='ad'>Buy</p><ul class='share-buttons'><li>A</li></ul></article>", "Text."),
    # markup that is not closed, quoted or ended as it should be
    ("<article><p title=it's>a < b &amp; c<p>d <b>e</article>", "a < b & c\nd e"),
    ("<article><p title='x > y'>a<p class=\"q>b</article>", "a\nb"),
    ("<article><p>a <a href=x <b>b</b></a> c</article>", "a b c"),
    ("<article><p>&am<b></b>p; &lt;i&gt; &#233;&nbsp;x</p></article>", "&amp; <i> é x"),
    ("<div>x</div></article></p></b><p>y", "x\ny"),
])
def test_odd_pages(page, text):
    assert html.extract(page, None) == text


@pytest.mark.parametrize("page", ["<a " * 350_000, "<b x " * 60_000, "<div>" * 100_000 + "text", "<div>" * 50_000 + "</span>" * 50_000, "<i><p>" + "<b>" * 50_000 + "</i>" * 50_000, "<title>" * 100_000, "<a b=\"x' " * 100_000, "<!-- " * 100_000, "<p>x" * 100_000])
def test_hostile_pages_take_time_in_proportion(page):
    began = time.perf_counter()
    html.extract(page, None)
    assert time.perf_counter() - began < 8  # 2 s alone; a quadratic reader takes minutes


def test_a_winner_must_suit_the_page():
    small = "<body><div class='post'><p>Short note.</p></div><div class='long'>" + "<p>The real text of this page.</p>" * 20 + "</div>"
    assert html.extract(small, ["body>div.post"]) == html.extract(small, None) == "\n".join(["The real text of this page."] * 20)


def test_pages_without_a_host_do_not_vote(spark):
    rows = [(i, None, PAGE.format(n=i)) for i in range(5)] + [(9, "http://a.b/", PAGE.format(n=9))]
    won = html.winning_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(r.host, len(r.paths)) for r in won] == [("a.b", 1)]


def test_every_path_with_its_share_wins(spark):
    rows = [(i, "http://a.b/", f"<body><div class='k{chr(97 + i % 20)}'><p>Text of a template.</p></div>") for i in range(60)]
    won = html.winning_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(won[0].paths) == 20
