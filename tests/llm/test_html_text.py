import html
import random
import re

from cases import prose

from tablewright.llm import html_text

LONG = "Some sentence of the article that is long enough to weigh. " * 3


def text(page):
    return html_text.main_text(page)


def test_marked_article():
    page = (
        "<html><head><title>T &amp; x</title><style>p{a:b}</style></head><body><header>Site</header><nav><ul><li><a>one</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies</div><article><header><h1>Head &amp; line</h1></header><p>Short.<p>b <b>bo</b>ld&#233;\n x<br>y"
        "<div class=ad>Buy</div><p>After<script>var t='</p>';</script> all.</p><aside>See also</aside><p>End</article>"
        "<section id=comments><article class='comment'>Nice " + LONG + "</article></section><footer>&copy; me</footer></body></html>"
    )
    assert text(page) == "Head & line Short. b boldé x y After all. End"


def test_text_between_surge_and_dive():
    page = (
        "<body><div><a>Home</a> <a>News</a></div><div><a>more links here</a></div><ul><li><a>" + "link " * 30 + "</a></ul>"
        "<h1>Title</h1><p>" + LONG + "</p><p>tiny</p><p>" + LONG + "</p>"
        "<div><a>" + "link " * 20 + "</a></div><div><a>x</a></div><div><a>y</a></div><div><a>z</a></div></body>"
    )
    got = text(page)
    assert got.endswith(("Title " + LONG + "tiny " + LONG).strip()) and "Home" not in got and got[-6:] == "weigh."


def test_boxes_without_an_article():
    page = "<div id='main-menu'>Menu " + LONG + "</div><p>" + LONG + "</p><form>Name " + LONG + "</form><div hidden>" + LONG + "</div>"
    assert text(page) == LONG.strip()


def test_a_teaser_article_does_not_hide_the_text():
    teaser = "<article class='teaser'><h3><a href='/x'>Other story</a></h3><p>Brief.</p></article>"
    body = "<h1>Title</h1><div>" + LONG + "</div><div>tiny</div><div>" + LONG + "</div>"
    want = ("Title " + LONG + "tiny " + LONG).strip()
    nav, foot = "<nav><a>Home</a></nav>", "<footer>&copy; me</footer>"
    assert text(nav + teaser + body + foot) == want
    assert text(nav + body + teaser + foot) == want
    assert text(nav + body + teaser + "<p>The end.</p>" + foot) == want + " The end."
    assert text(nav + body + "<aside>" + teaser + "</aside>" + foot) == want


def test_the_window_sums_decide_beside_an_article():
    both = "<div>" + LONG + "</div><article><p>" + LONG + "</p></article>"
    assert text(both) == (LONG + LONG).strip()
    assert text(both + "<div>Short.</div>") == LONG + LONG + "Short."  # an article does not end the text around it
    assert text("<article><p>" + LONG + "</p></article><div>Short.</div>") == LONG.strip()
    few = "<article><h2>Head</h2><p>A few words, and then a few more words.</p></article>"
    assert text("<div>Tagline</div>" + few + "<div>Contact</div>") == "Head A few words, and then a few more words."
    assert text("<div>" + LONG + "</div>" + few) == LONG + "Head A few words, and then a few more words."
    assert text("<article><p>" + LONG + "</p></article><nav>x</nav><article>Two.</article>") == LONG + "Two."


def test_short_text_behind_a_box():
    ad = "<div class='ad'>Buy " + LONG + "</div>"
    body = "<p>" + LONG + "</p>"
    assert text("<nav>Menu</nav><p>Lead.</p>" + ad + body + ad + "<p>More.</p>" + ad + "<p>The end.</p><footer>f</footer>") == (
        "Lead. " + LONG + "More. The end."
    )
    # a footer ends the text, and so do links outside any box
    assert text(body + "<footer>f</footer><p>Legal.</p>") == LONG.strip()
    assert text(body + ad + "<div><a>x</a></div>" * 3 + ad + "<p>Legal.</p>") == LONG.strip()


def test_names_that_only_contain_words_of_boxes():
    parts = [
        "<h2 id='related-work'>Related work</h2>", "<h2 id='comments'>Comments</h2>", "<p class='social history'>Social history.</p>",
        "<div class='share price'>Share price.</div>", "<p id='ad-hoc'>Ad hoc.</p>", "<p class='cookie-recipe'>Dough.</p>",
        "<pre>x <span class='hljs-comment'># note</span> <span class='comment'>y</span></pre>", "<p>a <math><mi>x</mi></math></p>",
        "<p class='menu-of-the-day'>Soup.</p>", "<div class='notice-of-appeal'>Appeal.</div>",
    ]
    want = "Related work Comments Social history. Share price. Ad hoc. Dough. x # note y a x Soup. Appeal."
    assert text("<article>" + "".join(parts) + "</article>") == want
    assert text("<p>" + LONG + "</p>" + "".join(parts[2:6])) == LONG + "Social history. Share price. Ad hoc. Dough."


def test_names_of_boxes():
    for name in (
        "ad", "ads", "top-ad", "ad-300x250", "ad_slot", "google-ads", "cookie-banner", "related-posts", "share-buttons", "social-links",
        "newsletter-signup", "reader-comments", "comment-body", "site-notice", "sidebar-left", "footer", "promo box", "col-md-4 sidebar",
        "widget widget_recent sidebar",
    ):
        for key in ("class", "id"):
            assert text(f"<article><p>One.</p><div {key}='{name}'>Box {LONG}</div><p>Two.</p></article>") == "One. Two.", (key, name)
            assert text(f"<p>{LONG}</p><div {key}='{name}'>Box {LONG}</div><footer>f</footer>") == LONG.strip(), (key, name)


def test_raw_elements():
    assert text("<article><p>a</p><xmp><b>&amp;</b></xmp><p>b</p></article>") == "a <b>&amp;</b> b"
    assert text("<article><noscript>on</noscript>a<noscript>b<p>c</p></article>") == "ab c"
    assert text("<article>a<iframe src=x>b<svg><text>t</text></svg>" + "<template>" * 5000 + "c</article>") == "abc"
    assert text("<article><svg/>a<xmp>open <i>") == "a open <i>"


def test_odd_markup():
    assert text("") == "" and text("   ") == "" and text("plain &lt;b&gt;  text") == "plain <b> text"
    assert text("<article><p>cut off in a <b>tag <a href=\"x") == 'cut off in a tag <a href="x'
    assert text("<!-- open comment <p>gone") == ""
    assert text("<article>a<p>" + "w " * 50000 + "</article>") == "a " + ("w " * 50000).strip()
    assert text("<p>1 < 2 & 3 > 2</p>") == "1 < 2 & 3 > 2"
    assert text("<script>x") == "" and text("<article><p></p></article>") == ""


def test_pages_like_those_given():
    r = random.Random(2)
    for k in range(100):
        paragraphs = [html.escape(prose(k * 100 + j, r.choice([1, 2, 30, 200])) + r.choice(["", " <&> é"])) for j in range(r.randrange(1, 8))]
        page = "<html><head><title>x</title></head><body><nav><ul><li><a href='/a'>a</a></li></ul></nav><!-- ad --><div class=\"ad\">Ad text.</div><article><h1>%s</h1>%s</article><footer>&copy; f</footer>%s" % (
            paragraphs[0], "".join("<p>%s%s" % (p, r.choice(["</p>", "<br>", ""])) for p in paragraphs), r.choice(["", "</body></html>"])
        )
        want = " ".join(" ".join(html.unescape(re.sub("<br>", " ", p)).split()) for p in [paragraphs[0], *paragraphs])
        assert text(page) == want


def test_table(spark):
    rows = [(1, "u", "<article>a</article>", "x"), (1, "u", "<article>a</article>", "x"), (None, None, None, "x"), (2, "v", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_text.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, "v", "", 0)], key=str)
    assert html_text.extract(pages.limit(0)).count() == 0
